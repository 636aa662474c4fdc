"""Ranked search, URL filters and the prefix trie against brute force, on ties, repeats, nulls and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from chalkstream.llm import lexical, params, prefix_trie, staging, url_filters

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def swept(spark):
    yield
    staging.release(spark)


def ranked_by_hand(docs, items, most):
    terms = [Counter(TERM.findall((t or "").translate(FOLD))) for _, t in docs]
    n_docs, total = sum(bool(c) for c in terms), sum(c.total() for c in terms)
    df = Counter(w for c in terms for w in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(docs, terms, strict=True):
            if c:
                m = 75 + 25 * c.total() * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                        for w in TERM.findall((text or "").translate(FOLD)) if c[w])
                if s > 0:
                    scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores)[:most], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    common = [f"W{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else f"rare{rng.randrange(300)}" for _ in range(rng.randint(1, 90)))) for i in range(400)]
    docs += [(900 + i, "same words for a tie, naïve Éa é") for i in range(40)] + [(900, "same words for a tie, naïve Éa é"), (None, "same tie"), (950, None), (951, ""), (952, "!? -")]
    docs.append((960, "w1 " * 400 + "rare7 " * 3))
    items = [(i, " ".join(rng.choice(common + [f"rare{rng.randrange(300)}"]) for _ in range(8))) for i in range(12)]
    items += [(50, "TIE naïve"), (51, None), (52, ""), (53, "absent"), (54, "w1 w1 rare7"), (54, "rare7"), (None, "same")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, n int")
    queries = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(params, "SEARCH_FIRST", 5)
    for most, at_once in ((20, 4096), (3, 4)):
        monkeypatch.setattr(params, "SEARCH_ITEMS", at_once)
        want = Counter(ranked_by_hand(docs, items, most))
        assert Counter(tuple(r) for r in lexical.rank(df, queries, most).collect()) == want
    assert lexical.rank(df.limit(0), queries).count() == 0 and lexical.rank(df, queries.limit(0)).count() == 0


def test_sketches_bound_the_impacts():
    rng = random.Random(3)
    for _ in range(50):
        c = Counter(f"t{rng.randrange(200)}".encode() for _ in range(rng.randint(1, 600)))
        s = lexical.sketch(c)
        assert all(s[zlib.crc32(t) & (len(s) - 1)] >= min(n, 255) for t, n in c.items())


def judged_by_hand(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(FOLD)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("small", [True, False])
def test_urls_equal_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(params, "BROADCAST_IDS", 0)
    rules = [*params.URL_RULES, ("example.org", "/a/b", "block"), ("org", "", "block"), ("x.example.org", "/a/", "allow"), ("example.com", "/en/", "allow")]
    merged = [r for r in rules if r != ("example.com", "/en/", "allow")]  # repeated: block wins
    hosts = ["example.com", "www.Example.com", "a.www.example.com", "notexample.com", "x.example.org", "org", "net", "b..net", "example.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/x?u=/es/", "/es/1", "/fr/", "/a/b", "/a/bc/d", "/a/", "?q=/en/", "#/en/", "/" * 300]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/", "a://b://example.com/en/"]
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)] + [(None, urls[1], "r", 1), (0, urls[0], "r", 1)], "page_id long, url string, rule string, row int")
    got = Counter(tuple(r) for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == Counter((r.page_id, *judged_by_hand(r.url, merged, "allow")) for r in pages.collect())


def test_urls_odd(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filters.judge(pages, none, "block").first().verdict == "block"
    assert url_filters.judge(pages.limit(0), none).count() == 0


def trie_by_hand(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % params.TRIE_HEADS
        built[c] = said.get(c - c % params.TRIE_GROUP, [])[:h] + own[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), sum(len(p) == len(path) + 1 for p in below), leaves,
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


@pytest.mark.parametrize("tasks", ["4000000", "7"])
def test_trie_equals_brute_force(spark, tasks):
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hé", "ho", ""])) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in range(60, 75) for t in range(20)]  # one conversation many times
    rows += [(80, t, "user", str(t % 3)) for t in range(60)] + [(81, 0, None, None), (82, None, "user", "x"), (82, None, None, "x"), (None, 1, "user", "lost")]
    rows += [rows[0], (2, 5, "b", "tie"), (2, 5, "a", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    spark.conf.set("spark.chalkstream.rowsPerTask", tasks)
    try:
        found = prefix_trie.nodes(prefix_trie.share_heads(prefix_trie.turns(df), params.TRIE_GROUP, params.TRIE_HEADS)).collect()
    finally:
        spark.conf.unset("spark.chalkstream.rowsPerTask")
    assert Counter(tuple(r) for r in found) == trie_by_hand(rows)
    nothing = prefix_trie.share_heads(prefix_trie.turns(df.limit(0)), params.TRIE_GROUP, params.TRIE_HEADS)
    assert prefix_trie.nodes(nothing).count() == 0
