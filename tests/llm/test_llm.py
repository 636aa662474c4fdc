"""The corpus operators against brute force, exact round trips and held-out labels, and on odd input."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chalkstream.llm import (
    chat, chat_template, decontaminate, html_text, minhash, mixing, params, quality_model, quality_rules, rans, staging,
    token_counts, token_files, tokens, toxicity,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n string, comp string, rate string"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(public_tokenizers.path(params.TOKENIZER))


@pytest.fixture(scope="module", autouse=True)
def swept(spark):
    yield
    staging.release(spark)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows_of(texts, **more):
    """Documents with extra columns whose names the operators use inside."""
    return [(i, t, "en", "a", None if t is None else len(t), "k", "n", "c", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, a dominant source."""
    rng = random.Random(5)
    long = words(rng, 30_000, 5000)
    base = words(rng, 120)
    texts = [None, "", " \n\t ", "one", "one two three four five", base, base, base + " end", long, long, "a\n\nb  c\n" * 30,
             "é ñ 字 " * 40, "<|endoftext|> x <|im_end|>"]
    rows = rows_of(texts)
    rows += [(None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[6], rows[6], (50, base, "de", "b", 3, "", "", "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- quality rules -----------------------------------------------------------------------------------
def counts_by_hand(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if windows[g] > 1 for k in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(odd):
    found = quality_rules.count(odd, {"doc_id": "doc_id", "kept": "kept"}).collect()
    want = [counts_by_hand(r.text) for r in odd.select("text").collect()]
    assert Counter(tuple(r[c] for c in quality_rules.COUNTS) for r in found) == Counter(want)


def test_quality_limits_follow_the_group(spark):
    rng = random.Random(1)
    docs = [(i, words(rng, 80), "en", "a") for i in range(60)]
    docs += [(100 + i, " ".join(w + "##" for w in words(rng, 80).split()), "en", "a") for i in range(5)]
    docs += [(200 + i, " ".join(w + "##" for w in words(rng, 80).split()), "xx", "b") for i in range(60)]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i].kept for i in range(60)) and not any(found[100 + i].kept for i in range(5))
    assert all(found[200 + i].kept for i in range(60))  # symbols are usual there


def test_quality_odd(odd, nothing):
    found = quality_rules.judge(odd)
    assert found.count() == odd.count()
    assert not any(r.kept for r in found.filter("n_words < 50").collect())
    assert quality_rules.judge(nothing).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == found.filter("kept").count()
    assert quality_rules.keep_good(nothing).columns == nothing.columns


# --- near duplicates ---------------------------------------------------------------------------------
def groups_by_hand(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        x = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(fold)) if w]
        sets.append((i, {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set()))
    comp = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets}


def near_copies(rng):
    """A chain of copies around the similarity, exact copies, and a passage that all other documents share."""
    base = words(rng, 90, 10**6).split()
    texts = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = words(rng, 60, 10**6)
    texts += [words(rng, 40, 10**6) + " " + passage + " " + words(rng, 30, 10**6) for _ in range(60)]
    texts += [texts[3]] * 5 + [texts[70].upper(), texts[71] + " more"]
    return texts


def test_groups_match_brute_force(spark):
    for seed in (1, 2):
        rows = list(enumerate(near_copies(random.Random(seed))))
        found = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == groups_by_hand(rows)


def test_prefix_search_alone_finds_all(spark, monkeypatch):
    """Without first links every link has to come from the exact search."""
    monkeypatch.setattr(params, "PIVOTS", 0)
    rows = list(enumerate(near_copies(random.Random(7))))
    found = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == groups_by_hand(rows)


def test_groups_odd(odd, nothing, monkeypatch):
    found = minhash.groups(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[0].n_shingles == 0 and by_id[0].kept and by_id[3].n_shingles == 1
    assert {by_id[i].component_id for i in (5, 6, 7, 50)} == {5} and by_id[9].component_id == 8
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert minhash.groups(nothing).count() == 0
    monkeypatch.setattr(params, "BROADCAST_IDS", 0)  # everything by shuffle
    assert sorted(minhash.groups(odd).collect(), key=str) == sorted(found, key=str)
    kept = minhash.keep_first(odd)
    assert kept.columns == odd.columns and not {6, 7, 9, 50} & {r.doc_id for r in kept.collect()}


def test_keep_first_leaves_one_row_of_a_group(spark, monkeypatch):
    rng = random.Random(11)
    one, two, alone, unlike = (words(rng, 100, 10**6) for _ in range(4))
    rows = [(1, one), (1, one), (2, one), (None, one), (None, one + " more"), (None, two), (None, two), (7, alone), (7, unlike),
            (8, None), (8, ""), (9, ""), (None, None), (None, " ")]
    want = Counter([(1, one), (None, two), (7, alone), (7, unlike), (8, ""), (9, ""), (None, ""), (None, " ")])
    for bound in (params.BROADCAST_IDS, 0):
        monkeypatch.setattr(params, "BROADCAST_IDS", bound)
        df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _mark string")
        kept = minhash.keep_first(df)
        assert kept.columns == df.columns
        assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == want
    assert minhash.keep_first(df.limit(0)).count() == 0


# --- decontamination ---------------------------------------------------------------------------------
ITEM = "A farmer has 12 cows and 30 sheep near Oakville and sells 12 of them after 4 weeks for 900 dollars each. How many remain?"


def test_reparameterised_items(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "Too short"), (3, None), (4, "")], "item_id long, text string")
    other = ITEM.replace("12", "15").replace("30", "41").replace("Oakville", "Elmstead").replace("900", "7.50")
    torn = ITEM.replace("12 cows", "15 cows")  # 12 becomes both 15 and 12
    lead = "Some quiet words before it stand here and there. "
    docs = [(1, lead + ITEM), (2, lead + other + " And more."), (3, torn), (4, lead * 5), (5, None), (6, ""), (None, ITEM), (8, ITEM.upper() + " too short")]
    found = {r.doc_id: r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert set(found) == {1, 2, 3, 8, None}  # one changed 12 of two costs one word of 25; case changes nothing
    assert found[1].n_changed == 0 and (found[2].n_changed, found[2].n_slots) == (5, 8)
    assert (found[3].covered_words, found[3].n_changed) == (24, 0)
    kept = decontaminate.drop_leaking(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6}


def test_copies_in_any_case_and_short_items(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()] + [
        "Which planet has the most moons, Saturn or Jupiter?", "Bread and salt",
        "Ann buys 2 apples and 2 pears at the market and pays 4 grams of silver for each of them today"]
    cased = [f(x) for x in items for f in (str.lower, str.upper, str.title)]
    n = len(items)
    docs = cased + ["So. " + items[-1].replace("2 apples", "3 apples").replace("2 pears", "5 pears"), "bread, and", "they ate BREAD and salt."]
    found = leaking(spark, items, docs)
    assert {(3 * i + k, i) for i in range(n) for k in range(3)} <= found
    assert {(3 * n, n - 1), (3 * n + 2, n - 2)} <= found and not any(d == 3 * n + 1 for d, _ in found)


def test_leaks_odd(spark, odd, nothing, monkeypatch):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    assert decontaminate.leaks(odd, benchmark).count() == 0
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaking(odd, benchmark).columns == odd.columns
    monkeypatch.setattr(params, "BROADCAST_IDS", 0)
    more = odd.union(spark.createDataFrame([(99, "So. " + ITEM, "en", "a", 1, "", "", "", "")], odd.schema))
    assert [r.doc_id for r in decontaminate.leaks(more, benchmark).collect()] == [99]


def leaking(spark, items, docs):
    """Pairs (document, item) that leak, by their places in the lists."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), benchmark)
    return {(r.doc_id, r.item_id) for r in found.collect()}


def test_names_do_not_depend_on_their_place(spark):
    short = "What is the largest city on this island?"
    tom = "Tom has 3 apples. Tom buys 5 more. How many does Tom have?"
    ride = "A train leaves the old harbour at noon and travels for 4 hours before it stops at Elmstead again"
    docs = [
        "Question: " + short,
        "so " + short + " Nobody knows.",
        tom.replace("Tom", "Ann").replace("3", "7").replace("5", "2"),
        ride.replace(" ", "\n"),
        ride.replace(" ", "  ").replace("4", "6"),
        "Question: What was the largest city on that island?",
        tom.replace("Tom buys", "Ann buys"),
    ]
    assert leaking(spark, [short, tom, ride], docs) == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)}


def test_verbatim_copies_of_placeholders(spark):
    items = ["12 + 30 = 42, 17 + 5 = 22", "Anna, Bert, Carl, Dora, Emil and Frida", "WHICH OF THESE PLANETS IS THE LARGEST?",
             "The Old Man And The Sea By Ernest Hemingway Was Printed First In New York"]
    docs = ["Compute: " + items[0], "They are Anna, Bert, Carl, Dora,\nEmil and Frida.", "1. " + items[2], "See " + items[3] + ".",
            "Compute: 11 + 30 = 41, 17 + 9 = 26", "They are Otto, Bert, Carl, Dora, Emil and Frida.", "NONE OF THESE PLANETS IS THE LARGEST?"]
    assert leaking(spark, items, docs) == {(0, 0), (1, 1), (2, 2), (3, 3)}


# --- mixing ------------------------------------------------------------------------------------------
def test_mix_reaches_targets(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, 20), "s%d" % (0 if i % 3 else i % 7)) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.plan(df).collect()
    by, source = {}, {i: s for i, _, s in docs}
    for r in rows:
        n, t = by.get(source[r.doc_id], (0, r.target))
        by[source[r.doc_id]] = (n + r.taken, t)
        assert r.taken <= 2 * r.size
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(r.size for r in rows)) < 1
    assert all(abs(n - t) <= 0.1 * t for n, t in by.values())
    emitted = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert emitted == Counter({r.doc_id: r.taken // r.size for r in rows if r.taken})


def test_mix_odd(odd, nothing, monkeypatch):
    found = mixing.plan(odd)
    assert found.count() == odd.count() and mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    taken = sum(r.taken for r in found.collect())
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len((r.text or "").replace("\n", " ").replace("\t", " ").split()) for r in mixed.collect()) == taken
    monkeypatch.setattr(params, "BROADCAST_IDS", 0)
    assert sum(r.taken for r in mixing.plan(odd).collect()) == taken


# --- tokens ------------------------------------------------------------------------------------------
def test_cuts_equal_whole_texts(lib):
    rng = random.Random(4)
    signs = list(" \t\n\r\xa0 \x1c\x85​ ab'sÉ1²,.!́字") + ["  ", " ", " ", "of", "the", "***", "'s", "-", '"', "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    ids = tokens.IdCutter(public_tokenizers.path(params.TOKENIZER))
    found = [v for b in tokens.batched(texts, 5000) for v in ids.of_texts(b)]
    for text, got in zip(texts, found, strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_cuts_at_every_code_point(lib):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    ids = tokens.IdCutter(public_tokenizers.path(params.TOKENIZER))
    for lo in range(0, len(chars), 50_000):
        text = ".".join(f"a {c}b{c} {c} a" for c in chars[lo : lo + 50_000])
        assert ids.of_texts([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 511, 513, 9000, 300_001])
def test_codec_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True) if n else (np.array([7]), np.array([1]))
    table = rans.Table.of(seen, rans.quantise(counts))
    assert int(table.freq.sum()) == 1 << params.FREQUENCY_BITS and (table.freq > 0).all()
    block, slots = rans.encode(ids, table), rans.slot_places(table)
    assert (rans.decode(block, table, slots) == ids).all()
    parts = [rans.decode(block, table, slots, k, k + 1) for k in range(rans.segments(block))]
    assert sum(map(len, parts)) == n and (not n or (np.concatenate(parts) == ids).all())
    if n > 9000:
        bad = bytearray(block)
        bad[-40] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table, slots)


def digests_by_hand(lib, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, params.END_ID], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, lib, odd, nothing, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    found = token_files.write_and_read(docs)
    assert sorted(tuple(r) for r in found.collect()) == digests_by_hand(lib, rows)
    assert token_files.write_and_read(nothing).count() == 0
    got = token_files.write_and_read(odd).collect()
    assert len(got) == odd.count() and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert {(r.doc_id, r.n_tokens) for r in got if r.doc_id in (0, 1)} == {(0, 1), (1, 1)}


def test_token_counts(spark, lib, odd, nothing, monkeypatch):
    def want(df):
        return Counter((r.doc_id, len((r.text or "").encode()), (n := len(lib.encode(r.text or "", add_special_tokens=False).ids)), n > 1024)
                       for r in df.select("doc_id", "text").collect())

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd, nothing):
        assert Counter(tuple(r) for r in token_counts.count(df).collect()) == want(df)
    monkeypatch.setattr(params, "MERGED_AT_ONCE", 2)
    assert Counter(tuple(r) for r in token_counts.count(odd.repartition(7)).collect()) == want(odd)


# --- pages -------------------------------------------------------------------------------------------
TEXT = "Some words here, and more of them, so that this paragraph counts as one of the article. "
PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><div id='content'><h2>Title</h2><p>" + TEXT + "<p>Second&nbsp;&amp; last<br>line, " + TEXT
    + "</div><div class='comments'><p>" + TEXT * 3 + "</p></div><footer>&copy;</footer>":
        ["Title", TEXT.strip(), "Second & last line, " + TEXT.strip()],
    "<article><header><h1>T</h1></header><p>" + TEXT + "</p><aside>x</aside><ul><li>one<li>two</ul><form><p>in</p></form></article>":
        ["T", TEXT.strip(), "one", "two"],
    "<div><p>" + TEXT + "</p></div><div class='side-bar sidebar'><p>" + TEXT + "</p></div>": [TEXT.strip()],
    "plain text": ["plain text"],
    "<p>unclosed <b>bold<p>next": ["unclosed bold", "next"],
    "<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> -->": [],
    "": [],
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert html_text.main_text(html) == "\n\n".join(PAGES[html])


def test_text_outside_the_best_container():
    long = "".join(f"<p>{TEXT * 3}</p>" for _ in range(10))
    menu = "<ul><li><a href=a>Home page</a><li><a href=b>All news</a><li><a href=c>Contact us.</a></ul>"
    page = f"<div>{menu}<div><p>It began early.</p></div><div><div>{long}</div><div>Short end.</div><p>And a last word.</p></div></div>"
    found = html_text.main_text(page).split("\n\n")
    assert found == ["It began early.", *[(TEXT * 3).strip()] * 10, "Short end.", "And a last word."]


def test_link_lists_and_headers_of_articles():
    links = "<ul><li><a href=a>First source</a><li><a href=b>Second source</a><li><a href=c>Third source</a></ul>"
    want = ["The title", TEXT.strip(), "First source", "Second source", "Third source"]
    inside = f"<div class='article-header'><h1>The title</h1></div><p>{TEXT}</p>{links}<nav><a href=x>Next</a></nav>"
    assert html_text.main_text(f"<article>{inside}</article>").split("\n\n") == want
    assert html_text.main_text(f"<main>{inside.replace('article-header', 'header')}</main>").split("\n\n") == want
    assert html_text.main_text(f"<div class='header'>Site</div><div>{inside}</div>").split("\n\n") == want


LONG = "".join(f"<p>{TEXT * 2}</p>" for _ in range(4))
LONG_TEXT = [(TEXT * 2).strip()] * 4


@pytest.mark.parametrize("extra", [
    "<div class='msg'><p>We use cookies to improve this site. By continuing you accept them.</p></div>",
    "<div class='cookieBanner'>Cookies make this site better. Fine?</div>",
    "<div><b>Bob</b><p>I do not agree with the second part.</p><a href='#r'>Reply</a></div>",
    "<div id='discussion'><p>Nice read, thanks a lot.</p></div>",
    "<h3>3 Comments</h3><div><p>Nice read, thanks a lot.</p></div>",
    "<div class='share-buttons'><p>Share this story with friends.</p></div>",
])
def test_what_must_go(extra):
    for page in (f"<article>{LONG}{extra}</article>", f"<div><div>{LONG}</div>{extra}</div>", f"<div>{LONG}{extra}</div>"):
        assert html_text.main_text(page).split("\n\n") == LONG_TEXT, page


@pytest.mark.parametrize("line", ["Copyright 2021 The Paper. All rights reserved.", "&copy; 2021 The Paper", "All rights reserved."])
def test_copyright_lines(line):
    for page in (f"<article>{LONG}</article><p>{line}</p>", f"<div><div>{LONG}</div><p>{line}</p></div>", f"<div>{LONG}<p>{line}</p></div>"):
        assert html_text.main_text(page).split("\n\n") == LONG_TEXT, page
    inside = html_text.main_text(f"<article>{LONG}<p>{line}</p></article>").split("\n\n")
    assert len(inside) == 5  # a line of the article itself


@pytest.mark.parametrize("inside, text", [
    ("<p>Hello <span class='share'>there</span>.</p>", "Hello there."),
    ("<p class='related'>Related research shows more.</p>", "Related research shows more."),
    ("<p class='social'>Social history is old.</p>", "Social history is old."),
    ("<section id='comments-on-method'><p>The method is sound.</p></section>", "The method is sound."),
    ("<p>Fill in <label>the name</label> first.</p>", "Fill in the name first."),
    ("<section id='discussion'><p>The results are discussed.</p></section>", "The results are discussed."),
    ("<ul><li>one point<li>another point</ul>", "one point\n\nanother point"),
    ("<p>Cookies are baked, we use butter.</p>", "Cookies are baked, we use butter."),
])
def test_what_must_stay(inside, text):
    for page in (f"<article>{LONG}{inside}</article>", f"<div><div>{LONG}</div>{inside}</div>", f"<div>{inside}{LONG}</div>",
                 f"<div class='widget'><h1>T</h1>{inside}{LONG}</div>"):
        found = html_text.main_text(page)
        assert text in found and found.count("Some words") == 8, page


def test_points_choose_among_articles_and_boxes():
    short = "<article><p>The first of two stories.</p></article>"
    assert html_text.main_text(f"<body>{short}<article>{LONG}</article>").split("\n\n") == ["The first of two stories.", *LONG_TEXT]
    # An article element that is only a teaser does not win over the text beside it.
    teaser = "<article><p>Read on, please.</p></article>"
    assert html_text.main_text(f"<div>{teaser}</div><div>{LONG}</div>").split("\n\n")[-4:] == LONG_TEXT
    # Outside an article only what scores a fifth of it counts.
    beside = f"<div><article>{LONG}</article><div><p>One word more.</p></div><div>{LONG}</div></div>"
    assert html_text.main_text(beside).split("\n\n") == LONG_TEXT * 2


def test_deep_and_broken_pages():
    deep = "<div>" * 20_000 + TEXT + "</div>" * 20_000
    assert html_text.main_text(deep) == TEXT.strip()
    assert html_text.main_text("<p>" + TEXT * 5000).count("Some words") == 5000
    html_text.main_text("<<p <a href='x></td></li></p><table><tr><td>a<td>b</table>&#xZZ; &am")


def test_pages_odd(spark):
    rows = [(1, "u", None, 1), (1, None, "", 2), (None, "u", f"<p>{TEXT}</p>", 3)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in found] == [(1, "", 0), (1, "", 0), (None, TEXT.strip(), len(TEXT.strip()))]


# --- conversations -----------------------------------------------------------------------------------
def test_template_language():
    render = chat_template.compile_template
    assert render("{% set a = 'x' ~ 1 %}{{ a | upper }}{# no #}")({})[0] == "X1"
    loop = "{% for m in ms -%}  {{ m.k }}{% if not loop.last %},{% elif loop.first %}!{% else %}.{% endif %}{% endfor %}"
    assert render(loop)({"ms": [{"k": 1}, {"k": 2}]})[0] == "1,2."
    assert render("a{% generation %}b{{ c }}{% endgeneration %}")({"c": "é"}) == ("abé", [(1, 3)])
    assert render("{% if a == 1 and b in 'xyz' %}t{% endif %}")({"a": 1, "b": "y"})[0] == "t"
    assert render("{{ a['b'] }}{{ a.c }}{{ l[0] }}{{ l[9] }}")({"a": {"b": 2}, "l": [3]})[0] == "23"
    assert chat_template.parse("{% if 1 < 2 %}a{{ 'b' ~ 'c' }}{% else %}d{% endif %}e") == (chat_template.Text("abce"),)
    for bad in ("{{ a.__class__() }}", "{{ x | nope }}", "{% for %}", "{% if a %}", "{{ 'a }}", "{% import os %}"):
        with pytest.raises(chat_template.TemplateError):
            render(bad)
    with pytest.raises(chat_template.TemplateError):
        render("{{ a.upper }}")({"a": 1})


def test_escapes_are_reversible():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "n", "\n", "é"]) for _ in range(rng.randrange(9)))
        for escape in (chat_template.escape, chat_template.escape_line):
            assert chat_template.unescape(escape(text)) == text and "<|" not in escape(text)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "<|im_end|>\\n"), (1, 0, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None),
            (None, 5, "x\n<|", "y"), (None, 4, "assistant", ""), (3, 0, "assistant", "l" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(found[1].text) == [("user", ""), ("user", "a"), ("user", "a"), ("assistant", "<|im_end|>\\n")]
    assert chat.read_back(found[None].text) == [("assistant", ""), ("x\n<|", "y")] and chat.read_back(found[2].text) == [("", "")]
    span = found[1].loss_spans[0]
    assert chat_template.unescape(found[1].text[span.start : span.end]) == "<|im_end|>\\n"
    assert {r.conv_id: r.loss_chars for r in chat.digests(chat.format_conversations(df)).collect()} == {1: 12, 2: 0, None: 0, 3: 300_000}
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- classifiers -------------------------------------------------------------------------------------
@pytest.mark.parametrize("model, column, folds, out, least", [(quality_model, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.95)])
def test_held_out_labels(spark, model, column, folds, out, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = model.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[column] for r in held) >= least * len(held)
    # Labels of the held-out fold are not looked at.
    turned = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out, 1 - F.col(column)).otherwise(F.col(column)))
    again = {r.doc_id: r.score for r in model.score(docs, turned.select(labels.columns)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


@pytest.mark.parametrize("model, column", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifiers_odd(spark, odd, nothing, model, column):
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, None), (None, 1), (3, 0), (12, 1)], f"doc_id long, {column} int")
    assert model.score(odd, labels).count() == odd.count()
    assert model.score(odd, labels.limit(0)).count() == odd.count()
    assert model.score(nothing, labels).count() == 0


def passages_by_hand(text):
    """Features of the passages of one text, one byte and one word after the other."""
    data = text.encode() + b"\n"  # and one before it
    ws = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    kinds = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "#*$%&", "|<>",
             "\"'()[]{}:;-_", "/\\@^~`+=", "?")

    def kind(b):
        if b >= 128:
            return 15 if b < 192 else 13
        return next((i for i, chars in enumerate(kinds) if chr(b) in chars), 14)

    spelled = [data[a:b] for a, b in ws]
    triples = Counter(zip(spelled, spelled[1:], spelled[2:], strict=False))
    n, rows = params.PASSAGE_WORDS, []
    for k in range(max(1, -(-len(ws) // n))):
        if not ws:
            return [[0.0] * quality_model.WIDTH]
        mine = range(k * n, min(len(ws), (k + 1) * n))
        lo = 0 if k == 0 else ws[mine[0]][0]
        hi = ws[mine[-1] + 1][0] if mine[-1] + 1 < len(ws) else len(data)
        pairs, single = [0.0] * 256, [0.0] * 16
        for i in range(lo, hi):
            single[kind(data[i])] += 1 / (hi - lo)
            pairs[16 * kind(data[i - 1] if i else 10) + kind(data[i])] += 1 / (hi - lo)
        again = sum(triples.get(tuple(spelled[i : i + 3]), 0) > 1 for i in mine if i + 2 < len(ws))
        m = len(mine)
        rows.append([*map(math.sqrt, pairs), *single, sum(len(spelled[i]) for i in mine) / m / 10, len({spelled[i] for i in mine}) / m,
                     again / m, math.log1p(len(ws)) / 5, m / n])
    return rows


def attention_by_hand(bag, w):
    """Logit of one bag of scaled passages, number by number."""
    def product(v, m):
        return [sum(v[i] * m[i][j] for i in range(len(v))) for j in range(len(m[0]))]

    hs, raw = [], []
    for x in bag:
        h = [math.tanh(v + e) for v, e in zip(product(x, w["E"]), w["e"], strict=True)]
        gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(product(h, w["V"]), product(h, w["U"]), strict=True)]
        hs.append(h)
        raw.append(math.exp(sum(a * b for a, b in zip(gate, w["w"], strict=True))))
    z = [sum(r * h[j] for r, h in zip(raw, hs, strict=True)) / sum(raw) for j in range(len(hs[0]))]
    return sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0]


def test_quality_scores_match_brute_force():
    rng = random.Random(3)
    texts = [words(rng, 150, 40), "", "One, two. THREE!\n\n" * 30, "é ñ 字 | # 12/3" * 9, "x", " lead and trail ", words(rng, 64)]
    x, per_text = quality_model.passages(pa.array(texts, pa.large_string()), 0, len(texts))
    by_hand = [passages_by_hand(t) for t in texts]
    assert per_text.tolist() == [len(b) for b in by_hand]
    assert np.allclose(x, np.array([p for b in by_hand for p in b]), atol=1e-5)
    draw = np.random.default_rng(1)
    w = quality_model.Model.start(quality_model.WIDTH, draw)
    w["e"], w["d"] = draw.normal(size=w["e"].shape), np.array([0.3])
    model = quality_model.Model(np.full(quality_model.WIDTH, 0.1), np.full(quality_model.WIDTH, 0.7), w)
    lists = {k: v.tolist() for k, v in w.items()}
    want = [1 / (1 + math.exp(-attention_by_hand([[(v - 0.1) / 0.7 for v in p] for p in b], lists))) for b in by_hand]
    assert np.allclose(model.scores(x, per_text), want, atol=1e-5)


def slopes(f, at, eps=1e-5):
    found = np.zeros_like(at)
    for i in np.ndindex(at.shape):
        kept = at[i]
        at[i] = kept + eps
        up = f()
        at[i] = kept - eps
        found[i] = (up - f()) / (2 * eps)
        at[i] = kept
    return found


def test_quality_gradient():
    draw = np.random.default_rng(2)
    model = quality_model.Model(np.zeros(7), np.ones(7), quality_model.Model.start(7, draw))
    x, begin, labels = draw.normal(size=(9, 7)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        logit = model.forward(x, begin)[0]
        return (np.logaddexp(0, logit) - labels * logit).sum()

    logit, state = model.forward(x, begin)
    found = model.gradient(x, state, 1 / (1 + np.exp(-logit)) - labels)
    for name, weights in model.w.items():
        assert np.allclose(found[name], slopes(loss, weights), atol=1e-6), name


@pytest.mark.parametrize("prior, below", [(0.1, False), (0.9, True)])
def test_toxic_risk(prior, below):
    draw = np.random.default_rng(3)
    p, u, w, b = draw.normal(size=(5, 4)) + below, draw.normal(size=(6, 4)) - below, draw.normal(size=4) * 0.1 + below, np.array([-0.2])

    def by_hand():
        g_p, g_u = ([sum(a * c for a, c in zip(row, w, strict=True)) + b[0] for row in rows] for rows in (p, u))
        loss = lambda g: 1 / (1 + math.exp(g))
        return prior * sum(map(loss, g_p)) / 5, sum(loss(-g) for g in g_u) / 6 - prior * sum(loss(-g) for g in g_p) / 5

    known, clean, step = toxicity._risk(p, u, w, b, prior)
    assert np.allclose((known, clean), by_hand()) and (clean < 0) == below
    aim = (lambda: -by_hand()[1]) if below else (lambda: sum(by_hand()))
    assert np.allclose(step["w"], slopes(aim, w), atol=1e-6) and np.allclose(step["b"], slopes(aim, b), atol=1e-6)


def test_toxic_rates_and_scores_match_brute_force():
    texts = ["bad words and badly meant bad things", "", "Nothing HERE", "bad " * 100]
    keys = {}
    for t in texts:
        found, _, _ = toxicity._keys(pa.array([t], pa.large_string()), 0, 1)
        names = t.lower().split()
        names += [w[:n] + f"*{n}" for n in (5, 6, 7, 8) for w in t.lower().split() if len(w) > n]
        keys.update(zip(names, found.tolist(), strict=True))
    chosen = {"bad": 2.0, "things": -1.0, "nothi*5": 0.5, "here": 0.25}
    order = sorted(chosen, key=keys.__getitem__)
    model = toxicity.Model(np.array([keys[k] for k in order], np.uint64), np.array([chosen[k] for k in order]), -0.5)

    def want(t):
        ws = t.lower().split()
        held = Counter(ws) + Counter(w[:n] + f"*{n}" for n in (5, 6, 7, 8) for w in ws if len(w) > n)
        return 1 / (1 + math.exp(0.5 - sum(v * min(100 * held[k] / (len(ws) + 64), 4.0) for k, v in chosen.items())))

    assert np.allclose(model.scores(pa.array(texts, pa.large_string()), 0, 4), [want(t) for t in texts])


@pytest.mark.parametrize("model, column", [(quality_model, "quality"), (toxicity, "toxic")])
def test_repeated_training_rows_change_nothing(spark, model, column):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    again = docs.union(docs.filter("doc_id < 40")).union(docs.filter("doc_id < 40"))
    once = {r.doc_id: r.score for r in model.score(docs, labels).collect()}
    assert all(abs(once[r.doc_id] - r.score) < 1e-9 for r in model.score(again, labels).collect())


# --- pipeline ----------------------------------------------------------------------------------------
def test_pipeline_stages(spark, lib, nothing):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        rows[name] = docs = staging.stage(apply(spark, docs, SF), "test")
        assert docs.columns == columns
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in rows.items()}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(source).filter("kept").collect()}
    assert set(ids["quality rules"]) == good
    texts = {r.doc_id: r.text for r in source.collect()}
    kept = {i for i, (_, c, k) in groups_by_hand([(i, texts[i]) for i in sorted(good)]).items() if k}
    assert set(ids["near duplicates"]) == kept
    benchmark = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(b in " ".join(texts[i].split()) for b in benchmark)}
    assert set(ids["benchmark decontamination"]) == clean
    mixed = Counter(ids["source mixing"])
    assert set(mixed) <= clean and max(mixed.values()) <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = digests_by_hand(lib, sorted((i, texts[i]) for i in ids["source mixing"]))
    assert sorted(tuple(r) for r in final.collect()) == want
    assert corpus_pipeline.STAGES[0][1](spark, source.limit(0), SF).count() == 0
