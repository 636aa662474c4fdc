"""One query per operator over its whole table, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import (
    chat, decontaminate, html_text, lexical, minhash, mixing, params, prefix_trie, quality_model, quality_rules, token_counts,
    token_files, toxicity, url_filters,
)
from .staging import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


WORD = r"[^\x20\x09-\x0D]+"

# Base counts per document; `base` is a table expression with doc_id, lang, source and text.
QUALITY_COUNTS_SQL = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT rid, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM g WHERE z IS NOT NULL),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM f WHERE n >= 2) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
        SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
counts AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
rated AS (
  SELECT *, n_words < {params.MIN_WORDS} OR 100 * n_repeat_words > {params.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         word_chars * 100 // nullif(n_words, 0) AS length, n_symbols * 1000 // nullif(n_words, 0) AS symbols,
         n_dup_lines * 1000 // nullif(n_words, 0) AS dup_lines, n_repeat_words * 1000 // nullif(n_words, 0) AS repeats
  FROM counts),
long AS (
  SELECT lang, source, metric, (v >> s) << s AS bucket FROM (
    SELECT lang, source, unnest(['length', 'symbols', 'dup_lines', 'repeats']) AS metric,
           unnest([length, symbols, dup_lines, repeats]) AS v,
           greatest(0, length(bin(v)) - 8) AS s
    FROM rated WHERE NOT base_failed)),
own AS (SELECT lang, source, metric, quantile_disc(bucket, [0.1, 0.5, 0.9]) AS q, count(*) AS docs
        FROM long GROUP BY ALL),
by_lang AS (SELECT lang, metric, quantile_disc(bucket, [0.1, 0.5, 0.9]) AS q, count(*) AS docs FROM long GROUP BY ALL),
over_all AS (SELECT metric, quantile_disc(bucket, [0.1, 0.5, 0.9]) AS q FROM long GROUP BY ALL),
widths AS (SELECT unnest([{", ".join(repr(k) for k in quality_rules.WIDTHS)}]) AS metric,
                  unnest([{", ".join(str(v) for v in quality_rules.WIDTHS.values())}]) AS width),
fence AS (
  SELECT o.lang, o.source, o.metric, width,
         CASE WHEN o.docs >= {params.SKETCH_MIN_DOCS} THEN o.q WHEN b.docs >= {params.SKETCH_MIN_DOCS} THEN b.q ELSE a.q END AS q
  FROM own o JOIN by_lang b ON o.lang IS NOT DISTINCT FROM b.lang AND o.metric = b.metric
  JOIN over_all a ON o.metric = a.metric JOIN widths k ON o.metric = k.metric),
limits AS (
  SELECT lang, source, max(CASE WHEN metric = 'length' THEN bottom END) AS length_min,
         {", ".join(f"max(CASE WHEN metric = '{m}' THEN top END) AS {m}_max" for m in quality_rules.WIDTHS)}
  FROM (SELECT lang, source, metric, q[2] + {params.FENCE} * greatest(q[2] - q[1], width) AS top,
               q[2] - {params.FENCE} * greatest(q[3] - q[2], width) AS bottom FROM fence) GROUP BY lang, source)"""


@query(
    "op5_quality_rules",
    f"""WITH {QUALITY_COUNTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(length BETWEEN length_min AND length_max AND symbols <= symbols_max
         AND dup_lines <= dup_lines_max AND repeats <= repeats_max, false) AS kept,
       length_max, symbols_max, dup_lines_max, repeats_max, length_min
FROM rated r LEFT JOIN limits t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source""",
)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op3_minhash_near_dedup",
    rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS ws
      FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
        ELSE list_transform(range(greatest(len(ws) - {params.SHINGLE_WORDS - 1}, 1)),
                            lambda i: list_aggregate(ws[i + 1:i + {params.SHINGLE_WORDS}], 'string_agg', ' ')) END) AS x
      FROM w),
n AS (SELECT doc_id, count(x) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT p.doc_id AS u, q.doc_id AS v, count(*) AS i FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
      WHERE 100 * i >= {params.SIMILARITY_PERCENT} * (a.n + b.n - i)),
ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN ways ON b = u)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM n JOIN reach ON a = doc_id GROUP BY doc_id, n""",
)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


_P = f"[{decontaminate.NAME}-{decontaminate.UNIT}]"
_CAPITAL = r"([^.!?\x20\x09-\x0D]) (\p{Lu})"


def _words_sql(cleaned: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({cleaned}), '{decontaminate.DROPPED}', '', 'g'), '{WORD}')"


def _template_sql(t: str) -> str:
    """Capitals are marked first, twice because matches may touch."""
    mark = "\ue003"
    for _ in range(2):
        t = rf"regexp_replace({t}, '{_CAPITAL}', '\1 {mark}\2', 'g')"
    t = rf"regexp_replace({t}, '{mark}\p{{Lu}}[\p{{L}}''’-]*', '{decontaminate.NAME}', 'g')"
    t = f"regexp_replace({t}, '{decontaminate.NUMBERS}', '{decontaminate.NUMBER}', 'g')"
    return _words_sql(rf"regexp_replace({t}, '{decontaminate.UNITS}', '{decontaminate.NUMBER}\1{decontaminate.UNIT}', 'g')")


def _open_sql(t: str) -> str:
    t = rf"regexp_replace({t}, '\p{{Lu}}[\p{{L}}''’-]*', '{decontaminate.NAME}', 'g')"
    t = f"regexp_replace({t}, '{decontaminate.NUMBERS}', '{decontaminate.NUMBER}', 'g')"
    return _words_sql(rf"regexp_replace({t}, '{decontaminate.UNITS_APART}', '{decontaminate.NUMBER}\1{decontaminate.UNIT}', 'g')")


_T = params.TEMPLATE_WINDOW


@query(
    "op7_benchmark_decontamination",
    f"""WITH
it AS (SELECT item_id, {_template_sql("coalesce(text, '')")} AS ws, {_open_sql("coalesce(text, '')")} AS os,
              {_words_sql("coalesce(text, '')")} AS vs FROM benchmark),
items AS (SELECT *, least(len(vs), {_T}) AS n FROM it WHERE len(vs) > 0),
iw AS (SELECT item_id, n, i, 'open' AS form, array_to_string(os[i + 1:i + n], ' ') AS win FROM (
         SELECT *, unnest(range(len(os) - n + 1)) AS i FROM items WHERE len(os) >= {params.MIN_ITEM_WORDS})
       WHERE len(list_filter(os[i + 1:i + n], lambda x: NOT regexp_matches(x, '{_P}'))) >= {params.MIN_LITERALS} * n
       UNION ALL
       SELECT item_id, n, i, 'plain', array_to_string(vs[i + 1:i + n], ' ') FROM (SELECT *, unnest(range(len(vs) - n + 1)) AS i FROM items)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_open_sql("coalesce(text, '')")} AS os, {_words_sql("coalesce(text, '')")} AS vs FROM documents),
dw AS (SELECT rid, n, i, unnest(['open', 'plain']) AS form,
              unnest([array_to_string(os[i + 1:i + n], ' '), array_to_string(vs[i + 1:i + n], ' ')]) AS win FROM (
         SELECT rid, n, os, vs, unnest(range(len(vs) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(vs) >= n)),
cov AS (SELECT DISTINCT rid, item_id, shift, unnest(range(i, i + n)) AS p FROM (
          SELECT rid, item_id, dw.i - iw.i AS shift, iw.i AS i, n FROM dw JOIN iw USING (n, form, win))),
w AS (SELECT cov.*, d.doc_id, len(items.vs) AS item_words, items.vs[p + 1] AS iv, d.vs[p + shift + 1] AS dv,
             regexp_matches(items.ws[p + 1], '{_P}') AS slot, regexp_matches(items.os[p + 1], '{_P}') AS open_slot
      FROM cov JOIN items USING (item_id) JOIN d USING (rid)),
v AS (SELECT rid, item_id, shift, iv, true AS torn FROM w WHERE open_slot GROUP BY ALL HAVING min(dv) <> max(dv)),
k AS (SELECT w.* FROM w LEFT JOIN v USING (rid, item_id, shift, iv) WHERE NOT (open_slot AND dv <> iv AND coalesce(torn, false))),
a AS (SELECT rid, item_id, shift, count(*) FILTER (slot) AS n_slots, count(*) FILTER (slot AND dv <> iv) AS n_changed FROM k GROUP BY ALL),
g AS (SELECT rid, doc_id, item_id, max(item_words) AS item_words, count(DISTINCT p) AS covered_words,
             max(n_slots) AS n_slots, max(n_changed) AS n_changed
      FROM k JOIN a USING (rid, item_id, shift) GROUP BY rid, doc_id, item_id)
SELECT doc_id, item_id, max(item_words)::BIGINT AS item_words, max(covered_words)::BIGINT AS covered_words,
       max(n_slots)::BIGINT AS n_slots, max(n_changed)::BIGINT AS n_changed
FROM g WHERE covered_words >= least({params.LEAK_WORDS}, item_words) GROUP BY doc_id, item_id""",
)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = len(params.MIX_WEIGHTS)


@query(
    "op6_mixing",
    f"""WITH
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {params.MIX_MOST} * sum(size)::BIGINT AS cap,
             ({list(params.MIX_WEIGHTS)})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {_W} + 1)::INT] AS weight
      FROM d GROUP BY source),
o AS (SELECT *, ({params.MIX_SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM s WINDOW before AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE,
        (SELECT min_by(level, cap::DOUBLE / weight) FROM o WHERE cap > level * weight) * weight) AS target FROM s),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN
         ('0x' || md5('{params.MIX_SEED}:' || coalesce(doc_id::VARCHAR, ''))[:13])::BIGINT::DOUBLE / {1 << 52}::DOUBLE
           < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Alone, workers have room for more cuts than as the last stage of the pipeline.
    return token_files.write_and_read(table(spark, sf_dir, "documents"), known=600_000, chars=1 << 21)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


@query(
    "op4_html_extraction",
    r"""WITH
a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(regexp_replace(h, '<br>', ' ', 'g'), '</?(?:p|h1)>')) AS x,
             unnest(range(len(string_split_regex(regexp_replace(h, '<br>', ' ', 'g'), '</?(?:p|h1)>')))) AS i FROM a),
c AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
               '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS x FROM b),
t AS (SELECT page_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS text FROM c WHERE x <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM a LEFT JOIN t USING (page_id)""",
)
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(
    "op8_chat_formatting",
    f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{chat.HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{chat.HOSTILE}'),
e AS (SELECT *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS et,
             replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n') AS er
      FROM t),
l AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
      FROM e GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       any_value(length(loss))::BIGINT AS loss_chars, any_value(sha256(loss)) AS loss_sha256,
       sum(12 + length(er) + 1 + length(et) + 10 + 1)::BIGINT AS formatted_chars
FROM e JOIN l USING (conv_id) GROUP BY conv_id""",
)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_hostile(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(rows))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(table_name: str, key: str) -> str:
    return (f"SELECT *, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term "
            f"FROM (SELECT row_number() OVER () AS {key}, * FROM {table_name})")


@query(
    "op11_lexical_search",
    f"""WITH
q AS (SELECT qid, item_id, term, count(*) AS repeats FROM ({_terms_sql("benchmark", "qid")}) GROUP BY ALL),
t AS ({_terms_sql("documents", "rid")}),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nl FROM len),
m AS (SELECT rid, 75 + (25 * n * nd) // nl AS m FROM len, whole),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole
      WHERE term IN (SELECT term FROM q) GROUP BY term, nd),
s AS (SELECT qid, item_id, rid, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= {params.SEARCH_MOST}""",
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_url_filters",
    rf"""WITH rules(h, p, v) AS (VALUES {", ".join(repr(r) for r in params.URL_RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id,
             CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
x AS (SELECT rid, page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM x JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, '{params.URL_DEFAULT}') AS verdict FROM x LEFT JOIN m USING (rid)""",
)
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(params.URL_RULES), "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules, params.URL_DEFAULT)


# Turns of rebuilt conversations; crc32 is folded over the digits of an id.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), "
    "lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"
)


@query(
    "op13_prefix_trie",
    f"""WITH
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {params.TRIE_GROUP} AS src, {_CRC.format(x="conv_id::VARCHAR")} % {params.TRIE_HEADS} AS h,
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = src AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
b AS (SELECT conv_id, row_number() OVER o AS d, strlen(text) AS size,
             md5(role || chr(10) || text) AS tid FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (SELECT conv_id, d, size, string_agg(tid, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM b
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY d, path),
e AS (SELECT d, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
      FROM (SELECT conv_id, max(d) AS d, arg_max(path, d) AS path FROM p GROUP BY conv_id) GROUP BY d, path),
k AS (SELECT n.conv_id, n.d, n.path, n.n_convs, (n.n_convs - 1) * n.size AS saved, u.conv_id AS parent_conv_id
      FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.path = n.path[:32 * (n.d - 1)]),
f AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
g AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f ON f.parent_conv_id = k.conv_id AND f.d = k.d),
a AS (SELECT path, d, saved, n_children, unnest(range(d + 1)) AS top FROM g),
s AS (SELECT top AS d, path[:32 * top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN s USING (d, path) LEFT JOIN e USING (d, path)""",
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(prefix_trie.share_heads(said, params.TRIE_GROUP, params.TRIE_HEADS))
