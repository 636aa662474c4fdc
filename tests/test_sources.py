"""Files in and out."""

import glob
import json
import os

from pyspark.sql import functions as F

from chalkstream.functions.strict_json import is_json
from chalkstream.operators import joins as J
from chalkstream.operators import responses as Rs
from chalkstream.operators import sets as S
from chalkstream.operators import transforms as X
from chalkstream.operators import windows as Wn
from chalkstream.sources import glossary as SG
from chalkstream.sources import library as SL
from chalkstream.sources import transcripts as ST

GLOSSARY = """korean,english
벡터,vector
# ===== 선형대수 =====
행렬,matrix
# plain note
"고유값, 고윳값",eigenvalue
빈칸,
벡터,VECTOR

# ===== AI =====
가,A
"""


def test_glossary_file(spark, tmp_path):
    path = str(tmp_path / "g.csv")
    open(path, "w").write(GLOSSARY)
    got = [(r.id, r.term, r.value, r.category) for r in SG.read_sectioned_glossary(spark, path).orderBy("id").collect()]
    assert got == [
        (1, "벡터", "vector", "일반"), (3, "행렬", "matrix", "선형대수"), (5, "고유값, 고윳값", "eigenvalue", "선형대수"),
        (6, "빈칸", "", "선형대수"), (7, "벡터", "VECTOR", "선형대수"), (10, "가", "A", "AI"),
    ]
    d = [(r.term, r.value) for r in SG.read_dictionary(spark, path).collect()]
    assert d == [("고유값, 고윳값", "eigenvalue"), ("벡터", "VECTOR"), ("행렬", "matrix")]
    out = str(tmp_path / "out")
    SG.write_glossary(SG.read_sectioned_glossary(spark, path), out)
    names = sorted(os.path.basename(d) for d in glob.glob(f"{out}/category_no=*"))
    assert len(glob.glob(f"{out}/category_no=1/category=*/*.csv")) >= 1
    assert names == ["category_no=1", "category_no=2", "category_no=3"]
    first = spark.read.option("header", True).csv(out).where("category_no = 1")
    assert [r.category for r in first.collect()] == ["일반"]


def test_exports(spark, tmp_path):
    rows = [("s", 0, 0.0, "가", "A", 1), ("s", 1, 10.0, "나", "B", None), ("s", 2, 20.001, "다", "C", 3), ("s", 3, 3661.5, "라", "D", None), ("t", 0, -1.0, "마", "E", 2)]
    df = spark.createDataFrame(rows, "session_id string, seq int, t_offset double, original string, translated string, page int")
    cues = {(r.session_id, r.cue_no): r.cue for r in ST.export_srt(df).collect()}
    assert cues[("s", 1)] == "1\n00:00:00,000 --> 00:00:10,000\n가\nA\n"
    assert cues[("s", 2)].startswith("2\n00:00:10,000 --> 00:00:14,000")
    assert cues[("s", 4)].split("\n")[1].startswith("01:01:01,500 --> 01:01:05,500")
    assert cues[("t", 1)].split("\n")[1] == "00:00:00,000 --> 00:00:03,000"
    lines = {(r.session_id, r.line_no): r.line for r in ST.export_txt(df).collect()}
    assert lines[("s", 0)] == "[00:00] (page 1) 가\n          → A" and lines[("s", 3)] == "[61:01] 라\n          → D"
    ST.write_export(ST.export_srt(df), str(tmp_path / "srt"), "session_id", "cue_no", "cue")
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "srt/session_id=s/*.txt"))))
    assert [line for line in text.split("\n") if line.isdigit()] == ["1", "2", "3", "4"]


def test_finalize(spark, tmp_path):
    d = tmp_path / "logs" / "session_id=s1"
    d.mkdir(parents=True)
    good = [json.dumps({"seq": i, "t_offset": i * 1.5, "original": f"o{i}", "translated": "x", "page": i}) for i in range(5)]
    (d / "a.json").write_text("\n".join([good[0], "", "{broken", good[2], good[1] + "}", good[3], good[4]]) + "\n")
    seg = ST.read_segment_logs(spark, str(tmp_path / "logs"))
    meta = spark.createDataFrame([("s1", "2024-01-01"), ("s2", "2024-01-02")], "session_id string, started_at string")
    lost = spark.createDataFrame([("s9", 0)], "session_id string, seq int").withColumns(
        {c: F.lit(None).cast(t) for c, t in seg.dtypes if c not in ("session_id", "seq")}
    ).select(seg.columns)
    out = ST.finalize_session(seg.union(lost), meta)
    got = sorted((r.session_id, r.position, r.total_segments, r.meta and r.meta.started_at, r.segment and r.segment.seq) for r in out.collect())
    assert got == [
        ("s1", 0, 4, "2024-01-01", None), *[("s1", i + 1, None, None, n) for i, n in enumerate((0, 2, 3, 4))], ("s2", 0, 0, "2024-01-02", None),
    ]
    ST.write_sessions(out, str(tmp_path / "sessions"))
    lines = [json.loads(x) for f in sorted(glob.glob(str(tmp_path / "sessions/*.json"))) for x in open(f)]
    assert [(x["session_id"], x["position"]) for x in lines] == [r[:2] for r in got]
    assert lines[1]["segment"]["original"] == "o0" and lines[0]["meta"]["started_at"] == "2024-01-01"


def test_list_and_scan(spark, tmp_path):
    meta = tmp_path / "meta"
    up, tr = tmp_path / "up", tmp_path / "tr"
    for p in (meta, up, tr):
        p.mkdir()
    (meta / "a.meta.json").write_text(json.dumps({"slide_id": "a", "filename": "A.pdf", "total_pages": 3}, indent=1))
    (meta / "b.meta.json").write_text(json.dumps({"slide_id": "b", "status": "failed"}))
    (meta / "c.meta.json").write_text("{oops")
    (up / "a.pdf").write_bytes(b"12345")
    (tr / "a_translated.pdf").write_bytes(b"1")
    got = {r.slide_id: (r.filename, r.total_pages, r.status, r.has_translated, r.file_size) for r in SL.scan_library(spark, str(meta), str(up), str(tr)).collect()}
    assert got == {"a": ("A.pdf", 3, "completed", True, 5), "b": ("b.pdf", 0, "failed", False, 0)}
    s = tmp_path / "sessions"
    s.mkdir()
    (s / "x.meta.json").write_text(json.dumps({"session_id": "x", "started_at": "2024-01-01T00:00:00Z", "total_segments": 2}, indent=2))
    (s / "y.meta.json").write_text(json.dumps({"session_id": "y", "started_at": "2024-02-01T00:00:00Z", "total_segments": 0}))
    (s / "z.meta.json").write_text("nope")
    assert [r.session_id for r in ST.list_sessions(spark, str(s)).collect()] == ["y", "x"]


def test_strict_json(spark):
    rows = ['{"a":1}', ' [1] ', "3", '{"a":1}}', '{"a":1} x', '{"a":1', "", '{"a":1}, 0', '{"a":1}{"b":2}', "[1,2]]", "{'a':1}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t string")
    assert sorted(r.id for r in df.where(is_json(F.col("t"))).collect()) == [0, 1, 2]


def test_payload(spark):
    rows = [
        (1, 'ok {"blocks": [{"idx": 0, "on_image": true}]} bye'), (2, 'x\n```json\n[{"idx": 1, "merge_with": [2]}]\n```'),
        (3, 'note {"a": {"b": 1}, "blocks": [{"idx": 2, "expand_ok": false}]} {'), (4, "none"), (5, '{"blocks": ['),
    ]
    out = Rs.layout_rows(Rs.extract_json_payload(spark.createDataFrame(rows, "id int, response string")), ["id"])
    got = {r.id: (r.idx, r.on_image, r.expand_ok, r.merge_with) for r in out.collect()}
    assert got == {1: (0, True, True, []), 2: (1, False, True, [2]), 3: (2, False, False, [])}


def test_tagged_and_numbered(spark):
    text = "[b1] (TITLE): Hello\nworld\n[b2]: - item\n[b3] (BODY): [b3] (BODY): text\n[b9]: stray\n[b2]: second\n[b4]: ???"
    asked = spark.createDataFrame([(1, f"b{i}") for i in range(1, 6)] + [(2, "b1")], "chunk int, block_id string")
    df = spark.createDataFrame([(1, text), (2, "[b1] note here: fine")], "chunk int, response string")
    got = {(r.chunk, r.block_id): r.translated for r in Rs.parse_tagged_responses(df, asked, ["chunk"]).collect()}
    assert got == {(1, "b1"): "Hello\nworld", (1, "b2"): "second", (1, "b3"): "text", (2, "b1"): "fine"}
    num = spark.createDataFrame(
        [(1, 3, "1. a\n2) \"b\"\n9: z\nnoise\n2 - c"), (2, 2, "x\n\n'y'"), (3, 2, "x"), (4, 2, "1. a\nplain")], "k int, total_lines int, response string")
    got = {(r.k, r.line_no): r.translated for r in Rs.parse_numbered_responses(num, "k").collect()}
    assert got == {(1, 1): "a", (1, 2): "c", (2, 1): "x", (2, 2): "y", (4, 1): "a"}


def test_words(spark):
    words = [("u", i, w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(["첫", "문장입니다.", "둘째", "문장."])] + [("e", 0, " ", 0.0, 1.0)]
    w = spark.createDataFrame(words, "utt_id string, pos long, word string, start double, stop double")
    s = spark.createDataFrame([("u", 0, "첫 문장입니다."), ("u", 1, "둘째 문장."), ("u", 2, "남는 것"), ("e", 0, "가")], "utt_id string, pos long, sentence string")
    c = spark.createDataFrame([("u", 1000, 5000), ("e", 50, 60)], "utt_id string, speech_start_ms long, duration_ms long")
    got = {(r.utt_id, r.pos): (r.start_ms, r.stop_ms) for r in J.align_words(w, s, c).collect()}
    assert got == {("u", 0): (1000, 1900), ("u", 1): (2000, 2900), ("u", 2): (1000, 6000), ("e", 0): (50, 110)}


def test_strokes(spark):
    ev = [
        ("b", 1, "draw_begin", "i1", "pencil", 0.0), ("b", 2, "draw_point", "i1", None, 0.1), ("b", 3, "draw_begin", "i2", "rect", 0.0),
        ("b", 4, "draw_point", "i2", None, 0.2), ("b", 5, "draw_point", "i9", None, 0.9), ("b", 6, "draw_point", "i2", None, 0.5), ("b", 7, "draw_end", "i2", None, 0.0),
        ("b", 8, "draw_end", "i1", None, 0.0), ("b", 9, "draw_erase", None, None, 0.7), ("b", 10, "draw_begin", "i3", "pencil", 0.0), ("b", 11, "draw_end", "i3", None, 0.0),
    ]
    df = spark.createDataFrame(ev, "slide string, seq int, type string, id string, tool string, x double").withColumns(
        {"page": F.lit(1), "color": F.lit("c"), "y": F.col("x")})
    got = sorted((r.seq, r.kind, r.points, r.x_first, r.x_last) for r in Wn.assemble_strokes(df, ["slide"], ["seq"]).collect())
    assert got == [(7, "rect", 2, 0.2, 0.5), (9, "erase", 1, 0.7, 0.7)]


def test_table_maintenance(spark):
    g = spark.createDataFrame([(1, "a", "A", "x"), (5, "b", "B", "y"), (7, "a", "C", "y")], "id long, term string, value string, category string")
    new = spark.createDataFrame([(0, "a", "Z", "x"), (1, "c", "C", ""), (2, "d", "D", "q"), (3, "c", "E", "r")], "pos int, term string, value string, category string")
    got = {r.id: (r.term, r.value, r.category) for r in S.glossary_insert(g, new).collect()}
    assert got[8] == ("c", "C", "일반") and got[9] == ("d", "D", "q") and len(got) == 5
    ch = spark.createDataFrame([("a", "aa", "AA", None), ("zz", "q", "q", "q")], "term string, new_term string, new_value string, new_category string")
    up = {r.id: (r.term, r.value, r.category, r.updated) for r in S.glossary_update(g, ch).collect()}
    assert up == {1: ("aa", "AA", "x", True), 5: ("b", "B", "y", False), 7: ("a", "C", "y", False)}
    assert [r.term for r in S.missing_keys(ch, g).collect()] == ["zz"]
    lib = spark.createDataFrame([("1", "old.pdf"), ("2", "keep.pdf")], "slide_id string, filename string")
    rn = spark.createDataFrame([("1", ' a/b:"c" ', 1), ("1", "  ", 2), ("2", "???", 1)], "slide_id string, new_name string, pos int")
    assert {r.slide_id: r.filename for r in S.rename_items(lib, rn).collect()} == {"1": "abc.pdf", "2": "keep.pdf"}


def test_splits(spark):
    df = spark.createDataFrame([(1, "증액 ⇒ 감소", 0.0, 70.0)], "id int, text string, x0 double, x1 double")
    got = [(r.piece, r.is_arrow, r.piece_x0, r.piece_x1) for r in X.split_arrows(df).orderBy("piece_no").collect()]
    assert got == [("증액 ", False, 0.0, 30.0), ("⇒", True, 30.0, 40.0), (" 감소", False, 40.0, 70.0)]
    p = spark.createDataFrame([(1, "one two three four five. six"), (2, "  ")], "id int, text string")
    assert [(r.id, r.phrase) for r in X.split_phrases(p).orderBy("id", "phrase_no").collect()] == [
        (1, "one two three four"), (1, "five."), (1, "six"), (2, "  ")]
    m = spark.createDataFrame([(1, "<b>x</b> <math>a</math> <math>b</math> y<br/>")], "id int, text string")
    assert X.strip_markup(m, math=True).first().plain == "x → y"
    n = spark.createDataFrame([(1, "“a” – b… ⇒ ⇔：")], "id int, text string")
    assert X.normalize_unicode(n).first().normalized == '"a" - b... -> <->:'


def test_sort_library(spark):
    from chalkstream.operators.ranking import sort_library

    df = spark.createDataFrame(
        [("1", "나.pdf", "2024-01-02", 5), ("2", "가.pdf", "2024-01-03", 9), ("3", "B.pdf", "2024-01-01", 1)],
        "slide_id string, filename string, uploaded_at string, file_size int")
    ids = lambda *a: [r.slide_id for r in sort_library(df, *a).collect()]
    assert ids() == ["2", "1", "3"] and ids("size") == ["2", "1", "3"] and ids("name") == ["3", "2", "1"]
    assert ids("name", "ko")[-2:] == ["2", "1"] or ids("name", "ko")[:2] == ["2", "1"]


def test_one_change_and_one_translation_per_key(spark):
    from chalkstream.operators import joins as J
    from chalkstream.sources import library as lib

    g = spark.createDataFrame([(1, "a", "x", "c"), (2, "b", "y", "c")], "id long, term string, value string, category string")
    ch = spark.createDataFrame([("a", "a1", "v1", "", 1), ("a", "a2", "v2", "d", 2)], "term string, new_term string, new_value string, new_category string, pos int")
    assert sorted(tuple(r) for r in S.glossary_update(g, ch).collect()) == [(1, "a2", "v2", "d", True), (2, "b", "y", "c", False)]
    blocks = spark.createDataFrame([("p1", "one"), ("p2", "two")], "block_id string, text string")
    t = spark.createDataFrame([("p1", "old", 1), ("p1", "new", 2)], "block_id string, translated string, pos int")
    assert sorted(tuple(r) for r in J.attach_translations(blocks, t).collect()) == [("p1", "one", "new"), ("p2", "two", "two")]
    assert sorted(tuple(r) for r in lib.with_translations(blocks, t).collect()) == [("p1", "one", "new"), ("p2", "two", None)]


def test_guests_keep_their_number(spark):
    from chalkstream.operators import joins as J

    moves = [(1, 7, 10, "join"), (1, 8, 20, "join"), (1, 7, 30, "leave"), (1, 9, 40, "join"), (1, 5, 50, "join")]
    moves = spark.createDataFrame(moves, "session_id int, user_id int, ts_ms long, type string")
    people = spark.createDataFrame([(5, "Kim", "ko"), (7, None, None), (8, " ", None), (9, None, "fr")], "user_id int, name string, audio_lang string")
    got = sorted((r.user_id, r.name, r.audio_lang) for r in J.participants(moves, people).collect())
    assert got == [(5, "Kim", "ko"), (8, "Guest2", "en"), (9, "Guest2", "fr")]
