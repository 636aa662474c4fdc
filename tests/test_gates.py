"""Boundary values of the gates with the default (Korean) patterns."""

from pyspark.sql import functions as F

from chalkstream.operators import gates as G
from chalkstream.operators import terms as TM
from chalkstream.operators import transforms as X


def reasons(df, key="id"):
    return {r[key]: r["reason"] for r in df.collect()}


def test_asr_segments(spark):
    rows = [
        (1, "정상 문장입니다", 2.4, 0.4, -0.8), (2, "정상", 2.41, 0.0, 0.0), (3, "정상", 1.0, 0.41, 0.0), (4, "정상", 1.0, 0.0, -0.81),
        (5, "Please SUBSCRIBE now", 1.0, 0.0, 0.0), (6, "감사합니다.", 1.0, 0.2, -0.4), (7, "감사합니다.", 1.0, 0.21, 0.0),
        (8, "감사합니다.", 1.0, 0.0, -0.41), (9, "다음 영상에서 만나요", 1.0, 0.0, 0.0), (10, "다음 시간에는 미적분", 1.0, 0.3, 0.0),
    ]
    df = spark.createDataFrame(rows, "id int, text string, compression_ratio double, no_speech_prob double, avg_logprob double")
    assert reasons(G.gate_asr_segments(df)) == {
        1: None, 2: "compression", 3: "no_speech", 4: "logprob", 5: "stock_phrase", 6: None, 7: "courtesy", 8: "courtesy",
        9: "stock_phrase", 10: None,
    }


def test_trailing(spark):
    rows = [(1, "오늘은 행렬입니다 시청해주셔서 감사합니다"), (2, "감사합니다!"), (3, "다음 시간에는 미적분")]
    got = {r.id: r.text for r in G.trim_trailing_boilerplate(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: "오늘은 행렬입니다", 3: "다음 시간에는 미적분"}


def test_utterances(spark):
    rows = [
        (1, "  "), (2, "가"), (3, "가나다라마바사아자차" * 20), (4, "가나다라마바사아자차" * 20 + "카"), (5, "네네네네"), (6, "하나둘하나둘하나둘하나둘"),
        (7, "가 나 가 나 가 나 가 나"), (8, "이것은 BERT 모델 입니다"), (9, "BERT model is good"), (10, "감사합니다…"), (11, "구독과 좋아요"),
        (12, "가 나, 다 라 마 바 사 아"),
    ]
    terms = spark.createDataFrame([("자연어", "BERT"), ("모형", "model")], "term string, value string")
    df = spark.createDataFrame(rows, "id int, text string")
    got = reasons(G.gate_utterances(df, TM.term_remover(terms)))
    assert got == {
        1: "empty", 2: "short", 3: None, 4: "long", 5: "repeated_unit", 6: "repeated_unit", 7: "repeated_words", 8: None, 9: "ascii",
        10: "courtesy", 11: "stock_phrase", 12: None,
    }


def test_mt(spark):
    df = spark.createDataFrame([(1, "어"), (2, "12. 3"), (3, "가나그그그그"), (4, "ab가"), (5, "가나다")], "id int, text string")
    assert reasons(G.gate_mt_input(df)) == {1: "short", 2: "digits_only", 3: "repeated_char", 4: "script", 5: None}
    out = spark.createDataFrame(
        [(1, "yes yes yes yes"), (2, "감사합니다 ok"), (3, "BERT는 양방향 인코더"), (4, "Subtitles by Amara.org"), (5, "Thank you!"),
         (6, "thank you for asking"), (7, "yes yes yes no"), (8, "WEBVTT x"), (9, "www.mbc.co.kr")], "id int, text string")
    assert reasons(G.gate_mt_output(out, ["BERT"])) == {
        1: "loop", 2: "untranslated", 3: None, 4: "stock_phrase", 5: "stock_phrase", 6: None, 7: None, 8: "stock_phrase", 9: "stock_phrase",
    }


def test_translations(spark):
    df = spark.createDataFrame(
        [(1, ""), (2, "?! ."), (3, "[x]"), (4, "Untranslatable"), (5, "N/A"), (6, "--"), (7, "abcdefg가나다"), (8, "abcdef가나다"),
         (9, "alpha α"), (10, "fine"), (11, None)], "id int, text string")
    assert reasons(G.gate_translations(df)) == {
        1: "blank", 2: "punctuation", 3: "placeholder", 4: "placeholder", 5: "placeholder", 6: "no_letters", 7: None, 8: "source_share",
        9: "foreign_script", 10: None, 11: "blank",
    }
    loose = reasons(G.gate_translations(df, strict=False))
    assert loose[8] is None and loose[9] is None


def test_render(spark):
    df = spark.createDataFrame([(1, "what??"), (2, "device?OS"), (3, "see p3_b4"), (4, "ok 가"), (5, "ok?"), (6, "")], "id int, text string")
    got = reasons(G.gate_render(df))
    assert got[1].startswith("matched_pattern") and got[2].startswith("matched_pattern") and got[3].startswith("matched_pattern")
    assert got[4] == "korean_remaining_in_english" and got[5] is None and got[6] == "empty_text"


def test_regions(spark):
    df = spark.createDataFrame(
        [(1, "abc 123"), (2, "가 a@b.co"), (3, "a@b.co"), (4, r"\frac 1"), (5, "printf (x) é"), (6, "가"), (7, "赤些"), (8, "赤abcd"), (9, "赤赤abc"),
         (10, "赤abcdef"), (11, "1 + 2 = 3")], "id int, text string")
    got = {r.id: r for r in G.flag_regions(df).collect()}
    assert got[1].number_or_latin and not got[2].passthrough and got[3].passthrough and got[4].has_math and got[5].is_code
    assert got[6].is_single_char and not got[6].skip_translate
    assert got[7].is_misread and not got[8].is_misread and got[9].is_misread and not got[10].is_misread and got[11].passthrough


def test_lines_and_search(spark):
    df = spark.createDataFrame(
        [(1, "가나", 0.0, 0.0, 10.0, 10.0), (2, "→", 0.0, 0.0, 10.0, 10.0), (3, "abc", 0.0, 0.0, 10.0, 10.0), (4, "ㄱㄴㄷㄹ가", 0.0, 0.0, 10.0, 10.0),
         (5, "가", 0.0, 0.0, 4.0, 10.0), (6, "가", -1.0, 0.0, 9.0, 10.0), (7, "가", 0.0, 0.0, 111.0, 10.0), (8, "가", 0.0, 0.0, 110.0, 10.0)],
        "id int, text string, x0 double, y0 double, x1 double, y1 double",
    ).withColumns({"page_width": F.lit(100.0), "page_height": F.lit(100.0)})
    assert sorted(r.id for r in G.filter_text_lines(df).collect()) == [1, 2, 8]
    g = spark.createDataFrame([("Matrix", "행렬", "a"), ("vector", "벡터", "b")], "term string, value string, category string")
    assert G.search(g, ["term", "value"], "MAT").count() == 1 and G.search(g, ["term"], "  ").count() == 2
    assert G.search(g, ["term", "value"], "벡", "a").count() == 0


def test_patterns(spark):
    df = spark.createDataFrame(
        [("p", 1, "무엇을 선택하는지에"), ("p", 2, "관한 기본원리 네 가지"), ("p", 3, "기본원리 1: 모든"), ("p", 4, "a. 첫째"), ("p", 5, "어떻게 하는가?")],
        "page string, pos int, text string",
    ).withColumns({"size": F.lit(18.0), "role": F.lit("body"), "y0": F.lit(50.0), "page_height": F.lit(100.0)})
    got = {r.pos: r for r in G.tag_line_patterns(df, ["page"], ["pos"]).collect()}
    assert got[2].is_continuation and got[2].is_section and got[3].is_principle and got[4].is_option and got[5].is_section


def test_prefix(spark):
    df = spark.createDataFrame(
        [(1, "• 항목"), (2, "☐할일"), (3, "-값"), (4, "- 값"), (5, "✅ 완료"), (6, "✅"), (7, "본문"), (8, "•")], "id int, text string")
    got = {r.id: (r.prefix, r.content, r.prefix_policy) for r in X.split_prefix(df).collect()}
    assert got == {
        1: ("• ", "항목", "render"), 2: ("☐ ", "할일", "preserve"), 3: ("", "-값", "none"), 4: ("- ", "값", "render"),
        5: ("✅ ", "완료", "preserve"), 6: ("", "✅", "none"), 7: ("", "본문", "none"), 8: ("• ", "", "render"),
    }
    back = spark.createDataFrame([(1, "• ", "- item"), (2, "", " x"), (3, "☐ ", "✅done")], "id int, prefix string, translated string")
    assert {r.id: r.restored for r in X.restore_prefix(back).collect()} == {1: "• item", 2: " x", 3: "☐ done"}


def test_vertical(spark):
    df = spark.createDataFrame([(1, "세로글", 0.0, 0.0, 20.0, 51.0), (2, "세로글", 0.0, 0.0, 20.0, 50.0), (3, "세abc", 0.0, 0.0, 20.0, 90.0)],
                               "id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.render_skip for r in G.flag_vertical_regions(df).collect()} == {1: True, 2: False, 3: False}
