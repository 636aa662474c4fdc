"""Paragraph grouping, merging and fitting against plain Python twins."""

import random
import re

from pyspark.sql import functions as F

from chalkstream import params as P
from chalkstream.operators import gates as G
from chalkstream.operators import joins as J
from chalkstream.operators import layout as L
from chalkstream.operators import transforms as X

W, H = 600.0, 800.0
TEXTS = [
    "기본원리 1: 선택", "선택에는 대가가 있다.", "무엇을 하는지에", "관한 기본원리 네 가지", "→", "a. 첫째 항목", "둘째 내용", "- 글머리 항목", "이어지는 내용", "short",
    "사람들은 어떻게 하는가?", "그리고 나서 이것은 아주 긴 문장으로 이어진다", "고 말했다", "■", "lower case text",
]


def make_lines(seed, pages=25):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        y = 20.0
        for pos in range(rng.randint(1, 14)):
            y += rng.choice([8, 14, 18, 24, 40, 60])
            x = rng.choice([50.0, 60.0, 85.0, 140.0])
            rows.append((page, pos, rng.choice(TEXTS), x, y, x + 300, y + 12, rng.choice([9.0, 12.0, 13.0, 16.0, 24.0]), rng.choice([0, 0, 1]),
                         rng.choice([0, 0, 1]), rng.random() < 0.2))
    return rows


SCHEMA = "page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, size double, color int, block_idx int, has_bullet boolean"


def twin(lines):
    """Group numbers by the rules in words: symbols alone; labels, principles and options open a group;
    a section opens one unless it continues; else gap, indent, size, colour and sentence end decide."""
    connectors = set(G.P.CONNECTORS)
    starts = set(G.P.CONTINUATION_STARTS)

    def symbol(t):
        return t.strip() in connectors or not re.search(r"[a-zA-Z0-9가-힯]", t)

    def principle(t):
        return bool(re.search(r"^(기본원리|원리|원칙)\s*\d+|^[Bb]asic\s+[Pp]rinciple\s*\d+|^[Pp]rinciple\s*\d+", t.strip()))

    def option(t):
        return bool(re.match(r"^([a-dA-D][.)]|[1-9]\)|\(?[가나다라마바사아][.)])", t.strip()))

    def section(t):
        t = t.strip()
        m = re.search("관련된|관한|관하여", t)
        return bool(m and len(t[m.end():].strip()) >= 5 and not principle(t)) or (t.endswith("?") and len(t) < 50)

    def continues(t, prev):
        t = t.lstrip()
        if t[0].islower() or t[0] in starts:
            return True
        return bool(re.search("(지에|과|와|야)$", prev.rstrip())) and bool(re.search(G.P.CONTINUATION_WORDS, t))

    def diagram(r):
        return len(r["text"].strip()) <= 20 and r["size"] <= 14 and r["role"] in ("body", "caption") and 0.15 <= r["y0"] / H <= 0.85

    out, group, no, head = {}, None, 0, None
    for r in sorted(lines, key=lambda r: (r["y0"], r["x0"], r["pos"])):
        t = r["text"]
        if symbol(t):
            no += 1
            out[r["pos"]] = no
            group = None
            continue
        new = True
        if group is not None:
            p = group[-1]
            end = p["text"].rstrip()[-1] in ".!?。？！"
            gap = r["y0"] - p["y1"]
            close = -5 < gap < p["size"] * 1.2 * 1.8
            dx = r["x0"] - p["x0"]
            size, color = abs(r["size"] - p["size"]) < 2, r["color"] == p["color"]
            if diagram(r) or head["diagram"] or principle(t) or option(t):
                new = True
            elif section(t):
                new = not continues(t, p["text"])
            elif head["option"] and not end and close:
                new = False
            elif r["role"] in ("title", "heading"):
                new = not (not end and close and size)
            elif r["has_bullet"] or t.startswith("- "):
                new = True
            elif head["bullet"] and not end and close and size:
                new = False
            elif r["block_idx"] == p["block_idx"] and close and (abs(dx) < 30 or 0 < dx < 100):
                new = not (size and color and (not end or continues(t, p["text"])))
            elif close and 0 < dx < 100 and not end:
                new = not (size and color)
        if new:
            no += 1
            group = [r]
            head = {"diagram": diagram(r), "option": option(t), "bullet": r["has_bullet"] or t.startswith("- ")}
        else:
            group.append(r)
        out[r["pos"]] = no
    return out


def test_group_lines(spark):
    for seed in (1, 2):
        df = spark.createDataFrame(make_lines(seed), SCHEMA).withColumns({"page_width": F.lit(W), "page_height": F.lit(H)})
        df = G.line_role(df)
        rows = [r.asDict() for r in df.collect()]
        want = {(p, pos): n for p in {r["page"] for r in rows} for pos, n in twin([r for r in rows if r["page"] == p]).items()}
        got = {(r.page, r.pos): r.group_no for r in L.group_lines(df, ["page"], ["pos"]).collect()}
        assert got == want
        assert max(want.values()) > 3 and len(set(want.values())) < len(want)
        spark.conf.set("spark.chalkstream.rowsPerTask", "5")
        try:
            again = {(r.page, r.pos): r.group_no for r in L.group_lines(df, ["page"], ["pos"]).collect()}
        finally:
            spark.conf.unset("spark.chalkstream.rowsPerTask")
        assert again == want


def test_paragraphs(spark):
    rows = [
        (0, 0, "선택의 비용은", 50.0, 400.0, 350.0, 412.0, 16.0, 0, 0, False), (0, 1, "포기한 것이다.", 55.0, 420.0, 300.0, 432.0, 16.0, 0, 0, False),
        (0, 2, "⇒", 50.0, 450.0, 70.0, 462.0, 16.0, 1, 1, False),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"page_width": F.lit(2000.0), "page_height": F.lit(H), "font": F.lit("f")})
    got = L.paragraphs(G.line_role(df), ["page"], ["pos"]).orderBy("group_no").collect()
    assert [(g.text, g.role, g.n_lines, g.x0, g.y0, g.x1, g.y1) for g in got] == [
        ("선택의 비용은 포기한 것이다.", "body", 2, 50.0, 400.0, 350.0, 432.0), ("⇒", "symbol", 1, 50.0, 450.0, 70.0, 462.0)
    ]


def test_merge_adjacent(spark):
    rng = random.Random(3)
    texts = ["이것은 매우", "긴 문장으로", "끝났습니다.", "항목입니다", "• 새 항목", "2. 번호", "NASA", "Q1 질문", "계속되는", "짧은 (설명)"]
    rows = []
    for page in range(40):
        y = 0.0
        for pos in range(rng.randint(1, 9)):
            y += rng.choice([10.0, 12.0, 22.0, 31.0, 45.0])
            x = rng.choice([10.0, 40.0, 59.0, 70.0])
            rows.append((page, pos, rng.choice(texts), x, y, x + 100, y + 10, rng.random(), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, skip_translate boolean")

    def unfinished(text):
        """The rules written out on the whole text: what closes it, then what it is."""
        text = text.strip()
        closed = not text or text[-1] in ".?!。)）]】" or re.search(P.FINISHED_ENDINGS, text) or not re.search(f"[{P.HANGUL}]$", text)
        return not (closed or re.match(r"[QA]\d", text) or re.fullmatch(r"\d+[.)]\s*.{1,15}", text))

    want = []
    for page in range(40):
        cur = None
        for _, pos, t, x0, y0, x1, y1, c, skip in sorted((r for r in rows if r[0] == page), key=lambda r: (r[4], r[3], r[1])):
            bad = re.match(r"^[•●▶☐◦○■□※★☆◆◇→⇒✓✔▼▲\-]|^\d+[.)]\s+|^[QA]\d+|^\d{2}\s+[가-힣A-Z]", t.strip())
            if cur and 0 <= y0 - cur["y1"] <= 20 and abs(x0 - cur["x0"]) < 50 and unfinished(cur["t"]) and not bad and not cur["skip"] and not skip:
                cur.update(t=cur["t"].rstrip() + " " + t.lstrip(), x0=min(x0, cur["x0"]), x1=max(x1, cur["x1"]), y1=y1, c=min(c, cur["c"]))
            else:
                if cur:
                    want.append((page, cur["t"], cur["x0"], cur["y0"], cur["x1"], cur["y1"], cur["c"]))
                cur = dict(t=t, x0=x0, y0=y0, x1=x1, y1=y1, c=c, skip=skip)
        want.append((page, cur["t"], cur["x0"], cur["y0"], cur["x1"], cur["y1"], cur["c"]))
    got = [(r.page, r.text, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in L.merge_adjacent(df, ["page"], ["pos"]).collect()]
    assert sorted(got) == sorted(want)
    assert len(want) < len(rows)


def test_merge_groups(spark):
    rows = [("d", 1, 0, "p1_b0", [1, 2]), ("d", 1, 1, "p1_b1", [3]), ("d", 1, 2, "p1_b2", []), ("d", 1, 3, "p1_b3", [0, 4, 9]), ("d", 1, 4, "p1_b4", None),
            ("d", 2, 0, "p2_b0", [0]), ("d", 2, 1, "p2_b1", [0])]
    df = spark.createDataFrame(rows, "doc string, page int, pos int, block_id string, merge_with array<int>")
    got = sorted((r.page, r.group_no, r.member_no, r.block_id) for r in L.merge_groups(df, ["doc", "page"]).collect())
    assert got == [(1, 1, 1, "p1_b0"), (1, 1, 2, "p1_b1"), (1, 1, 3, "p1_b2"), (1, 2, 1, "p1_b3"), (1, 2, 2, "p1_b4")]


def test_merge_groups_on_a_long_page(spark):
    rows = [(1, i, f"p1_b{i}", [i + 1] if i % 2 == 0 else []) for i in range(66)] + [(1, 66, "x", [0, 0]), (2, 0, "p2_b0", [5])]
    df = spark.createDataFrame(rows, "page int, pos int, block_id string, merge_with array<int>")
    got = [(r.page, r.group_no, r.block_id) for r in L.merge_groups(df, ["page"]).orderBy("group_no", "member_no").collect()]
    assert got == [(1, i // 2 + 1, f"p1_b{i}") for i in range(66)]


def test_fit(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        x0, y0 = rng.uniform(0, 400), rng.uniform(0, 600)
        rows.append((i, " ".join("x" * rng.randint(1, 14) for _ in range(rng.randint(1, 25))), x0, y0, x0 + rng.uniform(20, 200), y0 + rng.uniform(8, 60),
                     rng.choice([5.0, 9.0, 12.0, 24.0]), rng.choice(["title", "body", "bullet", "caption", "footer", "other"]), rng.random() < 0.7))
    df = spark.createDataFrame(rows, "id int, text string, x0 double, y0 double, x1 double, y1 double, size double, role string, expand_allowed boolean")
    df = df.withColumns({"page_width": F.lit(W), "page_height": F.lit(H)})

    def lines(text, size, width):
        cw, n, cur = size * 0.65, 0, 0
        for w in map(len, text.split()):
            longer = cur + (1 if cur else 0) + w
            if longer * cw <= width:
                cur = longer
                continue
            n += 1 if cur else 0
            if w * cw > width:
                n, cur = n + 1, 0
            else:
                cur = w
        return n + (1 if cur else 0)

    def want(r):
        _, text, x0, y0, x1, y1, size, role, grow = r
        low = G.P.MIN_FONT_SIZE.get(role, 5.0)
        right, down = G.P.EXPAND_RATIO.get(role, (0.7, 0.5))
        mr, mb = min(x1 + (x1 - x0) * right, W - 10), min(y1 + (y1 - y0) * down, H - 10)
        sizes, s = [], size
        while s >= low:
            sizes.append(s)
            s *= 0.9
        if not sizes or sizes[-1] > low:
            sizes.append(low)
        for no, (bx, by) in enumerate([(x1, y1), (mr, y1), (mr, mb)] if grow else [(x1, y1)]):
            for s in sizes:
                spare = (by - y0) - lines(text, s, bx - x0) * s * 1.3
                if spare >= 0:
                    return True, no, round(s, 6), round(spare, 4)
        return False, 2 if grow else 0, low, -1.0

    got = {r.id: (r.fits, r.fit_box, round(r.fit_size, 6), round(r.fit_spare, 4)) for r in X.fit_audit(df).collect()}
    assert got == {r[0]: want(r) for r in rows}
    assert {v[:2] for v in got.values()} >= {(True, 0), (False, 0), (False, 2)}


def test_neighbours_on_a_crowded_page(spark):
    rng = random.Random(4)
    rows = [(0, i, float(x := rng.randint(0, 300)), float(y := rng.randint(0, 300)), x + float(rng.randint(5, 60)), y + 10.0) for i in range(250)]
    rows += [(1, i, 1000.0 * i, 0.0, 1000.0 * i + 20, 10.0) for i in range(20)] + [(2, i, 5.0, 5.0, 25.0, 15.0) for i in range(10)]
    df = spark.createDataFrame(rows, "page int, pos int, x0 double, y0 double, x1 double, y1 double")
    boxes = {(r[0], *r[2:]) for r in rows}

    def center(b):
        return (b[1] + b[3]) / 2, (b[2] + b[4]) / 2

    near = {b for b in boxes for o in boxes if b[0] == o[0] and b != o
            and ((center(b)[0] - center(o)[0]) ** 2 + (center(b)[1] - center(o)[1]) ** 2) ** 0.5 < 12}
    assert {tuple(r) for r in J.near_boxes(df, ["page"], 12.0).select("page", "x0", "y0", "x1", "y1").collect()} == near
    assert 0 < len(near) < len(boxes)

    def aligned(b, o, t=4):
        _, x0, y0, x1, y1 = b
        _, ox0, oy0, ox1, oy1 = o
        row = (abs(y0 - oy0) < t or abs(y1 - oy1) < t) and (abs(x1 - ox0) < 2 * t or abs(ox1 - x0) < 2 * t)
        return row or (abs(x0 - ox0) < t and (abs(y1 - oy0) < 3 * t or abs(oy1 - y0) < 3 * t))

    want = {b for b in boxes for o in boxes if b[0] == o[0] and b != o and aligned(b, o)}
    assert {tuple(r) for r in J.aligned_boxes(df, ["page"], 4.0).select("page", "x0", "y0", "x1", "y1").collect()} == want
    assert 0 < len(want) < len(boxes)
