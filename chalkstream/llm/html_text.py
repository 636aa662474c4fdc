"""Main text of web pages by scoring the element tree.

A page is parsed into elements; menus, page headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments are left out by tag, by role, and by class or id: a class names such a part if all its words do
(``cookieBanner``, ``share-buttons``; not ``comments-on-method``). Classes count for boxes; inside running text and on
paragraphs only those of adverts and notices do, and not for a box that holds an article or a page title.

Every block with text of its own earns points (one, one per comma, up to three for its length), lowered by the share of its
text in links, and passes them up: all to its parent, half to the next ancestor, a third to the one
after, and so on. The container with most points, again lowered by its link share, is the main one; being an article or main
element counts half as much again. What is kept beside it:

* everything in the article or main element around it, and other article elements that hold a sentence;
* where there is no such element, headings, lists and blocks beside it, and every other block that holds a sentence and is not
  mostly links, however short; otherwise only blocks with a fifth of its points.

Lists of links inside the main container stay; elsewhere they count as menus. Readers' answers below a heading of comments, or
in a box with a link to answer them, go, and so do cookie notices in a box of their own and copyright lines at
the end, unless an article holds them.

Blocks come in page order, white space inside a block is one space, character references are decoded, blocks are joined
by an empty line.

Defined results: null, empty and text-less pages give an empty text; broken and unclosed markup
closes where browsers close it; rows are taken one by one, whatever their ids; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import texts_of

# Names of elements, roles and class words.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "aside button canvas dialog embed fieldset footer form head iframe input menu nav noscript object option script "
    "select style svg template textarea title video audio".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
AD_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts consent cookie cookies gdpr newsletter promo promoted sponsor sponsored".split()
)
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond responses".split())
CLASS_WORDS = AD_WORDS | COMMENT_WORDS | frozenset(
    "banner breadcrumb breadcrumbs footer header login masthead menu modal nav navbar navigation notice notices overlay pagination "
    "pager popup recommended related share sharing sidebar signup social subscribe toolbar widget widgets".split()
)
#: Words that may stand beside those without a meaning of their own.
NEUTRAL_WORDS = frozenset(
    "area article articles bar body bottom box button buttons col column container content entry form global group head holder icon "
    "icons inner item items left line link links list main media outer page panel policy post posts primary right row secondary "
    "section side site slot text thread title top unit wrap wrapper zone".split()
)
COMMENT_HEADINGS = frozenset(
    "comment comments replies responses discussion kommentar kommentare commentaire commentaires comentario comentarios 댓글".split()
)
ANSWER_LINKS = frozenset(("reply", "antworten", "répondre", "responder", "답글"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("article", "main"))
#: An opening tag that closes an open one of the second set, unless one of the third set is met before.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Class words beside "header" that tell the header of an article from that of the page.
_OF_ARTICLE = frozenset("article content entry post story".split())
_BOXES = frozenset("article aside center dd details div dl figure header hgroup li main ol section table td ul".split())
_INLINE_TEXT = frozenset("p li td th dd dt blockquote figcaption h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl table".split())
_MENU_LINKS, _MENU_SHARE = 3, 0.8
_TEXT_SHARE = 0.5  # of the letters of a block beside the main one may be in links
_WHOLE_BONUS = 1.5
_ENOUGH = 0.2  # of the main container's worth
_NOTICE_CHARS = 400
_TOKEN_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_COOKIES = re.compile(r"\bcookies?\b", re.I)
_CONSENT = re.compile(r"\b(?:accept|agree|consent|we use|uses? cookies|by continuing|privacy policy)\b", re.I)
_COPYRIGHT = re.compile(r"(?:©|\(c\)\s|copyright\b)(?=.*(?:\d{4}|©|rights))|.*\ball rights reserved\b", re.I | re.S)
_COUNT = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"""\w[.!?…]+["'”’»)\]]*(?:\s|$)|[。！？]""")


class _Element:
    __slots__ = ("tag", "parent", "inside", "out", "points", "letters", "linked", "links", "sentence", "soft")

    def __init__(self, tag: str, parent: _Element | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.inside: list[_Element | str] = []
        self.points = 0.0
        self.letters = self.linked = self.links = 0
        self.sentence = self.soft = False  # soft: left out by class or id, unless an article or a page title is inside


def _left_out(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """By tag, role or being hidden."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value and value.lower() in ROLES:
            return True
    return False


def _class_says_out(tag: str, attrs: list[tuple[str, str | None]], in_article: bool, in_text: bool) -> bool:
    """By class or id."""
    if tag in ("body", "html") or tag in HEADINGS:
        return False
    named = [v for n, v in attrs if n in ("class", "id") and v]
    if not named:
        return False
    if tag in WHOLE:
        roles = COMMENT_WORDS
    elif tag in _BOXES:
        roles = CLASS_WORDS
    elif in_text:
        return False
    else:
        roles = AD_WORDS
    parts = [[w.lower() for w in _TOKEN_WORD.findall(token)] for value in named for token in value.split()]
    own = in_article or any(w in _OF_ARTICLE for words in parts for w in words)
    for words in parts:
        said = [w for w in words if w in roles and not (own and w == "header") and not (tag == "section" and w == "discussion")]
        if said and all(w in roles or w in NEUTRAL_WORDS or w.isdigit() or len(w) == 1 for w in words):
            return True
    return False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("html", None, False)
        self.articles = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            # A block ends an open paragraph, also through inline elements.
            closes, stop = _CLOSES.get(tag, (frozenset(), frozenset()))
            self._close_until(closes | {"p"}, stop)
        in_text = self._in_text()
        out = self.at.out or _left_out(tag, attrs, self.articles > 0) or (tag == "label" and not in_text)
        new = _Element(tag, self.at, out)
        new.soft = not out and _class_says_out(tag, attrs, self.articles > 0, in_text)
        if (tag in WHOLE or tag == "h1") and not out and not new.soft:
            up = self.at
            while up is not None and up.soft:
                up.soft, up = False, up.parent
        self.at.inside.append(new)
        if tag not in VOID:
            self.at = new
            self.articles += tag in WHOLE

    def _in_text(self) -> bool:
        """Whether the place is inside a paragraph or the like, perhaps through inline elements."""
        node = self.at
        while node.tag not in BLOCKS and node.parent is not None:
            node = node.parent
        return node.tag in _INLINE_TEXT

    def _close_until(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        node, found = self.at, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                found = node
                if node.tag != "p":
                    break
            elif node.tag in BLOCKS and not stop:
                break
            node = node.parent
        if found is not None:
            self._leave(found)

    def _leave(self, node: _Element) -> None:
        while self.at is not node:
            self.articles -= self.at.tag in WHOLE
            self.at = self.at.parent
        self.articles -= node.tag in WHOLE
        self.at = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._leave(node)
                return
            if tag not in BLOCKS and node.tag in BLOCKS:
                return  # an inline end does not close a block
            node = node.parent

    def handle_data(self, data: str) -> None:
        if not self.at.out:
            self.at.inside.append(data)


def _walk(root: _Element) -> Iterator[tuple[bool, _Element | str]]:
    """Elements when entered (True) and left (False), and texts, without recursion."""
    todo: list[tuple[bool, _Element | str]] = [(True, root)]
    while todo:
        enter, x = todo.pop()
        yield enter, x
        if enter and isinstance(x, _Element):
            todo.append((False, x))
            if not (x.out or x.soft):
                todo.extend((True, y) for y in reversed(x.inside))


def _blocks(root: _Element) -> Iterator[tuple[_Element, str, int]]:
    """Blocks of text below an element: the block element, its text and how much of it is in links."""
    parts: list[str] = []
    linked = in_link = 0
    stack = [root]
    for enter, x in _walk(root):
        if isinstance(x, str):
            parts.append(x)
            if in_link:
                linked += len("".join(x.split()))
            continue
        if x.tag == "a":
            in_link += 1 if enter else -1
        if x.tag == "br" and enter:
            parts.append(" ")
        if x.tag in BLOCKS:
            if text := " ".join("".join(parts).split()):
                yield stack[-1], text, linked
            parts, linked = [], 0
            if enter:
                stack.append(x)
            else:
                stack.pop()
    if text := " ".join("".join(parts).split()):
        yield root, text, linked


def _is_short(box: _Element) -> bool:
    size = 0
    for _, text, _ in _blocks(box):
        size += len(text)
        if size > _NOTICE_CHARS:
            return False
    return True


def _without_notices(root: _Element) -> None:
    """Leave out readers' answers below a heading of comments or with a link to answer them, and cookie notices in a box of
    their own."""
    for block, text, _ in list(_blocks(root)):
        size = len(text)
        if block.out:
            continue
        if block.tag in HEADINGS and size < 60:
            words = _COUNT.sub(" ", text.lower()).split()
            if words and len(words) <= 2 and words[-1] in COMMENT_HEADINGS and block.parent is not None:
                # The end of the box is what readers wrote.
                beside = block.parent.inside
                after = next(i for i, x in enumerate(beside) if x is block)
                for x in beside[after:]:
                    if isinstance(x, _Element):
                        x.out = True
        elif size <= _NOTICE_CHARS and _COOKIES.search(text) and _CONSENT.search(text):
            box = block if block.tag == "div" or block.parent is None else block.parent
            if box.parent is not None and box.tag in ("div", "section") and _is_short(box):
                box.out = True
    answers = []
    for enter, x in _walk(root):
        if enter and isinstance(x, _Element) and x.tag == "a":
            said = " ".join("".join(y for y in x.inside if isinstance(y, str)).split()).lower()
            if said in ANSWER_LINKS:
                answers.append(x)
    for x in answers:
        box = x.parent
        while box is not None and box.tag not in ("div", "li", "section"):
            box = box.parent
        if box is not None and box.parent is not None:
            box.out = True


def _score(root: _Element) -> list[_Element]:
    """Points, text and links of all containers; returns those with points in page order."""
    seen: dict[int, _Element] = {}
    for block, text, linked in _blocks(root):
        size = len(text)
        share = min(1.0, linked / size)
        points = (1 + text.count(",") + min(size / 100, 3)) * (1 - share)
        node = block if block.parent is None or block.tag in ("div", "section", "article", "main") else block.parent
        block.points += points if node is not block else 0
        depth, up, sentence = 1, block, _SENTENCE.search(text) is not None
        while up is not None:
            up.letters += size
            up.linked += linked
            up.sentence = up.sentence or sentence
            up = up.parent
        while node is not None:
            node.points += points / depth
            seen.setdefault(id(node), node)
            depth += 1
            node = node.parent
    for enter, x in _walk(root):
        if enter and isinstance(x, _Element) and x.tag == "a":
            up = x
            while up is not None:
                up.links += 1
                up = up.parent
    return list(seen.values())


def _worth(node: _Element) -> float:
    bonus = _WHOLE_BONUS if node.tag in WHOLE else 1.0
    return bonus * node.points * (1 - min(1.0, node.linked / max(node.letters, 1)))


def _is_menu(node: _Element) -> bool:
    """Lists and boxes that are hardly more than links."""
    return (node.tag in ("ul", "ol", "div", "section", "table") and node.links >= _MENU_LINKS
            and node.linked >= _MENU_SHARE * node.letters)


def _chosen(root: _Element, best: _Element) -> list[_Element]:
    """The main container, or the article around it, and what is kept outside, in page order."""
    zone, up = best, best.parent
    while up is not None:
        if up.tag in WHOLE:
            zone = up
        up = up.parent
    above, up = set(), zone.parent
    while up is not None:
        above.add(id(up))
        up = up.parent
    in_article = zone.tag in WHOLE
    enough = _ENOUGH * _worth(best)
    kept: list[_Element] = []
    todo: list[_Element | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.out or x.soft:
            continue
        if x is zone:
            kept.append(x)
            continue
        if id(x) in above:
            todo.extend(reversed(x.inside))
            continue
        text = x.tag in BLOCKS and x.letters and x.linked <= _TEXT_SHARE * x.letters and not _is_menu(x)
        if in_article:
            wanted = text and ((x.tag in WHOLE and x.sentence) or (x.sentence and _worth(x) >= enough))
        else:
            beside = x.parent is zone.parent and (x.tag in HEADINGS or x.tag in _LISTS or _worth(x) >= enough)
            wanted = text and (x.sentence or beside)
        if wanted:
            kept.append(x)
        elif x.sentence:
            todo.extend(reversed(x.inside))
    for node in kept:
        if node is zone:
            continue
        for enter, x in _walk(node):
            if enter and isinstance(x, _Element) and x is not node and _is_menu(x):
                x.out = True
    return kept


def _in_article(node: _Element | None) -> bool:
    while node is not None and node.tag not in WHOLE:
        node = node.parent
    return node is not None


def main_text(html: str) -> str:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    _without_notices(root)
    containers = _score(root)
    if not containers:
        return ""
    best = max(containers, key=_worth)  # the first of equals
    kept = [best] if best.parent is None else _chosen(root, best)
    blocks = [(block, text) for node in kept for block, text, _ in _blocks(node)]
    while len(blocks) > 1 and len(blocks[-1][1]) <= _NOTICE_CHARS and _COPYRIGHT.match(blocks[-1][1]) and not _in_article(blocks[-1][0]):
        blocks.pop()
    return "\n\n".join(text for _, text in blocks)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(t.as_py()) for t in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(
        pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return rows.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
