"""A small sandboxed template language, compiled to Python closures.

    {{ expression | filter }}      {% set name = expression %}      {# comment #}
    {% for item in list %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}     text the model is trained on

Expressions know strings, whole numbers, true, false, none, names, ``a.key`` and ``a["key"]`` on mappings and ``a[0]``
on lists, ``+ ~ == != < > <= >= in not and or`` and filters. ``loop.index``, ``index0``, ``first`` and ``last`` exist
inside a loop. There are no calls and no access to Python attributes, and loops run over given
lists only, so a template can neither reach out nor run on. A ``-`` inside a tag's border strips white space.

Templates go through a syntax tree: constants are folded, branches on constants resolved and
neighbouring texts joined; what is left becomes one closure per node.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

CONTROL = ("<|im_start|>", "<|im_end|>")


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Reversible; the result holds no ``<|``, so no control string either."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """Like ``escape``, on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "in": lambda a, b: a in b, "+": operator.add, "~": lambda a, b: f"{a}{b}",
}


# --- syntax tree -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A filter, an operator, or a logical connective, by name."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -----------------------------------------------------------------------------------------
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()]))""")
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if not self.peek(*values):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value} expected")

    def whole(self) -> Any:
        found = self.disjunction()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]}")
        return found

    def disjunction(self) -> Any:
        left = self.conjunction()
        while self.take("or"):
            left = Apply("or", (left, self.conjunction()))
        return left

    def conjunction(self) -> Any:
        left = self.negation()
        while self.take("and"):
            left = Apply("and", (left, self.negation()))
        return left

    def negation(self) -> Any:
        return Apply("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        left = self.addition()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            left = Apply(op, (left, self.addition()))
        return left

    def addition(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Apply(op, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        value = self.access()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            value = Apply(name, (value,))
        return value

    def access(self) -> Any:
        value = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                kind, name = self.next()
                if kind != "name":
                    raise TemplateError("a name is expected after a point")
                value = Item(value, Const(name))
            else:
                value = Item(value, self.disjunction())
                self.need("]")
        return value

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self) -> Any:
        kind, value = self.next()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            return Const(_LITERALS[value]) if value in _LITERALS else Name(value)
        if value == "(":
            found = self.disjunction()
            self.need(")")
            return found
        raise TemplateError(f"unexpected {value}")


def _pieces(source: str) -> list[tuple[str, str]]:
    """Texts, outputs and tags in order, white space control applied."""
    pieces, at, strip = [], 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if strip:
            text = text.lstrip()
        if m and m[0].startswith("-", 2):
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if m:
            strip, at = m[0][:-2].endswith("-"), m.end()
            if m[1] is not None:
                pieces.append(("out", m[1].strip().removesuffix("-")))
            elif m[2] is not None:
                pieces.append(("tag", m[2].strip().removesuffix("-").strip()))
    return pieces


def _body(pieces: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[tuple, str]:
    """Nodes up to a tag that begins with one of ``ends``, and that tag."""
    nodes: list[Any] = []
    while pieces:
        kind, text = pieces.pop(0)
        if kind == "text":
            nodes.append(Text(text))
            continue
        if kind == "out":
            nodes.append(Out(_Expression(text).whole()))
            continue
        word, _, rest = text.partition(" ")
        if word in ends:
            return tuple(nodes), text
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"cannot set {name.strip()!r}")
            nodes.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "for":
            name, _, over = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError(f"cannot loop with {name.strip()!r}")
            nodes.append(For(name.strip(), _Expression(over).whole(), _body(pieces, ("endfor",))[0]))
        elif word == "if":
            nodes.append(_branch(rest, pieces))
        elif word == "generation":
            nodes.append(Generation(_body(pieces, ("endgeneration",))[0]))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), ""


def _branch(test: str, pieces: list[tuple[str, str]]) -> If:
    then, end = _body(pieces, ("elif", "else", "endif"))
    if end.startswith("elif"):
        other: tuple = (_branch(end[4:], pieces),)
    elif end == "else":
        other = _body(pieces, ("endif",))[0]
    else:
        other = ()
    return If(_Expression(test).whole(), then, other)


# --- folding -----------------------------------------------------------------------------------------
def _apply(name: str, args: list[Any]) -> Any:
    if name == "not":
        return not args[0]
    return FILTERS[name](args[0]) if name in FILTERS else _BINARY[name](*args)


def fold(x: Any) -> Any:
    """The expression with its constant parts worked out."""
    if isinstance(x, Item):
        return Item(fold(x.of), fold(x.key))
    if not isinstance(x, Apply):
        return x
    args = tuple(fold(a) for a in x.args)
    if x.name in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.name == "and") else args[0]
    elif all(isinstance(a, Const) for a in args):
        return Const(_apply(x.name, [a.value for a in args]))
    return Apply(x.name, args)


def fold_body(nodes: tuple) -> tuple:
    """Nodes with constants folded, known branches taken and neighbouring texts joined."""
    out: list[Any] = []
    for x in nodes:
        if isinstance(x, Out):
            value = fold(x.value)
            new: tuple = (Text(_shown(value.value)),) if isinstance(value, Const) else (Out(value),)
        elif isinstance(x, Set):
            new = (Set(x.name, fold(x.value)),)
        elif isinstance(x, For):
            new = (For(x.name, fold(x.over), fold_body(x.body)),)
        elif isinstance(x, If):
            test, then, other = fold(x.test), fold_body(x.then), fold_body(x.other)
            new = (then if test.value else other) if isinstance(test, Const) else (If(test, then, other),)
        elif isinstance(x, Generation):
            new = (Generation(fold_body(x.body)),)
        else:
            new = (x,)
        for y in new:
            if isinstance(y, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + y.text)
            elif not (isinstance(y, Text) and not y.text):
                out.append(y)
    return tuple(out)


# --- closures ----------------------------------------------------------------------------------------
@dataclass
class _State:
    names: dict[str, Any]
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"{type(of).__name__} has no items of this kind")


def _value(x: Any) -> Callable[[_State], Any]:
    if isinstance(x, Const):
        return lambda s, v=x.value: v
    if isinstance(x, Name):
        return lambda s, n=x.name: s.names.get(n)
    if isinstance(x, Item):
        of, key = _value(x.of), _value(x.key)
        return lambda s: _item(of(s), key(s))
    first, *more = map(_value, x.args)
    if x.name == "and":
        return lambda s: first(s) and more[0](s)
    if x.name == "or":
        return lambda s: first(s) or more[0](s)
    if x.name == "not":
        return lambda s: not first(s)
    if x.name in FILTERS:
        return lambda s, f=FILTERS[x.name]: f(first(s))
    return lambda s, f=_BINARY[x.name]: f(first(s), more[0](s))


def _steps(nodes: tuple) -> Callable[[_State], None]:
    steps = [_step(x) for x in nodes]

    def run(s: _State) -> None:
        for step in steps:
            step(s)

    return run


def _step(x: Any) -> Callable[[_State], None]:
    if isinstance(x, Text):
        return lambda s, t=x.text: s.put(t)
    if isinstance(x, Out):
        value = _value(x.value)
        return lambda s: s.put(_shown(value(s)))
    if isinstance(x, Set):
        value = _value(x.value)
        return lambda s: s.names.__setitem__(x.name, value(s))
    if isinstance(x, If):
        test, then, other = _value(x.test), _steps(x.then), _steps(x.other)
        return lambda s: then(s) if test(s) else other(s)
    if isinstance(x, Generation):
        inner = _steps(x.body)

        def marked(s: _State) -> None:
            start = s.size
            inner(s)
            s.spans.append((start, s.size))

        return marked
    over, body = _value(x.over), _steps(x.body)

    def loop(s: _State) -> None:
        items = over(s)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("only lists can be looped over")
        before = {n: s.names.get(n) for n in (x.name, "loop")}
        for i, item in enumerate(items):
            s.names[x.name] = item
            s.names["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}
            body(s)
        s.names.update(before)

    return loop


def parse(source: str) -> tuple:
    return fold_body(_body(_pieces(source), ())[0])


def compile_template(source: str) -> Callable[[dict[str, Any]], tuple[str, list[tuple[int, int]]]]:
    """A function from names to the text and the code point spans under generation markers."""
    run = _steps(parse(source))

    def render(names: dict[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        s = _State(dict(names))
        run(s)
        return "".join(s.parts), s.spans

    return render
