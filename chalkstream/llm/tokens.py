"""Token ids and counts by a public tokenizer, with what repeats looked up instead of encoded again.

A text is cut before each single space or newline that stands between two visible characters. The
tokenizer's own rules begin a new piece there, so the ids of the text are those of the cuts in order.
Cuts repeat much more than texts do; each worker remembers what it has encoded. Where a text holds white space in a
row, that stays inside a cut; texts with a special string of the tokenizer go to the library as they are.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

from . import worker
from .wordhash import mix

_ROW_OF_SPACE = re.compile(r"\s\s")
_CACHED = 400_000
IDS_KNOWN = 150_000  # cuts whose ids a worker keeps, about 60 bytes each; as many older ones besides
_AT_ONCE = 2048  # words encoded in one call, whose result takes much more room than the ids
_IN_A_ROW = 64  # of them in one piece
#: Characters that are neither letters, numbers nor white space, and begin no contraction.
_MARKS = ".,;:!?#*$%&|()[]{}<>/-_=+\""


def tokenizer(path: str):
    """The tokenizer of a ``tokenizers`` file and its special strings, loaded once per worker."""
    loaded = worker.store("tokens").setdefault("tokenizers", {})
    if path not in loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        found = Tokenizer.from_file(path)
        loaded[path] = found, [t.content for t in found.get_added_tokens_decoder().values()]
    return loaded[path]


_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: Letters of a byte-level vocabulary: printable bytes stand for themselves, the others follow U+0100. Spaces stay.
_LETTERS = "".join(
    chr(b) if b in _PRINTED or b == 0x20 else chr(0x100 + sum(x not in _PRINTED for x in range(b))) for b in range(0x100)
)
_SPACE, _NEWLINE = chr(0x120), chr(0x10A)


def word_tokenizer(lib: Tokenizer) -> Tokenizer | None:
    """The same model for words that are one piece each, written in the letters of its vocabulary, so that no rule has to
    look for pieces. None for tokenizers that are not byte-level, or whose words have more to them than merges."""
    if not isinstance(lib.model, BPE) or not isinstance(lib.pre_tokenizer, ByteLevel) or lib.normalizer is not None:
        return None
    if lib.model.ignore_merges or lib.model.dropout or lib.model.continuing_subword_prefix or lib.model.end_of_word_suffix:
        return None
    words = Tokenizer(lib.model)
    words.pre_tokenizer = WhitespaceSplit()
    return words


def spelled(words: list[str]) -> str:
    """Words with a space before each, in the letters of a byte-level vocabulary, apart."""
    return _SPACE + _lettered(" ".join(words)).replace(" ", f" {_SPACE}")


def _lettered(text: str) -> str:
    """Words in the letters of a byte-level vocabulary, spaces as they are."""
    if text.isascii():
        return text.replace("\n", _NEWLINE)
    return codecs.charmap_decode(text.encode(), "strict", _LETTERS)[0]


class Memory:
    """Values of later cuts, as a worker knows them: what ``values`` makes of the ids of several cuts in a row
    and the place where each cut ends.

    Two generations bound the memory: when the younger is full it becomes the older one, and what is
    still asked for comes back from there."""

    def __init__(self, lib, values: Callable[[list[int], list[int]], list[Any]]):
        self.lib, self.values = lib, values
        self.known: dict[str, Any] = {}
        self.older: dict[str, Any] = {}
        self.bare: dict[str, Any] = {}  # strings without anything before them: marks and first cuts

    def of_text(self, text: str) -> Any:
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return self.values(ids, [len(ids)])[0]

    def of_bare(self, text: str) -> Any:
        found = self.bare.get(text)
        if found is None:
            if len(self.bare) >= _CACHED // 10:
                self.bare.clear()
            found = self.bare[text] = self.of_text(text)
        return found

    def learn(self, cuts: set[str]) -> None:
        """After this, ``known`` holds all of ``cuts``."""
        missing = cuts.difference(self.known)
        if len(self.known) + 2 * len(missing) > _CACHED:
            self.older, self.known = self.known, {}
            missing = cuts
        known, older = self.known, self.older
        marked, plain, after_newline, others = [], set(), set(), []
        for cut in missing:
            found = older.get(cut)
            if found is not None:
                known[cut] = found
                continue
            # Letters and the marks behind them are two pieces; words are encoded together, once each.
            word = cut.rstrip(_MARKS)
            newline = word[:1] == "\n"
            letters = word[1:] if newline else word
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
                if cut != word:
                    marked.append((cut, word))
                if word not in known:
                    (after_newline if newline else plain).add(word)
            else:
                others.append(cut)
        self._learn_words(list(plain), " ", 1)
        self._learn_words(list(after_newline), "", 2)
        for cut, word in marked:
            known[cut] = known[word] + self.of_bare(cut[len(word) :])
        for cut, e in zip(others, self.lib.encode_batch_fast([text_of(c) for c in others], add_special_tokens=False), strict=True):
            known[cut] = self.values(e.ids, [len(e.ids)])[0]

    def _learn_words(self, words: list[str], lead: str, pieces: int) -> None:
        """Words of letters only, each of one piece, or of two with the newline it begins with."""
        if not words:
            return
        found = self.lib.encode(lead + lead.join(words), add_special_tokens=False)
        place = np.array(found.word_ids) // pieces
        end = np.searchsorted(place, np.arange(len(words)), "right").tolist()
        self.known.update(zip(words, self.values(found.ids, end), strict=True))


def memory(kind: str, path: str, values: Callable[[list[int], list[int]], list[Any]]) -> Memory:
    """The memory that the tasks of a worker share."""
    kept = worker.store("tokens").setdefault("memories", {})
    if (kind, path) not in kept:
        kept[kind, path] = Memory(tokenizer(path)[0], values)
    return kept[kind, path]


class Cutter:
    """Looks texts up cut by cut. ``join`` puts the value of the first cut and those of the others together.

    ``fixed`` is a table of cuts asked before the worker's memory."""

    def __init__(self, kind: str, path: str, values: Callable[[list[int], list[int]], list[Any]], join: Callable[[Any, Iterator[Any]], Any],
                 fixed: dict[str, Any] | None = None):
        self.special = tokenizer(path)[1]
        self.memory, self.join, self.fixed = memory(kind, path, values), join, fixed

    def of_texts(self, texts: list[str]) -> list[Any]:
        """Values of some texts, best of about a megabyte together."""
        whole = [any(s in t for s in self.special) for t in texts]
        cuts = [[] if w else cuts_of(t) for w, t in zip(whole, texts, strict=True)]
        wanted = set().union(*(c[1:] for c in cuts))
        if self.fixed:
            wanted = wanted.difference(self.fixed)
        self.memory.learn(wanted)
        # Most cuts come several times in a batch: a table of its own stays close at hand.
        known = self.memory.known
        near = {c: known[c] for c in wanted}
        look = _Tiers(self.fixed, near).__getitem__ if self.fixed else near.__getitem__
        return [
            self.memory.of_text(t) if w else self.join(self.memory.of_bare(c[0]), map(look, c[1:]))
            for w, t, c in zip(whole, texts, cuts, strict=True)
        ]


class _Tiers(dict):
    """A fixed table in front of a memory that knows the rest."""

    def __init__(self, fixed: dict[str, Any], known: dict[str, Any]):
        super().__init__(fixed)
        self.known = known

    def __missing__(self, cut: str):
        return self.known[cut]


_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _safe_cuts(text: str) -> list[str]:
    """Cuts at single spaces only; runs of white space stay inside a cut."""
    return _SAFE.split(text)


def cuts_of(text: str) -> list[str]:
    """The cuts in order. All but the first have lost the space before them, unless they begin with a newline."""
    if _ROW_OF_SPACE.search(text):
        return _safe_cuts(text)
    return text.replace("\n", " \n").split(" ")


def text_of(cut: str) -> str:
    """What a later cut stands for."""
    return cut if cut.startswith("\n") else " " + cut


def _lengths(ids: list[int], end: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *end], end, strict=False)]


_SHORT = 15
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class _Keys:
    """Strings as numpy compares them: up to 15 bytes and their number make two whole numbers, ``mark`` is a digest of both.
    Longer strings are kept as they are."""

    def __init__(self, strings: pa.Array):
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        size = np.diff(offsets)
        data = np.zeros(offsets[-1] - offsets[0] + 16, np.uint8)
        if len(data) > 16:
            data[:-16] = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        at = offsets[:-1] - offsets[0]
        a = eight[at] & _MASKS[np.minimum(size, 8)]
        b = eight[at + 8] & _MASKS[np.clip(size - 8, 0, 7)] | np.minimum(size, _SHORT + 1).astype(np.uint64) << np.uint64(56)
        self.strings, self.long = strings, size > _SHORT
        self.parts = mix(a ^ mix(b)), a, b

    def take(self, rows: np.ndarray) -> _Keys:
        some = object.__new__(_Keys)
        some.strings, some.long = self.strings.take(pa.array(rows)), self.long[rows]
        some.parts = tuple(x[rows] for x in self.parts)
        return some


class _Numbers:
    """Numbers of strings: short ones in arrays sorted by ``mark``, compared in full when found there, long ones in a dict."""

    def __init__(self):
        self.parts = tuple(np.zeros(0, np.uint64) for _ in range(3))
        self.number = np.zeros(0, np.int32)
        self.long: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.number) + len(self.long)

    def of(self, keys: _Keys) -> np.ndarray:
        """The numbers of strings, -1 for those not known."""
        numbers = np.full(len(keys.long), -1, np.int64)
        if len(self.number):
            order = np.argsort(keys.parts[0])  # neighbours are found near each other
            place = np.empty_like(order)
            place[order] = np.searchsorted(self.parts[0], keys.parts[0][order])
            place[place == len(self.number)] = 0
            same = ~keys.long
            for mine, asked in zip(self.parts, keys.parts, strict=True):
                same &= mine[place] == asked
            numbers[same] = self.number[place[same]]
        if keys.long.any():
            long = np.flatnonzero(keys.long)
            numbers[long] = [self.long.get(s, -1) for s in keys.strings.take(pa.array(long)).to_pylist()]
        return numbers

    def add(self, keys: _Keys, numbers: np.ndarray) -> None:
        """Take over strings that are not known."""
        if keys.long.any():
            long = np.flatnonzero(keys.long)
            self.long.update(zip(keys.strings.take(pa.array(long)).to_pylist(), numbers[long].tolist(), strict=True))
        short = np.flatnonzero(~keys.long)
        short = short[np.argsort(keys.parts[0][short])]
        place = np.searchsorted(self.parts[0], keys.parts[0][short]) + np.arange(len(short))
        old = np.ones(len(self.number) + len(short), bool)
        old[place] = False

        def merged(mine: np.ndarray, new: np.ndarray) -> np.ndarray:
            both = np.empty(len(old), mine.dtype)
            both[old], both[place] = mine, new[short]
            return both

        self.parts = tuple(map(merged, self.parts, keys.parts))
        self.number = merged(self.number, numbers)


class _Known:
    """Ids of strings, one after the other in one array, and the place of each string there."""

    def __init__(self, kind: type | np.dtype = np.uint32):
        self.later = _Numbers()
        self.bare: dict[str, int] = {}
        self.n, self.size = 0, 0
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, kind)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Place the ids of some strings; their numbers."""
        n, size = self.n + len(lengths), self.size + len(ids)
        if n > len(self.begin):
            self.begin, self.length = (np.resize(x, max(n, 2 * len(x))) for x in (self.begin, self.length))
        if size > len(self.ids):
            self.ids = np.resize(self.ids, max(size, 2 * len(self.ids)))
        self.begin[self.n : n] = self.size + np.cumsum(lengths) - lengths
        self.length[self.n : n] = lengths
        self.ids[self.size : size] = ids
        added, self.n, self.size = range(self.n, n), n, size
        return added

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings with these numbers, and how many each has."""
        lengths = self.length[numbers]
        place = np.repeat(self.begin[numbers] - (np.cumsum(lengths) - lengths), lengths)
        place += np.arange(len(place))
        return self.ids[place], lengths


#: ``_ROW_OF_SPACE`` for Arrow, whose white space is that of ASCII alone.
_ROW_OF_SPACE_ARROW = "[" + "".join(f"\\x{{{i:x}}}" for i in range(0x110000) if chr(i).isspace()) + "]{2}"
#: Letters of up to U+024F, perhaps behind a newline.
_WORD = "^\n?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+$"


class IdCutter:
    """Ids of texts, cut by cut, in the smallest type that has room for the vocabulary. A batch's cuts are numbered by
    Arrow, so each distinct one is looked up once.

    A worker's tasks share what it knows; when that is full it becomes the older half and gives back what is
    asked for again."""

    def __init__(self, path: str, known: int = IDS_KNOWN):
        self.lib, self.special = tokenizer(path)
        self.most = known
        self.words = word_tokenizer(self.lib)
        kept = worker.store("tokens").setdefault("ids", {})
        if path not in kept:
            vocabulary = self.lib.get_vocab()
            size = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                size[i] = len(token)  # byte-level tokens are written with one character a byte
            kind = np.min_scalar_type(len(size))
            kept[path] = [_Known(kind), _Known(kind)], size
        self.kept, self.bytes_of = kept[path]
        self.kind = np.min_scalar_type(len(self.bytes_of))

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.kept[0].later) > self.most:
            self.kept[:] = [_Known(self.kind), self.kept[0]]
        found: list[np.ndarray | None] = [None] * len(texts)
        single, spaced = [], []
        rows_of_space = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ROW_OF_SPACE_ARROW).to_pylist()
        for i, (t, has_row) in enumerate(zip(texts, rows_of_space, strict=True)):
            if any(s in t for s in self.special):
                found[i] = self._encoded(t)
            else:
                (spaced if has_row else single).append(i)
        split = [_safe_cuts(texts[i]) for i in spaced]
        cuts = pc.split_pattern(pc.replace_substring(pa.array([texts[i] for i in single], pa.string()), "\n", " \n"), " ")
        counts = np.concatenate([pc.list_value_length(cuts).to_numpy(zero_copy_only=False), [len(c) for c in split]]).astype(np.int64)
        flat = pa.concat_arrays([cuts.flatten(), pa.array([c for x in split for c in x], pa.string())])
        if not len(flat):
            return found
        first = np.cumsum(counts) - counts
        numbers = self._numbers(flat, first)
        ids, lengths = self.kept[0].of(numbers)
        end = np.cumsum(np.add.reduceat(lengths, first))
        for i, a, b in zip(single + spaced, end - np.diff(end, prepend=0), end, strict=True):
            found[i] = ids[a:b]
        return found

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind)

    def _numbers(self, flat: pa.Array, first: np.ndarray) -> np.ndarray:
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        later = np.ones(len(codes), bool)
        later[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[later]] = True
        asked = coded.dictionary.filter(pa.array(used))
        of_code = np.zeros(len(used), np.int64)
        of_code[used] = self._later(asked)
        numbers = of_code[codes]
        numbers[first] = [self._bare(c) for c in flat.take(pa.array(first)).to_pylist()]
        return numbers

    def _later(self, cuts: pa.Array) -> np.ndarray:
        """Numbers of distinct later cuts; those not known are learned."""
        keys = _Keys(cuts)
        numbers = self._known(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            numbers[missing] = self._learn(cuts.take(pa.array(missing)))
            self.kept[0].later.add(keys.take(missing), numbers[missing])
        return numbers

    def _known(self, keys: _Keys) -> np.ndarray:
        """Numbers of cuts, -1 where neither half knows one; what the older half knows is taken over."""
        known, older = self.kept
        numbers = known.later.of(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing) and len(older.later):
            past = older.later.of(keys.take(missing))
            missing, past = missing[past >= 0], past[past >= 0]
            numbers[missing] = known.add(*older.of(past))
            known.later.add(keys.take(missing), numbers[missing])
        return numbers

    def _bare(self, text: str) -> int:
        """Strings without anything before them: first cuts and marks."""
        known = self.kept[0]
        if text not in known.bare:
            ids = self._encoded(text)
            known.bare[text] = known.add(ids, np.array([len(ids)]))[0]
        return known.bare[text]

    def _learn(self, cuts: pa.Array) -> np.ndarray:
        """Encode cuts; their new numbers."""
        known = self.kept[0]
        numbers = np.zeros(len(cuts), np.int64)
        # Letters and the marks behind them are two pieces; words are encoded together, once each.
        words = pc.utf8_rtrim(cuts, _MARKS)
        simple = pc.match_substring_regex(words, _WORD)
        is_simple = simple.to_numpy(zero_copy_only=False)
        others = [text_of(c) for c in cuts.filter(pc.invert(simple)).to_pylist()]
        if others:
            found = []
            for lo in range(0, len(others), _AT_ONCE):
                found += [e.ids for e in self.lib.encode_batch_fast(others[lo : lo + _AT_ONCE], add_special_tokens=False)]
            numbers[~is_simple] = known.add(np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64))
        coded = words.filter(simple).dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        trimmed = (pc.binary_length(cuts).to_numpy(zero_copy_only=False) - pc.binary_length(words).to_numpy(zero_copy_only=False))[is_simple]
        marked = np.flatnonzero(trimmed)
        # A cut that is its own word is not known, or it would not be learned.
        of_word, behind = np.full(len(distinct), -1, np.int64), np.ones(len(distinct), bool)
        behind[codes[trimmed == 0]] = False
        behind = np.flatnonzero(behind)
        keys = _Keys(distinct.take(pa.array(behind)))
        of_word[behind] = self._known(keys)
        new = np.flatnonzero(of_word[behind] < 0)
        newline = pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False)
        for after_newline in (False, True):
            rows = np.flatnonzero((of_word < 0) & (newline == after_newline))
            for some in np.split(rows, range(_AT_ONCE, len(rows), _AT_ONCE)) if len(rows) else []:
                of_word[some] = known.add(*self._words(distinct.take(pa.array(some)), after_newline))
        known.later.add(keys.take(new), of_word[behind[new]])
        mine = of_word[codes]
        if len(marked):
            ends = [c[-n:] for c, n in zip(cuts.filter(simple).take(pa.array(marked)).to_pylist(), trimmed[marked].tolist(), strict=True)]
            of_end = {m: self._bare(m) for m in set(ends)}
            both = np.stack([mine[marked], [of_end[m] for m in ends]], axis=1)
            ids, lengths = known.of(both.ravel())
            mine[marked] = known.add(ids, lengths[::2] + lengths[1::2])
        numbers[is_simple] = mine
        return numbers

    def _words(self, words: pa.Array, after_newline: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, behind a space or the newline they begin with, and how many each has. Some words in a
        row make one piece; the ids are dealt out by the bytes they stand for. No merge reaches over a word's end, or the
        ids would not meet there: then each word goes to the library alone."""
        lead = "" if after_newline else " "
        rows = pa.ListArray.from_arrays(pa.array([*range(0, len(words), _IN_A_ROW), len(words)], pa.int32()), words)
        texts = [lead + t for t in pc.binary_join(rows, lead).to_pylist()]
        if self.words:
            texts = [_lettered(t).replace(" ", _SPACE) for t in texts]
        found = (self.words or self.lib).encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], self.kind)
        reach = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + len(lead))
        ends = np.concatenate([reach, np.concatenate(([0], reach[:-1])) + 1]) if after_newline else reach
        upto = np.cumsum(self.bytes_of[ids]) if len(ids) else np.zeros(1, np.int64)
        if upto[-1] != reach[-1] or (upto[np.searchsorted(upto, ends)] != ends).any():
            found = [e.ids for e in self.lib.encode_batch_fast([lead + w for w in words.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64)
        return ids, np.bincount(np.searchsorted(reach, upto), minlength=len(words))


def count_cutter(path: str, fixed: dict[str, int]) -> Cutter:
    return Cutter("counts", path, _lengths, lambda first, rest: first + sum(rest), fixed)


def batched(texts: Iterable[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` together; a longer text is alone."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > chars:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch
