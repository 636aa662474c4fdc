"""Static range coding of token ids (asymmetric numeral system) over interleaved lanes, in numpy.

One table of frequencies, adding up to 2**20, serves all blocks. In a block, id i belongs to lane i % lanes;
a step codes one id on every lane. States are 64-bit in [2**31, 2**63) and give off 32-bit words. A block
keeps the states before its first step and, every 256 steps, a checkpoint: states and word position, from
which the ids up to the next one are decoded alone. Each such segment has a CRC-32 of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import params

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MOST = 31 + 32 - params.FREQUENCY_BITS  # a state is below frequency << _MOST when its id is coded
_BITS = np.uint64(params.FREQUENCY_BITS)
_TOTAL = 1 << params.FREQUENCY_BITS
_HEAD = "<4sHHQI"  # magic, version, lanes, ids, segments
_MAGIC = b"CSTB"


@dataclass(frozen=True)
class Table:
    """Ids in ascending order, their frequencies and where each begins."""

    ids: np.ndarray
    freq: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, freq: np.ndarray) -> Table:
        return Table(ids.astype(np.uint32), freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64))


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**20, close to the shares of ``counts`` (all positive)."""
    if len(counts) > _TOTAL:
        raise ValueError(f"more than {_TOTAL} different ids")
    if not len(counts):
        return np.zeros(0, np.int64)
    exact = counts.astype(np.float64) / counts.sum() * _TOTAL
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    # What is missing goes to the largest remainders; what is too much comes from the most frequent.
    while (gap := _TOTAL - int(freq.sum())) > 0:
        order = np.argsort(freq - exact, kind="stable")[:gap]
        freq[order] += 1
    while (gap := int(freq.sum()) - _TOTAL) > 0:
        order = np.argsort(-freq, kind="stable")
        order = order[freq[order] > 1][:gap]
        freq[order] -= np.maximum(1, np.minimum(freq[order] - 1, gap // len(order)))
    return freq


def lanes_for(n: int) -> int:
    lanes = 1
    while lanes < params.MOST_LANES and lanes * 512 < n:
        lanes *= 2
    return lanes


def _lanes(n: int, *values) -> list[np.ndarray]:
    """One array a value: numpy takes longer to widen a single number at each step."""
    return [np.full(n, v, np.uint64) for v in values]


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block."""
    n, lanes = len(ids), lanes_for(len(ids))
    both = np.zeros(int(table.ids[-1]) + 1 if len(table.ids) else 1, np.uint64)
    both[table.ids] = table.freq << _BITS | table.begin
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks, given = [], 0
    wide = ids.astype(np.intp)
    begin, freq, most, bits, up, mask, total = _lanes(lanes, 0, 0, 0, _BITS, _MOST, _TOTAL - 1, _TOTAL)
    for t in range(-(-n // lanes) - 1, -1, -1):
        at = wide[t * lanes : (t + 1) * lanes]
        x = state[: len(at)]  # the last step may be short: lanes beyond it stay as they are
        if len(begin) != len(at):
            begin, freq, most, bits, up, mask, total = _lanes(len(at), 0, 0, 0, _BITS, _MOST, _TOTAL - 1, _TOTAL)
        both.take(at, out=begin, mode="clip")
        np.right_shift(begin, bits, out=freq)
        begin &= mask
        np.left_shift(freq, up, out=most)
        over = (x >= most).nonzero()[0]
        out = x[over]
        words.append(out.astype(np.uint32))
        given += len(out)
        out >>= _WORD
        x[over] = out
        # A lane holds quotient * total + remainder + begin, that is state + quotient * (total - freq) + begin.
        begin += x
        x //= freq
        np.subtract(total, freq, out=freq)
        x *= freq
        x += begin
        if t % params.CHECKPOINT_STEPS == 0:
            marks.append((given, state.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    parts = [struct.pack(_HEAD, _MAGIC, 1, lanes, n, len(marks))]
    size = params.CHECKPOINT_STEPS * lanes
    for k, (left, states) in enumerate(marks):
        crc = zlib.crc32(ids[k * size : (k + 1) * size].astype("<u4").tobytes())
        parts.append(struct.pack("<QI", given - left, crc) + states.astype("<u8").tobytes())
    return b"".join([*parts, stream.astype("<u4").tobytes()])


def segments(block: bytes) -> int:
    """Number of parts of a block that can be decoded on their own."""
    return struct.unpack_from(_HEAD, block)[4]


def decode(block: bytes, table: Table, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of segments ``first`` to ``last`` (exclusive; all by default); fails where a checksum does not fit."""
    magic, version, lanes, n, marks = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    one = 12 + 8 * lanes
    body = struct.calcsize(_HEAD) + marks * one
    stream = np.frombuffer(block, "<u4", offset=body).astype(np.uint64)
    size = params.CHECKPOINT_STEPS * lanes
    parts = []
    both = table.freq << _BITS | table.begin
    for k in range(first, marks if last is None else last):
        at, crc = struct.unpack_from("<QI", block, struct.calcsize(_HEAD) + k * one)
        state = np.frombuffer(block, "<u8", lanes, struct.calcsize(_HEAD) + k * one + 12).astype(np.uint64)
        count = min(size, n - k * size)
        places = np.empty(count, np.intp)
        begin, freq, bits, mask, least = _lanes(lanes, 0, 0, _BITS, _TOTAL - 1, _LOW)
        for lo in range(0, count, lanes):
            x, p = state, places[lo : lo + lanes]
            if len(p) < lanes:
                x = state[: len(p)]
                begin, freq, bits, mask, least = _lanes(len(p), 0, 0, _BITS, _TOTAL - 1, _LOW)
            low = x & mask
            slots.take(low.view(np.intp), out=p, mode="clip")
            both.take(p, out=begin, mode="clip")
            x >>= bits
            np.right_shift(begin, bits, out=freq)
            x *= freq
            begin &= mask
            low -= begin
            x += low
            need = (x < least).nonzero()[0]
            few = x[need]
            few <<= _WORD
            few |= stream[at : at + len(few)]
            x[need] = few
            at += len(few)
        ids = table.ids[places]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of segment {k} does not fit")
        if k == marks - 1 and (state != _LOW).any():
            raise ValueError("the lanes do not end where they began")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def slot_places(table: Table) -> np.ndarray:
    """For each slot of the table the place of its id."""
    return np.repeat(np.arange(len(table.ids), dtype=np.intp), table.freq.astype(np.int64))
