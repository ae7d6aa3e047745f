"""The pieces that the byte-level pre-tokenizers cut texts into, without a loop over letters.

The pre-tokenizers' pattern is compiled to a deterministic transducer over
classes of letters.  Its transitions say whether a piece starts at the letter
read, or started at the letter before it (the last blank of a run belongs to
what follows; an apostrophe may open a contraction).  All texts of a slice lie
one after another and are cut into chunks of equal length.  A chunk's map gives
the state after it for every state before it; maps compose associatively, and a
prefix scan over them gives each chunk's first state.  Chunks then run side by
side, a letter of each at a time, as numpy lanes.

Equal pieces are encoded once: Arrow numbers the distinct pieces of a slice, and
a bounded ``PieceStore`` keeps what is known of them from slice to slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern that the transducer below stands for; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of a chunk, those of its end that are tried from every state, and bytes of texts that are treated at once.
CHUNK, TAIL, SLICE = 256, 6, 1 << 20

# States: nothing open; a run of letters, numbers or other signs; one white space; several (the last a blank or not);
# an apostrophe that may open a contraction, perhaps with its first letter.
START, LETTERS, NUMBERS, SIGNS, BLANK, SPACE, BLANKS, SPACES, MARK, MARK_R, MARK_V, MARK_L = range(12)
STATES = 12
# Classes: letters by their part in contractions, numbers, other signs, white space, the blank, the apostrophe.
L, STMD, R, V, E, LL, N, O, S, B, Q = range(11)
#: Added to the class of a text's first letter; the class that changes nothing.
FIRST, NONE = 16, 31
_NEXT, _HERE, _BEFORE = 0x1E0, 1 << 10, 1 << 11


def _opened(c: int) -> int:
    """The state of a piece that starts with class ``c``."""
    return {N: NUMBERS, O: SIGNS, S: SPACE, B: BLANK, Q: MARK}.get(c, LETTERS)


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """The next state, and whether a piece starts at this letter or at the one before it."""
    joined = SIGNS if c == Q else _opened(c)  # as part of a piece that is open
    white, letter = c in (S, B), c <= LL
    if state == START:
        return _opened(c), True, False
    if state in (LETTERS, NUMBERS, SIGNS):
        return (joined, False, False) if joined == state else (_opened(c), True, False)
    if state in (BLANK, SPACE, BLANKS, SPACES):
        if white:
            return (BLANKS if c == B else SPACES), False, False
        several = state in (BLANKS, SPACES)
        if state in (BLANK, BLANKS):  # the last blank belongs to what follows
            return joined, False, several
        return _opened(c), True, several
    if state == MARK:
        if c in (STMD, R, V, LL):
            return {STMD: START, R: MARK_R, V: MARK_V, LL: MARK_L}[c], False, False
        return (SIGNS, False, False) if joined == SIGNS else (_opened(c), True, False)
    if c == (LL if state == MARK_L else E):
        return START, False, False
    return (LETTERS, False, True) if letter else (_opened(c), True, True)  # no contraction: the letter opened a piece


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """The compiled table: ``state << 5 | class`` to ``next << 5`` and two marks."""
    table = np.zeros(STATES << 5, np.int64)
    for state in range(STATES):
        for c in range(11):
            after, here, before = _step(state, c)
            table[state << 5 | c] = after << 5 | here * _HERE | before * _BEFORE
            table[state << 5 | c | FIRST] = _opened(c) << 5 | _HERE | (state >= MARK_R) * _BEFORE
        table[state << 5 | NONE] = state << 5
    return table


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, asked of the library itself, since Unicode versions differ; planes above 3 have signs only."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    points = [c for c in range(0x40000) if c != 0x20 and not 0xD800 <= c < 0xE000]
    out = np.full(0x110000, O, np.uint8)
    for _, (a, b) in cut("".join(map(chr, points))):  # runs of one class
        probe = chr(points[a])
        kind = next((k for k, sign in ((L, "a"), (N, "1"), (O, "!")) if len(cut(sign + probe)) == 1), S)
        out[points[a] : points[b - 1] + 1] = kind
    out[0x20], out[ord("'")] = B, Q
    for c, letters in ((STMD, "stmd"), (R, "r"), (V, "v"), (E, "e"), (LL, "l")):
        out[[ord(x) for x in letters]] = c
    return out


def scan(maps: np.ndarray) -> np.ndarray:
    """All prefixes of the composition of state maps (a row a map), in about log2 n rounds of independent compositions."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], axis=1)  # the earlier map first
        reach *= 2
    return out


def _run(table: np.ndarray, states: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """States of some lanes (a row each) after some letters (a row a letter)."""
    for letters in steps:
        states = table[states | letters[:, None]] & _NEXT
    return states


def starts(kinds: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """Where pieces start, given the class of every letter (``FIRST`` added where a text starts)."""
    table, n, chunk = transitions(), len(kinds), chunk or CHUNK
    lanes = -(-n // chunk)
    steps = np.full(lanes * chunk, NONE, np.uint8)
    steps[:n] = kinds
    steps = np.ascontiguousarray(steps.reshape(lanes, chunk).T)
    # The last letters of a chunk nearly always settle the state after it, whatever the state before; the others run whole.
    every = _run(table, np.full((lanes, STATES), np.arange(STATES) << 5), steps[-TAIL:])
    rest = np.flatnonzero((every != every[:, :1]).any(axis=1))
    if len(rest):
        every[rest] = _run(table, np.full((len(rest), STATES), np.arange(STATES) << 5), steps[:, rest])
    after = scan(every >> 5)[:, START]
    state = np.concatenate([[START], after[:-1]]) << 5
    marks = np.empty((chunk, lanes), np.uint8)
    for k in range(chunk):
        value = table[state | steps[k]]
        marks[k] = value >> 10
        state = value & _NEXT
    flat = marks.T.reshape(-1)[:n]
    at = (flat & 1).astype(bool)
    at[:-1] |= flat[1:] > 1
    if n and after[-1] >= MARK_R:
        at[-1] = True
    return np.flatnonzero(at)


class Cut(NamedTuple):
    """The pieces of some texts: the distinct ones, which of them each place holds, and each text's first place (and the end)."""

    distinct: pa.Array
    which: np.ndarray
    bounds: np.ndarray


def cut(texts: pa.Array) -> Cut:
    """The pieces of texts (strings without nulls, of less than 2 GB in all)."""
    texts = texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return Cut(pa.array([], pa.binary()), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    if (raw < 0x80).all():
        kinds, place, firsts = classes()[raw], None, ends[:-1]
    else:
        kinds = classes()[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")]
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        firsts = np.searchsorted(place, ends[:-1])
    kinds[firsts[ends[1:] > ends[:-1]]] |= FIRST
    at = starts(kinds)
    at = at if place is None else place[at]
    bounds = np.append(at, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    coded = pieces.dictionary_encode()
    return Cut(coded.dictionary, coded.indices.to_numpy(), np.append(np.searchsorted(at, ends[:-1]), len(at)))


def slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes of text, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    total, at, size = np.cumsum(lengths), 0, size or SLICE
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


class PieceStore:
    """What an encoder says of pieces, kept for pieces that come again.

    ``learn`` takes distinct pieces as bytes and gives one flat array of
    numbers and how many of them each piece has.  At most about ``limit``
    pieces and ``limit * 4`` numbers stay; then only those of the present slice do.
    """

    #: Longer pieces aren't kept.
    LONG = 48

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: np.dtype, limit: int = 200_000) -> None:
        self._learn, self.dtype, self._limit = learn, np.dtype(dtype), limit
        self._clear()

    def _clear(self) -> None:
        self._known: dict[bytes, int] = {}
        self._codes, self._lengths = np.empty(0, self.dtype), np.empty(0, np.int64)

    def look(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, and the place and number of each piece's codes among them."""
        pieces = distinct.to_numpy(zero_copy_only=False).tolist()
        known = self._known.get
        at = np.fromiter([known(p, -1) for p in pieces], np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [pieces[k] for k in new]
            codes, lengths = self._learn(fresh)
            at[new] = len(self._lengths) + np.arange(len(new))
            self._codes, self._lengths = np.concatenate([self._codes, codes.astype(self.dtype)]), np.concatenate([self._lengths, lengths])
            first = len(self._known)
            if first + len(new) <= self._limit and len(self._codes) <= 4 * self._limit:
                self._known.update((p, k) for p, k in zip(fresh, at[new].tolist(), strict=True) if len(p) <= self.LONG)
            else:
                out = self._picked(at)
                self._clear()
                keep = [k for k, p in enumerate(pieces) if len(p) <= self.LONG][: self._limit // 2]
                self._known = {pieces[k]: n for n, k in enumerate(keep)}
                kept = np.array(keep, np.int64)
                self._codes, self._lengths = ragged(out[0], out[1][kept], out[2][kept]), out[2][kept]
                return out
        return self._picked(at)

    def _picked(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.cumsum(self._lengths) - self._lengths
        return self._codes, first[at], self._lengths[at]


def ragged(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``first``, one after another."""
    shift = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(len(shift))]


def encoded(texts: pa.Array, store: PieceStore, whole: Callable[[str], np.ndarray] | None = None, special: Iterable[str] = ()) -> Iterator[np.ndarray]:
    """The codes of each text in order; a null text has none, one with a special string is left to ``whole``."""
    for a, to in slices(texts):
        part = texts.slice(a, to - a)
        odd: dict[int, np.ndarray] = {}
        for s in special:
            for k in np.flatnonzero(pc.fill_null(pc.match_substring(part, s), False).to_numpy(zero_copy_only=False)):
                odd.setdefault(int(k), whole(part[int(k)].as_py()))
        if odd:
            part = pa.array([None if k in odd else x for k, x in enumerate(part.to_pylist())], pa.string())
        found = cut(pc.fill_null(part, ""))
        codes, first, lengths = store.look(found.distinct)
        sizes = lengths[found.which]
        out = ragged(codes, first[found.which], sizes)
        ends = np.append(0, np.cumsum(sizes))[found.bounds]
        for k in range(to - a):
            yield odd[k] if k in odd else out[ends[k] : ends[k + 1]]
