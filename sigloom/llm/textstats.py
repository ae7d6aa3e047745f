"""Statistics of one whole text, shared by the quality operators."""

from __future__ import annotations

import numpy as np

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def words(text: str) -> list[bytes]:
    """Runs of signs other than ``BLANKS``; ``bytes.split`` splits at just these."""
    return text.encode("utf-8", "surrogatepass").split()


def n_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, count = set(), 0
    for line in lines:
        if line in seen:
            count += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return count


def repeated(ids: np.ndarray, width: int = 8) -> int:
    """Places inside windows of ``width`` items that occur twice or more, the first ones too.

    Windows are compared by a 64-bit hash that doubles its reach in each step.
    """
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h, reach = (ids.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    h ^= h >> np.uint64(29)
    for step in _STEPS[: width.bit_length() - 1]:
        h = h[:-reach] * step + h[reach:]
        h ^= h >> np.uint64(31)
        reach *= 2
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def word_ids(items: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers, in order of first sight."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in items), np.int64, len(items))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    items = words(text)
    return (
        len(items),
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        n_dup_lines(text),
        repeated(word_ids(items)),
    )
