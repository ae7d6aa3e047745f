"""Which neighbours a byte-pair encoding can leave side by side.

Tokens are numbered by merge order: 0 to 255 are the single bytes, a merge
makes a token above both of its halves.  A sequence of tokens is the encoding
of its bytes exactly if every two neighbours are compatible, that is, if the
merge procedure run over the bytes of both never joins anything across the
place between them.
"""

from __future__ import annotations

from collections.abc import Mapping


class Merges:
    """``pair[a, b]`` is the token that a merge of two tokens gives; ``halves[t]`` is its inverse."""

    #: Most answers that are remembered; then the memo starts anew.
    MEMO = 1_000_000

    def __init__(self, pair: Mapping[tuple[int, int], int], halves: Mapping[int, tuple[int, int]]) -> None:
        self.pair, self.halves = pair, halves
        self._memo: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` can stand in an encoding."""
        got = self._memo.get((a, b))
        if got is None:
            if len(self._memo) >= self.MEMO:
                self._memo.clear()
            got = self._memo[a, b] = self.stays_apart(a, b)
        return got

    def stays_apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge that comes earlier than ``before`` joins across the place between ``a`` and ``b``.

        Walks back through the merges of both sides, last merge first: the
        tokens that touch at the place are then those that touched before that
        merge, and a merge across counts only if it comes before the merges
        already undone.  With equal numbers the left place is merged first.
        """
        pair, halves, bound = self.pair, self.halves, before
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < bound:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                a, bound = left[1], a
            else:
                # The right token may be the one the left merge would have made first: it wins a tie.
                b, bound = right[0], b + 1
