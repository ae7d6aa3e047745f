"""Byte-level BPE by longest matches and backtracking, and its decoder.

A piece's bytes are mapped to Latin-1 letters, one a byte, so that an
Aho-Corasick automaton over the vocabulary finds every token that lies in the
piece.  The encoder takes the longest token at each place that is compatible
with the token before it (see ``merges``), takes shorter ones where the rest
can't be reached, and remembers dead places, so each place is left at most
once.  The result is that of the rank-ordered merges.  Pieces are cut by
``pieces``; equal pieces are encoded once as long as they are remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigloom.llm.merges import Merges
from sigloom.llm.pieces import PATTERN, PieceStore, encoded

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Joined(dict):
    """``[a, b]``: the rank of the joined bytes of two tokens, if they are a token."""

    def __init__(self, ranks: dict[bytes, int], text: dict[int, bytes]) -> None:
        super().__init__()
        self.ranks, self.text = ranks, text

    def get(self, key, default=None):
        return self.ranks.get(self.text[key[0]] + self.text[key[1]], default)


class BacktrackingBpe:
    """Encoder and decoder for a vocabulary of ranks and a pattern that cuts pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick

        if pattern != PATTERN:
            raise ValueError("only the pattern that pieces stands for")
        self.ranks, self.text = ranks, {k: b for b, k in ranks.items()}
        halves: dict[int, tuple[int, int]] = {}
        self.merges = Merges(_Joined(ranks, self.text), halves)
        automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and not self._halve(token, rank, halves):
                continue  # no merges lead to it
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self.automaton = automaton
        self._store = PieceStore(self._learn, np.dtype("<u4"))

    def _halve(self, token: bytes, rank: int, halves: dict[int, tuple[int, int]]) -> bool:
        """The last merge on the way to ``token``: its halves are reached themselves and nothing joins them earlier."""
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
            if a is None or b is None or max(a, b) >= rank:
                continue
            if all(len(self.text[x]) == 1 or x in halves for x in (a, b)) and self.merges.stays_apart(a, b, rank):
                halves[rank] = (a, b)
                return True
        return False

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself in the vocabulary is that token."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for last, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            starts[last - size + 1].append((rank, size))  # short to long
        compatible, n = self.merges.compatible, len(piece)
        dead = bytearray(n + 1)
        tokens: list[int] = []
        places, tries = [0], [len(starts[0])]
        while places[-1] < n:
            at, k = places[-1], tries[-1] - 1
            options = starts[at]
            while k >= 0:
                rank, size = options[k]
                if not dead[at + size] and (not tokens or compatible(tokens[-1], rank)):
                    break
                k -= 1
            if k >= 0:
                tries[-1] = k
                tokens.append(rank)
                places.append(at + size)
                tries.append(len(starts[at + size]) if at + size < n else 0)
            else:
                dead[at] = 1  # whichever token leads here, the rest can't follow
                places.pop()
                tries.pop()
                if not places:
                    raise ValueError("a byte of the piece is missing in the vocabulary")
                tokens.pop()
        return tokens

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.encode_piece, pieces))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a column in order; none for null."""
        return encoded(texts, self._store)

    def encode_many(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        return list(self.encoded(pa.array(texts, pa.string())))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BacktrackingBpe:
    return BacktrackingBpe(read_ranks(path), pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and digest both.

    A narrow pass without a shuffle; memory is bounded by one Arrow batch and
    the caches.  A null text is empty (no ids, the digest of nothing); repeated
    rows are repeated; other columns of ``docs`` are ignored; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            sizes, digests, decoded = [], [], []
            for ids in bpe.encoded(batch.column(1)):
                sizes.append(len(ids))
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
