"""Packing documents into fixed windows through several context-size tiers.

Every full window's worth of a document becomes a window of its own; the rest
is routed to the smallest tier that holds it.  A tier fills sequences of its
size first-come, closes the gap at the end with the best-fitting waiting
pieces of shorter tiers, and at last by cutting one piece, so all sequences but
the last few of a task are exactly full.  Sequences of one size are dealt into
step groups of equal token counts.

Packing needs no shuffle: each task packs the documents of its own split as
they stream by, so memory is bounded by one Arrow batch and the waiting pieces
(under ``4 * window`` tokens a tier).  A hot source or group of copies is
spread like any other rows.  A retried task reads the same split and gives the
same rows, if the input is a table of files, as it is meant to be.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sigloom.llm.library_bpe import encoder, release

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in [x.split()[0] for x in SCHEMA.split(", ")]])


class TierPacker:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` into sequences; see the module."""

    def __init__(self, window: int, tiers: int, step_tokens: int, base: int) -> None:
        if window & (window - 1) or window < 1 << tiers:
            raise ValueError("window must be a power of two and hold all tiers")
        self.sizes = [window >> k for k in range(tiers)]  # long to short
        self.step_tokens, self.base, self.count = max(step_tokens, window), base, 0
        self.waiting: list[deque] = [deque() for _ in self.sizes]
        self.tokens = [0] * tiers
        self.made = [0] * tiers
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        window, n, at = self.sizes[0], len(ids), 0
        while n - at >= window:
            self._emit(0, [(doc_id, at, ids[at : at + window], n)])
            at += window
        if at < n:
            self._route((doc_id, at, ids[at:], n))
        for k, size in enumerate(self.sizes):
            while self.tokens[k] >= 3 * size:
                self._fill(k)

    def _route(self, piece: tuple, first: bool = False) -> None:
        k = max(i for i, size in enumerate(self.sizes) if len(piece[2]) <= size)
        self.waiting[k].appendleft(piece) if first else self.waiting[k].append(piece)
        self.tokens[k] += len(piece[2])

    def _take(self, k: int) -> tuple:
        piece = self.waiting[k].popleft()
        self.tokens[k] -= len(piece[2])
        return piece

    def _fill(self, k: int) -> None:
        """One sequence of tier ``k``, exactly full as long as enough tokens wait."""
        size, sequence, used = self.sizes[k], [], 0
        while self.waiting[k] and used + len(self.waiting[k][0][2]) <= size:
            sequence.append(piece := self._take(k))
            used += len(piece[2])
        for j in range(k + 1, len(self.sizes)):  # gaps of long windows are filled from shorter tiers
            while self.waiting[j] and used + len(self.waiting[j][0][2]) <= size:
                sequence.append(piece := self._take(j))
                used += len(piece[2])
        while used < size:
            source = next((j for j in [*range(len(self.sizes) - 1, k, -1), *range(k, -1, -1)] if self.waiting[j]), None)
            if source is None:
                break
            doc_id, start, ids, n = self._take(source)
            room = size - used
            sequence.append((doc_id, start, ids[:room], n))
            used += min(room, len(ids))
            if len(ids) > room:
                self._route((doc_id, start + room, ids[room:], n), first=True)
        self._emit(k, sequence)

    def _emit(self, k: int, sequence: list[tuple]) -> None:
        number, offset = self.base + self.count, 0
        group = self.base + self.made[k] // (self.step_tokens // self.sizes[k]) * len(self.sizes) + k
        self.count += 1
        self.made[k] += 1
        for doc_id, start, ids, n in sequence:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
            self.rows.append((doc_id, start, len(ids), crc, n, number, offset, self.sizes[k], group))
            offset += len(ids)

    def finish(self) -> None:
        """What still waits: full sequences from long to short, then one padded one at most."""
        for k, size in enumerate(self.sizes):
            while sum(self.tokens) >= size:
                self._fill(k)
        if sum(self.tokens):
            self._fill(len(self.sizes) - 1)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, tiers: int = 4, step_tokens: int = 16 * 2048, end_id: int = 1, keep_caches: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever
    their names.  A null text is empty and gives the end token alone; repeated
    rows are packed each for itself; a null ``doc_id`` stays null; no rows give
    no rows.  Sequences and step groups are numbered within a task above
    ``partition << 40``; ``tier`` is the sequence's context size.  At the end
    of a task at most one sequence is left short.  ``keep_caches`` leaves the
    encoder to later tasks of a worker; without it a task gives its memory back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        packer = TierPacker(window, tiers, step_tokens, TaskContext.get().partitionId() << 40)
        try:
            for batch in batches:
                for doc_id, own in zip(batch.column(0).to_pylist(), enc.encoded(batch.column(1)), strict=True):
                    packer.add(doc_id, np.concatenate([own, end]))
                    if len(packer.rows) >= 4096:
                        yield packer.take()
            packer.finish()
            yield packer.take()
        finally:
            if not keep_caches:
                del enc
                release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
