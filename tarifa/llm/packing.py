"""Packing of documents into fixed windows by the online sum-of-squares rule.

Every input partition is one stream. Full windows are cut off a document first; what is left (less than a
window) goes to the fill level h that makes the sum over levels of (windows open at that level) squared
smallest, the fuller level on ties. A level array holds the counts, so a placement looks at no window.
When the stream ends, or when more than ``max_open`` windows are open, the emptiest open windows are
dissolved into the gaps of the fullest ones (their pieces are cut as needed), so one window a stream at
most stays partly filled. Its tokens become sequences whose lengths are powers of two, which need no padding.

No shuffle is needed: windows never span streams, and a lost task packs its own partition again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarifa.llm.tokens import BYTE_BPE, encoder, tokenizer_path

#: tokens: ids as little-endian unsigned 32-bit integers.
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"
_FIELDS = [x.split()[0] for x in PIECES.split(", ")]
_SCHEMA = pa.schema([(name, pa.binary() if name == "tokens" else pa.int64()) for name in _FIELDS])


class SquaresPacker:
    """One stream: put() places a document, settle() closes the open windows; rows gathers the pieces."""

    def __init__(self, window: int, first_id: int, max_open: int):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list] = [[] for _ in range(window + 1)]  # at each level, the open windows: lists of pieces
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            self.rows.append((doc_id, start, len(ids), doc_tokens, self.next_id, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.next_id += 1

    def _emit_powers(self, left: int, pieces: list[tuple]) -> None:
        """What is left of a stream, as sequences of the powers of two in its length, the largest first."""
        waiting = pieces[::-1]
        while left:
            size = 1 << left.bit_length() - 1
            left -= size
            taken = []
            while size:
                doc_id, start, n, ids = waiting.pop()
                taken.append((doc_id, start, n, ids[:size]))
                if len(ids) > size:
                    waiting.append((doc_id, start + size, n, ids[size:]))
                size -= min(size, len(ids))
            self._emit(taken)

    def level(self, size: int) -> int:
        """The fill level for a piece of this size; 0 opens a window."""
        counts, last = self.counts, self.window - size
        change = np.where(counts[: last + 1] > 0, 1 - 2 * counts[: last + 1], np.iinfo(np.int64).max // 2)
        change[0] = 0
        change += 2 * counts[size : self.window + 1] + 1
        change[last] -= 2 * counts[self.window] + 1  # full windows aren't counted
        return last - int(np.argmin(change[::-1]))

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.window:
            self._emit([(doc_id, start, n, ids[start : start + self.window])])
            start += self.window
        if start < n:
            size = n - start
            h = self.level(size)
            pieces = self.levels[h].pop() if h else []
            self.counts[h] -= bool(h)
            pieces.append((doc_id, start, n, ids[start:]))
            if h + size == self.window:
                self._emit(pieces)
            else:
                self.levels[h + size].append(pieces)
                self.counts[h + size] += 1
                if self.counts.sum() > self.max_open:
                    self.settle(False)

    def settle(self, end: bool = True) -> None:
        opened = [(h, pieces) for h in range(self.window - 1, 0, -1) for pieces in self.levels[h]]
        self.levels = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        i, j = 0, len(opened) - 1
        while i < j:
            h, pieces = opened[i]
            left, given = opened[j]
            doc_id, start, n, ids = given.pop()
            gap = self.window - h
            take = ids[:gap]
            pieces.append((doc_id, start, n, take))
            if len(take) < len(ids):
                given.append((doc_id, start + len(take), n, ids[len(take) :]))
            opened[i], opened[j] = (h + len(take), pieces), (left - len(take), given)
            if h + len(take) == self.window:
                self._emit(pieces)
                i += 1
            if not given:
                j -= 1
        if i == j:
            h, pieces = opened[i]
            if end:
                self._emit_powers(h, pieces)
            else:
                self.levels[h].append(pieces)
                self.counts[h] += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, spaced: bool = True, end_id: int = 0, window: int = 1024, max_open: int = 4096, slice_rows: int = 256, max_chunks: int = 500_000) -> DataFrame:
    """Packs all rows of docs (doc_id, text) into windows of ``window`` tokens; a row of PIECES for each piece.

    A document's tokens are the ids of its whole text and then end_id. Each id lies in exactly one piece;
    the pieces of a sequence_id lie gapless from offset 0. A sequence is full, but for a partition's last ones, which have
    a power of two of tokens.
    A null text counts as empty (one token); a null doc_id is kept; repeated rows are packed each; an empty
    table gives no rows. Other columns are ignored. tokenizer is a file every machine has.
    """
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path, spaced, max_chunks), np.array([end_id], np.uint32)
        packer = SquaresPacker(window, TaskContext.get().partitionId() << 40, max_open)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                doc_ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, ids in zip(doc_ids, coder.encode(texts), strict=True):
                    packer.put(doc_id, np.concatenate([ids, end]))
                if len(packer.rows) > 2000:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.settle()
        for at in range(0, len(packer.rows), 4000):
            yield _batch(packer.rows[at : at + 4000])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(stream, PIECES)
