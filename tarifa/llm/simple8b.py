"""Token ids in Simple-8b files: 64-bit words whose top four bits select how many ids of what width follow.

A dataset is a folder of Parquet files; a row is a segment of whole documents in ascending doc_id order:

* ``shard``, ``segment``, ``first`` (ids of the shard before the segment), ``n_ids``;
* ``doc_ids``, ``doc_lengths``: the segment's documents;
* ``words``: the code words, little-endian; ``escapes``: ids too wide for a word, as unsigned 64-bit integers;
* ``block_words``, ``block_escapes``: where in these each block of BLOCK ids begins, so any block decodes alone.

Shards follow one another in doc_id order, so a document's start is its shard's first id plus its place there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa.llm.tokens import WORD_BPE, encoder, tokenizer_path

BLOCK = 16_384

# The selectors of Simple-8b as (ids in a word, bits of each), by selector; the last one is the escape.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
#: A word of the last selector with this payload stands for the next of the escapes.
ESCAPED = np.uint64((1 << 60) - 1)

SEGMENTS = "shard long, segment long, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, words binary, escapes binary, block_words array<long>, block_escapes array<long>"
_FIELDS = [x.split() for x in SEGMENTS.split(", ")]
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_SEGMENT = pa.schema([(name, _KINDS[kind]) for name, kind in _FIELDS])


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words and escapes of a block of unsigned integers, each word taking as many ids as fit."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    wide = ids >= ESCAPED
    width = np.zeros(n + 240, np.uint8)
    for bits in sorted({b for _, b in SELECTORS}):
        width[:n] += ids >> np.uint64(bits) > 0  # the index of the narrowest width that holds the id
    widths = sorted({b for _, b in SELECTORS})
    best = np.full(n, len(SELECTORS) - 1, np.int64)
    reach = {1: width}
    for count in sorted({c for c, _ in SELECTORS})[1:]:
        # The largest width among the next count ids, from windows already known.
        have = max(c for c in reach if c <= count)
        top = reach[have].copy()
        while have < count:
            step = max(c for c in reach if c <= count - have)
            top[: len(top) - have] = np.maximum(top[: len(top) - have], reach[step][have:])
            have += step
        reach[count] = top
    for k in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[k]
        best[reach[count][:n] <= widths.index(bits)] = k
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    # Where words begin: the first one, and twice as many with every doubling of the step from word to word.
    jump = np.append(np.minimum(np.arange(n) + counts[best], n), n)
    begins = more = np.zeros(min(n, 1), np.int64)
    while len(more):
        more = jump[begins]
        more = more[more < n]
        begins, jump = np.concatenate([begins, more]), jump[jump]
    chosen = best[begins]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([np.where(wide, ESCAPED, ids), np.zeros(240, np.uint64)])
    for k, (count, bits) in enumerate(SELECTORS):
        if bits and len(where := np.flatnonzero(chosen == k)):
            for i in range(count):
                words[where] |= padded[begins[where] + i] << np.uint64(bits * i)
    return words, ids[wide]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[chosen]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(SELECTORS):
        if bits and len(where := np.flatnonzero(chosen == k)):
            mask = np.uint64((1 << bits) - 1)
            for i in range(count):
                out[begins[where] + i] = words[where] >> np.uint64(bits * i) & mask
    if len(escapes):
        last = begins[chosen == len(SELECTORS) - 1]
        out[last[out[last] == ESCAPED]] = escapes
    return out[:n]


def encode_segment(ids: np.ndarray) -> tuple[bytes, bytes, list[int], list[int]]:
    words, escapes, at_word, at_escape = [], [], [], []
    w = e = 0
    for begin in range(0, len(ids), BLOCK):
        at_word.append(w)
        at_escape.append(e)
        a, b = encode_block(ids[begin : begin + BLOCK])
        words.append(a)
        escapes.append(b)
        w, e = w + len(a), e + len(b)
    join = lambda x: np.concatenate([np.zeros(0, np.uint64), *x]).astype("<u8").tobytes()
    return join(words), join(escapes), at_word, at_escape


def decode_segment(words: bytes, escapes: bytes, at_word: list[int], at_escape: list[int], n: int) -> np.ndarray:
    words, escapes = np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8")
    parts = [np.zeros(0, np.uint64)]
    for k, begin in enumerate(range(0, n, BLOCK)):
        ends = [x[k + 1] if k + 1 < len(x) else None for x in (at_word, at_escape)]
        parts.append(decode_block(words[at_word[k] : ends[0]], escapes[at_escape[k] : ends[1]], min(BLOCK, n - begin)))
    return np.concatenate(parts)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, spaced: bool = False, end_id: int = 1, segment_ids: int = 262_144, slice_rows: int = 1024) -> None:
    """Writes the token ids of every whole text of docs (doc_id, text), each followed by end_id, under path.

    Documents lie in ascending doc_id order, null first, those of one doc_id in the order of their texts'
    hashes; repeated rows are all written. A null text counts as empty (one id). A segment closes at the
    document that brings it to segment_ids ids. An empty table gives a dataset without segments.
    tokenizer is a file every machine has.
    """
    file = tokenizer or tokenizer_path(WORD_BPE)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, shard = encoder(file, spaced, group_chars=3_000_000), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        segment = first = size = 0
        doc_ids, parts = [], []

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            values = (shard, segment, first, len(ids), doc_ids, [len(x) for x in parts], *encode_segment(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= segment_ids:
                        yield row()
                        segment, first, size, doc_ids, parts = segment + 1, first + size, 0, [], []
        if parts:
            yield row()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, SEGMENTS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a dataset: doc_id, start (ids of all documents before it), n_tokens, tokens (little-endian unsigned 32-bit ids)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()}
                ids = decode_segment(row["words"], row["escapes"], row["block_words"], row["block_escapes"], row["n_ids"])
                lens = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lens)
                raw = ids.astype("<u4")
                for a in range(0, len(lens), 1024):
                    own = slice(a, a + 1024)
                    tokens = [raw[e - n : e].tobytes() for e, n in zip(ends[own].tolist(), lens[own].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(tokens), pa.int64()), pa.array(row["doc_ids"][own], pa.int64()), pa.array(row["first"] + ends[own] - lens[own]), pa.array(lens[own]), pa.array(tokens, pa.binary())],
                        ["shard", "doc_id", "place", "n_tokens", "tokens"],
                    )

    docs = segments.drop("segment").mapInArrow(stream, "shard long, doc_id long, place long, n_tokens long, tokens binary")
    # A row for each shard, so a row for each writing task: the running sum over them is small.
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "tokens")
