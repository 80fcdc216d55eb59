"""Sets of word shingles as sorted 64-bit keys, and exact similarity of pairs of them, with bitmaps that spare most of the reading."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import checkpointed, small_batches, written

SEED = 42
#: Bits of the parity bitmaps.
BITS = 4096
#: Multipliers of the words in a shingle, and what is added for the words a short text lacks.
ODD = np.array([xxhash.xxh64_intdigest(f"word {k}", SEED) | 1 for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shingle_keys(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the word shingles of the texts one after the other, and how many each has. A-Z are lower-cased;
    a text of fewer words has the whole sequence, one without words none."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    parts = [[number[w] for w in (t or "").encode("utf-8", "surrogatepass").lower().split()] for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in number], np.uint64)
    number.default_factory = None  # it refers to its owner, and such a circle stays until Python happens to look for circles
    words = hashes[np.fromiter(chain.from_iterable(parts), np.int64, int(n.sum()))]
    begins = np.cumsum(n) - n
    left = np.repeat(begins + n, n) - np.arange(len(words))  # words from here to the end of the text
    whole = left >= shingle
    whole[begins[n > 0]] = True
    at, left = np.flatnonzero(whole), left[whole]
    padded = np.concatenate([words, np.zeros(shingle, np.uint64)])
    keys = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        keys += np.where(left > k, padded[at + k], np.uint64(k)) * ODD[k]
    return mix(keys), np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each of BITS places: whether an odd number of tokens is there. Two of them differ in no more bits than the sets in tokens."""
    odd = np.bincount((tokens >> np.uint64(7)).astype(np.int64) & BITS - 1, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, as texts and sets are wide."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """rid, n, shingles (the set, sorted, as bytes) and bitmap of texts (rid, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = [np.unique(shingle_keys([t.as_py()], shingle)[0]) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([parity(x) for x in sets], pa.binary())], ["rid", "n", "shingles", "bitmap"])

    return texts.select("rid", "text").mapInArrow(cut, "rid long, n long, shingles binary, bitmap binary")


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens that differ in at least so many can be similar: the tokens in common are at most (n + m - differ) / 2."""
    both = (n + m - differ) // 2
    return 100 * np.minimum(both, np.minimum(n, m)) >= percent * (n + m - np.minimum(both, np.minimum(n, m)))


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, BITS // 64)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of pairs whose sets have 100 * common >= percent * union; bitmaps decide which sets are fetched."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = np.bitwise_count(_words(batch.column("bits_a")) ^ _words(batch.column("bits_b"))).sum(axis=1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(may_link(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), differ, percent)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            kept = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda c, *columns: sets.select(F.col("rid").alias(c), *(F.col(x).alias(f"{y}_{c}") for x, y in columns))
    bits, whole = (("n", "n"), ("bitmap", "bits")), (("shingles", "set"),)
    with small_batches(pairs.sparkSession, 2048):
        likely = written(pairs.join(side("a", *bits), "a").join(side("b", *bits), "b").mapInArrow(prune, "a long, b long"), "likely")
    with small_batches(pairs.sparkSession, 128):
        return checkpointed(likely.join(side("a", *whole), "a").join(side("b", *whole), "b").mapInArrow(check, "a long, b long"))
