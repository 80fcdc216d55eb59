"""Exact deduplication over any time: an index of all keys ever seen, with Bloom filters in front.

The index is a stored table in buckets by the hash of the key, to which each batch adds its new keys. A batch also adds a Bloom filter for each bucket
that it has keys in. Most keys of a batch are new, and the filters say so; only of the others are the buckets read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tarifa.sources.stored import StoredTable
from tarifa.streaming.runs import run_of

HASHES = 7


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places of each key among bits (a power of two)."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return (h1.astype(np.uint64)[:, None] + steps * (h2.astype(np.uint64) | np.uint64(1))[:, None]) & np.uint64(bits - 1)


def _filter(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """A filter with ten bits or more for each key, so that one in a hundred others passes."""
    bits = 1 << max(6, int(10 * len(h1) - 1).bit_length())
    set_ = np.zeros(bits, np.uint8)
    set_[_places(h1, h2, bits).ravel().astype(np.int64)] = 1
    return np.packbits(set_, bitorder="little").tobytes()


def _passes(filter_: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    held = np.frombuffer(filter_, np.uint8)
    at = _places(h1, h2, 8 * len(held)).astype(np.int64)
    return (held[at >> 3] >> (at & 7) & 1).all(axis=1)


class SeenIndex:
    """All keys ever given to new_rows(). buckets: as of StoredTable; a bucket's filters, ten bits a key, are what a task holds."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("source", "content_hash"), buckets: int = 256):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.index = StoredTable(spark, f"{self.path}/keys", self.keys, buckets=buckets)
        self.filters = StoredTable(spark, f"{self.path}/filters", ["slot", "batch"], by=["slot"], buckets=buckets)
        self.buckets = buckets

    def _hashed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*self.keys)
        return rows.withColumns({"slot": F.pmod(h, F.lit(self.buckets)).cast("int"), "h1": h, "h2": F.xxhash64(*self.keys, F.lit("second"))})

    def maybe_seen(self, rows: DataFrame) -> DataFrame:
        """rows (keys, slot, h1, h2) with maybe: false for those that were certainly not seen."""
        filters = self.filters.lookup(rows.select("slot"))
        if filters is None:
            return rows.withColumn("maybe", F.lit(False))
        # Filters of a slot stand before its keys; keys come in batches, each tested against all of them.
        columns = rows.columns
        both = rows.withColumn("bits", F.lit(None).cast("binary")).unionByName(filters.select("slot", "bits"), allowMissingColumns=True)
        schema = rows.withColumn("maybe", F.lit(False)).schema

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                slots, bits = batch.column("slot").to_numpy(), batch.column("bits")
                given = np.array(bits.is_valid())
                maybe = np.zeros(len(slots), bool)
                h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
                for a, b in zip(*(np.concatenate(x) for x in (([0], np.flatnonzero(np.diff(slots)) + 1), (np.flatnonzero(np.diff(slots)) + 1, [len(slots)]))), strict=True) if len(slots) else ():
                    if slots[a] != now:
                        now, held = slots[a], []
                    held += [bits[i].as_py() for i in range(a, b) if given[i]]
                    own = a + np.flatnonzero(~given[a:b])
                    if len(own):
                        k1, k2 = h1[own].astype(np.int64), h2[own].astype(np.int64)
                        for f in held:
                            maybe[own] |= _passes(f, k1, k2)
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(maybe)], [*columns, "maybe"])
                yield out.filter(pa.array(~given))

        # Hashes as numbers without nulls, so that no digit is lost on the way.
        whole = both.withColumns({"h1": F.coalesce("h1", F.lit(0)), "h2": F.coalesce("h2", F.lit(0))})
        return whole.repartition("slot").sortWithinPartitions("slot", F.col("bits").isNull()).mapInArrow(test, schema)

    def new_rows(self, batch: DataFrame, name: str, order: list[str]) -> DataFrame:
        """The first row by ``order`` of each key of batch that no batch with another name had; the key is remembered under this name.

        Called again with a batch and its name, it gives the same rows and adds nothing. Null keys are keys like others.
        """
        folder = f"{self.path}/batches/{name}"
        w = Window.partitionBy(*self.keys).orderBy(*order)
        first = self._hashed(batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"))
        first.write.mode("overwrite").parquet(f"{folder}/first")
        first = self.spark.read.parquet(f"{folder}/first")
        self.maybe_seen(first.select(*self.keys, "slot", "h1", "h2")).write.mode("overwrite").parquet(f"{folder}/tested")
        tested = self.spark.read.parquet(f"{folder}/tested")
        maybe = tested.filter("maybe").select(*self.keys)
        found = self.index.lookup(maybe)
        if found is None:
            old = again = maybe.filter("false")
        else:
            # The index is what decides; of equal names the batch is run again.
            found.write.mode("overwrite").parquet(f"{folder}/found")
            found = self.spark.read.parquet(f"{folder}/found")
            old, again = found.filter(F.col("batch") != name).select(*self.keys), found.filter(F.col("batch") == name).select(*self.keys)
        new = self._without(first, old)
        add = self._without(new, again).select(*self.keys, F.lit(name).alias("batch"), "slot", "h1", "h2")
        # Filters go first: a key in the index without a filter would not be found.
        self.filters.merge(self._filters(add, name))
        self.index.append(add.drop("slot", "h1", "h2"))
        return new.drop("slot", "h1", "h2")

    def _without(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        g = gone.select(*[F.col(k).alias(f"_g_{k}") for k in self.keys])
        return rows.join(g, [rows[k].eqNullSafe(g[f"_g_{k}"]) for k in self.keys], "left_anti")

    def _filters(self, keys: DataFrame, name: str) -> DataFrame:
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def row() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([_filter(*np.concatenate(held, axis=1))], pa.binary())], ["slot", "batch", "bits"])

            for batch in batches:
                slots = batch.column("slot").to_numpy()
                hashes = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")])
                cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a:
                        if slots[a] != now:
                            if held:
                                yield row()
                            now, held = int(slots[a]), []
                        held.append(hashes[:, a:b])
            if held:
                yield row()

        return keys.select("slot", "h1", "h2").repartition("slot").sortWithinPartitions("slot").mapInArrow(build, "slot int, batch string, bits binary")

    def compact(self, writes: int = 8) -> None:
        """Writes buckets of many batches anew, with one filter for each in place of theirs."""
        self.index.compact(writes)
        held = self.index.read()
        old = self.filters.read()
        if held is None:
            return
        many = [r[0] for r in old.groupBy("slot").count().filter(F.col("count") > writes).collect()]  # buckets at most
        if many:
            gone = old.filter(F.col("slot").isin(many)).select("slot", "batch")
            gone.write.mode("overwrite").parquet(f"{self.path}/batches/compacted")
            version = self.filters.merge(self._filters(self._hashed(held).filter(F.col("slot").isin(many)), "all")).version
            gone = self.spark.read.parquet(f"{self.path}/batches/compacted").filter("batch <> 'all'")
            self.filters.delete(gone, since=version)


def first_seen_ever(observations: DataFrame, path: str, checkpoint: str, order: list[str], keys: tuple[str, ...] = ("source", "content_hash"), buckets: int = 256) -> DataStreamWriter:
    """A writer that keeps, under ``path/rows``, the first row of each key of a stream, over all runs and whatever the watermark.

    The caller sets the trigger and starts it; a batch that runs again replaces what it wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, checkpoint)
        new = SeenIndex(spark, f"{path}/index", keys, buckets).new_rows(batch, f"{run}-{number}", order)
        new.write.mode("overwrite").parquet(f"{path}/rows/run={run}/batch={number}")

    return observations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
