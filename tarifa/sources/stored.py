"""Tables that are changed in place: rows lie in buckets by hash, a merge rewrites the buckets it changes, a version file commits it.

A table is a folder with ``data`` (a folder for each write, and in it one for each bucket) and ``versions`` (a file for each
commit, which names the writes that each bucket is in). Readers take the latest version, so they see a commit whole or not at all.
A version's file is made by a rename that fails where the file exists: of two writers that began from one version,
the second gets ConcurrentWrite, and nothing of it is seen. Object stores need a file system whose rename does that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarifa.operators.latest import merge_by


class ConcurrentWrite(RuntimeError):
    """Another writer has committed the version that this one was to make."""


class Commit(NamedTuple):
    """What a write did: the version after it, rows by kind, and the buckets written (none: nothing changed, and nothing is written)."""

    version: int
    inserted: int
    updated: int
    deleted: int
    buckets: list[int]


class StoredTable:
    """A table at path with unique keys, in ``buckets`` buckets by the hash of ``by`` (some or all of the keys).

    A merge reads and writes whole buckets, so their number should give buckets of some hundred MB at most; it is fixed by the first commit.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), keys, by or keys
        self._buckets = buckets

    # Files

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_version(self, number: int, state: dict) -> None:
        files, jvm = self._files(), self.spark._jvm
        draft, final = self._at("drafts", uuid.uuid4().hex), self._at("versions", f"{number:020d}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files.mkdirs(self._at("versions"))
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, how)
        except Exception as e:
            files.delete(draft, False)
            if files.exists(final):
                raise ConcurrentWrite(f"version {number} of {self.path} was written by another") from e
            raise

    def versions(self) -> list[int]:
        files, at = self._files(), self._at("versions")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in files.listStatus(at) if s.getPath().getName().endswith(".json")) if files.exists(at) else []

    def _state(self, version: int | None = None) -> tuple[int, dict | None]:
        """The version asked for, or the latest (-1: none yet), and what its file says."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return -1, None
        stream = self._files().open(self._at("versions", f"{version:020d}.json"))
        try:
            return version, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # Reading

    def bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.by), F.lit(buckets)).cast("int"))

    def _read(self, state: dict | None, buckets: set[int] | None = None) -> DataFrame | None:
        if state is None:
            return None
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/{write}/_bucket={b}" for b, writes in state["buckets"].items() if buckets is None or int(b) in buckets for write in writes]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows at a version (None: the latest); None before the first commit."""
        return self._read(self._state(version)[1])

    def lookup(self, wanted: DataFrame) -> DataFrame | None:
        """The rows whose ``by`` columns are among those of wanted; only buckets with such rows are read."""
        _, state = self._state()
        if state is None:
            return None
        wanted = self.bucketed(wanted.select(*self.by).distinct(), state["n"])
        touched = {r[0] for r in wanted.select("_bucket").distinct().collect()}  # as many as there are buckets at most
        found = self._read(state, touched)
        w = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in self.by])
        return found.join(w, [found[c].eqNullSafe(w[f"_w_{c}"]) for c in self.by], "left_semi")

    # Writing

    def _commit(self, base: int, state: dict | None, n: int, rows: DataFrame, buckets: list[int], whole: bool = True) -> int:
        """Writes rows as the whole content of the buckets, or in addition to what they have, and makes the next version of it."""
        write = uuid.uuid4().hex
        kept = {b: w for b, w in (state["buckets"] if state else {}).items() if not whole or int(b) not in buckets}
        # A bucket lies together, but is cut into several files where it is large: a common key's bucket has very many rows.
        dealt = self.bucketed(rows, n).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.keys)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{write}")
        for status in self._files().listStatus(self._at("data", write)):
            name = status.getPath().getName()
            if name.startswith("_bucket="):
                kept[name.split("=")[1]] = [*kept.get(name.split("=")[1], []), write]
        try:
            self._write_version(base + 1, {"schema": json.loads(rows.schema.json()), "n": n, "keys": self.keys, "by": self.by, "buckets": kept})
        except ConcurrentWrite:
            self._files().delete(self._at("data", write), True)
            raise
        return base + 1

    def _staged(self, rows: DataFrame, n: int, work: Callable[[DataFrame], Commit]) -> Commit:
        """work() on rows as written with their buckets: they are computed once, and removed after."""
        name = uuid.uuid4().hex
        self.bucketed(rows, n).write.parquet(f"{self.path}/staged/{name}")
        try:
            return work(self.spark.read.parquet(f"{self.path}/staged/{name}"))
        finally:
            self._files().delete(self._at("staged", name), True)

    def _same(self, a: DataFrame, b: DataFrame) -> list:
        return [a[k].eqNullSafe(b[k]) for k in self.keys]

    def _check_unique(self, rows: DataFrame) -> None:
        if rows.groupBy(*self.keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"rows to merge repeat a key of {self.keys}")

    def merge(self, rows: DataFrame, policy: dict[str, str] | None = None, since: int | None = None) -> Commit:
        """Merges rows by key, with a policy by column as of merge_by (default: the new value).

        Rows must be unique by key. Only buckets in which a row is new or gets another value are written. since is the version
        that rows were made from (default: the latest): if others have committed after it, ConcurrentWrite.
        """
        base, state = self._state(since)
        n = state["n"] if state else self._buckets

        def work(new: DataFrame) -> Commit:
            self._check_unique(new)
            columns = [c for c in new.columns if c != "_bucket"]
            if state is None:
                counts = {r[0]: r[1] for r in new.groupBy("_bucket").count().collect()}
                return Commit(self._commit(base, None, n, new.select(*columns), list(counts)), sum(counts.values()), 0, 0, sorted(counts))
            touched = {r[0] for r in new.select("_bucket").distinct().collect()}
            old = self._read(state, touched)
            columns = old.columns
            kinds = {c: "new" for c in columns if c in new.columns} | (policy or {})
            before = old.select("*", *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_old"))
            both = merge_by(before, new.drop("_bucket"), self.keys, kinds)  # what new doesn't have stays as it was
            differs = F.lit(False)
            for c in columns:
                differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
            changed = self.bucketed(both.filter(F.col("_old").isNull() | differs), n).groupBy("_bucket").agg(F.count_if(F.col("_old").isNull()), F.count_if(F.col("_old").isNotNull())).collect()
            buckets = sorted(r[0] for r in changed)
            if not buckets:
                return Commit(base, 0, 0, 0, [])
            content = merge_by(self._read(state, set(buckets)), new.filter(F.col("_bucket").isin(buckets)).drop("_bucket"), self.keys, kinds)
            return Commit(self._commit(base, state, n, content, buckets), sum(r[1] for r in changed), sum(r[2] for r in changed), 0, buckets)

        return self._staged(rows, n, work)

    def append(self, rows: DataFrame, since: int | None = None, checked: bool = False) -> Commit:
        """Adds rows whose keys the table doesn't have, which is for the caller to know; nothing that is there is read or written again.

        checked: rows that repeat a key among themselves are an error.
        """
        base, state = self._state(since)
        n = state["n"] if state else self._buckets

        def work(new: DataFrame) -> Commit:
            if checked:
                self._check_unique(new)
            counts = {r[0]: r[1] for r in new.groupBy("_bucket").count().collect()}
            if not counts:
                return Commit(base, 0, 0, 0, [])
            return Commit(self._commit(base, state, n, new.drop("_bucket"), list(counts), whole=False), sum(counts.values()), 0, 0, sorted(counts))

        return self._staged(rows, n, work)

    def compact(self, writes: int = 8) -> Commit:
        """Writes the buckets that are spread over more than so many writes anew."""
        base, state = self._state()
        buckets = sorted(int(b) for b, w in (state["buckets"] if state else {}).items() if len(w) > writes)
        return Commit(self._commit(base, state, state["n"], self._read(state, set(buckets)), buckets) if buckets else base, 0, 0, 0, buckets)

    def delete(self, rows: DataFrame, since: int | None = None) -> Commit:
        """Deletes the rows that have the keys of rows and, in the other columns that rows has, equal values: what changed meanwhile stays."""
        base, state = self._state(since)
        if state is None:
            return Commit(base, 0, 0, 0, [])

        def work(gone: DataFrame) -> Commit:
            touched = {r[0] for r in gone.select("_bucket").distinct().collect()}
            old = self._read(state, touched)
            g = gone.select(*[F.col(c).alias(f"_g_{c}") for c in gone.columns if c != "_bucket"])
            same = lambda df: [df[c[3:]].eqNullSafe(g[c]) for c in g.columns]
            hit = self.bucketed(old.join(g, same(old), "left_semi"), state["n"]).groupBy("_bucket").count().collect()
            buckets = sorted(r[0] for r in hit)
            if not buckets:
                return Commit(base, 0, 0, 0, [])
            held = self._read(state, set(buckets))
            return Commit(self._commit(base, state, state["n"], held.join(g, same(held), "left_anti"), buckets), 0, 0, sum(r[1] for r in hit), buckets)

        return self._staged(rows, state["n"], work)

    def vacuum(self, keep: int = 2) -> int:
        """Removes what only versions before the last ``keep`` name; returns how many writes that was. Call it while nobody writes."""
        versions, files = self.versions(), self._files()
        used = {w for v in versions[-keep:] for writes in self._state(v)[1]["buckets"].values() for w in writes}
        writes = {s.getPath().getName() for s in files.listStatus(self._at("data"))} if files.exists(self._at("data")) else set()
        for v in versions[:-keep]:
            files.delete(self._at("versions", f"{v:020d}.json"), False)
        for w in writes - used:
            files.delete(self._at("data", w), True)
        return len(writes - used)
