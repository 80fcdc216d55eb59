"""Upkeep of the price history as one run: what is old or repeats its neighbours is archived, read back, and only then deleted, if it is still the same.

A run goes over the buckets of the stored history in batches. A batch's rows are written to an archive of their own and read back against its
manifest; then the buckets are read again, and of the archived rows those are deleted that are unchanged and still may go, in one
commit that fails if anybody has written meanwhile. So wherever a run stops, each row is in the table or in a verified archive, or in both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.operators.latest import compaction_candidates, retention_candidates
from tarifa.plans.batch import ARCHIVE_BATCHES, ARCHIVE_BYTES, COMPACTION_ROWS, settled
from tarifa.sources.ndjson import restore_archive, write_archive
from tarifa.sources.stored import StoredTable

REPORT = "reason string, archive string, archived long, deleted long"


class BudgetReached(RuntimeError):
    """More is to be done, or more space is taken, than a run may; what was archived stays."""


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def _batches(counts: dict[int, int], rows: int) -> Iterator[list[int]]:
    """Buckets in order, as many at a time as have at most so many rows, one at least."""
    held, size = [], 0
    for bucket, n in sorted(counts.items()):
        if held and size + n > rows:
            yield held
            held, size = [], 0
        held, size = [*held, bucket], size + n
    if held:
        yield held


def maintain(
    history: StoredTable, archive: str, as_of: datetime, state: list[str], apply: bool = False, days: int = K.RETENTION_DAYS, batch_rows: int = 500, max_batches: int = ARCHIVE_BATCHES, max_repeats: int = COMPACTION_ROWS, max_bytes: int = ARCHIVE_BYTES,
    before_delete: Callable[[str], None] | None = None,
) -> DataFrame:
    """A report of what is archived and deleted, by batch: first rows from before the cutoff that have successors (retention), then rows inside a run of one state (repeated).

    history is a stored table with keys (store_product_id, ..., id) in buckets by store_product_id, so a listing's rows lie together. Without apply nothing is
    done, and the report has the rows that may go. A run takes at most max_batches batches of about batch_rows rows for each reason (whole buckets, so one with more is a batch of its own);
    more than max_repeats repeated rows, or archives of over max_bytes, raise BudgetReached. before_delete is called between archive and deletion.
    """
    spark, done = history.spark, []
    rules = {"retention": lambda rows: retention_candidates(rows, as_of, days), "repeated": lambda rows: compaction_candidates(rows, state)}
    for reason, may_go in rules.items():
        version, content = history._state()
        if content is None:
            break
        found = history.bucketed(may_go(history._read(content)), content["n"])
        counts = {r[0]: r[1] for r in found.groupBy("_bucket").count().collect()}  # buckets at most
        if not apply:
            done.append((reason, None, sum(counts.values()), 0))
            continue
        if reason == "repeated" and sum(counts.values()) > max_repeats:
            raise BudgetReached(f"{sum(counts.values())} repeated rows, and {max_repeats} may go in a run")
        for number, buckets in enumerate(_batches(counts, batch_rows)):
            if number == max_batches:
                break
            if _size(spark, archive) >= max_bytes:
                raise BudgetReached("archives take the space that they may")
            version, content = history._state()
            path = f"{archive}/{reason}-{uuid.uuid4().hex}"
            now = history._read(content, set(buckets))
            going = settled(may_go(now).select(*now.columns))
            n = write_archive(going, path).first().n_rows
            if before_delete:
                before_delete(path)
            latest, content = history._state()
            if latest == version:  # nobody has written: what was archived is as it was, and a commit on this version fails if somebody does
                same = going.select(*history.keys)
            else:
                now = history._read(content, set(buckets))
                archived = spark.read.schema(now.schema).json(f"{path}/rows")
                # All columns are compared, so a row that has changed since isn't among those that may go.
                same = may_go(now).select(*now.columns).intersect(archived)
            deleted = history.delete(same, since=latest).deleted
            done.append((reason, path, n, deleted))
            if deleted != n:
                raise RuntimeError(f"{n - deleted} of {n} rows have changed while they were archived; the archive stays for review: {path}")
    return spark.createDataFrame(done, REPORT)


def archives(spark: SparkSession, archive: str) -> list[str]:
    """The archives that have a manifest, so were read back."""
    at = spark._jvm.org.apache.hadoop.fs.Path(archive)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/manifest/_SUCCESS")))


def restored(history: StoredTable, archive: str, key: str = "id") -> int:
    """Puts archived rows back that the table doesn't have; how many there were."""
    n = 0
    for path in archives(history.spark, archive):
        table = history.read()
        missing = restore_archive(table, path, key).join(table.select(key), key, "left_anti").select(*table.columns)
        n += history.merge(missing).inserted
    return n
