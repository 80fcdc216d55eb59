"""Searches for a text anywhere in a name, by an index of three-letter grams: what lacks a gram of the text isn't looked at.

The index is a stored table with a row for each gram and id, in buckets by gram, so a search reads the buckets of its own grams. The text is a LIKE pattern
whose wildcards are live; only its literal runs have grams. Whatever passes the index is held against the pattern itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.sources.stored import Commit, StoredTable

SIZE = 3


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case; none for null and shorter ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - SIZE + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(SIZE)))
    return F.array_distinct(F.filter(every, lambda g: F.char_length(g) == SIZE))


def literal_runs(text: str) -> list[str]:
    """What must stand in a row as it is: the runs between wildcards and escapes of at least a gram's length."""
    return [run for run in re.split(r"\\.|[%_\\]", text, flags=re.DOTALL) if len(run) >= SIZE]


class TrigramIndex:
    """Which ids have a gram in one of their texts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.table = StoredTable(spark, path, ["gram", "id"], by=["gram"], buckets=buckets)

    def add(self, rows: DataFrame, *texts: str) -> Commit:
        """Rows (id and texts) that are new or have changed. Grams that a text has lost stay, and cost a look at the row."""
        found = F.array_union(grams(F.col(texts[0])), grams(F.col(texts[1]))) if len(texts) == 2 else F.array_distinct(F.flatten(F.array(*[grams(F.col(t)) for t in texts])))
        return self.table.merge(rows.select(F.explode(found).alias("gram"), "id").distinct())

    def candidates(self, text: str | None) -> DataFrame | None:
        """The ids that have all grams of the text; None if it has none, so any row may match."""
        runs = literal_runs((text or "").strip())
        if not runs:
            return None
        # Grams are cut by Spark, as those in the index were.
        wanted = self.spark.createDataFrame([(r,) for r in runs], "run string").select(F.explode(grams(F.col("run"))).alias("gram")).distinct()
        n, found = wanted.count(), self.table.lookup(wanted)
        if found is None:
            return None
        return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("id")


def search(rows: DataFrame, index: TrigramIndex, text: str | None, *texts: str) -> DataFrame:
    """The rows (id and texts) of which a text contains the text asked for, as catalog searches have it; all rows for a blank one."""
    matches = S.matches_search(text, *[F.col(t) for t in texts])
    if matches is None:
        return rows
    ids = index.candidates(text)
    return rows.filter(matches) if ids is None else rows.join(ids, "id", "left_semi").filter(matches)
