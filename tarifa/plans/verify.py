"""Two versions of a paged search held against each other: every page for every set of arguments, by key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Search = Callable[..., DataFrame]


def walked(spark: SparkSession, search: Search, arguments: dict[str, dict], keys: list[str], pages: int) -> DataFrame:
    """case, page, place and keys of the first pages of a search under each named set of arguments. A page is what search(page=n, ...) gives."""
    found = []
    for case, given in arguments.items():
        for page in range(1, pages + 1):
            rows = search(page=page, **given).select(*keys)
            found.append(rows.select(F.lit(case).alias("case"), F.lit(page).alias("page"), F.monotonically_increasing_id().alias("place"), *keys))
    return reduce(DataFrame.unionByName, found)


def differences(spark: SparkSession, old: Search, new: Search, arguments: dict[str, dict], keys: list[str], pages: int = 3) -> DataFrame:
    """case, page, keys and finding of all that differs: missing (on a page of the old alone), unexpected (of the new alone), repeated (on two pages of the new).

    Keys that moved to another page are both. Equal versions without overlapping pages give no rows.
    """
    a, b = (walked(spark, s, arguments, keys, pages).drop("place").checkpoint() for s in (old, new))
    by = ["case", "page", *keys]

    def without(rows: DataFrame, other: DataFrame) -> DataFrame:
        o = other.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
        return rows.join(o, [rows[c].eqNullSafe(o[f"_{c}"]) for c in by], "left_anti")

    repeated = b.groupBy("case", *keys).agg(F.count_distinct("page").alias("_pages"), F.max("page").alias("page")).filter("_pages > 1").select(*by)
    found = [without(a, b).withColumn("finding", F.lit("missing")), without(b, a).withColumn("finding", F.lit("unexpected")), repeated.withColumn("finding", F.lit("repeated"))]
    return reduce(DataFrame.unionByName, found)


def summary(found: DataFrame, arguments: dict[str, dict]) -> DataFrame:
    """A row for each set of arguments: how many keys are missing, unexpected and repeated, and whether the versions agree."""
    cases = found.sparkSession.createDataFrame([(c,) for c in arguments], "case string")
    counts = found.groupBy("case").agg(*[F.count_if(F.col("finding") == f).alias(f) for f in ("missing", "unexpected", "repeated")])
    out = cases.join(counts, "case", "left").na.fill(0, ["missing", "unexpected", "repeated"])
    return out.withColumn("equal", F.col("missing") + F.col("unexpected") + F.col("repeated") == 0)
