"""Operators on observation histories: latest rows, repeats, retention, compaction, idempotent inserts and merges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions.scalars import instant

HISTORY_KEYS = ["store_product_id", "branch_id", "price_scope"]


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: rows are dropped within tasks before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_by(df: DataFrame, keys: list[str], time: str = "captured_at", tie: str = "id") -> DataFrame:
    return first_by(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def drop_repeats(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(df, keys, order)


def retention_candidates(snapshots: DataFrame, as_of: datetime, days: int = K.RETENTION_DAYS) -> DataFrame:
    """Rows from before the cutoff that aren't the last of their listing, branch and scope (null branches are alike)."""
    w = Window.partitionBy(*HISTORY_KEYS).orderBy("captured_at", "id")
    newer = F.lead(F.lit(True)).over(w)
    cutoff = instant(as_of) - F.make_dt_interval(F.lit(days))
    return snapshots.withColumn("_newer", newer).filter(F.col("_newer") & (F.col("captured_at") < cutoff)).drop("_newer")


def compaction_candidates(snapshots: DataFrame, state: list[str]) -> DataFrame:
    """Interior rows of runs of one state: both neighbours exist and have the same state, nulls alike. Each run keeps its ends."""
    w = Window.partitionBy(*HISTORY_KEYS).orderBy("captured_at", "id")
    now = F.struct(*state)
    same = lambda other: F.coalesce(other.eqNullSafe(now) & other.isNotNull(), F.lit(False))
    marked = snapshots.withColumn("_removable", same(F.lag(now).over(w)) & same(F.lead(now).over(w)))
    return marked.filter("_removable").drop("_removable")


def remove_checked(table: DataFrame, candidates: DataFrame, fingerprint: Column) -> DataFrame:
    """table without the candidates (id, fingerprint) whose row hasn't changed since."""
    gone = candidates.select(F.col("id").alias("_id"), F.col("fingerprint").alias("_print"))
    marked = table.withColumn("_own", fingerprint)
    return marked.join(gone, (marked["id"] == gone["_id"]) & (marked["_own"] == gone["_print"]), "left_anti").drop("_own")


def state_changes(df: DataFrame, keys: list[str], order: list[str], state: list[str]) -> DataFrame:
    """Rows whose state differs from the row before in their key, and each key's first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*state)
    marked = df.withColumn("_before", F.lag(now).over(w))
    return marked.filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def on_time(df: DataFrame, keys: list[str], arrival: list[str], time: str) -> DataFrame:
    """Rows that aren't older than what their key has already seen, in order of arrival."""
    w = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_seen", F.max(time).over(w)).filter(F.col("_seen").isNull() | (F.col(time) >= F.col("_seen"))).drop("_seen")


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of rows whose key isn't in table; null keys match nulls. Rows that repeat a key among themselves are for the caller to settle."""
    known = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = [rows[k].eqNullSafe(known[f"_k_{k}"]) for k in keys]
    return rows.join(known, same, "left_anti")


def merge_by(table: DataFrame, rows: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """table with rows merged in by key: for each column ``new`` takes the new value, ``coalesce`` the new one unless null, ``old`` the old one unless null."""
    a, b = table.alias("a"), rows.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    marked = a.withColumn("_in", F.lit(True)).alias("a").join(b.withColumn("_new", F.lit(True)).alias("b"), on, "full_outer")
    out = []
    for c in table.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}") if c in rows.columns else F.lit(None)
        kind = "coalesce" if c in keys else policy.get(c, "coalesce")
        value = {"new": F.when(F.col("b._new"), new).otherwise(old), "coalesce": F.coalesce(new, old), "old": F.coalesce(old, new)}[kind]
        out.append(value.alias(c))
    return marked.select(*out)


def without_matches(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(other.select(*keys).distinct(), keys, "left_anti")


def with_matches(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(other.select(*keys).distinct(), keys, "left_semi")


def differences(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys with side: missing (only expected) or unexpected (only found)."""
    missing = without_matches(expected, found, keys).select(*keys, F.lit("missing").alias("side"))
    return missing.unionByName(without_matches(found, expected, keys).select(*keys, F.lit("unexpected").alias("side"))).distinct()


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Every group's first row, then every group's second and so on, at most ``limit``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", group).limit(limit)


def rekey(table: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """table with the values of a column replaced by what pairs (old, new) say."""
    p = pairs.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return table.join(p, table[column] == p["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
