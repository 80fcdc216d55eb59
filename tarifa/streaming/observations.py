"""The publisher over a stream: each micro-batch is decided by the rules of the batch, against a table of what is known."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.plans.publish import STATE, decided


def publishing(observations: DataFrame, path: str, key: str = "store_product_id", order: str = "position", time: str = "observed_at", state: tuple[str, ...] = STATE, retention_days: int = K.RETENTION_DAYS) -> DataStreamWriter:
    """A writer that decides a stream of observations; the caller sets its checkpoint and trigger and starts it.

    Under path it keeps ``decisions`` (the batch's rows with action), ``rejected`` (those in conflict) and ``known`` (per key the
    latest instant and its first state), each by batch, so a batch that runs again replaces what it wrote. Rows of
    a batch are taken in the order of ``order``. Keys not seen for ``retention_days`` before the latest instant are forgotten.
    Decisions are plans.publish.decided(): sorted windows that spill, so a key with a third of the rows is no frame in memory.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = known(spark, path, number)
        found = decided(batch, before, key, order, time, state)
        found.write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        found = spark.read.parquet(f"{path}/decisions/batch={number}")
        found.filter("action = 'conflict'").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        rows = found.filter("action IN ('insert', 'unchanged')").select(key, time, F.struct(*state).alias("facts"))
        if before is not None:
            rows = rows.unionByName(before.select(key, time, F.struct(*state).alias("facts")))
        latest = rows.groupBy(key).agg(F.max(time).alias(time), F.max_by("facts", time).alias("facts")).select(key, time, "facts.*")
        top = rows.agg(F.max(time).alias("top")).first().top
        if top is not None:
            latest = latest.filter(F.col(time) > F.lit(top - timedelta(days=retention_days)))
        latest.write.mode("overwrite").parquet(f"{path}/known/{number:012d}")

    return observations.writeStream.foreachBatch(step)


def known(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What was known after the batch before this one; None for the first."""
    return spark.read.parquet(f"{path}/known/{before - 1:012d}") if before > 0 else None


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/decisions")


def valid_now(observations: DataFrame, as_of=None, time: str = "observed_at") -> DataFrame:
    """Observations of the last seven days, at most five minutes ahead of the clock (by default that of each micro-batch)."""
    return observations.filter(S.in_catalog_window(F.col(time), F.current_timestamp() if as_of is None else as_of))


def first_seen(observations: DataFrame, time: str = "observed_at", within: str = "7 days") -> DataFrame:
    """Each source and content hash once, for as long as the watermark keeps them apart; with valid_now() before it, nothing older comes."""
    return observations.withWatermark(time, within).dropDuplicatesWithinWatermark(["source", "content_hash"])
