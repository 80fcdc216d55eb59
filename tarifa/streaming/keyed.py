"""The publisher over a stream with keyed state: a listing's latest instant and state are kept by Spark, and a batch costs by its own listings.

State is forgotten when a listing has had no newer observation for the retention time. It belongs to a checkpoint; a stream with
a new checkpoint begins with what the decisions of earlier ones say. The state store must be RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tarifa import constants as K
from tarifa.plans.publish import STATE
from tarifa.streaming.runs import run_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a null time, which is late.
NEVER = -(1 << 63)


def folded(at: np.ndarray, facts: np.ndarray, seen: int | None, known: str | None) -> tuple[np.ndarray, int | None, str | None]:
    """What is decided for the observations of one listing, in order of arrival, and what is known after them.

    at: instants; facts: a digest of each state; seen and known: the latest instant so far and the first state at it.
    """
    start = NEVER if seen is None else seen
    before = np.maximum.accumulate(np.concatenate([[start], at]))[:-1]
    newer = at > before
    # The observation that is known before each: the last newer one, 0 stands for the state at the start.
    last = np.maximum.accumulate(np.concatenate([[0], np.where(newer, np.arange(1, len(at) + 1), 0)]))
    held = np.concatenate([np.array([known], object), facts])
    same, first = facts == held[last[:-1]], before == NEVER
    action = np.select([at == NEVER, newer & ~first & same, newer, at < before, same], ["late", "unchanged", "insert", "late", "replay"], "conflict")
    top = max(start, int(at.max(initial=NEVER)))
    return action, None if top == NEVER else top, held[last[-1]]


class Publisher(StatefulProcessor):
    """Decides the observations (key, order, at, facts) of a listing."""

    def __init__(self, key: str, order: str, ttl_ms: int):
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "at long, facts string", self.ttl_ms)

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        self.state.update((int(initial["at"].iloc[0]), initial["facts"].iloc[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # Narrow rows of one listing and micro-batch, whose size the source's options bound.
        own = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        seen, known = self.state.get() if self.state.exists() else (None, None)
        action, top, facts = folded(own["at"].to_numpy(np.int64), own["facts"].to_numpy(object), seen, known)
        if top is not None and top != seen:
            self.state.update((top, facts))
        yield pd.DataFrame({self.key: own[self.key], self.order: own[self.order], "at": own["at"], "facts": own["facts"], "action": action})


def narrow(observations: DataFrame, key: str, order: str, time: str, state: tuple[str, ...]) -> DataFrame:
    """What the decision needs: key, order, the instant in microseconds and a digest of the state."""
    facts = F.sha2(F.to_json(F.struct(*state), {"ignoreNullFields": "false"}), 256)
    return observations.select(key, order, F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(NEVER)).alias("at"), facts.alias("facts"))


def latest_known(decided: DataFrame, key: str, retention_days: int = K.RETENTION_DAYS) -> DataFrame:
    """key, at and facts of what decisions say is known of each listing seen in the retention time before the latest instant."""
    kept = decided.filter("action IN ('insert', 'unchanged')").groupBy(key).agg(F.max_by("facts", "at").alias("facts"), F.max("at").alias("at"))
    top = kept.agg(F.max("at").alias("top"))
    return kept.join(F.broadcast(top), F.col("at") > F.col("top") - retention_days * 86_400_000_000).select(key, "at", "facts")  # one row is broadcast


def decisions(spark: SparkSession, path: str) -> DataFrame | None:
    """All that was decided so far (key, order, at, facts, action, run and batch); None before anything was."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/decisions")
    return spark.read.parquet(f"{path}/decisions") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def publishing(observations: DataFrame, path: str, checkpoint: str, key: str = "store_product_id", order: str = "position", time: str = "observed_at", state: tuple[str, ...] = STATE, retention_days: int = K.RETENTION_DAYS) -> DataStreamWriter:
    """A writer that decides a stream of observations under ``path/decisions``; the caller sets its trigger and starts it.

    Decisions are those of plans.publish.decided(): order is the order of arrival in a batch, and must not be null. A batch that runs again
    replaces what it wrote. Earlier runs under path, with other checkpoints, are what a new checkpoint begins with. Sets two options of the session
    that the state needs when the stream starts.
    """
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Batches without data would only look for expired state, again and again, and a run over what is available would not end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = narrow(observations, key, order, time, state)
    output = rows.withColumn("action", F.lit("")).schema
    run, earlier = run_of(spark, checkpoint), decisions(spark, path)
    known = rows.sparkSession.createDataFrame([], rows.drop(order).schema) if earlier is None else latest_known(earlier.filter(F.col("run") != run), key, retention_days).select(*rows.drop(order).columns)
    found = rows.groupBy(key).transformWithStateInPandas(Publisher(key, order, retention_days * 86_400_000), output, "Append", "ProcessingTime", initialState=known.groupBy(key))

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/decisions/run={run}/batch={number}")

    return found.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(step)
