"""The batch publisher over stored tables: a batch reads and rewrites only the buckets that it has rows in, and one that comes again writes nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.plans.batch import TABLES, State, prepared, published, settled
from tarifa.sources.stored import Commit, StoredTable

# Keys of the tables, and the columns that say in which bucket a row is: what a batch knows of a row before it has read it.
KEYS = {
    "staging": (["source", "content_hash"], None),
    "stores": (["slug"], None),
    "products": (["normalized_name"], None),
    "branches": (["source", "external_key"], None),
    "listings": (["store_id", "product_id", "external_url"], ["external_url"]),
    "snapshots": (["store_product_id", "branch_id", "captured_at"], ["store_product_id"]),
}


class StoredCatalog:
    """The tables of the batch publisher under path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.tables = {name: StoredTable(spark, f"{path.rstrip('/')}/{name}", keys, by, buckets) for name, (keys, by) in KEYS.items()}

    def read(self) -> State:
        return State(**{name: self._or_empty(name, t.read()) for name, t in self.tables.items()})

    def _or_empty(self, name: str, found: DataFrame | None) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def touched(self, r: DataFrame) -> State:
        """The rows that a batch of prepared() records can match or change."""
        c = F.col
        find = lambda name, wanted: self._or_empty(name, self.tables[name].lookup(wanted))
        listings = find("listings", r.select(c("store_product_url").alias("external_url")))
        return State(
            staging=find("staging", r.select("source", "content_hash")),
            stores=find("stores", r.select(c("store_slug").alias("slug"))),
            products=find("products", r.select("normalized_name")),
            branches=find("branches", r.select("source", c("branch_external_key").alias("external_key"))),
            listings=listings,
            # A listing that isn't known yet has no snapshots.
            snapshots=find("snapshots", listings.select(c("id").alias("store_product_id"))),
        )

    def publish(self, records: DataFrame, as_of: datetime) -> tuple[DataFrame, dict[str, Commit]]:
        """Publishes a batch of accepted, unique records (raw) as publish_batch() does: its report, and what was written of each table.

        Tables are written one after the other, snapshots last, each in one commit. A batch that was stopped between them is
        published again from the start: what it has written already stays as it is. Staging and snapshots only grow, so nothing that they have is written again
        (but a bucket of many writes, which becomes one).
        """
        since = {name: max(t.versions(), default=-1) for name, t in self.tables.items()}
        rows = settled(prepared(records))
        after, new, report = published(self.touched(rows), rows, as_of)
        report = self.spark.createDataFrame(report.collect(), report.schema)  # one row, of the state before the tables change
        base = {name: v if v >= 0 else None for name, v in since.items()}
        commits = {"staging": self._grow("staging", new, base)}
        for name, content in zip(("stores", "products", "branches", "listings"), after, strict=True):
            commits[name] = self.tables[name].merge(content, since=base[name])
        return report, commits | {"snapshots": self._grow("snapshots", new, base)}

    def _grow(self, name: str, new: dict[str, DataFrame], base: dict[str, int | None]) -> Commit:
        done = self.tables[name].append(new[name], since=base[name], checked=True)
        if done.buckets:
            self.tables[name].compact()
        return done
