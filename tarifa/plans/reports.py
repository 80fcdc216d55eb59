"""Coverage, freshness and quality reports, and checks of a load against what was expected."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.operators.latest import latest_by
from tarifa.plans.catalog import Tables

count_if = F.count_if


def product_coverage(latest: DataFrame) -> DataFrame:
    """Stores, branches, sources and the span of time by product."""
    return latest.groupBy("product_id", "product_name", "normalized_name", "category").agg(
        F.countDistinct("store_id").cast("int").alias("store_count"),
        F.countDistinct("branch_id").cast("int").alias("listing_count"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.min("captured_at").alias("oldest_observation_at"),
        F.max("captured_at").alias("last_updated_at"),
    )


def source_stats(t: Tables) -> DataFrame:
    return t.snapshots.groupBy("source").agg(
        F.count("*").cast("int").alias("total_snapshots"),
        F.countDistinct("store_product_id").cast("int").alias("total_listings"),
        F.countDistinct("branch_id").cast("int").alias("total_branches"),
        F.min("captured_at").alias("oldest_snapshot_at"),
        F.max("captured_at").alias("latest_snapshot_at"),
    )


def _as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row with a JSON object of key: value in order of the keys; {} for no rows."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.groupBy().agg(F.to_json(F.map_from_entries(entries)).alias(name))


def coverage_summary(t: Tables) -> DataFrame:
    """Totals, and snapshots, products and stores by source as JSON objects, in one row."""
    totals = t.snapshots.groupBy().agg(
        F.countDistinct("branch_id").cast("int").alias("total_branches"), F.count("*").cast("int").alias("total_price_snapshots"), F.max("captured_at").alias("latest_snapshot_at"), F.min("captured_at").alias("oldest_snapshot_at")
    )
    parts = [
        t.products.groupBy().agg(F.count("*").cast("int").alias("total_products")),
        t.stores.filter("enabled").groupBy().agg(F.count("*").cast("int").alias("total_stores")),
        totals,
        _as_map(t.snapshots.groupBy("source").agg(F.count("*").cast("int").alias("n")), "source", "n", "snapshots_by_source"),
        _as_map(t.listings.groupBy("source").agg(F.countDistinct("product_id").cast("int").alias("n")), "source", "n", "products_by_source"),
        _as_map(t.listings.groupBy("source").agg(F.countDistinct("store_id").cast("int").alias("n")), "source", "n", "stores_by_source"),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def branch_coverage(branches: DataFrame) -> DataFrame:
    status, found = F.col("geocoding_status"), F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return branches.groupBy().agg(
        F.count("*").cast("int").alias("total_normalized_branches"),
        count_if(status.isin(*K.GEOCODED) & found).cast("int").alias("total_geocoded_branches"),
        count_if(status == "review").cast("int").alias("total_review_geocoding"),
        count_if(status.isin("pending", "failed")).cast("int").alias("total_pending_geocoding"),
        F.countDistinct("city_code").cast("int").alias("total_city_codes"),
    )


def quality_summary(latest: DataFrame) -> DataFrame:
    """Counts over latest prices: completeness, age, implausible prices, sources and products."""
    n = lambda c, name: count_if(c).cast("int").alias(name)
    return latest.groupBy().agg(
        F.count("*").cast("int").alias("total_latest_prices"),
        n(F.col("image_url").isNotNull(), "with_image"),
        n(F.col("store_product_url").isNotNull(), "with_official_link"),
        *[n(F.col("freshness") == f, f"{f}_prices") for f in ("fresh", "stale", "old")],
        n(S.implausible(F.col("price")), "implausible_prices"),
        F.countDistinct("source").cast("int").alias("direct_sources"),
        F.countDistinct("product_id").cast("int").alias("covered_products"),
        n(F.col("branch_id").isNotNull(), "with_branch"),
        n(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "with_coordinates"),
    )


def coverage_matrix(t: Tables, catalog: DataFrame, as_of: datetime) -> DataFrame:
    """What each source covers, how, how fresh, and what stands in its way. catalog: source, capture_scope, status."""
    known = catalog.select("source").union(t.listings.select("source")).union(t.snapshots.select("source")).union(t.branches.select("source")).distinct()
    placed = F.col("geocoding_status").isin(*K.GEOCODED) & S.in_mexico(F.col("latitude"), F.col("longitude"))
    branches = t.branches.groupBy("source").agg(count_if(placed).cast("int").alias("branches_with_coordinates"))
    b = t.branches.select(F.col("id").alias("b_id"), F.col("store_id").alias("b_store"), F.coalesce(placed, F.lit(False)).alias("placed"))
    listed = t.listings.select(F.col("id").alias("store_product_id"), "store_id", "product_id", "store_product_url", "image_url")
    snaps = t.snapshots.join(listed, "store_product_id")
    snaps = snaps.join(b, (snaps["branch_id"] == b["b_id"]) & (snaps["store_id"] == b["b_store"]), "left")
    in_branch = F.col("branch_id").isNotNull()
    counts = snaps.groupBy("source").agg(
        F.count("*").cast("int").alias("prices_total"),
        count_if(in_branch).cast("int").alias("branch_prices"),
        count_if(~in_branch).cast("int").alias("online_prices"),
        F.countDistinct("branch_id").cast("int").alias("branches_with_snapshots"),
        F.countDistinct("product_id").cast("int").alias("n_products"),
        F.max("captured_at").alias("latest_capture"),
        count_if(S.implausible(F.col("price"))).cast("int").alias("implausible"),
        count_if(in_branch & ~F.coalesce("placed", F.lit(False))).cast("int").alias("unplaced"),
    )
    newest = latest_by(snaps, ["source", "store_product_id", "branch_id"])
    quality = newest.groupBy("source").agg(
        count_if(F.col("store_product_url").isNull() | ~F.col("store_product_url").rlike("(?i)^https?://")).cast("int").alias("without_url"), count_if(F.col("image_url").isNull()).cast("int").alias("without_image")
    )
    m = known.join(catalog, "source", "left").join(branches, "source", "left").join(counts, "source", "left").join(quality, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    unknown_status = zero("prices_total") == 0
    mode = (
        F.when((zero("branch_prices") > 0) & (zero("branches_with_coordinates") > 0), "branch_local")
        .when((zero("online_prices") > 0) & (zero("branch_prices") == 0), "online_only")
        .when((F.col("status") == "blocked") | (unknown_status & ~F.coalesce("status", F.lit("candidate")).isin("candidate", "validated")), "inactive")
        .otherwise("experimental")
    )
    state = (
        F.when(zero("implausible") > 0, "invalid_prices")
        .when(zero("unplaced") > 0, "invalid_branch_evidence")
        .when(zero("without_url") > 0, "missing_official_urls")
        .when(zero("without_image") > 0, "incomplete_images")
        .when(zero("prices_total") == 0, "no_observations")
        .otherwise("ok")
    )
    old = F.col("latest_capture") < S.instant(as_of) - F.make_dt_interval(F.lit(K.STALE_DAYS))
    said = [
        F.when(zero("prices_total") == 0, "no snapshots"),
        F.when((F.col("capture_scope") == "branch") & (zero("branch_prices") == 0), "declared branch source without branch snapshots"),
        F.when((zero("online_prices") > 0) & (zero("branch_prices") == 0), "online prices have no branch_id evidence"),
        F.when(zero("unplaced") > 0, F.format_string("%s branch snapshots lack valid coordinates", zero("unplaced"))),
        F.when(old, "latest capture is older than 21 days"),
        F.when(zero("implausible") > 0, F.format_string("%s implausible prices", zero("implausible"))),
        F.when(zero("without_url") > 0, F.format_string("%s latest listings lack official URL", zero("without_url"))),
    ]
    order = F.when(F.col("mode") == "branch_local", 1).when(F.col("mode") == "online_only", 2).when(F.col("mode") == "experimental", 3).otherwise(4)
    return m.select(
        "source", mode.alias("mode"), F.coalesce("capture_scope", F.lit("unregistered")).alias("declared_scope"), F.coalesce("status", F.lit("unregistered")).alias("catalog_status"),
        zero("branches_with_coordinates").alias("branches_with_coordinates"), zero("branches_with_snapshots").alias("branches_with_snapshots"), zero("n_products").alias("products"), zero("prices_total").alias("prices"),
        "latest_capture", S.coverage_freshness(F.col("latest_capture"), as_of).alias("freshness"), state.alias("quality"), F.nullif(F.concat_ws("; ", *said), F.lit("")).alias("blockers"),
    ).orderBy(order, "source")


def source_verification(t: Tables, as_of: datetime) -> DataFrame:
    """By source: listings, snapshots, invalid and future rows, and keys that repeat, in one pass over the snapshots and one over its keys."""
    now = S.instant(as_of)
    online = F.col("branch_id").isNull()
    base = t.snapshots.groupBy("source").agg(
        F.count("*").alias("snapshots"),
        F.countDistinct("store_product_id").alias("listings"),
        count_if(F.col("price") <= 0).alias("invalid_prices"),
        count_if(F.col("currency") != K.CURRENCY).alias("other_currencies"),
        count_if(F.col("captured_at") > now).alias("future"),
        count_if((F.col("price_scope") == "online") != online).alias("scope_conflicts"),
        F.max("captured_at").alias("latest"),
    )
    keys = t.snapshots.groupBy("source", "store_product_id", "branch_id", "captured_at").agg(F.count("*").alias("n"))
    twice = keys.filter("n > 1").groupBy("source").agg(F.count("*").alias("repeated_keys"))
    return base.join(twice, "source", "left").withColumn("repeated_keys", F.coalesce("repeated_keys", F.lit(0)))


def expected_vs_current(expected: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """By source: how many expected rows there are, and how many the catalog has with equal values in the columns (null like null)."""
    have = catalog.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct().withColumn("_have", F.lit(True))
    rows = expected.join(have, [expected[c].eqNullSafe(have[f"_{c}"]) for c in columns], "left")
    return rows.groupBy("source").agg(F.count("*").alias("expected"), F.count("_have").alias("matched"))


def sources_overview(catalog: DataFrame, t: Tables, as_of: datetime) -> DataFrame:
    """Registered sources with their statistics and health; sources without snapshots count 0."""
    stats = source_stats(t)
    rows = catalog.select("source", "capture_scope", "status").join(stats, "source", "left")
    for c in ("total_snapshots", "total_listings", "total_branches"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    return rows.withColumn("health", S.source_health(F.col("latest_snapshot_at"), as_of))


def gate(reports: DataFrame, ok: Column) -> DataFrame:
    """One row: how many reports there are, how many fail, and whether all may be published (none may where there are none)."""
    return reports.groupBy().agg(F.count("*").alias("reports"), count_if(~F.coalesce(ok, F.lit(False))).alias("failing")).withColumn("publish", (F.col("reports") > 0) & (F.col("failing") == 0))
