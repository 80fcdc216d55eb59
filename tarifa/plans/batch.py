"""A batch of staged records into the catalog: what is staged, which stores, products, branches and listings it brings, and the new snapshots.

publish_batch() is a function of the state and the batch: it gives the next state and a report, and a batch that comes again
changes nothing but the times a listing was last seen. Ids are hashes of natural keys, so tasks need no common counter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.operators.latest import first_by, insert_new, merge_by
from tarifa.plans.ingest import BRANCH_FIELDS, BRANCH_TEXTS
from tarifa.plans.validators import bound_to_known

# Fields of a staged record as they are read.
RECORD = (
    "source string, store_brand string, store_slug string, source_product_name string, normalized_name string, category string, presentation string, price decimal(12,2), currency string, available boolean, "
    "price_scope string, store_product_url string, image_url string, external_reference string, source_url string, evidence_kind string, review_status string, is_synthetic boolean, confidence_score double, content_hash string, "
    "validation_errors array<string>, captured_at string, observed_at string, branch_external_key string, branch_name string, branch_address string, branch_municipality string, branch_state string, latitude string, longitude string"
)

TABLES = {
    "staging": "id string, source string, content_hash string, payload string, review_status string",
    "stores": "id string, slug string, name string, country string, enabled boolean",
    "products": "id string, normalized_name string, name string, category string",
    "branches": "id string, source string, external_key string, store_id string, name string, address string, municipality string, state string, latitude double, longitude double, geocoding_status string, geocoding_provider string, geocoding_confidence double, geocoded_at timestamp",
    "listings": "id string, store_id string, product_id string, external_url string, external_name string, image_url string, presentation string, available boolean, last_seen_at timestamp, source string, branch_id string",
    "snapshots": "id string, store_product_id string, branch_id string, price_scope string, price decimal(12,2), currency string, available boolean, source string, captured_at timestamp, source_product_name string, source_store_name string, source_branch_name string, external_reference string, raw_payload string",
}


@dataclass
class State:
    staging: DataFrame
    stores: DataFrame
    products: DataFrame
    branches: DataFrame
    listings: DataFrame
    snapshots: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})


def _id(*parts: Column) -> Column:
    return F.md5(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})).alias("id")


def settled(df: DataFrame) -> DataFrame:
    """df computed once, where the session has a folder for that."""
    found = df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    return df.checkpoint() if found else df


def prepared(records: DataFrame) -> DataFrame:
    """Typed fields of unique records (raw), with the record itself as payload. Rows without a scope are a branch's."""
    r = records.select(F.col("raw").alias("payload"), F.from_json("raw", RECORD).alias("r")).select("payload", "r.*")
    times = {c: S.parse_instant(F.col(c)) for c in ("captured_at", "observed_at")}
    return r.withColumns(times | {"price_scope": F.coalesce("price_scope", F.lit("branch_local")), "validation_errors": F.coalesce("validation_errors", F.array().cast("array<string>")), "image_url": F.nullif("image_url", F.lit(""))})


def fit_to_publish(rows: DataFrame) -> DataFrame:
    """Rows of prepared() that may become prices: proven, accepted, confident, without errors, and whole for their scope."""
    c, number = F.col, r"^-?[0-9]+(\.[0-9]+)?$"
    proven = ~F.coalesce("is_synthetic", F.lit(False)) & (F.coalesce("evidence_kind", F.lit("unknown")) != "unknown") & (c("review_status") == "accepted") & c("observed_at").isNotNull()
    sure = c("source_url").rlike("(?i)^https?://") & (F.coalesce("confidence_score", F.lit(0.0)) >= K.MIN_CONFIDENCE) & (F.size("validation_errors") == 0)
    empty = lambda name: F.coalesce(name, F.lit("")) == ""
    no_branch, whole = F.lit(True), F.lit(True)
    for f in BRANCH_FIELDS:
        no_branch = no_branch & empty(f)
    for f in BRANCH_TEXTS:
        whole = whole & ~empty(f)
    lat, lon = (F.when(c(f).rlike(number), c(f).try_cast("double")) for f in ("latitude", "longitude"))
    scoped = F.when(c("price_scope") == "online", no_branch).when(c("price_scope") == "branch_local", whole & F.coalesce(S.in_mexico(lat, lon), F.lit(False)))
    return rows.filter(proven & sure & scoped)


def publish_batch(state: State, records: DataFrame, as_of: datetime) -> tuple[State, DataFrame]:
    """The state after a batch of accepted, unique records (raw: a JSON object each), and the report in one row."""
    after, new, report = published(state, settled(prepared(records)), as_of)
    return State(state.staging.unionByName(new["staging"]), *after, state.snapshots.unionByName(new["snapshots"])), report


def published(state: State, rows: DataFrame, as_of: datetime) -> tuple[tuple[DataFrame, ...], dict[str, DataFrame], DataFrame]:
    """What publish_batch() makes of settled rows of prepared(): stores, products, branches and listings after them, the rows that staging and snapshots (which only grow) get, and the report."""
    new_staging = insert_new(state.staging, rows.select(_id(F.col("source"), F.col("content_hash")), "source", "content_hash", "payload", "review_status"), ["source", "content_hash"])
    fit = settled(fit_to_publish(rows))
    c = F.col

    stores = first_by(fit.select("store_slug", "store_brand"), ["store_slug"], [c("store_brand").asc()]).select(_id(c("store_slug")), c("store_slug").alias("slug"), c("store_brand").alias("name"), F.lit(K.COUNTRY).alias("country"), F.lit(True).alias("enabled"))
    stores = merge_by(state.stores, stores, ["slug"], {"id": "old", "name": "new", "country": "old", "enabled": "new"})
    goods = first_by(fit.select("normalized_name", "source_product_name", "category"), ["normalized_name"], [c("source_product_name").asc(), c("category").asc()])
    goods = goods.select(_id(c("normalized_name")), "normalized_name", c("source_product_name").alias("name"), "category")
    products = merge_by(state.products, goods, ["normalized_name"], {"id": "old", "name": "new", "category": "coalesce"})

    placed = fit.join(stores.select(c("slug").alias("store_slug"), c("id").alias("store_id")), "store_slug").join(products.select("normalized_name", c("id").alias("product_id")), "normalized_name")
    placed = settled(placed)
    local = first_by(placed.filter("price_scope = 'branch_local'"), ["source", "branch_external_key"], [c("branch_name").asc(), c("branch_address").asc()])
    local = local.select(
        _id(c("source"), c("branch_external_key")), "source", c("branch_external_key").alias("external_key"), "store_id", c("branch_name").alias("name"), c("branch_address").alias("address"),
        c("branch_municipality").alias("municipality"), c("branch_state").alias("state"), c("latitude").cast("double").alias("latitude"), c("longitude").cast("double").alias("longitude"),
        F.lit("manual").alias("geocoding_status"), F.lit("official_source").alias("geocoding_provider"), F.lit(1.0).alias("geocoding_confidence"), F.lit(as_of).cast("timestamp").alias("geocoded_at"),
    )
    renewed = {f: "new" for f in ("name", "address", "municipality", "state", "latitude", "longitude", "geocoding_status", "geocoding_provider", "geocoding_confidence", "geocoded_at")}
    branches = merge_by(state.branches, local, ["source", "external_key"], {"id": "old", "store_id": "old"} | renewed)

    listed = first_by(placed, ["store_id", "product_id", "store_product_url"], [c("observed_at").desc(), c("content_hash").asc()])
    listed = listed.select(
        _id(c("store_id"), c("product_id"), c("store_product_url")), "store_id", "product_id", c("store_product_url").alias("external_url"), c("source_product_name").alias("external_name"), "image_url", "presentation", "available",
        c("observed_at").alias("last_seen_at"), "source", F.lit(None).cast("string").alias("branch_id"),
    )
    taken = {f: "new" for f in ("external_name", "image_url", "presentation", "available", "last_seen_at", "source", "branch_id")}
    listings = merge_by(state.listings, listed, ["store_id", "product_id", "external_url"], {"id": "old"} | taken)

    keys = ["store_id", "product_id", "store_product_url"]
    of_listing = listings.select("store_id", "product_id", c("external_url").alias("store_product_url"), c("id").alias("store_product_id"))
    of_branch = branches.select("source", c("external_key").alias("branch_external_key"), c("id").alias("branch_id"))
    found = placed.join(of_listing, keys).join(of_branch, ["source", "branch_external_key"], "left").filter((c("price_scope") == "online") == c("branch_id").isNull())
    found = first_by(found, ["store_product_id", "branch_id", "captured_at"], [c("external_reference").asc(), c("content_hash").asc()])
    candidates = settled(
        found.select(
            _id(c("store_product_id"), c("branch_id"), F.unix_micros("captured_at")), "store_product_id", "branch_id", "price_scope", "price", "currency", "available", "source", "captured_at", "source_product_name",
            c("store_brand").alias("source_store_name"), c("branch_name").alias("source_branch_name"), "external_reference", c("payload").alias("raw_payload"),
        )
    )
    inserted = settled(insert_new(state.snapshots, candidates, ["store_product_id", "branch_id", "captured_at"]))
    return (stores, products, branches, listings), {"staging": new_staging, "snapshots": inserted}, run_report(rows, new_staging, fit, candidates, inserted)


def run_report(rows: DataFrame, new_staging: DataFrame, fit: DataFrame, candidates: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: counts of a run, and its publishable records by source, branch and category as a JSON array in that order."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    groups = fit.groupBy("source", F.col("branch_external_key").alias("branch"), "category").agg(F.count("*").cast("int").alias("publishable"))
    lists = groups.agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "branch", "category", "publishable")))).alias("by_source_branch_category"))
    parts = [count(rows, "input_records"), count(new_staging, "new_staging_rows"), count(fit, "publishable"), count(candidates, "snapshot_candidates"), count(inserted, "inserted_snapshots"), lists]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    reused = (F.col("input_records") - F.col("new_staging_rows")).alias("reused_staging")
    skipped = (F.col("snapshot_candidates") - F.col("inserted_snapshots")).alias("skipped_existing_snapshots")
    return out.select("input_records", "new_staging_rows", reused, "publishable", "inserted_snapshots", skipped, "by_source_branch_category")


def refreshed(state: State, records: DataFrame, known: DataFrame, source: str, as_of: datetime) -> tuple[State, DataFrame, DataFrame]:
    """A batch in which only known listings are observed anew: the state after it, the report, and what was rejected and why.

    records: raw, a JSON object each; known: as of validators.bound_to_known(). No listing is added and none changes.
    """
    fields = ("source", "store_product_url", "source_url", "normalized_name", "source_product_name", "presentation", "store_slug", "captured_at", "category")
    rows = records.select("raw", *[S.json_text(F.col("raw"), f).alias(f) for f in fields])
    bound = settled(bound_to_known(rows, known, source))
    kept = bound.filter("reject_reason IS NULL").select(S.merged_json(F.col("raw"), F.to_json(F.struct("category"))).alias("raw"))
    after, report = publish_batch(state, kept, as_of)
    return after, report, bound.filter("reject_reason IS NOT NULL").select("store_product_url", "reject_reason")


def registered_sources(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """The catalog of sources with entries (source, capture_scope, status, ...) put in: a new scope holds, a blocked source stays blocked."""
    out = merge_by(catalog, entries, ["source"], {c: "new" for c in entries.columns if c not in ("source", "status")} | {"status": "new"})
    blocked = catalog.filter("status = 'blocked'").select("source", F.lit(True).alias("_blocked"))
    return out.join(blocked, "source", "left").withColumn("status", F.when(F.col("_blocked"), "blocked").otherwise(F.col("status"))).select(*catalog.columns)


def saved_products(state: State, batch: DataFrame, as_of: datetime) -> State:
    """The state with captured products of branches saved: the earlier path, in which an observation is always kept once per listing, branch and instant.

    batch: typed columns as of prepared(). Stores, products, branches and listings are merged as in publish_batch(), without its tests of evidence.
    """
    rows = batch.withColumns({"is_synthetic": F.lit(False), "evidence_kind": F.lit("store_api"), "review_status": F.lit("accepted"), "confidence_score": F.lit(1.0)})
    raw = F.to_json(F.struct(*[c for c in rows.columns if c != "payload"]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})
    after, _ = publish_batch(state, rows.select(raw.alias("raw")), as_of)
    return replace(after, staging=state.staging)


# Branches


def branch_merges(branches: DataFrame) -> DataFrame:
    """old and new: branches without a city code, and the one of the same source, store and name (whatever the case) that has one; the smallest if there are several."""
    key = ["source", "store_id", F.lower("name").alias("_name")]
    current = branches.filter("city_code IS NOT NULL").groupBy(*key).agg(F.min("id").alias("new"))
    return branches.filter("city_code IS NULL").select(F.col("id").alias("old"), *key).join(current, ["source", "store_id", "_name"]).select("old", "new")


def backfilled_branches(snapshots: DataFrame, listings: DataFrame) -> DataFrame:
    """A branch for each source and branch key of the snapshots, with the address of the latest of them.

    snapshots: store_product_id, source, source_city_code, source_store_name, source_branch_name, captured_at, raw_payload; listings: id, store_id.
    """
    c = F.col
    named = snapshots.filter("source_branch_name IS NOT NULL").withColumn("external_key", S.branch_key(c("source"), c("source_city_code"), c("source_store_name"), c("source_branch_name")))
    latest = first_by(named, ["source", "external_key"], [c("captured_at").desc_nulls_last(), c("id").desc()])
    # Keys of the official records and the columns that they fill.
    fields = {"direccion": "address", "colonia": "neighborhood", "cp": "postal_code", "municipio": "municipality", "entidad": "state"}
    out = latest.join(listings.select(c("id").alias("store_product_id"), "store_id"), "store_product_id")
    return out.select("store_id", "source", "external_key", c("source_branch_name").alias("name"), *[F.nullif(S.json_text(c("raw_payload"), k), F.lit("")).alias(v) for k, v in fields.items()], c("source_city_code").alias("city_code"))


def pending_geocoding(branches: DataFrame, limit: int) -> DataFrame:
    """The branches that wait longest for a place."""
    return branches.filter(F.col("geocoding_status").isin("pending", "failed")).orderBy("updated_at", "id").limit(limit)


def geocoded_branches(branches: DataFrame, results: DataFrame, threshold: float, as_of: datetime) -> DataFrame:
    """branches with what a geocoder found for some: results (id, latitude, longitude, confidence, error; no confidence: nothing found).

    Sure enough places are taken, others wait for review without a place; each attempt counts.
    """
    r = results.select("id", F.struct("latitude", "longitude", "confidence", "error").alias("_r"))
    j = branches.join(r, "id", "left")
    c, tried = F.col, F.col("_r").isNotNull()
    status = F.coalesce(S.geocode_status(c("_r.confidence"), threshold), F.lit("failed"))
    sure = tried & (status == "geocoded")
    kept = lambda new, old: F.when(sure, new).when(tried & (status == "review"), F.lit(None)).otherwise(c(old))
    return j.withColumns(
        {
            "latitude": kept(c("_r.latitude"), "latitude"),
            "longitude": kept(c("_r.longitude"), "longitude"),
            "geocoding_status": F.when(tried, status).otherwise(c("geocoding_status")),
            "geocoded_at": F.when(sure, F.lit(as_of).cast("timestamp")).otherwise(c("geocoded_at")),
            "geocoding_error": F.when(tried & (status == "failed"), F.coalesce("_r.error", F.lit("no_result"))).when(~tried, c("geocoding_error")),
            "geocoding_attempts": c("geocoding_attempts") + tried.cast("int"),
        }
    ).select(*branches.columns)


# Maintenance


def published_staging(staging: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Staged rows that were accepted and whose whole payload is that of a snapshot with their source and content hash: they may go.

    Payloads are compared as JSON, whatever the order of their keys.
    """
    canonical = lambda c: F.sha2(F.to_json(F.try_parse_json(c)), 256)
    p = snapshots.select("source", S.json_text(F.col("raw_payload"), "content_hash").alias("content_hash"), canonical("raw_payload").alias("_print")).filter("content_hash IS NOT NULL").distinct()
    marked = staging.filter("review_status = 'accepted' AND content_hash IS NOT NULL").withColumn("_print", canonical("payload"))
    return marked.join(p, ["source", "content_hash", "_print"], "left_semi").drop("_print")


def next_batch(rows: DataFrame, key: str, cursor=None, limit: int = 400) -> DataFrame:
    """The first rows after a cursor in order of a key."""
    return (rows if cursor is None else rows.filter(F.col(key) > F.lit(cursor))).orderBy(key).limit(limit)


def bounded(candidates: DataFrame, order: list[str], most: int) -> DataFrame:
    """The candidates if there are at most ``most``, else an error: one more than may be is looked at, and no further."""
    if candidates.select(F.lit(1)).limit(most + 1).count() > most:
        raise ValueError(f"More than {most} candidates")
    return candidates.orderBy(*order)


# Storage guards.
DATABASE_BYTES, ARCHIVE_BYTES, COMPACTION_ROWS, ARCHIVE_BATCHES = 400 << 20, 700 << 20, 50_000, 100


def capacity(batches: DataFrame, database_bytes: int) -> DataFrame:
    """One row over archive batches (n_rows, n_bytes): their totals, and which guard is passed (null: none)."""
    t = batches.agg(F.count("*").alias("batches"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
    over = (
        F.when(F.lit(database_bytes) >= DATABASE_BYTES, "database_size").when(F.col("n_bytes") > ARCHIVE_BYTES, "archive_size").when(F.col("n_rows") > COMPACTION_ROWS, "archive_rows").when(F.col("batches") > ARCHIVE_BATCHES, "archive_batches")
    )
    return t.withColumn("over", over)


def key_checks(rows: DataFrame, keys: list[str], allowed: dict[str, list]) -> DataFrame:
    """One row: rows, distinct keys, whether all values of some columns are allowed ones, and which aren't (sorted)."""
    other = {c: F.array_except(F.collect_set(c), F.lit(v)) for c, v in allowed.items()}
    checks = [F.coalesce(F.bool_and(F.col(c).isin(*v)), F.lit(True)).alias(f"{c}_allowed") for c, v in allowed.items()]
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys"), *checks, *[F.sort_array(x).alias(f"{c}_other") for c, x in other.items()])


def shared_values(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """key of both sides, and whether their arrays of values overlap."""
    return left.select(key, F.col(values).alias("_a")).join(right.select(key, F.col(values).alias("_b")), key).select(key, F.arrays_overlap("_a", "_b").alias("overlap"))


def result_positions(page: DataFrame, order: list[Column]) -> DataFrame:
    """A page of results with position, from 1, in an order. A page is small: its rows meet in one task."""
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)))
