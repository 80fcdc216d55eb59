"""Online observations into the catalog in one call: every record is checked and resolved, and all are published or none is.

Records are taken in their order: one sees what those before it in the call have brought. Within a call, new listings are one where store and URL
are equal, or store and external id (then that of the first such record); new products are one where GTINs are equal, else
reviewed keys, else listings.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.plans.publish import STATE, captured_images, decided, new_product_name
from tarifa.plans.validators import observation_issues

#: A call has so many records at most, as publishers send them; it bounds the call, not the work.
LIMIT = 100

# Fields of a record as they are read, and the tables.
FIELDS = (
    "source string, store_slug string, product_name string, normalized_name string, category string, presentation string, store_product_url string, image_url string, external_id string, gtin string, canonical_variant_key string, brand string, "
    "variant_label string, net_quantity decimal(20,6), unit string, pack_count int, price decimal(12,2), available boolean, regular_price decimal(12,2), promotion_price decimal(12,2), promotion_description string, membership_required boolean, "
    "membership_price decimal(12,2), stock_status string, valid_until string, observed_at string"
)
GOODS = ("brand", "gtin", "variant_label", "net_quantity", "unit", "pack_count", "canonical_variant_key")
TABLES = {
    "stores": "id string, slug string, country string, enabled boolean",
    "products": "id string, name string, normalized_name string, category string, brand string, gtin string, variant_label string, net_quantity decimal(20,6), unit string, pack_count int, canonical_variant_key string",
    "listings": "id string, store_id string, product_id string, branch_id string, external_name string, external_url string, store_product_url string, image_url string, presentation string, available boolean, source string, last_seen_at timestamp, external_id string",
    "snapshots": "id string, store_product_id string, branch_id string, captured_at timestamp, last_seen_at timestamp, price decimal(12,2), available boolean, source string, regular_price decimal(12,2), promotion_price decimal(12,2), promotion_description string, membership_required boolean, membership_price decimal(12,2), stock_status string, valid_until string, raw_payload string",
    "images": "store_product_id string, image_url string",
}


@dataclass
class Catalog:
    """stores, products, listings, snapshots and images with the columns of TABLES."""

    stores: DataFrame
    products: DataFrame
    listings: DataFrame
    snapshots: DataFrame
    images: DataFrame


class Refused(ValueError):
    """The call was refused: the position of the first record at fault and its error."""

    def __init__(self, position: int | None, error: str):
        super().__init__(error if position is None else f"record {position}: {error}")
        self.position, self.error = position, error


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)


def _id(*parts: Column) -> Column:
    return F.md5(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}))


def _with_listings(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """rows with listing, new_listing and the known product of it."""
    known = listings.filter("branch_id IS NULL")
    by = lambda column, kind: known.filter(F.col(column).isNotNull()).select(F.col("store_id"), F.concat(F.lit(kind), column).alias("name"), F.struct("id", "product_id").alias("hit"))
    names = by("store_product_url", "u").union(by("external_url", "u")).union(by("external_id", "e"))
    own = F.explode(F.array_compact(F.array(F.concat(F.lit("u"), "store_product_url"), F.concat(F.lit("e"), _filled("external_id")))))
    hits = rows.select("position", "store_id", own.alias("name")).join(names, ["store_id", "name"]).groupBy("position").agg(F.min("hit").alias("hit"))
    rows = rows.join(hits, "position", "left")
    # New ones: by URL, or by that of the first new record with this external id.
    first = F.first("store_product_url").over(Window.partitionBy("store_id", _filled("external_id"), F.col("hit").isNull()).orderBy("position"))
    url = F.when(_filled("external_id").isNotNull(), first).otherwise(F.col("store_product_url"))
    return rows.withColumns({"listing": F.coalesce("hit.id", _id(F.lit("listing"), F.col("store_id"), url)), "new_listing": F.col("hit").isNull(), "listed_product": F.col("hit.product_id")}).drop("hit")


def _with_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """rows that are applied, with product, new_product, rule, whether the identity is in conflict, and the name of new products."""
    p = products.select("*", S.canonical_gtin(_filled("gtin")).alias("_gtin"))
    by_gtin = p.filter("_gtin IS NOT NULL").groupBy(F.col("_gtin").alias("canonical")).agg(F.min("id").alias("by_gtin"))
    by_key = p.filter(F.col("canonical_variant_key").startswith("reviewed:")).groupBy(F.col("canonical_variant_key").alias("reviewed")).agg(F.min("id").alias("by_key"))
    rows = rows.join(by_gtin, "canonical", "left").join(by_key, "reviewed", "left")
    made = F.coalesce(F.concat(F.lit("g"), "canonical"), F.concat(F.lit("r"), "reviewed"), F.concat(F.lit("l"), "listing"))
    found = F.coalesce("by_gtin", "by_key", "listed_product")
    rule = F.when(F.col("by_gtin").isNotNull(), "gtin").when(F.col("by_key").isNotNull(), "reviewed_key").when(F.col("listed_product").isNotNull(), "listing").otherwise("new")
    rows = rows.withColumns({"rule": rule, "new_product": found.isNull(), "product": F.coalesce(found, _id(F.lit("product"), made))})
    of = p.select(F.col("id").alias("product"), F.col("_gtin").alias("p_gtin"), *[F.col(c).alias(f"p_{c}") for c in ("pack_count", "net_quantity", "unit")])
    rows = rows.join(of, "product", "left")
    # What the product has, or the records before have given it.
    held = lambda c, own: F.coalesce(f"p_{c}", F.first(own, ignorenulls=True).over(_before("product")))
    rows = rows.withColumns({"h_gtin": held("gtin", "canonical"), **{f"h_{c}": held(c, c) for c in ("pack_count", "net_quantity", "unit")}})
    differs = lambda a: F.coalesce(F.col("canonical" if a == "gtin" else a) != F.col(f"h_{a}"), F.lit(False))
    unit = F.col("net_quantity").isNotNull() & F.col("h_net_quantity").isNotNull() & differs("unit")
    rows = rows.withColumn("identity_conflict", differs("gtin") | differs("pack_count") | differs("net_quantity") | unit)
    names = products.select("normalized_name").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(names, "normalized_name", "left")
    starts = F.col("new_product") & (F.row_number().over(Window.partitionBy("product").orderBy("position")) == 1)
    rows = rows.withColumn("starts", starts)
    earlier = F.max("starts").over(_before("normalized_name"))
    return rows.withColumn("new_name", F.when(F.col("starts"), new_product_name(F.col("normalized_name"), F.coalesce("taken", earlier, F.lit(False)), F.col("store_slug"), F.col("store_product_url"))))


def judged(catalog: Catalog, records: DataFrame, sources: DataFrame, as_of: datetime) -> DataFrame:
    """records (position, raw) with error (null: none) and, where there is none, action, listing, product, rule and new_name.

    action is insert, unchanged, replay or late; a listing, product and rule are given of the first two alone. The errors, by record the first: an issue
    of validators.observation_issues(), invalid_gtin, unknown_store, conflicting_observation, conflicting_identity.
    """
    checked = observation_issues(records.select("position", "raw"), sources, as_of)
    issue = F.try_element_at("issues", F.lit(1))
    rows = checked.select("position", "raw", issue.alias("issue"), F.from_json("raw", FIELDS).alias("r")).select("position", "raw", "issue", "r.*")
    rows = rows.withColumns({"observed_at": S.parse_instant(F.col("observed_at")), "membership_required": F.coalesce("membership_required", F.lit(False)), "canonical": S.canonical_gtin(_filled("gtin"))})
    rows = rows.withColumn("reviewed", F.when(F.col("canonical_variant_key").startswith("reviewed:"), F.col("canonical_variant_key")))
    stores = catalog.stores.filter("country = 'MX' AND enabled").groupBy(F.col("slug").alias("store_slug")).agg(F.min("id").alias("store_id"))
    rows = rows.join(stores, "store_slug", "left")
    early = F.coalesce("issue", F.when(_filled("gtin").isNotNull() & F.col("canonical").isNull(), "invalid_gtin"), F.when(F.col("store_id").isNull(), "unknown_store"))
    rows = rows.withColumn("error", early)
    # Records with an error stop the call, so what follows need not see them.
    good = _with_listings(rows.filter("error IS NULL"), catalog.listings)
    known = Window.partitionBy("store_product_id").orderBy(F.col("captured_at").desc(), F.col("id").desc())
    newest = catalog.snapshots.filter("branch_id IS NULL").join(good.select(F.col("listing").alias("store_product_id")).distinct(), "store_product_id", "left_semi").withColumn("n", F.row_number().over(known)).filter("n = 1")
    newest = newest.select(F.col("store_product_id").alias("listing"), F.coalesce("last_seen_at", "captured_at").alias("observed_at"), *STATE)
    good = decided(good, newest, "listing", state=STATE)
    applied = _with_products(good.filter("action IN ('insert', 'unchanged')"), catalog.products).select("position", "product", "new_product", "rule", "identity_conflict", "new_name")
    good = good.join(applied, "position", "left")
    late = F.when(F.col("action") == "conflict", "conflicting_observation").when(F.col("identity_conflict"), "conflicting_identity")
    return rows.filter("error IS NOT NULL").unionByName(good.withColumn("error", late), allowMissingColumns=True)


def _last(column: str, **how: bool) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("position"))) if how.get("filled") else F.max_by(column, "position")


def _first(column: str) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("position")))


def publish_online(catalog: Catalog, records: DataFrame, sources: DataFrame, as_of: datetime, limit: int | None = LIMIT) -> tuple[Catalog, DataFrame]:
    """The catalog after the call, and the records as judged() has them. Refused, with nothing changed, if any record has an error or there are
    none or more than ``limit`` (None: any number) of them.

    A product's empty fields are filled, its others stay; a listing takes what its last record says (an image or external id only where given);
    an unchanged observation moves last_seen_at of the newest snapshot. New images of listings are captured.
    """
    n = records.limit((limit or 1) + 1).count()
    if not n or (limit and n > limit):
        raise Refused(None, f"Expected 1..{limit or 'any number of'} observations")
    rows = judged(catalog, records, sources, as_of).checkpoint()
    wrong = rows.filter("error IS NOT NULL").orderBy("position").select("position", "error").first()
    if wrong:
        raise Refused(wrong.position, wrong.error)
    c, done = F.col, rows.filter("action IN ('insert', 'unchanged')")

    goods = done.groupBy(c("product").alias("id")).agg(_first("new_name").alias("normalized_name"), F.min_by("product_name", "position").alias("name"), F.min_by("category", "position").alias("category"), *[_first("canonical" if g == "gtin" else g).alias(g) for g in GOODS])
    old = {f: c(f"o.{f}") for f in catalog.products.columns}
    both = catalog.products.alias("o").join(goods.alias("n"), "id", "full_outer")
    products = both.select("id", *[F.coalesce(old[f], F.when(old["normalized_name"].isNull() | F.lit(f in GOODS), F.nullif(c(f"n.{f}"), F.lit("")) if dict(goods.dtypes)[f] == "string" else c(f"n.{f}"))).alias(f) for f in catalog.products.columns if f != "id"])

    taken = ("product", "product_name", "store_product_url", "presentation", "available", "source")
    told = done.groupBy(c("listing").alias("id")).agg(F.first("store_id").alias("store_id"), F.min_by("store_product_url", "position").alias("first_url"), *[_last(f).alias(f) for f in taken], _last("image_url", filled=True).alias("image_url"), F.max_by(_filled("external_id"), F.when(_filled("external_id").isNotNull(), c("position"))).alias("external_id"), F.max("observed_at").alias("seen"))
    b = catalog.listings.alias("o").join(told.alias("n"), "id", "full_outer")
    is_told = c("n.store_id").isNotNull()
    new = {"store_id": c("o.store_id"), "product_id": c("n.product"), "branch_id": c("o.branch_id"), "external_name": c("n.product_name"), "external_url": c("o.external_url"), "store_product_url": c("n.store_product_url"), "image_url": F.coalesce("n.image_url", "o.image_url"), "presentation": c("n.presentation"), "available": c("n.available"), "source": c("n.source"), "last_seen_at": F.greatest("o.last_seen_at", "n.seen"), "external_id": F.coalesce("n.external_id", "o.external_id")}
    new |= {"store_id": F.coalesce("o.store_id", "n.store_id"), "external_url": F.when(c("o.store_id").isNull(), c("n.first_url")).otherwise(c("o.external_url"))}
    listings = b.select("id", *[F.when(is_told, v).otherwise(c(f"o.{f}")).alias(f) for f, v in new.items()]).select(*catalog.listings.columns)

    made = done.filter("action = 'insert'").select(_id(F.lit("snapshot"), c("listing"), F.unix_micros("observed_at")).alias("id"), c("listing").alias("store_product_id"), F.lit(None).cast("string").alias("branch_id"), c("observed_at").alias("captured_at"), c("observed_at").alias("last_seen_at"), *STATE, c("raw").alias("raw_payload"))
    every = catalog.snapshots.unionByName(made.select(*catalog.snapshots.columns))
    # An unchanged observation belongs to the newest snapshot at or before it.
    again = done.filter("action = 'unchanged'").select(c("listing").alias("store_product_id"), F.lit(None).cast("string").alias("branch_id"), c("observed_at").alias("captured_at"), c("raw").alias("again_raw"), F.lit(1).alias("again"))
    run = Window.partitionBy("store_product_id", "branch_id").orderBy("captured_at", F.coalesce("again", F.lit(0)), "id").rowsBetween(Window.unboundedPreceding, 0)
    marked = every.join(done.select(c("listing").alias("store_product_id")).distinct(), "store_product_id", "left_semi").unionByName(again, allowMissingColumns=True)
    marked = marked.withColumn("of", F.last("id", ignorenulls=True).over(run)).filter("again = 1")
    moved = marked.groupBy(c("of").alias("id")).agg(F.max("captured_at").alias("moved"), F.max_by("again_raw", "captured_at").alias("moved_raw"))
    snapshots = every.join(moved, "id", "left").withColumns({"last_seen_at": F.coalesce("moved", "last_seen_at"), "raw_payload": F.coalesce("moved_raw", "raw_payload")}).select(*catalog.snapshots.columns)
    seen = listings.join(told.select("id"), "id", "left_semi")
    return Catalog(catalog.stores, products.select(*catalog.products.columns), listings, snapshots, captured_images(seen, catalog.images)), rows


def publish_always(catalog: Catalog, records: DataFrame, sources: DataFrame, as_of: datetime, limit: int | None = LIMIT) -> tuple[Catalog, int]:
    """The earlier way to publish: products go by name, listings by URL, and every observation becomes a snapshot unless its listing has one of that
    instant. The catalog after the call and the number of snapshots inserted; Refused as in publish_online(), for issues and unknown stores.

    A product takes name and category of its last record; a listing takes what the latest observation says, if it isn't older than the last one seen.
    """
    n = records.limit((limit or 1) + 1).count()
    if not n or (limit and n > limit):
        raise Refused(None, f"Expected 1..{limit or 'any number of'} observations")
    c = F.col
    rows = observation_issues(records.select("position", "raw"), sources, as_of)
    rows = rows.select("position", "raw", F.try_element_at("issues", F.lit(1)).alias("issue"), F.from_json("raw", FIELDS).alias("r")).select("position", "raw", "issue", "r.*")
    stores = catalog.stores.filter("country = 'MX' AND enabled").groupBy(c("slug").alias("store_slug")).agg(F.min("id").alias("store_id"))
    rows = rows.withColumn("observed_at", S.parse_instant(c("observed_at"))).join(stores, "store_slug", "left")
    rows = rows.withColumn("error", F.coalesce("issue", F.when(c("store_id").isNull(), "unknown_store"))).checkpoint()
    wrong = rows.filter("error IS NOT NULL").orderBy("position").select("position", "error").first()
    if wrong:
        raise Refused(wrong.position, wrong.error)

    goods = rows.groupBy("normalized_name").agg(_last("product_name").alias("name"), _last("category").alias("category"))
    p = catalog.products.alias("o").join(goods.alias("n"), "normalized_name", "full_outer")
    own = {"id": F.coalesce("o.id", _id(F.lit("product"), c("normalized_name"))), "name": F.coalesce("n.name", "o.name"), "normalized_name": c("normalized_name"), "category": F.coalesce("n.category", "o.category")}
    products = p.select(*[own.get(f, c(f"o.{f}")).alias(f) for f in catalog.products.columns])

    known = catalog.listings.filter("branch_id IS NULL")
    urls = known.select("store_id", c("store_product_url").alias("url"), "id").union(known.select("store_id", c("external_url").alias("url"), "id")).filter("url IS NOT NULL").groupBy("store_id", "url").agg(F.min("id").alias("known"))
    rows = rows.join(urls, (rows["store_id"] == urls["store_id"]) & (rows["store_product_url"] == urls["url"]), "left").drop(urls["store_id"], "url")
    rows = rows.withColumn("listing", F.coalesce("known", _id(F.lit("listing"), c("store_id"), c("store_product_url"))))
    rows = rows.join(products.groupBy("normalized_name").agg(F.min("id").alias("product")), "normalized_name")
    fields = ("store_id", "product", "product_name", "store_product_url", "image_url", "presentation", "available", "source", "observed_at")
    told = rows.groupBy(c("listing").alias("id")).agg(F.max_by(F.struct(*fields), F.struct("observed_at", "position")).alias("n"))
    b = catalog.listings.alias("o").join(told, "id", "full_outer")
    taken = c("n").isNotNull() & (c("o.last_seen_at").isNull() | (c("o.last_seen_at") <= c("n.observed_at")))
    new = {"store_id": F.coalesce("o.store_id", "n.store_id"), "product_id": c("n.product"), "branch_id": c("o.branch_id"), "external_name": c("n.product_name"), "external_url": F.coalesce("o.external_url", "n.store_product_url"), "store_product_url": c("n.store_product_url"), "last_seen_at": c("n.observed_at"), "external_id": c("o.external_id")}
    new |= {f: c(f"n.{f}") for f in ("image_url", "presentation", "available", "source")}
    listings = b.select("id", *[F.when(taken, v).otherwise(c(f"o.{f}")).alias(f) for f, v in new.items()]).select(*catalog.listings.columns)

    first = Window.partitionBy("listing", "observed_at").orderBy("position")
    made = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select(_id(F.lit("snapshot"), c("listing"), F.unix_micros("observed_at")).alias("id"), c("listing").alias("store_product_id"), c("observed_at").alias("captured_at"), "price", "available", "source", c("raw").alias("raw_payload"))
    have = catalog.snapshots.filter("branch_id IS NULL").select("store_product_id", "captured_at")
    made = made.join(have, ["store_product_id", "captured_at"], "left_anti").checkpoint()
    return Catalog(catalog.stores, products, listings, catalog.snapshots.unionByName(made, allowMissingColumns=True).select(*catalog.snapshots.columns), catalog.images), made.count()
