"""Publishing observations into the history: late ones are left out, repeats move last_seen_at, changes are inserted.

What is decided for one observation depends on those before it in its listing. Only an observation newer than
all before it changes what is known, so the fold over a listing is a running maximum, and all of it is windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import scalars as S

# What makes the economic state of an offer.
STATE = ("price", "available", "source", "regular_price", "promotion_price", "promotion_description", "membership_required", "membership_price", "stock_status", "valid_until")


def decided(batch: DataFrame, known: DataFrame | None = None, key: str = "store_product_id", order: str = "position", time: str = "observed_at", state: tuple[str, ...] = STATE) -> DataFrame:
    """batch with action: insert, unchanged, replay, conflict or late.

    known has the latest row of each key: key, time (when last seen) and the state. Rows older than what has been
    seen are late; at the same instant, equal states are a replay and others a conflict; newer ones are unchanged or
    inserted by whether the state is that of the newest row before them. Null times are late.
    """
    facts = F.struct(*[F.col(c) for c in state]).alias("_state")
    rows = batch.select("*", facts, F.lit(1).alias("_side"))
    if known is not None:
        rows = rows.unionByName(known.select(key, time, facts, F.lit(0).alias("_side")), allowMissingColumns=True)
    own = Window.partitionBy(key).orderBy("_side", order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # What is known is the first state that was seen at the latest instant: later ones at the same instant replay it or conflict.
    rows = rows.withColumn("_first", F.struct(F.col(time), -F.row_number().over(own)))
    seen = F.max(time).over(before)
    last = F.max_by("_state", F.when(F.col(time).isNotNull(), F.col("_first"))).over(before)
    marked = rows.withColumn("_seen", seen).withColumn("_last", last)
    newer = F.col("_seen").isNull() | (F.col(time) > F.col("_seen"))
    same = F.col("_state").eqNullSafe(F.col("_last"))
    action = (
        F.when(F.col(time).isNull(), "late")
        .when(newer & F.col("_seen").isNotNull() & same, "unchanged")
        .when(newer, "insert")
        .when(F.col(time) < F.col("_seen"), "late")
        .when(same, "replay")
        .otherwise("conflict")
    )
    return marked.withColumn("action", action).filter("_side = 1").drop("_state", "_side", "_first", "_seen", "_last")


def publish(history: DataFrame, batch: DataFrame, strict: bool = True, key: str = "store_product_id", state: tuple[str, ...] = STATE) -> tuple[DataFrame, DataFrame]:
    """The history (key, captured_at, last_seen_at, state) after a batch (key, position, observed_at, state), and what was decided for each row.

    A conflict fails the whole batch if strict; else it is left out.
    """
    columns = [key, "captured_at", "last_seen_at", *state]
    history = history.select(*columns)
    w = Window.partitionBy(key).orderBy(F.col("captured_at").desc())
    newest = history.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1")
    known = newest.select(key, F.coalesce("last_seen_at", "captured_at").alias("observed_at"), *state)
    found = decided(batch, known, key, state=state)
    if strict and not found.filter("action = 'conflict'").isEmpty():
        raise ValueError("Conflicting observation at the same timestamp")
    inserted = found.filter("action = 'insert'").select(key, F.col("observed_at").alias("captured_at"), F.col("observed_at").alias("last_seen_at"), *state)
    table = history.unionByName(inserted)
    # An unchanged observation moves last_seen_at of the newest row that is older than it.
    bumps = found.filter("action = 'unchanged'").select(key, F.col("observed_at").alias("captured_at"), F.lit(True).alias("_bump"))
    both = table.withColumn("_bump", F.lit(False)).unionByName(bumps, allowMissingColumns=True)
    run = Window.partitionBy(key).orderBy("captured_at", "_bump").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_row", F.count_if(~F.col("_bump")).over(run))
    last = F.max(F.when(F.col("_bump"), F.col("captured_at"))).over(Window.partitionBy(key, "_row"))
    after = both.withColumn("last_seen_at", F.greatest("last_seen_at", last)).filter(~F.col("_bump")).select(*columns)
    return after, found


def resolved_products(batch: DataFrame, listings: DataFrame, products: DataFrame) -> DataFrame:
    """batch (position, gtin, canonical_variant_key, store_product_id) with product_id, rule and conflict.

    The first rule that finds a product decides: equal GTIN, equal reviewed key, the listing's product; else null (a new product).
    Where several products fit a rule, the smallest id is taken. conflict: GTIN, pack, quantity or unit contradict the product's.
    """
    gtin = lambda c: S.canonical_gtin(F.nullif(c, F.lit("")))
    p = products.select(F.col("id").alias("p_id"), gtin(F.col("gtin")).alias("p_gtin"), F.col("canonical_variant_key").alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in ("pack_count", "net_quantity", "unit")])
    by_gtin = p.filter("p_gtin IS NOT NULL").groupBy(F.col("p_gtin").alias("_gtin")).agg(F.min("p_id").alias("_by_gtin"))
    by_key = p.filter(F.col("p_key").startswith("reviewed:")).groupBy(F.col("p_key").alias("canonical_variant_key")).agg(F.min("p_id").alias("_by_key"))
    of_listing = listings.select(F.col("id").alias("store_product_id"), F.col("product_id").alias("_by_listing"))
    rows = batch.withColumn("_gtin", gtin(F.col("gtin"))).join(by_gtin, "_gtin", "left").join(by_key, "canonical_variant_key", "left").join(of_listing, "store_product_id", "left")
    rows = rows.withColumn("product_id", F.coalesce("_by_gtin", "_by_key", "_by_listing"))
    rule = F.when(F.col("_by_gtin").isNotNull(), "gtin").when(F.col("_by_key").isNotNull(), "reviewed_key").when(F.col("_by_listing").isNotNull(), "listing").otherwise("new")
    rows = rows.withColumn("rule", rule).join(p, F.col("product_id") == F.col("p_id"), "left")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    conflict = differs("_gtin", "p_gtin") | differs("pack_count", "p_pack_count") | differs("net_quantity", "p_net_quantity") | (F.col("p_net_quantity").isNotNull() & F.col("net_quantity").isNotNull() & differs("unit", "p_unit"))
    return rows.withColumn("conflict", conflict).select(*batch.columns, "product_id", "rule", "conflict")


def new_product_name(name: Column, taken: Column, slug: Column, url: Column) -> Column:
    """The normalized name of a new product, with the store and the URL's hash where the name is taken."""
    return F.when(taken, S.collision_name(name, slug, url)).otherwise(name)


def captured_images(listings: DataFrame, images: DataFrame) -> DataFrame:
    """images (store_product_id, image_url) with those of listings that it lacks."""
    seen = listings.select(F.col("id").alias("store_product_id"), S.valid_url(F.col("image_url")).alias("image_url")).filter("image_url IS NOT NULL").distinct()
    return images.unionByName(seen.join(images, ["store_product_id", "image_url"], "left_anti"), allowMissingColumns=True)
