"""A batch of product records against the known listings: which are kept, which are held, and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import text as T

LISTING = ["source", "store_product_url"]


def _measured(df: DataFrame) -> DataFrame:
    """df with _measure, the key of the presentation's measure if it states one. Parsed once: the parts of the key refer to a column."""
    return df.withColumn("_parsed", T.parse_presentation(F.col("presentation"))).withColumn("_measure", T.presentation_key(F.col("_parsed"))).drop("_parsed")


def reconciled(batch: DataFrame, known: DataFrame, shared: tuple[str, ...] = (), comparable: Callable[[Column], Column] = T.comparable_name) -> DataFrame:
    """batch with normalized_name and image_url of the known listing, its captured_normalized_name, outcome and hold_reason.

    batch: position (unique), source, store_slug, store_product_url, product_name, normalized_name, presentation, external_reference,
    image_url, captured_at, weighted (price is of a weight or a multiple). known: source, store_slug, store_product_url, product_name,
    normalized_name, presentation, image_url. shared: sources whose listings have one URL together; a new name there is a new product.

    outcome is kept, held or superseded (an older record of a kept one). In the order of the rules, held are: weighted prices; records of
    a known URL whose name fits none or several of its listings; of a known listing whose presentation or store changed; all records of a
    publication identity (source, URL, name) with several references; of a source and name with several references; and of a name
    with several presentations, those of known listings included. A null reference or presentation agrees with any other.
    A record of an identity supersedes the older ones; of equal times the lower position stays. An empty table on either side is no special case.

    Known listings are aggregated before they are joined: by URL, by URL and name, and by name. The windows are by identity, source and
    name, and name, over minima and maxima, so a frequent name costs a sort and no set of its values.
    """
    old = _measured(known).withColumn("_name", comparable(F.col("product_name")))
    urls = old.groupBy(*LISTING).agg(F.count("*").alias("_at_url"))
    kept_fields = F.struct("store_slug", "normalized_name", "_measure", "image_url")
    names = old.groupBy(*LISTING, "_name").agg(F.count("*").alias("_matches"), F.first(kept_fields).alias("_old"))
    rows = _measured(batch).withColumn("_name", comparable(F.col("product_name"))).join(urls, LISTING, "left").join(names, [*LISTING, "_name"], "left")
    is_shared = F.col("source").isin(*shared) if shared else F.lit(False)
    matched = F.col("_matches") == 1
    same = (F.col("_measure") == F.col("_old._measure")) & (F.col("store_slug") == F.col("_old.store_slug"))
    own = (
        F.when(F.coalesce("weighted", F.lit(False)), "weighted_unit")
        .when(F.col("_at_url").isNotNull() & ~F.coalesce(matched, F.lit(False)) & ~(is_shared & F.col("_matches").isNull()), "ambiguous_known_url")
        .when(matched & ~F.coalesce(same, F.lit(False)), "presentation_or_store_changed")
    )
    rows = rows.withColumn("_own", own).withColumn("captured_normalized_name", F.col("normalized_name"))
    rows = rows.withColumn("normalized_name", F.coalesce(F.when(matched, F.col("_old.normalized_name")), "normalized_name"))
    rows = rows.withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), F.when(matched, F.col("_old.image_url"))))
    rows = rows.withColumn("_pack", F.coalesce("_measure", F.lower("presentation")))

    def several(column: str, counts: Column, *keys: str) -> Column:
        """Whether the rows of the keys that count have more than one value."""
        w, value = Window.partitionBy(*keys), F.when(counts, F.col(column))
        return F.coalesce(F.min(value).over(w) != F.max(value).over(w), F.lit(False))

    identity = ["source", "store_product_url", "normalized_name"]
    open_ = F.col("_own").isNull()
    rows = rows.withColumn("_refs", several("external_reference", open_, *identity))
    newest = Window.partitionBy(*identity, open_).orderBy(F.col("captured_at").desc_nulls_last(), "position")
    rows = rows.withColumn("_rank", F.row_number().over(newest))
    live = open_ & ~F.col("_refs") & (F.col("_rank") == 1)
    packs = _measured(known).filter("_measure IS NOT NULL").groupBy("normalized_name").agg(F.min("_measure").alias("_least"), F.max("_measure").alias("_most"))
    rows = rows.withColumn("_names", several("external_reference", live, "source", "normalized_name")).join(packs, "normalized_name", "left")
    w, pack = Window.partitionBy("normalized_name"), F.when(live, F.col("_pack"))
    clash = F.coalesce(F.least(F.min(pack).over(w), "_least") != F.greatest(F.max(pack).over(w), "_most"), F.lit(False))
    rows = rows.withColumn("_clash", clash)
    held = F.coalesce(
        "_own",
        F.when(F.col("_refs"), "several_references_of_identity"),
        F.when(live & F.col("_names"), "several_references_of_name"),
        F.when(live & F.col("_clash"), "conflicting_presentations"),
    )
    rows = rows.withColumn("hold_reason", held)
    rows = rows.withColumn("outcome", F.when(F.col("hold_reason").isNotNull(), "held").when(live, "kept").otherwise("superseded"))
    return rows.select(*batch.columns, "captured_normalized_name", "outcome", "hold_reason")
