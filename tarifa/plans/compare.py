"""Comparison of offers: groups, store totals, baskets, page-local ranks, carts, and matching between offers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.operators.latest import first_by


#: Millilitres of a gallon.
GALLON_ML = 3785.41


def _gallons(presentation: Column) -> Column:
    """The key of a presentation in gallons, in whole millilitres; the units of parse_presentation() have none."""
    number = F.nullif(F.regexp_extract(presentation, r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:gal|galones|gal[oó]n)\b", 1), F.lit(""))
    return F.concat(F.lit("1x"), F.round(F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * GALLON_ML).cast("long").cast("string"), F.lit("ml"))


def comparison_key(offers: DataFrame) -> Column:
    """Reviewed keys group by themselves; other offers by name and presentation in base units, each with the currency."""
    p = T.parse_presentation(F.col("presentation"))
    automatic = F.concat_ws("|", T.normalize_name(F.col("product_name")), F.coalesce(T.presentation_key(p), _gallons(F.col("presentation")), T.normalize_name(F.col("presentation"))))
    reviewed = F.col("canonical_variant_key").startswith("reviewed:") if "canonical_variant_key" in offers.columns else F.lit(False)
    key = F.when(reviewed, F.col("canonical_variant_key")).otherwise(automatic) if "canonical_variant_key" in offers.columns else automatic
    return F.concat_ws("|", key, F.col("currency"))


def active_order(sort: str) -> list[Column]:
    lead = {"price_desc": [F.col("price").desc()], "fresh_desc": [F.col("captured_at").desc()], "distance": [F.col("distance_km").asc_nulls_last()]}.get(sort, [])
    return [*lead, F.col("price").asc_nulls_last(), F.col("store_slug").asc_nulls_last(), F.col("offer_id").asc_nulls_last()]


def group_offers(offers: DataFrame, sort: str = "price_asc") -> DataFrame:
    """A row for each group of offers (offer_id, group_key, price, store_slug, captured_at, distance_km): best is the first in the active order.

    Values at the best place are taken with min_by over that order, so no group is gathered in one row.
    """
    rank = F.row_number().over(Window.partitionBy("group_key").orderBy(*active_order(sort)))
    ranked = offers.withColumn("_rank", rank)
    groups = ranked.groupBy("group_key").agg(
        F.min_by("price", "_rank").alias("best"),
        F.max("price").alias("worst"),
        F.countDistinct("store_slug").alias("stores"),
        F.count("*").alias("prices"),
        F.max("captured_at").alias("newest"),
        F.coalesce(F.min("distance_km"), F.lit(float("inf"))).alias("nearest"),
    )
    order = {
        "price_desc": [F.col("worst").desc()],
        "stores_desc": [F.col("stores").desc()],
        "fresh_desc": [F.col("newest").desc()],
        "distance": [F.col("nearest").asc()],
    }.get(sort, [])
    return groups.orderBy(*order, "best", "group_key")


def cheapest_in_groups(offers: DataFrame, keep: int = 4) -> DataFrame:
    """The cheapest offers of each group, at most ``keep``, with their place."""
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("price", "store_slug", "offer_id"))
    return offers.withColumn("place", place).filter(F.col("place") <= keep)


def store_totals(offers: DataFrame, cart: DataFrame) -> DataFrame:
    """By store: the sum over cart items (item, quantity) of its cheapest offer, and how many items it has. offers: item, store, price."""
    cheapest = offers.groupBy("item", "store").agg(F.min("price").alias("price"))
    rows = cheapest.join(cart, "item")
    total = rows.groupBy("store").agg(F.sum(S.cents(F.col("price")) * F.col("quantity")).alias("total_cents"), F.count("*").alias("covered"))
    return total.orderBy(F.col("covered").desc(), "total_cents", "store")


def usable(offers: DataFrame) -> DataFrame:
    """Offers to be had: available, with a finite price above zero in pesos (in any case), and of a named merchant."""
    price = F.col("price").cast("double")
    named = ~S.blank(F.col("store_name")) if "store_name" in offers.columns else F.lit(True)
    return offers.filter(F.col("available") & (price > 0) & (price < float("inf")) & (F.upper("currency") == K.CURRENCY) & named & F.col("merchant").isNotNull())


def baskets(offers: DataFrame, cart: DataFrame) -> DataFrame:
    """Baskets by merchant and branch (null: online), never across branches: each item's cheapest usable offer times its quantity, in cents.

    offers: offer_id, item, merchant, branch, price, available, currency and, if there, store_name; cart: item, quantity. Items of no quantity are left
    out, and not expected. The fullest baskets come first, then the cheapest.
    """
    cart = cart.filter("quantity > 0")
    chosen = first_by(usable(offers).join(cart, "item"), ["merchant", "branch", "item"], [F.col("price").asc(), F.col("offer_id").asc()])
    expected = cart.groupBy().agg(F.countDistinct("item").alias("expected"))
    lines = chosen.withColumn("line_cents", S.cents(F.col("price")) * F.col("quantity"))
    out = lines.groupBy("merchant", "branch").agg(F.sum("line_cents").alias("subtotal_cents"), F.count("*").alias("items"))
    out = out.withColumn("_one", F.lit(1)).join(expected.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out.withColumn("complete", F.col("items") == F.col("expected")).orderBy(F.col("items").desc(), "subtotal_cents", "merchant", F.col("branch").asc_nulls_first())


def rank_page(page: DataFrame) -> DataFrame:
    """best_price and price_rank among the rows of one page alone."""
    same = Window.partitionBy("normalized_name")
    return page.withColumn("best_price", F.min("price").over(same)).withColumn("price_rank", F.dense_rank().over(same.orderBy("price")))


def merge_carts(saved: DataFrame, local: DataFrame) -> DataFrame:
    """Carts (key, quantity, attributes) as one: quantities add up, attributes of the saved item win."""
    both = saved.withColumn("_side", F.lit(0)).unionByName(local.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("key", "quantity", "_side")]
    return both.groupBy("key").agg(F.sum("quantity").alias("quantity"), *[F.min_by(c, "_side").alias(c) for c in rest])


def recent_searches(history: DataFrame, keep: int = 10) -> DataFrame:
    """The latest searches (term, at) of each owner, one for each term whatever its case."""
    each = first_by(history.filter(~S.blank(F.col("term"))).withColumn("_term", F.lower(F.trim("term"))), ["owner", "_term"], [F.col("at").desc(), F.col("term").asc()])
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.col("at").desc(), "_term"))
    return each.withColumn("place", place).filter(F.col("place") <= keep).drop("_term")


def toggle(favourites: DataFrame, owner: str, key: str) -> DataFrame:
    """favourites (owner, key) without the pair if it is there, else with it."""
    one = favourites.sparkSession.createDataFrame([(owner, key)], "owner string, key string")
    return favourites.join(one, ["owner", "key"], "left_anti").unionByName(one.join(favourites, ["owner", "key"], "left_anti"))


def appended_pages(pages: DataFrame) -> DataFrame:
    """Rows of pages (identity, page, position) as one list: an identity keeps its first place and has its last row."""
    w = Window.partitionBy("identity")
    first = F.min(F.struct("page", "position")).over(w)
    last = F.row_number().over(w.orderBy(F.col("page").desc(), F.col("position").desc()))
    return pages.withColumn("_first", first).withColumn("_last", last).filter("_last = 1").orderBy("_first").drop("_first", "_last")


def rejection_reason(as_of: datetime, require_branch: bool) -> Column:
    """Why an offer isn't shown (the first reason that holds), null if it is."""
    c = F.col
    branch = c("branch_id").isNotNull()
    tests = [
        (S.blank(c("product_name")), "missing_product_name"),
        (S.blank(c("store_name")), "missing_store_name"),
        (c("price").isNull() | (c("price") <= 0), "invalid_price"),
        (c("currency") != K.CURRENCY, "unsupported_currency"),
        (~c("available"), "unavailable"),
        (c("captured_at").isNull(), "missing_captured_at"),
        (c("captured_at") > S.instant(as_of) + F.make_dt_interval(mins=F.lit(K.FUTURE_MINUTES)), "future"),
        (c("captured_at") <= S.instant(as_of) - F.make_dt_interval(F.lit(K.FRESH_DAYS)), "expired"),
        (F.lit(require_branch) & ~branch, "missing_branch_id"),
        (F.lit(require_branch) & (S.blank(c("branch_name")) | S.blank(c("branch_address"))), "missing_branch_details"),
        (F.lit(require_branch) & c("distance_km").isNull(), "missing_distance"),
        (F.lit(not require_branch) & ~branch & S.evidence_url(c("observation_url"), c("store_product_url")).isNull(), "missing_online_evidence"),
    ]
    out = F.lit(None).cast("string")
    for test, code in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(code)).otherwise(out)
    return out
