"""Catalog plans over the tables stores, products, listings, branches and snapshots.

The latest observation of a listing (and branch) is chosen first and tested after: a newest row that is
unavailable, expired or rejected hides what came before it. Evidence (JSON) is decoded of latest rows only.
Every plan takes the time it is asked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.operators.latest import latest_by


@dataclass
class Tables:
    """stores(id, name, slug, country, enabled), products(id, name, normalized_name, category, brand, gtin, variant_label, net_quantity,
    unit, pack_count, canonical_variant_key), listings(id, store_id, product_id, store_product_url, image_url, presentation, source),
    branches(id, store_id, name, address, municipality, latitude, longitude, geocoding_status, source, city_code), snapshots(id,
    store_product_id, branch_id, price_scope, price, currency, available, source, captured_at, external_reference, raw_payload)
    and images(store_product_id, image_url)."""

    stores: DataFrame
    products: DataFrame
    listings: DataFrame
    branches: DataFrame
    snapshots: DataFrame
    images: DataFrame | None = None


PRODUCT_DETAILS = ["brand", "gtin", "variant_label", "net_quantity", "unit", "pack_count", "canonical_variant_key"]
OFFER = [
    "product_name", "normalized_name", "category", "store_name", "store_slug", "branch_id", "branch_name", "branch_address", "branch_municipality",
    "price", "currency", "available", "source", "captured_at", "freshness", "days_old", "distance_km", "observation_url", "store_product_url", "image_url", "presentation",
]


def check_paging(limit: int | None, page: int | None) -> None:
    if limit is None or not 1 <= limit <= 100 or page is None or not 1 <= page <= 10_000:
        raise ValueError("Invalid pagination")


def check_place(lat: float | None, lon: float | None, radius: float | None) -> None:
    if lat is None or lon is None or radius is None or not -90 <= lat <= 90 or not -180 <= lon <= 180 or not 0.1 <= radius <= 100:
        raise ValueError("Invalid coordinates or radius")


def clamped(limit: int, page: int) -> tuple[int, int]:
    """Paging of the earlier functions: out of bounds values are moved to the bound."""
    return min(max(limit, 1), 100), max(page, 1)


def paged(df: DataFrame, order: list[Column], limit: int, page: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def evidence(snapshots: DataFrame, as_of: datetime) -> DataFrame:
    """Snapshots with source_url of their evidence, without those it makes unfit: synthetic, not accepted, or expired."""
    fields = F.from_json("raw_payload", "source_url string, is_synthetic string, review_status string, valid_until string").alias("facts")
    out = snapshots.select("*", fields)
    fit = (F.coalesce("facts.is_synthetic", F.lit("false")) == "false") & (F.coalesce("facts.review_status", F.lit("accepted")) == "accepted")
    current = F.col("facts.valid_until").isNull() | (F.to_timestamp("facts.valid_until") > S.instant(as_of))
    return out.filter(fit & current).withColumn("source_url", F.col("facts.source_url")).drop("facts", "raw_payload")


def _named_stores(t: Tables) -> DataFrame:
    s = t.stores.filter(F.col("enabled") & (F.col("country") == K.COUNTRY) & ~S.blank(F.col("name")))
    return s.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("slug").alias("store_slug"))


def _named_products(t: Tables, details: bool = True) -> DataFrame:
    p = t.products.filter(~S.blank(F.col("name")))
    return p.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "normalized_name", "category", *(PRODUCT_DETAILS if details else []))


def _listings(t: Tables) -> DataFrame:
    return t.listings.filter(~S.blank(F.col("presentation"))).select(F.col("id").alias("store_product_id"), "store_id", "product_id", "store_product_url", "image_url", "presentation")


def _current(latest: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return latest.filter(S.in_catalog_window(F.col("captured_at"), as_of, days) & (F.col("price") > 0) & (F.col("currency") == K.CURRENCY) & ~S.blank(F.col("source")))


def _urls(df: DataFrame) -> DataFrame:
    url = S.first_url(F.col("source_url"), F.col("external_reference"), F.col("store_product_url"))
    return df.withColumn("observation_url", url).filter("observation_url IS NOT NULL").withColumn("image_url", S.valid_url(F.col("image_url")))


def _with_image_count(df: DataFrame, t: Tables) -> DataFrame:
    if t.images is None:
        return df.withColumn("image_count", F.lit(0).cast("long"))
    counts = t.images.groupBy("store_product_id").agg(F.count("*").alias("image_count"))
    return df.join(counts, "store_product_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


def current_catalog(t: Tables, as_of: datetime, days: int = K.FRESH_DAYS) -> DataFrame:
    """The latest offer of each listing and branch that is new enough, priced, and proven."""
    latest = _current(latest_by(t.snapshots, ["store_product_id", "branch_id"]), as_of, days)
    rows = evidence(latest, as_of).join(_listings(t), "store_product_id").join(_named_products(t, False), "product_id").join(_named_stores(t), "store_id")
    b = t.branches.select(F.col("id").alias("b_id"), F.col("store_id").alias("b_store"), F.col("name").alias("branch_name"), F.col("address").alias("branch_address"), F.col("municipality").alias("branch_municipality"), "latitude", "longitude", "geocoding_status")
    rows = rows.join(b, (rows["branch_id"] == b["b_id"]) & (rows["store_id"] == b["b_store"]), "left")
    scoped = ((F.col("price_scope") == "online") & F.col("branch_id").isNull()) | ((F.col("price_scope") == "branch_local") & F.col("branch_id").isNotNull())
    found = F.col("geocoding_status").isin(*K.GEOCODED) & S.in_mexico(F.col("latitude"), F.col("longitude")) & ~S.blank(F.col("branch_name")) & ~S.blank(F.col("branch_address"))
    rows = _urls(rows.filter(scoped & (F.col("branch_id").isNull() | found)))
    rows = rows.withColumn("freshness", F.lit("fresh")).withColumn("days_old", S.days_old_elapsed(F.col("captured_at"), as_of)).withColumn("distance_km", F.lit(None).cast("double"))
    return rows.select("store_product_id", *[c for c in OFFER if c != "distance_km"], "latitude", "longitude")


# By sort, what leads the order, and in which direction.
_LEADS = {"price_desc": ("price", Column.desc_nulls_first), "fresh_desc": ("captured_at", Column.desc_nulls_first), "name": ("product_name", Column.asc_nulls_last)}


def _sort(sort: str | None, distance: bool) -> list[Column]:
    leads = _LEADS | ({"distance": ("distance_km", Column.asc_nulls_last)} if distance else {})
    lead = [way(F.col(c)) for c, way in (leads[sort],)] if sort in leads else []
    tail = [F.col(c).asc_nulls_last() for c in ("price", "product_name", "store_slug", "store_product_id")]
    return lead + tail + ([F.col("branch_id").asc_nulls_last()] if distance else [])


def _of_listings(snapshots: DataFrame, listings: DataFrame | None) -> DataFrame:
    """Snapshots of the listings asked for (None: of all), before any of them is ranked."""
    return snapshots if listings is None else snapshots.join(listings.select("store_product_id").distinct(), "store_product_id", "left_semi")


def online_offers(t: Tables, as_of: datetime, search: str | None = None, category: str | None = None, only_available: bool | None = True, days: int = K.FRESH_DAYS) -> DataFrame:
    """All online offers that fit, not yet ordered. A null only_available lets through available rows only."""
    products = _named_products(t).filter("normalized_name IS NOT NULL")
    if category is not None:
        products = products.filter(F.col("category") == category)
    if (found := S.matches_search(search, F.col("product_name"), F.col("normalized_name"))) is not None:
        products = products.filter(found)
    listings = _listings(t).join(products, "product_id").join(_named_stores(t), "store_id")
    # The latest row is chosen by listing, so where few listings are asked for only their histories are ranked: they are joined first.
    narrowed = bool(search or category)
    history = t.snapshots.filter("branch_id IS NULL")
    latest = latest_by(history.join(listings, "store_product_id") if narrowed else history, ["store_product_id"])
    rows = _current(latest, as_of, days).filter("price_scope = 'online'").filter(~F.lit(only_available).cast("boolean") | F.col("available"))
    rows = _urls(evidence(rows, as_of) if narrowed else evidence(rows, as_of).join(listings, "store_product_id"))
    empty = {c: F.lit(None).cast("string") for c in ("branch_name", "branch_address", "branch_municipality")}
    return _with_image_count(
        rows.withColumns(empty | {"freshness": F.lit("fresh"), "days_old": S.days_old_elapsed(F.col("captured_at"), as_of), "distance_km": F.lit(None).cast("double")}), t
    ).select("store_product_id", *OFFER, *PRODUCT_DETAILS, "image_count")


def online_prices(t: Tables, as_of: datetime, search: str | None = None, limit: int = 100, page: int = 1, category: str | None = None, only_available: bool | None = True, sort: str | None = "price_asc", days: int = K.FRESH_DAYS) -> DataFrame:
    """A page of online offers, best first in the order asked for."""
    check_paging(limit, page)
    return online_page(online_offers(t, as_of, search, category, only_available, days), limit, page, sort)


def online_page(offers: DataFrame, limit: int = 100, page: int = 1, sort: str | None = "price_asc") -> DataFrame:
    """A page of online_offers()."""
    check_paging(limit, page)
    return paged(offers, _sort(sort, False), limit, page).drop("store_product_id")


def online_leading(offers: DataFrame, sorts: list[str], most: int) -> DataFrame:
    """The rows of online_offers() that are among the first ``most`` in any of the orders, all found in one pass; pages up to there are the same of these."""
    if most > 1000:
        raise ValueError("Ranks are limited within tasks up to 1,000 rows")  # Spark's threshold; beyond it, all rows of an order would meet in one task
    # A lead is null in the other orders' rows.
    leads = [way(F.when(F.col("_sort") == s, F.col(c))) for s, (c, way) in _LEADS.items() if s in sorts]
    w = Window.partitionBy("_sort").orderBy(*leads, *_sort(None, False))
    rows = offers.withColumn("_sort", F.explode(F.array(*[F.lit(s) for s in sorts]))).withColumn("_rank", F.row_number().over(w))
    return rows.filter(F.col("_rank") <= most).drop("_sort", "_rank").dropDuplicates(["store_product_id"])


def online_prices_v3(t: Tables, as_of: datetime, **asked) -> DataFrame:
    """online_prices without product details and image counts."""
    return online_prices(t, as_of, **asked).select(*OFFER)


def online_prices_v2(t: Tables, as_of: datetime, search: str | None = None, limit: int = 100, page: int = 1, only_available: bool = False) -> DataFrame:
    """Offers up to 21 days old; the latest *among rows that fit*, so an older row may stand in for a newest one that doesn't.

    The search looks at the name that the source gave the product too, where snapshots have source_product_name.
    """
    limit, page = clamped(limit, page)
    listings = _listings(t).join(_named_products(t, False), "product_id").join(_named_stores(t), "store_id")
    days = S.days_old_calendar(F.col("captured_at"), as_of)
    fits = (F.col("price_scope") == "online") & F.col("branch_id").isNull() & (days <= K.STALE_DAYS) & (F.col("price") > 0)
    rows = t.snapshots.filter(fits & (F.col("available") if only_available else F.lit(True)))
    named = [F.col("source_product_name")] if "source_product_name" in t.snapshots.columns else []
    rows = rows.join(listings, "store_product_id")
    if (found := S.matches_search(search, F.col("product_name"), F.col("normalized_name"), *named)) is not None:
        rows = rows.filter(found)
    rows = latest_by(rows, ["store_product_id"])
    rows = rows.withColumn("days_old", days).withColumn("freshness", S.freshness(F.col("days_old")))
    return paged(rows, [F.col(c).asc_nulls_last() for c in ("price", "product_name", "store_slug", "store_product_id")], limit, page).select("product_name", "normalized_name", "category", "store_name", "store_slug", "price", "currency", "available", "source", "captured_at", "freshness", "days_old")


def nearby_prices_v2(t: Tables, as_of: datetime, lat: float, lon: float, radius: float = 10, search: str | None = None, source: str | None = None, store: str | None = None, only_available: bool | None = True, limit: int = 100) -> DataFrame:
    """Latest prices of geocoded branches within the radius, up to 21 days old: the nearest first, then the cheapest."""
    check_place(lat, lon, radius)
    near = S.distance_km(F.lit(float(lat)), F.lit(float(lon)), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    stores = t.stores.filter(F.col("country") == K.COUNTRY)
    if store is not None:
        stores = stores.filter(F.col("slug") == store)
    branches = t.branches.filter(~S.blank(F.col("name")) & S.in_mexico(F.col("latitude"), F.col("longitude")) & (near <= radius))
    history = t.snapshots.join(branches.select(F.col("id").alias("branch_id")).distinct(), "branch_id", "left_semi")
    rows = latest_prices(Tables(stores, t.products, t.listings, branches, history), as_of)
    soon = S.instant(as_of) + F.make_dt_interval(mins=F.lit(K.FUTURE_MINUTES))
    rows = rows.filter((F.col("price") > 0) & ~S.blank(F.col("source")) & (F.col("captured_at") <= soon) & (F.col("freshness") != "old") & (~F.lit(only_available).cast("boolean") | F.col("available")))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if (found := S.matches_search(search, F.col("normalized_name"), F.col("product_name"))) is not None:
        rows = rows.filter(found)
    rows = rows.withColumn("distance_km", near)
    return rows.orderBy("distance_km", "price", "store_product_id", "branch_id").limit(limit)


def nearby_offers(t: Tables, as_of: datetime, lat: float, lon: float, radius: float = 10, search: str | None = None, category: str | None = None, only_available: bool | None = True, days: int = K.FRESH_DAYS) -> DataFrame:
    """All offers of branches within the radius."""
    check_place(lat, lon, radius)
    near = S.distance_km(F.lit(float(lat)), F.lit(float(lon)), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    # Listing and branch are what the latest row is chosen by: only histories in reach, and of products asked for, are ranked.
    reach = t.branches.filter(F.col("geocoding_status").isin(*K.GEOCODED) & (near <= radius)).select(F.col("id").alias("branch_id")).distinct()
    history = t.snapshots.filter("branch_id IS NOT NULL").join(reach, "branch_id", "left_semi")
    products = t.products
    if category is not None:
        products = products.filter(F.col("category") == category)
    if (found := S.matches_search(search, F.col("name"), F.col("normalized_name"))) is not None:
        products = products.filter(found)
    asked = None
    if search or category:
        asked = _listings(t).join(products.select(F.col("id").alias("product_id")), "product_id")
    rows = current_catalog(Tables(t.stores, products, t.listings, t.branches, _of_listings(history, asked), t.images), as_of, days)
    rows = rows.withColumn("distance_km", near).filter((F.col("distance_km") <= radius) & (~F.lit(only_available).cast("boolean") | F.col("available")))
    details = t.listings.select(F.col("id").alias("store_product_id"), "product_id").join(t.products.select(F.col("id").alias("product_id"), *PRODUCT_DETAILS), "product_id").drop("product_id")
    return _with_image_count(rows.join(details, "store_product_id"), t).select("store_product_id", *OFFER, *PRODUCT_DETAILS, "image_count")


def nearby_prices(t: Tables, as_of: datetime, lat: float, lon: float, radius: float = 10, search: str | None = None, limit: int = 100, page: int = 1, category: str | None = None, only_available: bool | None = True, sort: str | None = "price_asc", days: int = K.FRESH_DAYS) -> DataFrame:
    check_place(lat, lon, radius)
    check_paging(limit, page)
    return paged(nearby_offers(t, as_of, lat, lon, radius, search, category, only_available, days), _sort(sort, True), limit, page).drop("store_product_id")


def nearby_prices_v3(t: Tables, as_of: datetime, lat: float, lon: float, **asked) -> DataFrame:
    return nearby_prices(t, as_of, lat, lon, **asked).select(*OFFER)


def nearby_branches(t: Tables, lat: float, lon: float, radius: float = 10, limit: int = 100) -> DataFrame:
    """The nearest geocoded branches: by distance, store, branch."""
    check_place(lat, lon, radius)
    near = S.distance_km(F.lit(float(lat)), F.lit(float(lon)), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    b = t.branches.filter(F.col("geocoding_status").isin(*K.GEOCODED)).withColumn("distance_km", near).filter(F.col("distance_km") <= radius)
    rows = b.select(F.col("id").alias("branch_id"), "store_id", F.col("name").alias("branch_name"), "latitude", "longitude", "distance_km").join(_named_stores(t), "store_id")
    return rows.orderBy("distance_km", "store_slug", "branch_name", "branch_id").limit(limit)


def categories(t: Tables, as_of: datetime, lat: float | None = None, lon: float | None = None, radius: float = 10, days: int = K.FRESH_DAYS) -> DataFrame:
    """name and count of available offers by category, online without coordinates, else near them; half a pair of coordinates finds none."""
    if lat is None and lon is None:
        rows = online_offers(t, as_of, days=days).drop("normalized_name")
    else:
        rows = current_catalog(t, as_of, days).filter("branch_id IS NOT NULL AND available")
        if lat is None or lon is None or not (-90 <= lat <= 90 and -180 <= lon <= 180 and 0.1 <= radius <= 100):
            rows = rows.filter("false")
        else:
            rows = rows.filter(S.distance_km(F.lit(float(lat)), F.lit(float(lon)), F.col("latitude").cast("double"), F.col("longitude").cast("double")) <= radius)
    return rows.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("count")).orderBy(F.col("name").asc_nulls_last())


def latest_prices(t: Tables, as_of: datetime) -> DataFrame:
    """The latest observation of each listing in each geocoded branch, of whatever age."""
    b = t.branches.filter(F.col("geocoding_status").isin(*K.GEOCODED) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    b = b.select(F.col("id").alias("branch_id"), F.col("store_id").alias("b_store"), F.col("name").alias("branch_name"), F.col("municipality").alias("branch_municipality"), "latitude", "longitude")
    s = t.stores.filter("enabled").select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("slug").alias("store_slug"))
    p = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "normalized_name", "category")
    listed = t.listings.select(F.col("id").alias("store_product_id"), "store_id", "product_id", "store_product_url", "image_url", "presentation")
    latest = latest_by(t.snapshots.filter("branch_id IS NOT NULL"), ["store_product_id", "branch_id"])
    latest = latest.select("store_product_id", "branch_id", "price", "currency", "available", "source", "captured_at", F.col("external_reference").alias("observation_url"))
    rows = latest.join(listed, "store_product_id").join(s, "store_id").join(p, "product_id")
    rows = rows.join(b, (rows["branch_id"] == b["branch_id"]) & (rows["store_id"] == b["b_store"])).drop(b["branch_id"]).drop("b_store")
    rows = rows.withColumn("days_old", S.days_old_calendar(F.col("captured_at"), as_of))
    return rows.withColumn("freshness", S.freshness(F.col("days_old")))


def compare_prices(t: Tables, as_of: datetime) -> DataFrame:
    """Available latest prices that aren't old and have an image and a link, with rank and best price among those of the same name."""
    rows = latest_prices(t, as_of).filter("available AND freshness <> 'old' AND image_url IS NOT NULL AND store_product_url IS NOT NULL")
    same = Window.partitionBy("normalized_name")
    return rows.withColumn("price_rank", F.dense_rank().over(same.orderBy("price"))).withColumn("best_price", F.min("price").over(same))
