"""Replies of a government price service, of geocoders, probes and saved captures."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.operators.latest import first_by

# Fields of the official price service.
_REPLY = "success boolean, message string, data struct<productos: array<struct<producto: string, tipo_producto: string, precio: string, fecha_observacion: string, cadena_comercial: string, establecimiento: string, direccion: string, colonia: string, cp: string, municipio: string, entidad: string>>>"
_NEEDED = ("producto", "tipo_producto", "cadena_comercial", "establecimiento")


def official_prices(replies: DataFrame) -> DataFrame:
    """A row for each price in replies (term, body: a JSON reply a row), with its place in them and reject_reason.

    A reply that isn't of the format or says that it failed gives one row with the reason; so does one bad price for its
    whole reply, since a reply is taken whole or not at all.
    """
    r = replies.select("term", F.monotonically_increasing_id().alias("_reply"), F.from_json("body", _REPLY).alias("r"))
    listed = r.select("*", F.posexplode_outer("r.data.productos").alias("place", "p"))
    price = F.col("p.precio").try_cast("double")
    whole = (price >= 0) & F.col("p.fecha_observacion").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date("p.fecha_observacion").isNotNull()
    for f in _NEEDED:
        whole = whole & (F.col(f"p.{f}") != "")
    wrong = F.when(F.col("r.success").isNull() | F.col("r.message").isNull() | F.col("r.data.productos").isNull(), "not_of_the_format").when(~F.col("r.success"), "service_failed").when(F.col("p").isNotNull() & ~F.coalesce(whole, F.lit(False)), "invalid_price")
    marked = listed.withColumn("_wrong", wrong)
    bad = marked.groupBy("_reply").agg(F.min("_wrong").alias("reject_reason"))
    rows = marked.join(bad, "_reply").filter(F.col("reject_reason").isNull() & F.col("p").isNotNull() | F.col("reject_reason").isNotNull() & (F.coalesce("place", F.lit(0)) == 0))
    empty = F.col("reject_reason").isNull()
    return rows.select("term", "place", *[F.when(empty, F.col(f"p.{f}")).alias(f) for f in (*_NEEDED, "direccion", "colonia", "cp", "municipio", "entidad")], F.when(empty, price).alias("price"), F.when(empty, F.col("p.fecha_observacion")).alias("observed_on"), "reject_reason")


def _listing_key() -> Column:
    return T.normalize_official_name(F.concat_ws("|", "cadena_comercial", "establecimiento", "producto"))


def latest_official(prices: DataFrame, most: int | None = None) -> DataFrame:
    """The latest price of each chain, shop and product, of equal dates the first one; newest first, then cheapest, at most ``most``."""
    latest = first_by(prices.filter("reject_reason IS NULL").withColumn("listing", _listing_key()), ["listing"], [F.col("observed_on").desc(), F.col("place").asc()])
    ordered = latest.orderBy(F.col("observed_on").desc(), "price", "listing")
    return ordered if most is None else ordered.limit(most)


def of_terms(prices: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Prices with product, a row for each rule whose required terms its name all holds: rules give the terms by product. Names are compared in the official form."""
    name, terms = T.normalize_official_name(F.col("producto")), lambda words: F.array(*[T.normalize_official_name(F.lit(w)) for w in words])
    fits = F.array(*[F.when(T.contains_all(name, terms(words)), F.lit(product)) for product, words in rules.items()])
    return prices.withColumn("product", F.explode(F.array_compact(fits)))


def official_records(prices: DataFrame, city_code: str, results_url: str) -> DataFrame:
    """Records of official prices: shop, branch key, variant, presentation, noon of the day as the instant, and a URL for each listing."""
    c = F.col
    variant = T.parse_variant(c("producto"))
    anchor = T.slug(F.concat_ws("-", "cadena_comercial", "establecimiento", "producto"))
    url = F.concat(F.lit(f"{results_url}?city={city_code}&searchTerm="), F.url_encode("term"), F.lit("#"), anchor)
    return prices.filter("reject_reason IS NULL").withColumn("_v", variant).select(
        T.slug(c("cadena_comercial")).alias("store_slug"), c("cadena_comercial").alias("store_name"), c("producto").alias("source_product_name"), c("establecimiento").alias("branch_name"),
        S.branch_key(F.lit("profeco"), F.lit(city_code), c("cadena_comercial"), c("establecimiento")).alias("branch_external_key"), c("direccion").alias("address"), c("municipio").alias("municipality"), c("entidad").alias("state"),
        c("_v.label").alias("variant_label"), c("_v.quantity").alias("net_quantity"), c("_v.unit").alias("unit"), c("_v.pack_count").alias("pack_count"), c("_v.key").alias("canonical_variant_key"),
        F.concat_ws(" · ", "producto", "establecimiento").alias("external_name"), "price", F.lit(K.CURRENCY).alias("currency"), url.alias("external_url"), T.third_parts(c("producto")).alias("presentation"), F.lit(True).alias("available"),
        S.noon_utc(c("observed_on")).alias("captured_at"),
    )


def label_parts(labels: Column) -> list[Column]:
    """Product and branch of a label that joins them by a middle dot; null where there is no second part."""
    split = lambda n: F.nullif(F.split_part(labels, F.lit(" · "), F.lit(n)), F.lit(""))
    return [split(1).alias("product"), split(2).alias("branch")]


# Names of a geocoder's confidence and the numbers that stand for them.
CONFIDENCES = {"exact": 1.0, "high": 0.9, "medium": 0.65, "low": 0.35}


def geocoder_results(replies: DataFrame) -> DataFrame:
    """id, latitude, longitude, confidence, accuracy and external_id of the first feature in replies (id, body); nulls where there is none. Coordinates come longitude first; without a named confidence it is 0.5."""
    schema = "features array<struct<id: string, geometry: struct<coordinates: array<double>>, properties: struct<match_code: struct<confidence: string>, coordinates: struct<accuracy: string>>>>"
    f = replies.select("id", F.get(F.from_json("body", schema)["features"], 0).alias("f"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCES.items() for x in pair]), F.col("f.properties.match_code.confidence"))
    at = F.col("f.geometry.coordinates")
    return f.select("id", F.get(at, 1).alias("latitude"), F.get(at, 0).alias("longitude"), F.when(F.col("f").isNotNull(), F.coalesce(named, F.lit(0.5))).alias("confidence"), F.col("f.properties.coordinates.accuracy").alias("accuracy"), F.col("f.id").alias("external_id"))


def region_of_token(token: Column) -> Column:
    """The region in a segment token: base64 of a JSON object whose regionId is base64 again; null for any other token."""
    padded = lambda c: F.concat(c, F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    plain = lambda c: F.try_to_binary(padded(F.translate(c, "-_", "+/")), F.lit("base64"))
    text = lambda c: F.try_validate_utf8(c.cast("string"))
    region = F.nullif(F.get_json_object(text(plain(token)), "$.regionId"), F.lit(""))
    return text(plain(region))


# Captures


def replayed(captures: DataFrame, host: str) -> DataFrame:
    """Saved replies (url, body, sha256, observed_at) with reject_reason: another origin, or a body that isn't the one that was saved. Good ones keep their time and can be parsed again without a request."""
    c = F.col
    ours = (F.try_parse_url("url", F.lit("HOST")) == host) & (F.try_parse_url("url", F.lit("PROTOCOL")) == "https")
    reason = F.when(~F.coalesce(ours, F.lit(False)), "unexpected_origin").when(~F.coalesce(F.sha2(c("body").cast("binary"), 256) == F.lower("sha256"), F.lit(False)), "body_changed").when(c("observed_at").isNull(), "no_observation_time")
    return captures.withColumn("reject_reason", reason)


def capture_pages(pages: DataFrame, known: DataFrame, page_size: int) -> DataFrame:
    """One row on a paged capture: pages (page, position, id, url). How many pages and ids, ids on several pages, a full last page (there may be more), a short one before it, and known URLs (known: url) that it didn't meet."""
    per_page = pages.groupBy("page").agg(F.count("*").alias("n"))
    last = per_page.agg(F.max("page").alias("pages"), F.max_by("n", "page").alias("last_n"), F.count_if(F.col("n") < page_size).alias("_short"))
    ids = pages.groupBy("id").agg(F.count_distinct("page").alias("p")).agg(F.count("*").alias("ids"), F.count_if(F.col("p") > 1).alias("repeated_ids"))
    missing = known.select("url").distinct().join(pages.select("url"), "url", "left_anti").agg(F.count("*").alias("known_missing"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(last).join(one(ids), "_one").join(one(missing), "_one")
    full = F.col("last_n") >= page_size
    return out.select("pages", "ids", "repeated_ids", full.alias("may_have_more"), (F.col("_short") - (~full).cast("int")).alias("short_pages_before"), "known_missing")


def homepage_cards(cards: DataFrame) -> DataFrame:
    """Cards seen on a storefront's front page (item_id, seller_id, offer_id, position, ...): each once, at its first place, and always held for review."""
    return first_by(cards, ["item_id", "seller_id", "offer_id"], [F.col("position").asc()]).withColumn("status", F.lit("held"))


def from_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all sources together with their source's name, and the sources that failed (source, error): one that fails to be planned doesn't stop the rest."""
    rows, failed = spark.createDataFrame([], schema).withColumn("source_name", F.lit("")), []
    for name, read in sources.items():
        try:
            rows = rows.unionByName(read().withColumn("source_name", F.lit(name)), allowMissingColumns=True)
        except Exception as error:  # noqa: BLE001  (whatever a source raises is its own failure)
            failed.append((name, f"{type(error).__name__}: {error}"[:500]))
    return rows, spark.createDataFrame(failed, "source string, error string")


def mock_prices(names: DataFrame, prices: dict[str, float], default: float, observed_at: datetime) -> DataFrame:
    """A made-up price for each name, by a table of prices or the default one; marked as synthetic, so nothing publishes it."""
    known = F.create_map(*[F.lit(x) for pair in prices.items() for x in pair]) if prices else F.create_map().cast("map<string,double>")
    return names.select("name", F.coalesce(F.element_at(known, F.lower("name")), F.lit(float(default))).alias("price"), F.lit(K.CURRENCY).alias("currency"), F.lit(observed_at).alias("captured_at"), F.lit(True).alias("is_synthetic"))


# Search terms of a hardware shop and the categories that they stand for.
TERM_CATEGORIES = {"pintura": "Pintura", "herramientas": "Herramientas", "escalera": "Escaleras", "sellador": "Selladores", "focos": "Iluminacion", "adhesivo": "Adhesivos"}


def category_of_term(term: Column) -> Column:
    out = F.lit("Hogar y ferreteria")
    for name, category in TERM_CATEGORIES.items():
        out = F.when(T.normalize_name(term) == name, category).otherwise(out)
    return out
