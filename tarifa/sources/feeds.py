"""Products out of the JSON that stores serve: search results, shared catalogs, storefront variants, store APIs.

Every format takes ``responses`` (url, observed_at, body: one JSON reply a row) and gives a row per product with the
common columns and reject_reason: the first rule that it breaks, null for good ones. A reply that isn't of the
format gives no row, or rows with a reason where it still names products. Nothing is shuffled but where it says so.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.sources.products import stated_presentation

# Reading JSON of unknown shape: a value of the wrong kind reads as null.


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"${path}" if path.startswith("[") else f"$.{path}", "variant")


def kind(value: Column) -> Column:
    """The variant type; VOID where there is nothing or null."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def absent(value: Column) -> Column:
    return kind(value) == "VOID"


def text(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def whole(value: Column) -> Column:
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def flag(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def scalar(value: Column) -> Column:
    """Texts and numbers, as text."""
    return F.when(kind(value).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, "$", "string"))


def items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def money(value: Column) -> Column:
    """The price of a text or number; zeros past the second decimal don't matter."""
    return S.parse_money(F.regexp_replace(F.trim(scalar(value)), r"(\.[0-9]{2})0+$", "$1"))


def first_image(images: Column, product_id: Column | None = None, variant_id: Column | None = None) -> Column:
    """The first https src that is no placeholder, of the product, and of the variant where the image names variants."""

    def fits(image: Column) -> Column:
        src, ok = text(at(image, "src")), F.lit(True)
        if product_id is not None:
            ok = ok & (scalar(at(image, "product_id")) == product_id)
        if variant_id is not None:
            of = F.transform(items(at(image, "variant_ids")), scalar)
            ok = ok & ((F.size(of) == 0) | F.array_contains(of, variant_id))
        return F.coalesce(ok & src.rlike(r"(?i)^https://[^/?#\s]+") & ~src.rlike("(?i)placeholder"), F.lit(False))

    return text(at(F.get(F.filter(images, fits), F.lit(0)), "src"))


# Spellings in names and the ones by which a presentation is stated.
SPELLINGS = (("pzs", "pzas"), ("por kilo", "por kg"), ("grs?|gramos?", "g"), ("lts?|ltos?|litros?", "l"), ("kilogramos?", "kg"))


def observed_presentation(name: Column, description: Column | None = None) -> Column:
    """The stated presentation. ``12 pack 355 ml`` counts only where it says that the measure is that of one piece."""

    def spelled(value: Column) -> Column:
        value = F.replace(value, F.lit("\u00a0"), F.lit(" "))
        for spelling, short in SPELLINGS:
            value = F.regexp_replace(value, rf"(?i)\b(?:{spelling})\b", short)
        return value

    name, description = spelled(name), spelled(F.lit("") if description is None else description)
    each = r"(?i)\b(\d+)\s*pack\s*(\d+(?:[.,]\d+)?)\s*(kg|ml|g|l)\s*(?:c/u|cada uno|por pieza)(?!\w)"
    per_piece = F.when(name.rlike(each), F.concat(F.regexp_extract(name, each, 1), F.lit(" x "), F.regexp_extract(name, each, 2), F.lit(" "), F.regexp_extract(name, each, 3)))
    return F.when(name.rlike(r"(?i)\b\d+\s*pack\b"), per_piece).otherwise(stated_presentation(name, description))


Rules = list[tuple[Column, str]]


def _first(rules: Rules) -> Column:
    """The code of the first rule that doesn't hold; what is unknown doesn't hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in rules])


def _records(found: DataFrame, host: str, as_of: datetime, rules: Callable[[DataFrame], Rules]) -> DataFrame:
    """found: url, observed_at, name, presentation, price, available, product_url, sku, category, image, gtin, valid_until, product (variant)."""
    c = found.__getitem__
    until = S.parse_expiry(c("valid_until"))
    ours = lambda u: (F.try_parse_url(u, F.lit("HOST")) == host) & (F.try_parse_url(u, F.lit("PROTOCOL")) == "https")
    common = [
        (ours(c("url")) & ours(c("product_url")), "unexpected_origin"),
        (c("available").isNotNull() & ~S.blank(c("name")) & ~S.blank(c("sku")), "missing_identity_or_availability"),
        (c("price").isNotNull(), "invalid_price"),
        (S.in_catalog_window(c("observed_at"), as_of), "invalid_observation_date"),
        (S.blank(c("valid_until")) | (until > c("observed_at")), "expired_offer"),
        (c("presentation").isNotNull(), "missing_presentation"),
    ]
    image = T.unescape_html(c("image"))
    name = F.trim(T.unescape_html(c("name")))
    out = found.select(
        "url", "observed_at", name.alias("product_name"), T.strip_marks(name).alias("normalized_name"), "presentation",
        F.when(S.blank(c("category")), "Otros").otherwise(c("category")).alias("category"), "price", F.lit(K.CURRENCY).alias("currency"), "available", "product_url",
        c("sku").alias("external_reference"), F.when(image.rlike(r"(?i)^https://[^/?#\s]+"), image).alias("image_url"), S.canonical_gtin(c("gtin")).alias("gtin"), until.alias("valid_until"),
        F.to_json("product").alias("evidence"), _first(rules(found) + common).alias("reject_reason"),
    )
    parts = ("product_name", "presentation", "category", "price", "available", "product_url", "external_reference", "image_url", "observed_at", "evidence")
    return out.withColumn("content_hash", S.content_hash(*[F.col(p) for p in parts]))


def _elements(responses: DataFrame, path: str | None) -> DataFrame:
    """url, observed_at, reply and product: the elements of the reply's array, or of the array at a path of it."""
    read = responses.select("url", "observed_at", F.try_parse_json("body").alias("reply"))
    return read.select("*", F.explode(items(F.col("reply") if path is None else at(F.col("reply"), path))).alias("product"))


def search_results(responses: DataFrame, host: str, as_of: datetime, currency: str | None) -> DataFrame:
    """Search replies: one item a product, sold by the store itself, by the piece, at its list price, with a quantity that agrees with its availability."""
    p = F.col("product")
    found = _elements(responses, None).select("*", items(at(p, "items")).alias("variants"))
    found = found.withColumn("item", F.get("variants", F.lit(0)))
    item = F.col("item")
    found = found.withColumn("sellers", F.filter(items(at(item, "sellers")), lambda s: F.coalesce(text(at(s, "sellerId")) == "1", F.lit(False))))
    found = found.withColumn("offer", at(F.get("sellers", F.lit(0)), "commertialOffer"))
    offer, name = F.col("offer"), text(at(p, "productName"))
    quantity, listed, stated, unit, times = whole(at(offer, "AvailableQuantity")), at(offer, "ListPrice"), at(offer, "IsAvailable"), at(item, "measurementUnit"), at(item, "unitMultiplier")
    found = found.select(
        "*", name.alias("name"), observed_presentation(name, text(at(p, "description"))).alias("presentation"), money(at(offer, "Price")).alias("price"), (quantity > 0).alias("available"),
        text(at(p, "link")).alias("product_url"), scalar(at(item, "itemId")).alias("sku"), F.split_part(F.trim(text(at(p, "categories[0]")), F.lit("/")), F.lit("/"), F.lit(1)).alias("category"),
        text(at(item, "images[0].imageUrl")).alias("image"), scalar(at(item, "ean")).alias("gtin"), text(at(offer, "PriceValidUntil")).alias("valid_until"),
    )
    combined = T.strip_marks(F.coalesce(name, F.lit(""))).rlike(r"\b(?:mas|gratis|combo)\b|\+")
    return _records(found, host, as_of, lambda f: [
        (F.lit(currency == K.CURRENCY), "currency_not_declared"),
        (~combined, "combined_pack"),
        (F.size("variants") == 1, "several_variants"),
        ((absent(unit) | (text(unit) == "un")) & (absent(times) | (scalar(times).try_cast("double") == 1)), "weighted_or_multiplied_unit"),
        (F.size("sellers") == 1, "ambiguous_own_offer"),
        (absent(listed) | (scalar(listed).try_cast("double") == 0) | (money(listed) == f["price"]), "promotion"),
        (quantity >= 0, "quantity_not_explicit"),
        (absent(stated) | (flag(stated) == (quantity > 0)), "availability_contradicts_quantity"),
    ])


def shared_catalog(responses: DataFrame, host: str, as_of: datetime, link: str) -> DataFrame:
    """Whole catalogs behind one link: {settings.currencyCode, categories, products}.

    Ids must be given and different within a reply. Good products of a reply that share their normalized name are all held
    as ambiguous: one shuffle by name. Categories are joined by reply and id; the last of a repeated id holds.
    """
    key = ["url", "observed_at"]
    read = responses.select(*key, F.try_parse_json("body").alias("reply"))
    r = F.col("reply")
    ids = F.transform(items(at(r, "products")), lambda p: text(at(p, "id")))
    unique = F.forall(ids, lambda i: F.coalesce(i != "", F.lit(False))) & (F.size(F.array_distinct(ids)) == F.size(ids))
    named = read.select(*key, F.posexplode(items(at(r, "categories"))).alias("_at", "_c"))
    named = named.select(*key, "_at", text(at(F.col("_c"), "id")).alias("_id"), text(at(F.col("_c"), "name")).alias("category"))
    named = named.groupBy(*key, "_id").agg(F.max_by("category", "_at").alias("category"))
    found = read.select(*key, (text(at(r, "settings.currencyCode")) == K.CURRENCY).alias("_mxn"), unique.alias("_unique"), F.explode(items(at(r, "products"))).alias("product"))
    p = F.col("product")
    found = found.withColumn("_id", text(at(p, "categoryId"))).join(named, [*key, "_id"], "left")
    measure, image, title = observed_presentation(text(at(p, "gramaje"))), text(at(p, "image")), F.trim(text(at(p, "name")))
    shown = F.when(image.rlike("(?i)^[a-z]+:"), image).otherwise(F.concat(F.lit(f"https://{host}/"), F.ltrim(image, F.lit("/"))))
    found = found.select(
        "*", F.concat_ws(" ", title, measure).alias("name"), measure.alias("presentation"), money(at(p, "price")).alias("price"), flag(at(p, "available")).alias("available"), F.lit(link).alias("product_url"),
        text(at(p, "id")).alias("sku"), F.when((image != "") & (F.try_parse_url(shown, F.lit("HOST")) == host), shown).alias("image"), F.lit(None).cast("string").alias("gtin"), F.lit(None).cast("string").alias("valid_until"),
    )
    out = _records(found, host, as_of, lambda f: [
        (f["_mxn"], "currency_not_declared"),
        (f["_unique"], "missing_or_repeated_id"),
        (flag(at(p, "available")).isNotNull() & ~S.blank(title), "missing_identity_or_availability"),
        (absent(at(p, "salePrice")) & absent(at(p, "promotion")), "promotion"),
        (f["category"].isNotNull(), "unknown_category"),
    ])
    alike = F.count_if(F.col("reject_reason").isNull()).over(Window.partitionBy(*key, "normalized_name"))
    return out.withColumn("reject_reason", F.coalesce("reject_reason", F.when(alike > 1, "ambiguous_shared_identity")))


def _piece(found: DataFrame, label: str) -> DataFrame:
    """pieces: the variants whose whole title is the label; variant: the first of them."""
    pieces = F.filter(items(at(F.col("product"), "variants")), lambda v: F.coalesce(text(at(v, "title")).rlike(f"(?i)^(?:{label})$"), F.lit(False)))
    return found.withColumn("pieces", pieces).withColumn("variant", F.get("pieces", F.lit(0)))


def _variant_fields(found: DataFrame, host: str, price: Column, category: str, image: Column) -> DataFrame:
    p, v = F.col("product"), F.col("variant")
    title, number = text(at(p, "title")), scalar(at(v, "id"))
    sku = F.nullif(scalar(at(v, "sku")), F.lit(""))
    return found.select(
        "*", F.concat(title, F.lit(" · "), text(at(v, "title"))).alias("name"), observed_presentation(title).alias("presentation"), price.alias("price"), flag(at(v, "available")).alias("available"),
        F.concat(F.lit(f"https://{host}/products/"), text(at(p, "handle")), F.lit("?variant="), number).alias("product_url"), F.coalesce(sku, number).alias("sku"), text(at(p, category)).alias("category"),
        image.alias("image"), sku.alias("gtin"), F.lit(None).cast("string").alias("valid_until"),
    )


def storefront_products(responses: DataFrame, host: str, as_of: datetime, currency: str | None, label: str) -> DataFrame:
    """Bulk replies {products: [...]} with decimal prices: the one variant whose title is the label, without a discount."""
    p, v = F.col("product"), F.col("variant")
    before = at(v, "compare_at_price")
    images = first_image(items(at(p, "images")), scalar(at(p, "id")), scalar(at(v, "id")))
    found = _variant_fields(_piece(_elements(responses, "products"), label), host, money(at(v, "price")), "product_type", images)
    return _records(found, host, as_of, lambda f: [
        (F.lit(currency == K.CURRENCY), "currency_not_declared"),
        (text(at(p, "handle")).rlike("^[a-z0-9-]+$"), "invalid_handle"),
        (F.size("pieces") == 1, "ambiguous_piece"),
        (scalar(at(v, "product_id")) == scalar(at(p, "id")), "variant_of_another_product"),
        (absent(before) | (text(before) == "") | (scalar(before).try_cast("double") == 0) | (money(before) == f["price"]), "promotion"),
    ])


def storefront_product(responses: DataFrame, host: str, as_of: datetime, currency: str | None, label: str) -> DataFrame:
    """Replies that are one product with prices in whole cents; its availability must be that of any variant."""
    p, v = F.col("product"), F.col("variant")
    found = _piece(responses.select("url", "observed_at", F.try_parse_json("body").alias("product")), label)
    price_cents, before, image = whole(at(v, "price")), at(v, "compare_at_price"), text(at(p, "featured_image"))
    shown = F.when(image.rlike("^//"), F.concat(F.lit("https:"), image)).when(image.rlike("(?i)^[a-z]+:"), image).otherwise(F.concat(F.lit(f"https://{host}/"), F.ltrim(image, F.lit("/"))))
    price = S.parse_money((price_cents.cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string"))
    found = _variant_fields(found, host, price, "type", F.when(image != "", shown))
    states = F.transform(items(at(p, "variants")), lambda x: flag(at(x, "available")))
    return _records(found, host, as_of, lambda f: [
        (F.lit(currency == K.CURRENCY), "currency_not_declared"),
        ((f["url"] == F.concat(F.lit(f"https://{host}/products/"), text(at(p, "handle")), F.lit(".js"))) & text(at(p, "title")).isNotNull(), "url_conflict"),
        (F.forall(states, lambda s: s.isNotNull()) & (flag(at(p, "available")) == F.array_contains(states, True)), "conflicting_availability"),
        (F.size("pieces") == 1, "ambiguous_piece"),
        (price_cents.isNotNull() & (absent(before) | whole(before).isin(0) | (whole(before) == price_cents)), "promotion"),
    ])


# Categories whose goods are sold by weight, and names that state a case or a weight.
FRESH = "(?i)frutas|verduras|carnes|pescados|mariscos"
CASE_OR_WEIGHT = r"(?i)\bcaja\b|\b(?:kg|kilos?|kilogramos?)\b"


def store_api_products(responses: DataFrame, host: str, as_of: datetime, by_summary: bool = False, wholesale: bool = False) -> DataFrame:
    """Replies that are arrays of simple products, prices in text of two minor units, not on sale, with explicit stock.

    by_summary: the short description may state the presentation too. wholesale: fresh goods are allowed, names of cases and weights aren't.
    """
    p = F.col("product")
    price, regular, code = at(p, "prices.price"), at(p, "prices.regular_price"), text(at(p, "prices.currency_code"))
    minor = F.when(text(price).rlike("^[0-9]{1,8}$"), text(price)).cast("decimal(18,2)")
    name = F.trim(T.unescape_html(text(at(p, "name"))))
    summary = F.trim(F.regexp_replace(T.unescape_html(F.regexp_replace(text(at(p, "short_description")), "<[^>]*>", " ")), r"[\s\u00a0]+", " "))
    categories = F.array_join(F.filter(F.transform(items(at(p, "categories")), lambda c: text(at(c, "name"))), lambda c: c.isNotNull()), " / ")
    found = _elements(responses, None).select(
        "*", name.alias("name"), observed_presentation(name, F.coalesce(summary, F.lit("")) if by_summary else None).alias("presentation"), S.parse_money((minor / 100).cast("decimal(18,2)").cast("string")).alias("price"),
        flag(at(p, "is_in_stock")).alias("available"), text(at(p, "permalink")).alias("product_url"), F.coalesce(F.nullif(scalar(at(p, "sku")), F.lit("")), scalar(at(p, "id"))).alias("sku"), categories.alias("category"),
        first_image(items(at(p, "images"))).alias("image"), F.lit(None).cast("string").alias("gtin"), F.lit(None).cast("string").alias("valid_until"),
    )
    empty = lambda v: absent(v) | (scalar(v) == "") | ((F.size(items(v)) == 0) & kind(v).startswith("ARRAY"))
    return _records(found, host, as_of, lambda f: [
        ((code == K.CURRENCY) & (whole(at(p, "prices.currency_minor_unit")) == 2), "currency_not_declared"),
        ((text(at(p, "type")) == "simple") & ~flag(at(p, "has_options")) & empty(at(p, "variation")) & empty(at(p, "variations")) & empty(at(p, "prices.price_range")), "variable_unit"),
        (~flag(at(p, "is_password_protected")), "protected"),
        (flag(at(p, "is_in_stock")).isNotNull() & ~flag(at(p, "is_on_backorder")), "stock_not_explicit"),
        (~flag(at(p, "on_sale")) & (text(price) == text(regular)), "promotion"),
        (~f["name"].rlike(CASE_OR_WEIGHT) if wholesale else ~f["category"].rlike(FRESH), "weighted_unit"),
    ])


def located_branches(responses: DataFrame, source: str, brand: str) -> DataFrame:
    """Branches out of store-locator replies {PhysicalStore: [...]}, with reject_reason; a reply without the list is a row of its own.

    A branch needs its number, id, city, state and coordinates (numbers or texts of numbers) inside Mexico.
    """
    filled = lambda v: F.nullif(F.trim(scalar(v)), F.lit(""))
    read = responses.select("url", "observed_at", at(F.try_parse_json("body"), "PhysicalStore").alias("_list"))
    found = read.select("url", "observed_at", kind(F.col("_list")).startswith("ARRAY").alias("_listed"), F.explode_outer(items(F.col("_list"))).alias("s"))
    found = found.filter(~F.col("_listed") | F.col("s").isNotNull())
    s = F.col("s")
    of = {"store_number": "storeName", "unique_id": "uniqueID", "branch_municipality": "city", "branch_state": "stateOrProvinceName"}
    described = at(s, "Description")
    shown = F.coalesce(filled(at(described, "displayStoreName")), filled(at(described, "[0].displayStoreName")), filled(at(s, "storeName")), F.lit("Sucursal"))
    lines = F.filter(F.transform(items(at(s, "addressLine")), filled), lambda x: x.isNotNull())
    market = F.get(F.filter(items(at(s, "Attribute")), lambda a: F.coalesce(text(at(a, "name")) == "MarketId", F.lit(False))), F.lit(0))
    out = found.select(
        "url", "observed_at", "_listed", kind(s).startswith("OBJECT").alias("_object"), *[filled(at(s, field)).alias(name) for name, field in of.items()], F.concat(F.lit(f"{brand} "), shown).alias("branch_name"),
        F.array_join(lines, ", ").alias("branch_address"), filled(at(s, "postalCode")).alias("postal_code"), *[filled(at(s, x)).try_cast("double").alias(x) for x in ("latitude", "longitude")], filled(at(market, "value")).alias("market_id"),
    )
    rules = [(F.col("_listed"), "missing_branch_list"), (F.col("_object"), "invalid_branch_object")]
    rules += [(F.col(name).isNotNull(), f"missing_{name}") for name in (*of, "latitude", "longitude")]
    rules.append((S.in_mexico(F.col("latitude"), F.col("longitude")), "unconfirmed_location"))
    out = out.withColumn("reject_reason", _first(rules)).withColumn("branch_external_key", F.concat(F.lit(f"{source}:"), "store_number"))
    return out.drop("_listed", "_object")


def rejections(found: DataFrame) -> DataFrame:
    """How often each reason was given."""
    return found.filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))
