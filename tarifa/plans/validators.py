"""Rules that records, offers, captures and reviews must keep, as conditions of Spark: the codes of what is broken, or the first of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.plans.ingest import BRANCH_FIELDS, Record

Tests = list[tuple[Column, str]]


def yes(test: Column) -> Column:
    """The test, with unknown as no."""
    return F.coalesce(test, F.lit(False))


def codes(tests: Tests) -> Column:
    """The codes of all tests that hold, in order."""
    return F.filter(F.array(*[F.when(yes(test), F.lit(code)) for test, code in tests]), lambda c: c.isNotNull())


def first_code(tests: Tests) -> Column:
    """The code of the first test that holds, else null."""
    return F.coalesce(*[F.when(yes(test), F.lit(code)) for test, code in tests])


# Online observations


def given_keys(raw: Column, keys: tuple[str, ...]) -> Column:
    """Those of the keys of a JSON object whose value isn't null."""
    return Record.read(raw, lambda r: _given(r, keys))


def _given(r: Record, keys: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.when(yes(r.kind(k) != "VOID"), F.lit(k)) for k in keys]), lambda k: k.isNotNull())


def observation_issues(records: DataFrame, sources: DataFrame, as_of: datetime, raw: str = "raw") -> DataFrame:
    """records (a column of JSON objects) with issues: what bars an online observation from being published, in the order of the rules.

    sources: source, store_slug, hosts (array), publisher_enabled, status, country.
    """
    text = lambda name: Record.read(F.col(raw), lambda r: r.text(name))
    marked = records.withColumn("_source", text("source")).withColumn("_slug", text("store_slug"))
    open_ = sources.filter(F.col("publisher_enabled") & (F.col("status") != "blocked") & (F.col("country") == K.COUNTRY) & (F.size("hosts") > 0))
    hosts = open_.groupBy(F.col("source").alias("_source"), F.col("store_slug").alias("_slug")).agg(F.flatten(F.collect_list("hosts")).alias("_hosts"))
    marked = marked.join(hosts, ["_source", "_slug"], "left")
    issues = Record.read(F.col(raw), lambda r: codes(_observation_tests(r, F.col("_hosts"), as_of)))
    return marked.withColumn("issues", issues).drop("_source", "_slug", "_hosts")


def _observation_tests(r: Record, hosts: Column, as_of: datetime) -> Tests:
    url, price = r.text("source_url"), r.get("price", "decimal(20,6)")
    number = lambda name: r.get(name, "decimal(20,6)")
    missing = lambda name: r.kind(name).isNull() | (r.kind(name) == "VOID")
    host = F.lower(F.regexp_extract(url, "^https://([a-zA-Z0-9.-]+)/", 1))
    observed, available = S.parse_instant(r.text("observed_at")), r.get("available", "boolean")
    stock, until = r.text("stock_status"), r.get("valid_until")
    is_number = r.kind("price").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return [
        (~yes(F.schema_of_variant(r.value).startswith("OBJECT")), "invalid_object"),
        (hosts.isNull(), "source_not_enabled"),
        (~yes(r.text("price_scope") == "online"), "not_online"),
        (F.size(_given(r, ("branch_id", *BRANCH_FIELDS))) > 0, "branch_data"),
        (~yes(r.text("currency") == K.CURRENCY), "currency"),
        (~yes(is_number), "price_not_a_number"),
        (~yes((r.kind("is_synthetic") == "BOOLEAN") & ~r.get("is_synthetic", "boolean")), "synthetic"),
        (~yes(r.text("review_status") == "accepted"), "not_accepted"),
        (~yes(r.kind("available") == "BOOLEAN"), "availability"),
        *[(~r.filled(f), f"missing_{f}") for f in ("product_name", "normalized_name", "presentation", "category")],
        (~yes(url == r.text("store_product_url")), "evidence_is_not_the_listing"),
        (~yes(F.array_contains(hosts, host)), "host_not_allowed"),
        (url.rlike(r"\s"), "space_in_url"),
        (~yes(r.text("response_sha256").rlike("^[a-f0-9]{64}$")), "response_sha256"),
        (observed.isNull(), "observed_at"),
        (~missing("image_url") & ~yes(r.text("image_url").rlike("^https://[^ /]+/")), "image_url"),
        (is_number & ((price <= 0) | (price != F.round(price, 2))), "price"),
        (~missing("confidence_score") & ~yes(number("confidence_score").between(K.MIN_CONFIDENCE, 1)), "confidence_score"),
        (~missing("membership_required") & (r.kind("membership_required") != "BOOLEAN"), "membership_required"),
        (~missing("pack_count") & ~yes((number("pack_count") >= 1) & (number("pack_count") == F.floor(number("pack_count")))), "pack_count"),
        (~missing("net_quantity") & ~yes(number("net_quantity") > 0), "net_quantity"),
        ((stock == "in_stock") & ~available | (stock == "out_of_stock") & available, "stock_contradicts_availability"),
        (observed.isNotNull() & ~yes(S.in_catalog_window(observed, as_of)), "not_current"),
        (until.isNotNull() & ~yes(F.try_to_timestamp(until) > S.instant(as_of)), "expired"),
    ]


def online_row_reason(as_of: datetime) -> Column:
    """The first reason why a parsed product isn't an online offer; columns of parsed records."""
    c = F.col
    needed = ("source", "store_slug", "product_name", "presentation", "category", "source_url", "store_product_url", "observed_at", "response_sha256")
    return first_code(
        [
            (~yes(c("price_scope") == "online") | c("branch_id").isNotNull() | c("branch_name").isNotNull() | c("latitude").isNotNull() | c("longitude").isNotNull(), "mixed_mode"),
            (~yes(~c("is_synthetic")) | ~yes(c("review_status") == "accepted"), "unreviewed_or_synthetic"),
            *[(F.coalesce(c(f).cast("string"), F.lit("")) == "", f"missing_{f}") for f in needed],
            (~yes((c("currency") == K.CURRENCY) & (c("price") > 0) & (c("price") < 1_000_000)), "invalid_price"),
            (~yes(S.in_catalog_window(c("observed_at"), as_of)), "expired_or_future_observation"),
            (c("valid_until").isNotNull() & (c("valid_until") <= S.instant(as_of)), "expired_offer"),
        ]
    )


# Offers of providers


def _bad_https(url: Column) -> Column:
    good = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull() & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return url.isNotNull() & ~yes(good)


def checked_offers(offers: DataFrame, as_of: datetime) -> DataFrame:
    """offers with reject_reason (the first rule broken, else null), quality_flags (sorted) and quantity, unit and pack_count of the presentation.

    offers: retailer, external_id, source, name, price, previous_price (texts), currency, captured_at (text with offset), product_url, image_url,
    price_type (store, online, ...), store_id, store_name, address, latitude, longitude, availability, stock, gtin, ean, upc, presentation.
    """
    c = F.col
    text = lambda name, most: ~S.blank(c(name)) & (F.length(name) <= most)
    observed = S.parse_instant(c("captured_at"))
    price, previous = S.parse_money(c("price")), S.parse_money(c("previous_price"))
    branch = c("store_id").isNotNull() | c("store_name").isNotNull() | c("address").isNotNull() | c("latitude").isNotNull() | c("longitude").isNotNull()
    now = S.instant(as_of)
    reason = first_code(
        [
            (~yes(c("retailer").rlike("^[a-z0-9-]{1,60}$")), "invalid_retailer"),
            (~yes(text("name", 500) & text("external_id", 200)), "invalid_identity"),
            (~yes(text("source", 100)), "missing_source"),
            (price.isNull(), "invalid_price"),
            (~yes(c("currency") == K.CURRENCY), "other_currency"),
            (~yes(observed <= now + F.make_dt_interval(mins=F.lit(K.FUTURE_MINUTES))), "invalid_observation"),
            (observed < now - F.make_dt_interval(F.lit(K.FRESH_DAYS)), "expired_observation"),
            (_bad_https(c("product_url")) | _bad_https(c("image_url")), "invalid_evidence_url"),
            ((c("price_type") == "store") & S.blank(c("store_id")), "store_price_without_store"),
            ((c("price_type") == "online") & branch, "online_offer_with_branch"),
            (c("latitude").isNull() != c("longitude").isNull(), "half_a_place"),
            (~yes(c("latitude").between(-90, 90)) & c("latitude").isNotNull() | ~yes(c("longitude").between(-180, 180)) & c("longitude").isNotNull(), "place_out_of_bounds"),
            (c("stock") < 0, "invalid_stock"),
            (c("previous_price").isNotNull() & previous.isNull(), "invalid_previous_price"),
        ]
    )
    given = F.filter(F.array("gtin", "ean", "upc"), lambda g: g.isNotNull())
    valid = F.array_distinct(F.filter(F.array(*[S.canonical_gtin(c(g)) for g in ("gtin", "ean", "upc")]), lambda g: g.isNotNull()))
    parsed = offers.withColumn("_pack", T.parse_presentation(F.coalesce(F.nullif("presentation", F.lit("")), "name"))).withColumn("_given", given).withColumn("_valid", valid)
    wrong = F.exists("_given", lambda g: S.canonical_gtin(g).isNull())
    flags = codes(
        [
            (F.size("_valid") > 1, "conflicting_gtin"),
            ((c("stock") == 0) & c("availability"), "inconsistent_stock"),
            (wrong, "invalid_gtin"),
            (previous <= price, "previous_price_not_higher"),
            (c("availability").isNull(), "unknown_availability"),
            (c("_pack").isNull(), "unknown_presentation"),
        ]
    )
    out = parsed.withColumn("reject_reason", reason).withColumn("quality_flags", F.array_sort(F.array_distinct(flags)))
    return out.withColumns({f: F.col(f"_pack.{f}") for f in ("quantity", "unit", "pack_count")}).drop("_pack", "_given", "_valid")


def provider_page(offers: DataFrame, providers: list[str], limit: int = 5, identity: tuple[str, ...] = ("retailer", "external_id", "store_id")) -> DataFrame:
    """A bounded page of the first provider, in order, that gave offers: offers (provider, position and the identity), of one identity the last at its first place."""
    if not 1 <= limit <= 10:
        raise ValueError("limit must be 1 to 10")
    rank = F.array_position(F.lit(providers), F.col("provider"))
    known = offers.withColumn("_rank", rank).filter("_rank > 0")
    first = known.agg(F.min("_rank").alias("_rank"))
    rows = known.join(F.broadcast(first), "_rank", "left_semi")  # one row
    w = Window.partitionBy(*identity)
    rows = rows.withColumn("_place", F.min("position").over(w)).withColumn("_last", F.row_number().over(w.orderBy(F.col("position").desc()))).filter("_last = 1")
    return rows.orderBy("_place").limit(limit).drop("_rank", "_place", "_last")


# Known listings and reviews


def bound_to_known(rows: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """rows with reject_reason (the first that holds) and, for those without one, the category of the known listing: a refresh adds no listing and changes none.

    rows: source, store_product_url, source_url, normalized_name, source_product_name, presentation, store_slug, captured_at (text), category.
    known: store_product_url (unique), normalized_name, external_name, presentation, store_slug, category, latest_capture.
    """
    k = known.select(F.col("store_product_url"), F.struct("normalized_name", "external_name", "presentation", "store_slug", "category", "latest_capture").alias("_k"))
    j = rows.join(k, "store_product_url", "left")
    c, captured = F.col, S.parse_instant(F.col("captured_at"))
    differs = lambda a, b: ~c(a).eqNullSafe(c(b))
    reason = first_code(
        [
            (~yes(c("source") == source) | c("_k").isNull(), "unknown_listing"),
            (differs("source_url", "store_product_url"), "changed_evidence_url"),
            (differs("normalized_name", "_k.normalized_name") | differs("source_product_name", "_k.external_name"), "changed_product_identity"),
            (differs("presentation", "_k.presentation"), "changed_presentation"),
            (differs("store_slug", "_k.store_slug"), "changed_store"),
            (c("_k.latest_capture").isNotNull() & captured.isNull(), "invalid_captured_at"),
            (captured < c("_k.latest_capture"), "older_than_current_observation"),
        ]
    )
    out = j.withColumn("reject_reason", reason)
    return out.withColumn("category", F.when(F.col("reject_reason").isNull(), F.col("_k.category")).otherwise(F.col("category"))).select(*rows.columns, "reject_reason")


def reviewed_listings(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each listing of a review manifest, and for each captured one that it lacks: reasons, and status ready or pending_review.

    manifest: canonical_variant_key, label, source, url, observed_name, observed_presentation. rows: source, store_product_url, source_product_name, presentation,
    price_scope, available, is_synthetic, review_status, raw_payload.
    """
    facts = ("source_product_name", "presentation", "price_scope", "available", "is_synthetic", "review_status", "raw_payload")
    seen = rows.groupBy("source", F.col("store_product_url").alias("url")).agg(F.count("*").alias("_n"), F.max_by(F.struct(*facts), F.struct(*[F.col(f).cast("string") for f in facts])).alias("_row"))
    asked = manifest.withColumn("_asked", F.lit(True))
    c = F.col
    j = asked.join(seen, ["source", "url"], "full_outer")
    here = c("_row").isNotNull() & c("_asked").isNotNull()
    reasons = codes(
        [
            (c("_asked").isNull(), "unexpected_listing"),
            (c("_asked") & (c("_n") > 1), "duplicate_capture"),
            (c("_row").isNull(), "missing_capture_or_evidence"),
            (here & ~c("_row.source_product_name").eqNullSafe(c("observed_name")), "product_name_changed"),
            (here & ~c("_row.presentation").eqNullSafe(c("observed_presentation")), "presentation_or_unit_changed"),
            (here & ~yes(c("_row.price_scope") == "online"), "price_scope_changed"),
            (here & ~yes(c("_row.available")), "availability_not_confirmed"),
            (here & ~yes(~c("_row.is_synthetic")), "synthetic_or_unknown_evidence"),
            (here & ~yes(c("_row.review_status") == "accepted"), "evidence_not_accepted"),
            (here & ~yes(S.json_kind(c("_row.raw_payload")) == "object"), "raw_evidence_missing"),
        ]
    )
    out = j.select("canonical_variant_key", "label", "source", "url", reasons.alias("reasons"), c("_row.source_product_name").alias("observed_name"), c("_row.presentation").alias("observed_presentation"))
    return out.withColumn("status", F.when(F.size("reasons") > 0, "pending_review").otherwise("ready"))


def basket_issues(manifest: DataFrame, sources: tuple[str, str]) -> DataFrame:
    """canonical_variant_key and reason of the items of a manifest that can't be compared: not a reviewed key, or not one listing of each of the two sources; and of listings that two items name."""
    items = manifest.groupBy("canonical_variant_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("found"))
    fit = F.col("canonical_variant_key").startswith("reviewed:")
    whole = (F.col("n") == 2) & (F.col("found") == F.array(*[F.lit(s) for s in sorted(sources)]))
    of_items = items.select("canonical_variant_key", first_code([(~yes(fit), "not_a_reviewed_key"), (~whole, "needs_one_listing_of_each_source")]).alias("reason")).filter("reason IS NOT NULL")
    shared = manifest.groupBy("source", "url").agg(F.countDistinct("canonical_variant_key").alias("n"), F.min("canonical_variant_key").alias("canonical_variant_key")).filter("n > 1")
    return of_items.union(shared.select("canonical_variant_key", F.lit("listing_of_several_items").alias("reason")))


def prepared_basket(manifest: DataFrame, rows: DataFrame, sources: tuple[str, str], reviewed_at: str) -> DataFrame:
    """rows of a reviewed basket with the category of their item and the review in their evidence; what isn't ready, or not one listing of each source, fails the whole basket.

    manifest: as of reviewed_listings(), with category and match_basis.
    """
    wrong = basket_issues(manifest, sources).select(F.concat_ws(" ", "canonical_variant_key", "reason").alias("said"))
    wrong = wrong.union(reviewed_listings(manifest, rows).filter("status <> 'ready'").select(F.concat_ws(" ", "source", "url", F.array_join("reasons", ","))))
    said = [r.said for r in wrong.orderBy("said").limit(20).collect()]
    if said:
        raise ValueError("Review required: " + "; ".join(said))
    item = manifest.select("source", F.col("url").alias("store_product_url"), "canonical_variant_key", F.col("category").alias("_category"), "match_basis")
    review = F.to_json(F.struct(F.struct("canonical_variant_key", F.col("match_basis").alias("basis"), F.lit(reviewed_at).alias("reviewed_at")).alias("reviewed_comparison")))
    out = rows.drop("category").join(item, ["source", "store_product_url"])
    return out.withColumn("raw_payload", S.merged_json(F.col("raw_payload"), review)).withColumnRenamed("_category", "category").drop("match_basis")


def bound_products(products: DataFrame, listings: DataFrame, mappings: DataFrame) -> DataFrame:
    """products with the reviewed identity of mappings (source, url, name, canonical_variant_key, brand, variant_label, net_quantity, unit, pack_count) bound by listings (source, store_product_url, external_name, product_id)."""
    facts = ["canonical_variant_key", "brand", "variant_label", "net_quantity", "unit", "pack_count"]
    m = mappings.select("source", F.col("url").alias("store_product_url"), F.col("name").alias("external_name"), F.struct(*facts).alias("_new"))
    bound = listings.select("source", "store_product_url", "external_name", "product_id").join(m, ["source", "store_product_url", "external_name"])
    bound = bound.groupBy(F.col("product_id").alias("id")).agg(F.max("_new").alias("_new"))
    out = products.join(bound, "id", "left")
    return out.withColumns({f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in facts}).select(*products.columns)


# Reports of captures

# Rejection codes and prefixes by the bucket that they are reported under.
BUCKETS = {
    "precio_ausente": ("missing_branch_price_field",),
    "stock_invalido": ("missing_branch_inventory_field",),
    "sku_duplicado": ("duplicate_product_across_terms",),
    "limite": ("global_limit", "products_per_term_limit"),
    "filtro_deliberado": ("out_of_stock",),
    "parsing": ("detail_missing_*", "missing_contents", "missing_part_number", "unknown_product_rejection"),
    "evidencia_incompleta": ("physical_store_id_mismatch", "missing_official_product_url", "missing_product_name", "invalid_branch_location", "unexpected_currency:*"),
}


def bucket(reason: Column, buckets: dict[str, tuple[str, ...]] = BUCKETS, other: str = "otro") -> Column:
    """The bucket of a rejection code; a star at the end stands for any rest."""
    out = F.lit(other)
    for name, members in buckets.items():
        exact = [m for m in members if not m.endswith("*")]
        fits = reason.isin(*exact) if exact else F.lit(False)
        for m in members:
            fits = fits | reason.startswith(m[:-1]) if m.endswith("*") else fits
        out = F.when(yes(fits), F.lit(name)).otherwise(out)
    return out


def probe_classes(outcomes: DataFrame) -> DataFrame:
    """probe and class (blocked, confirmed_branch_local, online_only, ambiguous) of probes of a product at two branches.

    outcomes: probe, blocked, attributable (the reply names the branch), region (the one the reply names), and sku (null without a snapshot), currency, price, available, quantity.
    """
    n = F.count("*")
    both = lambda c: F.count_if(c) == 2
    varies = lambda c: F.min(c) != F.max(c)
    o = outcomes.groupBy("probe").agg(
        F.bool_or("blocked").alias("blocked"),
        ((n == 2) & both(F.col("sku").isNotNull())).alias("whole"),
        both(yes(F.col("attributable"))).alias("attributed"),
        (~yes(varies("sku")) & ~yes(varies("currency"))).alias("same"),
        (yes(varies("price")) | yes(varies("available")) | both(F.col("quantity").isNotNull()) & yes(varies("quantity"))).alias("changed"),
        (both(~yes(F.col("attributable"))) & both(F.col("region").isNull())).alias("nowhere"),
    )
    kind = (
        F.when(F.col("blocked"), "blocked")
        .when(~F.col("whole"), "ambiguous")
        .when(F.col("attributed") & F.col("same") & F.col("changed"), "confirmed_branch_local")
        .when(F.col("nowhere"), "online_only")
        .otherwise("ambiguous")
    )
    return o.select("probe", kind.alias("class"))


def only_fresh(offers: DataFrame, on: bool = True) -> DataFrame:
    """The fresh offers, where the switch is on."""
    return offers.filter("freshness = 'fresh'") if on else offers


def of_direct_sources(offers: DataFrame) -> DataFrame:
    """Offers whose source is a retailer's own feed, by the earlier naming rule."""
    return offers.filter(F.col("source").like("%-direct"))
