"""More queries over the driver tables: texts, records, validators, batches and captures, made out of parts, suppliers and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.operators import latest as L
from tarifa.plans import batch as B
from tarifa.plans import compare as P
from tarifa.plans import ingest, validators
from tarifa.plans import publish as U
from tarifa.plans.mapping import AS_OF, dealt, load, tables
from tarifa.queries import query
from tarifa.sources import feeds, official, products, web

def _key() -> Column:
    return F.col("p_partkey")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part")


def _dealt_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(_part(spark, sf_dir), "p_partkey")


# Texts

_NAME = "'Café  Añejo ' || p_name || ', ' || p_brand || ', Caja ' || p_size || ' piezas, 1.5 Litros'"


@query(
    rf"""WITH t AS (SELECT p_partkey, p_brand, {_NAME} AS n FROM part), u AS (SELECT *, translate(lower(n), 'áàäâãåéèëêíìïîóòöôõúùüûñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy') AS f FROM t)
SELECT p_partkey, trim(regexp_replace(f, '[^a-z0-9.]+', ' ', 'g')) AS variant_text, trim(regexp_replace(regexp_replace(regexp_replace(f, '\b(litros?|lts?|lt)\b', 'l', 'g'), '\b(piezas?|pzas?|pza|pz)\b', 'pieza', 'g'), '[^a-z0-9]+', ' ', 'g')) AS official_name,
trim(regexp_replace(strip_accents(lower(n)), '[^a-z0-9.,]+', ' ', 'g')) AS compatible, strip_accents(lower(n)) AS unmarked, translate(lower(n), 'áéíóúü', 'aeiouu') AS vowels, trim(split_part(n, ',', 3)) || ', ' || trim(split_part(n, ',', 4)) AS parts, 'Café & ' || p_brand AS unescaped FROM u""",
    mapped=False,
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name with accents, units and parts under each of the normalisers."""
    n = F.concat(F.lit("Café  Añejo "), "p_name", F.lit(", "), "p_brand", F.lit(", Caja "), "p_size", F.lit(" piezas, 1.5 Litros"))
    c = F.col("n")
    return _part(spark, sf_dir).withColumn("n", n).select(
        "p_partkey", T.normalize_variant_text(c).alias("variant_text"), T.normalize_official_name(c).alias("official_name"), T.normalize_compatible(c).alias("compatible"), T.strip_marks(c).alias("unmarked"),
        T.fold_vowels(c).alias("vowels"), T.third_parts(c).alias("parts"), T.unescape_html(F.concat(F.lit("Caf&eacute; &amp; "), "p_brand")).alias("unescaped"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' kg' WHEN 1 THEN p_size || '.5 l' WHEN 2 THEN p_size || CASE WHEN p_size = 1 THEN ' pieza' ELSE ' piezas' END WHEN 3 THEN '1 pieza' WHEN 4 THEN '1 l' ELSE p_size || ' g' END AS shown,
CASE p_partkey % 6 WHEN 0 THEN 'arroz|qty=' || p_size || 'kg' WHEN 1 THEN 'arroz ' || p_size || '|qty=5l' WHEN 2 THEN 'arroz|pack=' || p_size WHEN 3 THEN 'arroz' WHEN 4 THEN 'arroz litro' ELSE 'arroz|qty=' || p_size || 'g' END AS variant FROM part""",
    mapped=False,
)
def presentations_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names state: a presentation to show, and the key of the variant."""
    k, size = _key() % 6, F.col("p_size").cast("string")
    end = F.when(k == 0, F.concat(size, F.lit(" Kilos"))).when(k == 1, F.concat(size, F.lit(",5 lt"))).when(k == 2, F.concat(size, F.lit(" pzas"))).when(k == 3, "").when(k == 4, "litro").otherwise(F.concat(size, F.lit(" gr")))
    return _part(spark, sf_dir).withColumn("n", F.trim(F.concat(F.lit("Arroz "), end))).select("p_partkey", T.infer_presentation(F.col("n")).alias("shown"), T.parse_variant(F.col("n"))["key"].alias("variant"))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 9 THEN CAST(p_size + 0.25 AS DECIMAL(10,2)) END AS money, 'Street ' || p_size || ', Town, México' AS place, CASE WHEN p_size % 10 >= 7 THEN 'geocoded' ELSE 'review' END AS placed,
p_name || ' [' || lower(p_type) || ':' || md5(p_brand) || ']' AS taken_name, p_partkey || '|null|' || p_brand AS identity, CASE WHEN p_partkey % 2 = 0 THEN 'https://b.mx/' || p_partkey END AS evidence,
sha256(p_partkey || '||' || p_brand) AS content_hash, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-02 05:59:59' WHEN p_partkey % 3 = 1 THEN TIMESTAMP '2024-01-01 10:00:00' END AS expiry, TIMESTAMP '2024-01-01 12:00:00' AS noon,
CASE WHEN p_size % 4 = 0 THEN 'no_data' WHEN p_size < 7 THEN 'healthy' WHEN p_size <= 21 THEN 'stale' ELSE 'old' END AS health FROM part""",
    mapped=False,
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    money = F.concat("p_size", F.when(c("p_size") > 9, ".25").otherwise(".255"))
    until = F.when(_key() % 3 == 0, "2024-01-01").when(_key() % 3 == 1, "2024-01-01T05:00:00-05:00").otherwise("2024-01-01T05:00:00")
    as_of = F.lit("2024-03-01").cast("timestamp")
    seen = F.when(c("p_size") % 4 != 0, as_of - F.make_dt_interval(c("p_size")))
    return _part(spark, sf_dir).select(
        "p_partkey", S.parse_money(money).alias("money"), S.geocoding_query(F.concat(F.lit("Street "), "p_size"), F.lit(" "), none, F.lit("Town"), F.lit("México")).alias("place"), S.geocode_status((c("p_size") % 10) / 10, 0.7).alias("placed"),
        S.collision_name(c("p_name"), F.lower("p_type"), c("p_brand")).alias("taken_name"), S.identity_key(_key(), none, c("p_brand")).alias("identity"),
        S.evidence_url(F.lit("ftp://a.mx/"), F.when(_key() % 2 == 0, F.concat(F.lit("https://b.mx/"), _key())), F.lit("https:///nowhere")).alias("evidence"), S.content_hash(_key(), none, c("p_brand")).alias("content_hash"),
        S.parse_expiry(until).alias("expiry"), S.noon_utc(F.lit("2024-01-01")).alias("noon"), S.source_health(seen, as_of).alias("health"),
    )


@query(
    """SELECT p_partkey, p_name AS product, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS branch, CASE WHEN p_name LIKE '%red%' THEN 'Pintura' ELSE 'Hogar y ferreteria' END AS category, CASE WHEN p_partkey % 3 = 0 THEN 'region ' || p_partkey END AS region,
CASE WHEN p_partkey % 7 = 0 THEN 'precio_ausente' WHEN p_partkey % 7 = 1 THEN 'parsing' WHEN p_partkey % 7 = 2 THEN 'evidencia_incompleta' WHEN p_partkey % 7 = 3 THEN 'filtro_deliberado' ELSE 'otro' END AS bucket FROM part""",
    mapped=False,
)
def label_and_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, _key() % 7
    label = F.concat("p_name", F.when(_key() % 2 == 0, F.concat(F.lit(" · "), "p_brand")).otherwise(""))
    term = F.when(F.contains("p_name", F.lit("red")), " Pintura! ").otherwise("otra cosa")
    inner = F.base64(F.concat(F.lit("region "), _key()).cast("binary"))
    token = F.when(_key() % 3 == 0, F.rtrim(F.base64(F.to_json(F.struct(inner.alias("regionId"))).cast("binary")), F.lit("="))).when(_key() % 3 == 1, "not base64 of JSON")
    reason = F.when(k == 0, "missing_branch_price_field").when(k == 1, "detail_missing_name").when(k == 2, "unexpected_currency:USD").when(k == 3, "out_of_stock").when(k == 4, "whatever")
    return _part(spark, sf_dir).select("p_partkey", *official.label_parts(label), official.category_of_term(term).alias("category"), official.region_of_token(token).alias("region"), validators.bucket(reason).alias("bucket"))


# Staged records


def _json(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _staged(k: Column) -> dict[str, Column]:
    """The fields of a staged record for each part: every third is of a branch, some have a defect."""
    text = lambda prefix, c=_key(): F.concat(F.lit(prefix), c)
    branch = _key() % 3 == 0
    local = lambda value: F.when(branch, value)
    fields = {c: F.lit(v) for c, v in {"source": "parts", "currency": "MXN", "evidence_kind": "store_api", "presentation": "1 pieza", "observed_at": "2001-11-04T10:00:00Z", "captured_at": "2001-11-04T10:00:00Z", "branch": None}.items() if v}
    fields |= {"store_brand": F.col("p_brand"), "store_slug": F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), "source_product_name": F.initcap("p_name"), "normalized_name": F.col("p_name"), "category": F.col("p_type")}
    fields |= {"price": F.round("p_retailprice", 2), "available": F.col("p_size") % 2 == 0, "source_url": text("https://parts.mx/"), "store_product_url": text("https://parts.mx/"), "external_reference": text("r"), "content_hash": text("hash-000000")}
    fields |= {"confidence_score": F.when(k == 1, 0.5).otherwise(0.9), "is_synthetic": k == 2, "review_status": F.when(k == 3, "pending").otherwise("accepted"), "price_scope": F.when(branch, "branch_local").otherwise("online")}
    fields |= {"branch_external_key": local(text("b", F.col("p_size"))), "branch_name": local(text("Branch ", F.col("p_size"))), "branch_address": local(F.lit("Street 1")), "branch_municipality": local(F.lit("Town")), "branch_state": local(F.lit("State"))}
    fields |= {"latitude": local(F.when(k == 4, 50.0).otherwise(19.5)), "longitude": local(F.lit(-99.0)), "image_url": F.lit(None).cast("string"), "validation_errors": F.array().cast("array<string>"), "raw_payload": F.struct(_key().alias("id"))}
    return fields


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged lines: one for each part, the first hundred twice, and a broken line for every fortieth."""
    once = _dealt_part(spark, sf_dir).select(_key(), _json(_staged(_key() % 11)).alias("raw"))
    again = once.filter("p_partkey < 100").withColumn("p_partkey", _key() + 1_000_000)
    broken = once.filter("p_partkey % 40 = 0").select((_key() + 2_000_000).alias("p_partkey"), F.lit("{").alias("raw"))
    rows = once.union(again).union(broken)
    error = F.when(S.json_kind(F.col("raw")).isNull(), "invalid_json")
    return rows.select(F.lit("lines").alias("file"), F.col("p_partkey").alias("line"), "raw", error.alias("error"))


_ISSUES = "CASE p_partkey % 11 WHEN 1 THEN 'invalid_confidence_score' WHEN 2 THEN 'synthetic_record' WHEN 3 THEN 'review_not_accepted' WHEN 4 THEN CASE WHEN p_partkey % 3 = 0 THEN 'invalid_latitude' END END"
_ACCEPTED = "(p_partkey % 11 NOT IN (1, 2, 3) AND NOT (p_partkey % 11 = 4 AND p_partkey % 3 = 0))"


@query(f"SELECT p_partkey AS line, coalesce({_ISSUES}, '') AS issues FROM part UNION ALL SELECT p_partkey + 1000000, coalesce({_ISSUES}, '') FROM part WHERE p_partkey < 100 UNION ALL SELECT p_partkey + 2000000, 'invalid_json' FROM part WHERE p_partkey % 40 = 0", mapped=False)
def staged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validated(_lines(spark, sf_dir), AS_OF).select("line", F.array_join("issues", ",").alias("issues"))


@query(
    f"""SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE p_partkey < 100) + (SELECT count(*) FROM part WHERE p_partkey % 40 = 0) AS input, n + d AS accepted, n AS "unique", d AS duplicates,
(SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE p_partkey < 100) + (SELECT count(*) FROM part WHERE p_partkey % 40 = 0) - n - d AS rejected
FROM (SELECT count(*) FILTER ({_ACCEPTED}) AS n, count(*) FILTER ({_ACCEPTED} AND p_partkey < 100) AS d FROM part)""",
    mapped=False,
)
def staged_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.preflight(ingest.validated(_lines(spark, sf_dir), AS_OF))


@query(f"SELECT code, count(*) AS n FROM (SELECT {_ISSUES} AS code FROM part UNION ALL SELECT {_ISSUES} FROM part WHERE p_partkey < 100 UNION ALL SELECT 'invalid_json' FROM part WHERE p_partkey % 40 = 0) WHERE code IS NOT NULL GROUP BY 1", mapped=False)
def staged_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejection_histogram(ingest.validated(_lines(spark, sf_dir), AS_OF))


@query(
    f"""WITH l AS (SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_partkey < 100) SELECT 'parts' AS source, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_size ELSE '<missing>' END AS branch_external_key, p_type AS category, count(*) AS records,
count(*) FILTER ({_ACCEPTED}) AS accepted, count(*) FILTER (NOT {_ACCEPTED}) AS rejected FROM l GROUP BY ALL""",
    mapped=False,
)
def staged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.preflight_groups(ingest.validated(_lines(spark, sf_dir), AS_OF))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 5 <> 0 AND p_partkey % 4 <> 1 AND (p_partkey % 3 > 0 OR p_partkey % 9 = 0) AND p_partkey % 7 > 0", mapped=False)
def publishable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part of a branch, of which some lie elsewhere or name no place."""
    branch = _key() % 3 == 0
    staged = _part(spark, sf_dir).select(
        _key().alias("id"), F.when(_key() % 4 == 1, "pending").otherwise("accepted").alias("review_status"), F.lit("sitemap").alias("evidence_kind"), F.when(F.col("p_size") % 5 == 0, 0.69).otherwise(0.7).alias("confidence_score"), (_key() % 7 == 0).alias("is_synthetic"),
        F.array().cast("array<string>").alias("validation_errors"), F.when(branch, "branch_local").otherwise("online").alias("price_scope"), F.when(branch, F.when(_key() % 9 == 0, "19.43").when(_key() % 9 == 3, "north").otherwise("51.5")).alias("latitude"),
        F.when(branch, "-99.1").alias("longitude"), F.when(branch, "b1").alias("branch_external_key"),
    )
    return ingest.publishable(staged).select("id")


# The batch publisher


def _published(spark: SparkSession, sf_dir: str, times: int = 1) -> tuple[B.State, DataFrame]:
    records = ingest.unique_records(ingest.validated(_lines(spark, sf_dir), AS_OF)).select("raw")
    if times > 1:
        records = B.settled(records)
    state, report = B.publish_batch(B.empty_state(spark), records, AS_OF)
    for _ in range(times - 1):
        state, report = B.publish_batch(state, records, AS_OF)
    return state, report


@query(f"SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS slug, p_brand AS name, 'MX' AS country, true AS enabled FROM part WHERE {_ACCEPTED}", mapped=False)
def published_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[0].stores.drop("id")


@query(f"SELECT p_name AS normalized_name, min(p_type) AS category FROM part WHERE {_ACCEPTED} GROUP BY 1", mapped=False)
def published_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[0].products.select("normalized_name", "category")


@query(f"SELECT DISTINCT 'b' || p_size AS external_key, 'Branch ' || p_size AS name, CAST(19.5 AS DOUBLE) AS latitude, CAST(-99.0 AS DOUBLE) AS longitude, 'manual' AS geocoding_status FROM part WHERE p_partkey % 3 = 0 AND {_ACCEPTED}", mapped=False)
def published_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[0].branches.select("external_key", "name", "latitude", "longitude", "geocoding_status")


@query(f"SELECT lower(replace(p_brand, '#', '-')) AS slug, p_name AS product, 'https://parts.mx/' || p_partkey AS external_url, p_size % 2 = 0 AS available FROM part WHERE {_ACCEPTED}", mapped=False)
def published_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _published(spark, sf_dir)[0]
    stores, goods = s.stores.select(F.col("id").alias("store_id"), "slug"), s.products.select(F.col("id").alias("product_id"), F.col("normalized_name").alias("product"))
    return s.listings.join(stores, "store_id").join(goods, "product_id").select("slug", "product", "external_url", "available")


@query(f"SELECT 'r' || p_partkey AS external_reference, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CASE WHEN p_partkey % 3 = 0 THEN 'branch_local' ELSE 'online' END AS price_scope, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_size END AS branch FROM part WHERE {_ACCEPTED}", mapped=False)
def published_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _published(spark, sf_dir)[0]
    b = s.branches.select(F.col("id").alias("branch_id"), F.col("external_key").alias("branch"))
    return s.snapshots.join(b, "branch_id", "left").select("external_reference", (F.col("price") * 100).cast("long").alias("price_cents"), "price_scope", "branch")


@query(
    f"""SELECT n AS input_records, 0 AS new_staging_rows, n AS reused_staging, n AS publishable, 0 AS inserted_snapshots, n AS skipped_existing_snapshots, (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_size END, p_type FROM part WHERE {_ACCEPTED})) AS groups
FROM (SELECT count(*) AS n FROM part WHERE {_ACCEPTED})""",
    mapped=False,
)
def replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a batch that is published a second time: nothing new."""
    report = _published(spark, sf_dir, times=2)[1]
    groups = F.size(F.from_json("by_source_branch_category", "array<struct<source: string>>")).cast("long").alias("groups")
    return report.select("input_records", "new_staging_rows", "reused_staging", "publishable", "inserted_snapshots", "skipped_existing_snapshots", groups)


@query(f"SELECT count(*) AS n FROM part WHERE {_ACCEPTED} AND p_partkey % 2 = 0", mapped=False)
def published_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows that may go: their snapshot holds the same payload. Half of the snapshots are made to differ."""
    s = _published(spark, sf_dir)[0]
    even = F.substring("external_reference", 2, 20).cast("long") % 2 == 0
    changed = s.snapshots.withColumn("raw_payload", F.when(even, F.col("raw_payload")).otherwise(F.replace("raw_payload", F.lit('"parts"'), F.lit('"others"'))))
    return B.published_staging(s.staging, changed).agg(F.count("*").alias("n"))


# Validators


def _observation(k: Column) -> dict[str, Column]:
    text = lambda prefix: F.concat(F.lit(prefix), _key())
    fields = {c: F.lit(v) for c, v in {"source": "parts", "price_scope": "online", "currency": "MXN", "review_status": "accepted", "presentation": "1 pieza"}.items()}
    fields |= {"store_slug": F.when(k == 1, "closed").otherwise("parts"), "product_name": F.col("p_name"), "normalized_name": F.when(k == 2, " ").otherwise(F.col("p_name")), "category": F.col("p_type"), "is_synthetic": F.lit(False)}
    fields |= {"price": F.when(k == 3, 1.005).otherwise(F.round("p_retailprice", 2)), "available": F.lit(True), "stock_status": F.when(k == 4, "out_of_stock"), "source_url": F.when(k == 5, text("https://other.mx/")).otherwise(text("https://parts.mx/"))}
    fields |= {"store_product_url": F.when(k == 5, text("https://other.mx/")).otherwise(text("https://parts.mx/")), "response_sha256": F.sha2(F.col("p_name"), 256), "observed_at": F.when(k == 6, "2001-10-29T00:00:00Z").otherwise("2001-11-04T10:00:00-06:00")}
    fields |= {"branch_name": F.when(k == 7, "Centro"), "pack_count": F.when(k == 8, 1.5).otherwise(2.0), "valid_until": F.when(k == 9, "2001-11-05T00:00:00Z")}
    return fields


@query(
    """SELECT p_partkey, CASE p_partkey % 12 WHEN 1 THEN 'source_not_enabled,host_not_allowed' WHEN 2 THEN 'missing_normalized_name' WHEN 3 THEN 'price' WHEN 4 THEN 'stock_contradicts_availability' WHEN 5 THEN 'host_not_allowed'
WHEN 6 THEN 'not_current' WHEN 7 THEN 'branch_data' WHEN 8 THEN 'pack_count' WHEN 9 THEN 'expired' ELSE '' END AS issues FROM part""",
    mapped=False,
)
def observation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("parts", "parts", ["parts.mx"], True, "validated", "MX"), ("parts", "closed", ["parts.mx"], False, "validated", "MX")], "source string, store_slug string, hosts array<string>, publisher_enabled boolean, status string, country string")
    rows = _part(spark, sf_dir).select(_key(), _json(_observation(_key() % 12)).alias("raw"))
    return validators.observation_issues(rows, sources, AS_OF).select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'invalid_retailer' WHEN 2 THEN 'invalid_price' WHEN 3 THEN 'expired_observation' WHEN 4 THEN 'invalid_evidence_url' WHEN 5 THEN 'online_offer_with_branch' WHEN 6 THEN 'half_a_place' END AS reject_reason,
concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'inconsistent_stock' END, CASE WHEN p_size % 3 = 0 THEN 'invalid_gtin' END, CASE WHEN p_size % 7 = 0 AND p_partkey % 9 <> 2 THEN 'previous_price_not_higher' END, CASE WHEN p_size % 2 = 0 THEN 'unknown_presentation' END) AS flags,
CASE WHEN p_size % 2 = 1 THEN p_size * 1000 END AS quantity FROM part""",
    mapped=False,
)
def offer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, none = F.col, _key() % 9, F.lit(None).cast("string")
    price = F.format_string("%.2f", "p_retailprice")
    offers = _part(spark, sf_dir).select(
        _key(), F.when(k == 1, "Not A Slug").otherwise("shop").alias("retailer"), _key().cast("string").alias("external_id"), F.lit("feed").alias("source"), c("p_name").alias("name"), F.when(k == 2, "-1").otherwise(price).alias("price"),
        F.when(c("p_size") % 7 == 0, price).alias("previous_price"), F.lit("MXN").alias("currency"), F.when(k == 3, "2001-10-20T00:00:00Z").otherwise("2001-11-04T00:00:00Z").alias("captured_at"), F.when(k == 4, "http://shop.mx/").otherwise("https://shop.mx/").alias("product_url"),
        none.alias("image_url"), F.when(k == 5, "online").otherwise("store").alias("price_type"), F.lit("s1").alias("store_id"), none.alias("store_name"), none.alias("address"), F.when(k == 6, 19.0).alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.lit(True).alias("availability"), F.when(c("p_size") % 5 == 0, 0).otherwise(4).alias("stock"), F.when(c("p_size") % 3 == 0, "123").alias("gtin"), F.lit("7501031311309").alias("ean"), none.alias("upc"),
        F.when(c("p_size") % 2 == 1, F.concat("p_size", F.lit(" kg"))).otherwise("suelto").alias("presentation"),
    )
    out = validators.checked_offers(offers, AS_OF)
    return out.select("p_partkey", "reject_reason", F.array_join("quality_flags", ",").alias("flags"), c("quantity").cast("int").alias("quantity"))


@query(
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'mixed_mode' WHEN 1 THEN 'unreviewed_or_synthetic' WHEN 2 THEN 'missing_category' WHEN 3 THEN 'invalid_price' WHEN 4 THEN 'expired_or_future_observation' WHEN 5 THEN 'expired_offer' END AS reason FROM part""",
    mapped=False,
)
def online_row_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none, at = _key() % 8, F.lit(None).cast("string"), lambda day: F.lit(f"2001-11-{day} 00:00:00").cast("timestamp")
    rows = _part(spark, sf_dir).select(
        _key(), F.when(k == 0, "branch_local").otherwise("online").alias("price_scope"), none.alias("branch_id"), none.alias("branch_name"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), (k == 1).alias("is_synthetic"), F.lit("accepted").alias("review_status"),
        F.lit("s").alias("source"), F.lit("s").alias("store_slug"), F.col("p_name").alias("product_name"), F.lit("1 kg").alias("presentation"), F.when(k == 2, "").otherwise(F.col("p_type")).alias("category"), F.lit("u").alias("source_url"), F.lit("u").alias("store_product_url"),
        F.when(k == 4, at("06")).otherwise(at("04")).alias("observed_at"), F.lit("x").alias("response_sha256"), F.lit("MXN").alias("currency"), F.when(k == 3, 0.0).otherwise(F.col("p_retailprice")).alias("price"), F.when(k == 5, at("05")).otherwise(at("07")).alias("valid_until"),
    )
    return rows.select("p_partkey", validators.online_row_reason(AS_OF).alias("reason"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 8 = 6 THEN CASE WHEN p_partkey % 5 > 0 THEN 'missing_branch_details' ELSE 'missing_branch_id' END ELSE CASE p_partkey % 8 WHEN 0 THEN 'missing_product_name' WHEN 1 THEN 'invalid_price' WHEN 2 THEN 'unsupported_currency' WHEN 3 THEN 'unavailable'
WHEN 4 THEN 'future' WHEN 5 THEN 'expired' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'missing_branch_id' END END END AS local, CASE p_partkey % 8 WHEN 0 THEN 'missing_product_name' WHEN 1 THEN 'invalid_price' WHEN 2 THEN 'unsupported_currency' WHEN 3 THEN 'unavailable'
WHEN 4 THEN 'future' WHEN 5 THEN 'expired' WHEN 6 THEN NULL ELSE CASE WHEN p_partkey % 5 = 0 THEN 'missing_online_evidence' END END AS online FROM part""",
    mapped=False,
)
def shown_offer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why offers aren't shown where a branch is asked for, and where it isn't."""
    k, branch, now = _key() % 8, _key() % 5 > 0, F.lit(AS_OF).cast("timestamp")
    at = F.when(k == 4, now + F.make_dt_interval(mins=F.lit(6))).when(k == 5, now - F.make_dt_interval(F.lit(7))).otherwise(now)
    rows = _part(spark, sf_dir).select(
        _key(), F.when(k == 0, " ").otherwise(F.col("p_name")).alias("product_name"), F.lit("Store").alias("store_name"), F.when(k == 1, 0.0).otherwise(F.col("p_retailprice")).alias("price"), F.when(k == 2, "USD").otherwise("MXN").alias("currency"), (k != 3).alias("available"),
        at.alias("captured_at"), F.when(branch, 1).alias("branch_id"), F.when(k != 6, "Branch").alias("branch_name"), F.lit("Street").alias("branch_address"), F.lit(1.0).alias("distance_km"),
        F.when(k == 6, "https://s.mx/").alias("observation_url"), F.lit(None).cast("string").alias("store_product_url"),
    )
    return rows.select("p_partkey", P.rejection_reason(AS_OF, True).alias("local"), P.rejection_reason(AS_OF, False).alias("online"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'unknown_listing' ELSE CASE p_partkey % 14 WHEN 2 THEN 'changed_evidence_url' WHEN 4 THEN 'changed_product_identity' WHEN 6 THEN 'changed_presentation' WHEN 8 THEN 'changed_store' WHEN 10 THEN 'invalid_captured_at' WHEN 12 THEN 'older_than_current_observation' END END AS reject_reason,
CASE WHEN p_partkey % 14 = 0 THEN p_type ELSE 'new' END AS category FROM part""",
    mapped=False,
)
def known_listing_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of the even parts, which are known, by rows of which most changed in something."""
    k, url = _key() % 14, F.concat(F.lit("u/"), _key())
    p = _part(spark, sf_dir)
    known = p.filter("p_partkey % 2 = 0").select(url.alias("store_product_url"), F.col("p_name").alias("normalized_name"), F.col("p_name").alias("external_name"), F.lit("1 kg").alias("presentation"), F.lit("s").alias("store_slug"), F.col("p_type").alias("category"), F.lit(AS_OF).cast("timestamp").alias("latest_capture"))
    rows = p.select(
        _key(), F.lit("parts").alias("source"), url.alias("store_product_url"), F.when(k == 2, "elsewhere").otherwise(url).alias("source_url"), F.when(k == 4, "other").otherwise(F.col("p_name")).alias("normalized_name"), F.col("p_name").alias("source_product_name"),
        F.when(k == 6, "2 kg").otherwise("1 kg").alias("presentation"), F.when(k == 8, "t").otherwise("s").alias("store_slug"), F.when(k == 10, "today").when(k == 12, "2001-11-04T00:00:00Z").otherwise("2001-11-05T00:00:00Z").alias("captured_at"), F.lit("new").alias("category"),
    )
    return validators.bound_to_known(rows, known, "parts").select("p_partkey", "reject_reason", "category")


@query(
    """WITH m AS (SELECT *, p_partkey % 10 AS k FROM part WHERE p_partkey % 10 < 8) SELECT 'u/' || p_partkey AS url, CASE k WHEN 1 THEN 'duplicate_capture' WHEN 2 THEN 'missing_capture_or_evidence' WHEN 3 THEN 'product_name_changed' WHEN 4 THEN 'presentation_or_unit_changed,price_scope_changed' WHEN 5 THEN 'availability_not_confirmed'
WHEN 6 THEN 'evidence_not_accepted,raw_evidence_missing' ELSE '' END AS reasons, CASE WHEN k IN (0, 7) THEN 'ready' ELSE 'pending_review' END AS status FROM m UNION ALL SELECT 'u/' || p_partkey, 'unexpected_listing', 'pending_review' FROM part WHERE p_partkey % 10 = 8""",
    mapped=False,
)
def review_of_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, url = _part(spark, sf_dir), _key() % 10, F.concat(F.lit("u/"), _key())
    manifest = p.filter(k < 8).select(F.concat(F.lit("reviewed:"), _key()).alias("canonical_variant_key"), F.col("p_name").alias("label"), F.lit("s").alias("source"), url.alias("url"), F.col("p_name").alias("observed_name"), F.lit("1 kg").alias("observed_presentation"))
    rows = p.filter(~k.isin(2, 9)).select(
        F.lit("s").alias("source"), url.alias("store_product_url"), F.when(k == 3, "other").otherwise(F.col("p_name")).alias("source_product_name"), F.when(k == 4, "2 kg").otherwise("1 kg").alias("presentation"), F.when(k == 4, "branch_local").otherwise("online").alias("price_scope"),
        F.when(k != 5, True).alias("available"), F.lit(False).alias("is_synthetic"), F.when(k == 6, "pending").otherwise("accepted").alias("review_status"), F.when(k == 6, "[]").otherwise("{}").alias("raw_payload"), F.explode(F.when(k == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return validators.reviewed_listings(manifest, rows).select("url", F.array_join("reasons", ",").alias("reasons"), "status")


@query(
    """SELECT 'reviewed:' || s_suppkey AS canonical_variant_key, CASE WHEN s_suppkey % 3 = 1 THEN 'needs_one_listing_of_each_source' ELSE 'listing_of_several_items' END AS reason FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'automatic:' || s_suppkey, 'not_a_reviewed_key' FROM supplier WHERE s_suppkey % 3 = 2""",
    mapped=False,
)
def basket_manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 2, "automatic:").otherwise("reviewed:"), k).alias("canonical_variant_key")
    sources = F.explode(F.when(k % 3 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("source")
    return validators.basket_issues(s.select(name, sources, F.concat(F.lit("u/"), k).alias("url")), ("a", "b"))


@query(
    """SELECT s_suppkey AS probe, CASE s_suppkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'confirmed_branch_local' WHEN 3 THEN 'online_only' WHEN 4 THEN 'ambiguous' ELSE 'confirmed_branch_local' END AS class FROM supplier""",
    mapped=False,
)
def branch_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k, second = load(spark, sf_dir, "supplier"), F.col("s_suppkey") % 6, F.col("n") == 1
    two = s.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    outcomes = two.select(
        F.col("s_suppkey").alias("probe"), ((k == 0) & second).alias("blocked"), (k != 3).alias("attributable"), F.when(k != 3, "r").alias("region"), F.when(~((k == 1) & second), "sku").alias("sku"), F.lit("MXN").alias("currency"),
        F.when((k == 2) & second, 2.0).otherwise(1.0).alias("price"), F.lit(True).alias("available"), F.when((k == 5) & second, 7).when(k == 5, 3).alias("quantity"),
    )
    return validators.probe_classes(outcomes)


@query("SELECT id, source, days_old FROM (SELECT store_product_id || '/' || branch_id AS id, source || CASE WHEN l_partkey % 2 = 0 THEN '-direct' ELSE '' END AS source, days_old, freshness FROM latest_prices) WHERE freshness = 'fresh' AND source LIKE '%-direct'")
def fresh_direct_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import catalog as C

    rows = C.latest_prices(tables(spark, sf_dir), AS_OF)
    direct = F.concat("source", F.when(F.col("product_id") % 2 == 0, "-direct").otherwise(""))
    named = rows.select(F.concat_ws("/", "store_product_id", "branch_id").alias("id"), direct.alias("source"), "days_old", "freshness")
    return validators.of_direct_sources(validators.only_fresh(named)).drop("freshness")


@query("SELECT retailer, external_id, price FROM (SELECT 'r' AS retailer, p_name AS external_id, arg_max(p_retailprice, p_partkey) AS price, min(p_partkey) AS place FROM part WHERE p_partkey % 3 = 1 GROUP BY 2) ORDER BY place LIMIT 10", mapped=False)
def provider_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider gives nothing, so the second one answers: names are identities, of which the last offer counts."""
    offers = _part(spark, sf_dir).filter("p_partkey % 3 > 0").select(F.when(_key() % 3 == 1, "second").otherwise("third").alias("provider"), _key().alias("position"), F.lit("r").alias("retailer"), F.col("p_name").alias("external_id"), F.lit("s").alias("store_id"), F.col("p_retailprice").alias("price"))
    return validators.provider_page(offers, ["first", "second", "third"], 10).select("retailer", "external_id", "price")


# Official prices, geocoders, saved captures


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official replies, one for each supplier with the prices of its line items; every seventh has one that can't be, every eleventh failed."""
    line = load(spark, sf_dir, "lineitem").filter("l_linenumber = 1").join(_part(spark, sf_dir), F.col("l_partkey") == _key())
    k = F.col("l_suppkey")
    price = F.struct(
        F.concat("p_name", F.lit(", "), "p_brand", F.lit(", 1 kg")).alias("producto"), F.lit("x").alias("tipo_producto"), F.when((k % 7 == 0) & (F.col("l_quantity") > 49), "-1").otherwise(F.col("l_quantity").cast("string")).alias("precio"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("fecha_observacion"), F.concat(F.lit("Chain "), k).alias("cadena_comercial"), F.concat(F.lit("Shop "), F.col("l_partkey") % 3).alias("establecimiento"),
    )
    # A reply holds the rows of one supplier and first line: the table has few suppliers, each with a bounded share.
    rows = line.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_partkey", price.alias("p")))), lambda x: x["p"]).alias("productos"))
    body = F.to_json(F.struct((k % 11 != 0).alias("success"), F.lit("ok").alias("message"), F.struct("productos").alias("data")))
    return rows.select(k.cast("string").alias("term"), body.alias("body"))


_OFFICIAL = """WITH p AS (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey) - 1 AS INTEGER) AS place, p_name || ', ' || p_brand || ', 1 kg' AS producto, l_quantity AS price, strftime(l_shipdate, '%Y-%m-%d') AS day, 'Shop ' || l_partkey % 3 AS shop
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1),
bad AS (SELECT l_suppkey, CASE WHEN l_suppkey % 11 = 0 THEN 'service_failed' WHEN l_suppkey % 7 = 0 AND max(price) > 49 THEN 'invalid_price' END AS reason FROM p GROUP BY 1)"""


@query(f"{_OFFICIAL} SELECT CAST(l_suppkey AS VARCHAR) AS term, place, CASE WHEN reason IS NULL THEN price END AS price, reason AS reject_reason FROM p JOIN bad USING (l_suppkey) WHERE reason IS NULL OR place = 0", mapped=False)
def official_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official.official_prices(_official(spark, sf_dir)).select("term", "place", "price", "reject_reason")


@query(
    f"""{_OFFICIAL}, g AS (SELECT l_suppkey, shop, producto, price, day FROM p JOIN bad USING (l_suppkey) WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY l_suppkey, shop, producto ORDER BY day DESC, place) = 1)
SELECT 'chain-' || l_suppkey AS store_slug, md5('profeco|0901|chain ' || l_suppkey || '|' || lower(shop)) AS branch_external_key, '1 kg' AS presentation, producto || ' · ' || shop AS external_name, price, CAST(day || ' 12:00:00' AS TIMESTAMP) AS captured_at FROM g""",
    mapped=False,
)
def official_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = official.latest_official(official.official_prices(_official(spark, sf_dir)))
    return official.official_records(latest, "0901", "https://official.example/").select("store_slug", "branch_external_key", "presentation", "external_name", "price", "captured_at")


@query(f"{_OFFICIAL} SELECT CASE t WHEN 1 THEN 'red' ELSE 'widget 1 kg' END AS product, count(*) AS n FROM p JOIN bad USING (l_suppkey), (VALUES (1), (2)) v(t) WHERE reason IS NULL AND CASE t WHEN 1 THEN producto LIKE '%red%' ELSE producto LIKE '%widget%' END GROUP BY 1", mapped=False)
def official_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = official.official_prices(_official(spark, sf_dir)).filter("reject_reason IS NULL")
    return official.of_terms(prices, {"red": ["Red"], "widget 1 kg": ["WIDGET", "1 Kilo"]}).groupBy("product").agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 4 > 0 THEN CAST(19.0 AS DOUBLE) + s_suppkey / 100.0 END AS latitude, CASE WHEN s_suppkey % 4 > 0 THEN CAST(-99.0 AS DOUBLE) END AS longitude, CAST(CASE s_suppkey % 4 WHEN 1 THEN 0.9 WHEN 2 THEN 0.35 WHEN 3 THEN 0.5 END AS DOUBLE) AS confidence,
CASE s_suppkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'geocoded' ELSE 'review' END AS geocoding_status, s_suppkey % 4 = 1 AS placed, 3 AS geocoding_attempts FROM supplier""",
    mapped=False,
)
def geocoding_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoder replies read, and the branches after them."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.when(k % 4 == 1, "high").when(k % 4 == 2, "low")
    feature = F.struct(F.lit("f").alias("id"), F.struct(F.array(F.lit(-99.0), 19.0 + k / 100.0).alias("coordinates")).alias("geometry"), F.struct(F.struct(name.alias("confidence")).alias("match_code")).alias("properties"))
    body = F.to_json(F.struct(F.when(k % 4 > 0, F.array(feature)).alias("features")))
    found = official.geocoder_results(s.select(k.cast("string").alias("id"), body.alias("body")))
    none = lambda kind: F.lit(None).cast(kind)
    before = s.select(k.cast("string").alias("id"), none("double").alias("latitude"), none("double").alias("longitude"), F.lit("pending").alias("geocoding_status"), none("timestamp").alias("geocoded_at"), none("string").alias("geocoding_error"), F.lit(2).alias("geocoding_attempts"))
    after = B.geocoded_branches(before, found.withColumn("error", none("string")), 0.7, AS_OF)
    return found.select("id", "latitude", "longitude", "confidence").join(after.select("id", "geocoding_status", F.col("latitude").isNotNull().alias("placed"), "geocoding_attempts"), "id")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unexpected_origin' WHEN page_id % 5 = 1 THEN 'body_changed' WHEN page_id % 5 = 2 THEN 'no_observation_time' END AS reject_reason FROM pages", mapped=False)
def replayed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    saved = load(spark, sf_dir, "pages").select(
        "page_id", F.when(k == 0, "https://other.mx/").otherwise(F.concat(F.lit("https://s.mx/"), "page_id")).alias("url"), F.col("html").alias("body"), F.when(k == 1, F.sha2("url", 256)).otherwise(F.upper(F.sha2("html", 256))).alias("sha256"),
        F.when(k != 2, F.lit(AS_OF).cast("timestamp")).alias("observed_at"),
    )
    return official.replayed(saved, "s.mx").select("page_id", "reject_reason")


@query(
    """WITH p AS (SELECT CAST(p_partkey // 48 AS BIGINT) AS page, p_partkey FROM part), s AS (SELECT page, count(*) AS n FROM p GROUP BY 1)
SELECT max(page) AS pages, (SELECT count(DISTINCT p_partkey % 1999) FROM part) AS ids, (SELECT count(*) FROM (SELECT 1 FROM p GROUP BY p_partkey % 1999 HAVING count(DISTINCT page) > 1)) AS repeated_ids, arg_max(n, page) >= 48 AS may_have_more,
count(*) FILTER (n < 48) - CASE WHEN arg_max(n, page) < 48 THEN 1 ELSE 0 END AS short_pages_before, (SELECT count(*) FROM supplier) AS known_missing FROM s""",
    mapped=False,
)
def paged_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _part(spark, sf_dir).select(F.expr("p_partkey div 48").alias("page"), (_key() % 48).alias("position"), (_key() % 1999).alias("id"), F.concat(F.lit("u/"), _key()).alias("url"))
    known = load(spark, sf_dir, "supplier").select(F.concat(F.lit("gone/"), "s_suppkey").alias("url"))
    return official.capture_pages(pages, known, 48)


@query("SELECT p_name AS item_id, p_brand AS seller_id, min(p_partkey) AS position, 'held' AS status FROM part GROUP BY p_name, p_brand", mapped=False)
def front_page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _part(spark, sf_dir).select(F.col("p_name").alias("item_id"), F.col("p_brand").alias("seller_id"), F.lit("o").alias("offer_id"), _key().alias("position"))
    return official.homepage_cards(cards).select("item_id", "seller_id", "position", "status")


# Pages and links of shops


def captured_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop pages with structured data, most with a defect."""
    c, k = F.col, _key() % 10
    offer = F.struct(F.lit("Offer").alias("@type"), c("p_retailprice").alias("price"), F.when(k == 1, "USD").otherwise("MXN").alias("priceCurrency"), F.when(k == 2, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock").alias("availability"), F.when(k == 3, "2001-11-01").alias("priceValidUntil"))
    name = F.concat("p_name", F.when(k == 7, "").otherwise(F.concat(F.lit(" 6 x "), c("p_size"), F.lit(" ml"))))
    product = F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), name.alias("name"), _key().cast("string").alias("sku"), F.when(_key() % 2 == 0, c("p_type")).alias("category"), F.when(k == 8, F.array(offer, offer)).otherwise(F.array(offer)).alias("offers"))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    whole = script(F.to_json(product))
    sale = F.lit('<div class="summary entry-summary"><del>10</del></div><div class="woocommerce-tabs">')
    html = F.when(k == 4, F.concat(whole, whole)).when(k == 5, F.concat(whole, script(F.lit("{")))).when(k == 6, F.concat(whole, sale)).otherwise(whole)
    pages = _part(spark, sf_dir).select(F.concat(F.lit("https://s.mx/"), _key()).alias("url"), html.alias("html"))
    return products.parsed_products(pages, "s.mx", AS_OF, reject_sales=True)


@query(
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'invalid_price_or_name' WHEN 2 THEN 'availability_not_confirmed' WHEN 3 THEN 'expired_offer' WHEN 4 THEN 'expected_one_product' WHEN 5 THEN 'broken_structured_data' WHEN 6 THEN 'promotion_without_known_end' WHEN 7 THEN 'missing_presentation' WHEN 8 THEN 'ambiguous_or_missing_offer' END AS reject_reason,
CASE WHEN p_partkey % 10 = 7 THEN NULL WHEN p_partkey % 10 IN (4) THEN NULL ELSE '6 x ' || p_size || ' ml' END AS presentation, CASE WHEN p_partkey % 10 = 4 THEN 'Otros' WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Otros' END AS category FROM part""",
    mapped=False,
)
def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = captured_products(spark, sf_dir)
    return out.select(F.substring("url", 14, 20).cast("long").alias("p_partkey"), "reject_reason", "presentation", "category")


@query("SELECT CAST(p_partkey // 100 AS VARCHAR) AS name, 'https://s.mx/p?a=' || p_partkey || '&b=1' AS url, CAST(p_partkey % 100 AS INTEGER) AS position FROM part WHERE p_partkey % 2 = 0", mapped=False)
def sitemap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of sitemaps of a hundred parts each, those of even parts kept."""
    loc = F.concat(F.lit("<url><loc> https://s.mx/p?a="), _key(), F.lit("&amp;b=1 </loc></url>"))
    maps = _part(spark, sf_dir).groupBy(F.expr("p_partkey div 100").cast("string").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_key(), loc.alias("l")))), lambda x: x["l"]), "").alias("xml"))
    return web.sitemap_locations(maps, F.regexp_extract("url", "a=([0-9]+)", 1).cast("long") % 2 == 0)


@query("SELECT 'https://s.mx/' || p_name || '-' || p_partkey % 50 AS url, CAST(p_partkey % 50 AS VARCHAR) AS sku, p_partkey AS position FROM part WHERE p_partkey < 50 ORDER BY p_partkey LIMIT 40", mapped=False)
def known_product_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _part(spark, sf_dir).select(_key().alias("position"), F.concat(F.lit("https://s.mx/"), "p_name", F.lit("-"), _key() % 50).alias("url"))
    return web.known_urls(urls, 40)


@query(
    """SELECT s_suppkey AS store, CASE s_suppkey % 5 WHEN 1 THEN 'missing_branch_state' WHEN 2 THEN 'unconfirmed_location' WHEN 3 THEN 'missing_latitude' END AS reject_reason, 'depot:' || s_suppkey AS branch_external_key, 'Depot ' || s_name AS branch_name FROM supplier""",
    mapped=False,
)
def store_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    store = F.struct(
        k.cast("string").alias("storeName"), F.concat(F.lit("u"), k).alias("uniqueID"), F.lit("Town").alias("city"), F.when(k % 5 != 1, "State").alias("stateOrProvinceName"), F.when(k % 5 == 2, "51.5").when(k % 5 == 3, "north").otherwise("19.5").alias("latitude"), F.lit(-99.1).alias("longitude"),
        F.struct(F.col("s_name").alias("displayStoreName")).alias("Description"), F.array(F.lit("Street 1"), F.lit(" ")).alias("addressLine"),
    )
    body = F.to_json(F.struct(F.array(store).alias("PhysicalStore")))
    found = feeds.located_branches(s.select(F.lit("u").alias("url"), F.lit(AS_OF).alias("observed_at"), body.alias("body")), "depot", "Depot")
    return found.select(F.substring("branch_external_key", 7, 20).cast("long").alias("store"), "reject_reason", "branch_external_key", "branch_name")


_FEED = "SELECT p_partkey AS part, CASE WHEN r IS NULL THEN p_size || ' kg' END AS presentation, CASE WHEN r IS NULL THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents, CASE WHEN r IS NULL THEN p_size % 3 <> 0 END AS available, r AS reject_reason FROM (SELECT *, {} AS r FROM part)"


def _outcome(found: DataFrame) -> DataFrame:
    good = F.col("reject_reason").isNull()
    return found.select(F.col("external_reference").try_cast("long").alias("part"), *[F.when(good, c).alias(n) for n, c in (("presentation", F.col("presentation")), ("price_cents", S.cents(F.col("price"))), ("available", F.col("available")))], "reject_reason")


@query(_FEED.format("CASE WHEN p_partkey % 7 = 0 THEN 'promotion' WHEN p_partkey % 5 = 0 THEN 'unknown_category' END"), mapped=False)
def shared_catalog_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of fifty parts each behind one link."""
    k = _key()
    product = F.struct(
        k.cast("string").alias("id"), F.concat("p_name", F.lit(" "), k).alias("name"), F.concat("p_size", F.lit(" kg")).alias("gramaje"), F.round("p_retailprice", 2).alias("price"), (F.col("p_size") % 3 != 0).alias("available"), F.when(k % 7 == 0, 1.0).alias("salePrice"),
        F.when(k % 5 == 0, "none").otherwise("c1").alias("categoryId"), F.lit("img.png").alias("image"),
    )
    replies = _part(spark, sf_dir).groupBy(F.expr("p_partkey div 50").alias("g")).agg(F.collect_list(product).alias("products"))
    category = F.struct(F.lit("c1").alias("id"), F.lit("Food").alias("name"))
    body = F.to_json(F.struct(F.struct(F.lit("MXN").alias("currencyCode")).alias("settings"), F.array(category).alias("categories"), "products"))
    responses = replies.select(F.concat(F.lit("https://s.mx/api/"), "g").alias("url"), F.lit(AS_OF).alias("observed_at"), body.alias("body"))
    return _outcome(feeds.shared_catalog(responses, "s.mx", AS_OF, "https://s.mx/menu"))


@query(_FEED.format("CASE WHEN p_partkey % 13 = 0 THEN 'ambiguous_piece' WHEN p_partkey % 11 = 0 THEN 'variant_of_another_product' WHEN p_partkey % 7 = 0 THEN 'promotion' END"), mapped=False)
def storefront_bulk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = _key(), F.format_string("%.2f", "p_retailprice")
    variant = F.struct(k.alias("id"), F.when(k % 11 == 0, k + 1).otherwise(k).alias("product_id"), F.lit("Pieza").alias("title"), k.cast("string").alias("sku"), price.alias("price"), F.when(k % 7 == 0, F.concat(F.lit("9"), price)).when(k % 2 == 0, "0.00").alias("compare_at_price"), (F.col("p_size") % 3 != 0).alias("available"))
    images = F.array(F.struct(k.alias("product_id"), F.concat(F.lit("https://s.mx/"), k, F.lit(".png")).alias("src")))
    product = F.struct(k.alias("id"), F.concat("p_name", F.lit(" "), "p_size", F.lit(" kg")).alias("title"), F.concat(F.lit("part-"), k).alias("handle"), F.col("p_type").alias("product_type"), F.when(k % 13 == 0, F.array(variant, variant)).otherwise(F.array(variant)).alias("variants"), images.alias("images"))
    body = F.to_json(F.struct(F.array(product).alias("products")))
    responses = _part(spark, sf_dir).select(F.lit("https://s.mx/products.json").alias("url"), F.lit(AS_OF).alias("observed_at"), body.alias("body"))
    return _outcome(feeds.storefront_products(responses, "s.mx", AS_OF, "MXN", "pieza"))


@query(_FEED.format("CASE WHEN p_partkey % 13 = 0 THEN 'url_conflict' WHEN p_partkey % 11 = 0 THEN 'conflicting_availability' WHEN p_partkey % 7 = 0 THEN 'promotion' END"), mapped=False)
def storefront_product_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cents, open_ = _key(), S.cents(F.col("p_retailprice")), F.col("p_size") % 3 != 0
    variant = F.struct(k.alias("id"), F.lit("Pieza").alias("title"), k.cast("string").alias("sku"), cents.alias("price"), F.when(k % 7 == 0, cents + 1).when(k % 2 == 0, 0).alias("compare_at_price"), open_.alias("available"))
    handle = F.concat(F.lit("part-"), k)
    product = F.struct(F.concat("p_name", F.lit(" "), "p_size", F.lit(" kg")).alias("title"), handle.alias("handle"), F.col("p_type").alias("type"), F.when(k % 11 == 0, ~open_).otherwise(open_).alias("available"), F.array(variant).alias("variants"), F.lit("//s.mx/i.png").alias("featured_image"))
    url = F.concat(F.lit("https://s.mx/products/"), handle, F.when(k % 13 == 0, ".json").otherwise(".js"))
    responses = _part(spark, sf_dir).select(url.alias("url"), F.lit(AS_OF).alias("observed_at"), F.to_json(product).alias("body"))
    return _outcome(feeds.storefront_product(responses, "s.mx", AS_OF, "MXN", "pieza"))


# Identity, images, branches, upkeep


@query(
    """WITH b AS (SELECT p_partkey, p_partkey % 5 AS k FROM part WHERE p_partkey % 2 = 1) SELECT p_partkey AS position, CASE k WHEN 0 THEN p_partkey - 1 WHEN 1 THEN p_partkey - 1 WHEN 2 THEN p_partkey END AS product_id, CASE k WHEN 0 THEN 'gtin' WHEN 1 THEN 'reviewed_key' WHEN 2 THEN 'listing' ELSE 'new' END AS rule, k = 1 AS conflict FROM b""",
    mapped=False,
)
def resolved_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd parts against products: by the GTIN or the key of the part before, whose pack differs where the key binds, or by the listing."""
    p, k = _part(spark, sf_dir), _key() % 5
    digits = lambda n: F.lpad(n.cast("string"), 7, "0")
    total = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda s, i: s + F.substring(digits(n), i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    code = lambda n: F.concat(digits(n), ((10 - total(n) % 10) % 10).cast("string"))
    none = F.lit(None)
    goods = p.select(_key().alias("id"), F.when(_key() % 2 == 0, code(_key() + 1)).alias("gtin"), F.when(_key() % 2 == 0, F.concat(F.lit("reviewed:"), _key())).alias("canonical_variant_key"), F.lit(1).alias("pack_count"), none.cast("double").alias("net_quantity"), none.cast("string").alias("unit"))
    odd = p.filter("p_partkey % 2 = 1")
    listings = odd.select(_key().alias("id"), _key().alias("product_id"))
    batch = odd.select(
        _key().alias("position"), F.when(k == 0, code(_key())).alias("gtin"), F.when(k == 1, F.concat(F.lit("reviewed:"), _key() - 1)).alias("canonical_variant_key"), F.when(k <= 2, _key()).alias("store_product_id"), F.when(k == 1, 6).otherwise(1).alias("pack_count"), none.cast("double").alias("net_quantity"), none.cast("string").alias("unit"),
    )
    return U.resolved_products(batch, listings, goods).select("position", "product_id", "rule", "conflict")


@query("SELECT p_partkey AS store_product_id, 'https://i.mx/' || p_partkey AS image_url FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0", mapped=False)
def captured_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://i.mx/"), _key())
    have = _part(spark, sf_dir).filter("p_partkey % 3 = 0").select(_key().alias("store_product_id"), url.alias("image_url"))
    listings = _part(spark, sf_dir).select(_key().alias("id"), F.when(_key() % 2 == 0, url).otherwise("none").alias("image_url"))
    return U.captured_images(listings, have)


@query("SELECT product_name, store_slug, price_cents, 1 + l_partkey % 3 AS image_count FROM current_catalog WHERE branch_id IS NULL AND available AND l_partkey % 4 > 0 UNION ALL SELECT product_name, store_slug, price_cents, 0 FROM current_catalog WHERE branch_id IS NULL AND available AND l_partkey % 4 = 0", 365)
def online_offers_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online offers with how many images their listing has; a fourth of the listings have none."""
    from tarifa.plans import catalog as C
    from tarifa.plans.mapping import price_cents

    t = tables(spark, sf_dir)
    n = F.col("product_id") % 3 + 1
    t.images = t.listings.filter("product_id % 4 > 0").select(F.col("id").alias("store_product_id"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("image_url"))
    return price_cents(C.online_offers(t, AS_OF, days=365).select("product_name", "store_slug", "price", "image_count"))


@query(
    f"""SELECT product_name, store_slug, branch_id, price_cents, days_old, round(km, 6) AS km FROM (SELECT *, 6371 * 2 * asin(sqrt(power(sin(radians(latitude - 19.43) / 2), 2) + cos(radians(19.43)) * cos(radians(latitude)) * power(sin(radians(longitude + 99.13) / 2), 2))) AS km FROM latest_prices)
WHERE km <= 50 AND freshness <> 'old' AND price_cents > 0 AND available ORDER BY km, price_cents, store_product_id, branch_id LIMIT 100"""
)
def nearby_prices_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import catalog as C
    from tarifa.plans.mapping import HERE, price_cents

    rows = C.nearby_prices_v2(tables(spark, sf_dir), AS_OF, *HERE, radius=50)
    return price_cents(rows.select("product_name", "store_slug", "branch_id", "price", "days_old", F.round("distance_km", 6).alias("km")))


@query("SELECT s_suppkey AS old, s_suppkey - 1 AS new FROM supplier WHERE s_suppkey % 2 = 1", mapped=False)
def branch_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    pair = F.expr("s_suppkey div 2")
    branches = load(spark, sf_dir, "supplier").select(k.alias("id"), F.lit("s").alias("source"), F.lit(1).alias("store_id"), F.concat(F.when(k % 2 == 0, "BRANCH ").otherwise("Branch "), pair).alias("name"), F.when(k % 2 == 0, "09").alias("city_code"))
    return B.branch_merges(branches)


@query("SELECT l_suppkey AS store_id, 'Branch ' || l_linenumber AS name, max('Street ' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0')) AS address FROM lineitem GROUP BY 1, 2", mapped=False)
def backfilled_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches out of line items as snapshots: the address is that of the latest, by order."""
    order = F.lpad(F.col("l_orderkey").cast("string"), 12, "0")
    s = load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("store_product_id"), F.lit("s").alias("source"), F.lit("09").alias("source_city_code"), F.concat(F.lit("Store "), "l_suppkey").alias("source_store_name"), F.concat(F.lit("Branch "), "l_linenumber").alias("source_branch_name"),
        F.col("l_orderkey").alias("captured_at"), F.concat_ws("-", order, F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("id"), F.to_json(F.struct(F.concat(F.lit("Street "), order).alias("direccion"))).alias("raw_payload"),
    )
    listings = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("store_id"))
    return B.backfilled_branches(s, listings).select("store_id", "name", "address")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 IN (0, 1) ORDER BY c_acctbal, c_custkey LIMIT 25", mapped=False)
def pending_geocoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    b = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 0, "pending").when(k == 1, "failed").otherwise("geocoded").alias("geocoding_status"), F.col("c_acctbal").alias("updated_at"))
    return B.pending_geocoding(b, 25).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey > 77 ORDER BY p_partkey LIMIT 400", mapped=False)
def keyset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.next_batch(_part(spark, sf_dir).select(_key().alias("id")), "id", 77)


@query("SELECT p_partkey AS id, p_size FROM part", mapped=False)
def bounded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, which the guard lets pass as far as they are no more than it may; it is set for the tables' scale."""
    return B.bounded(_part(spark, sf_dir).select(_key().alias("id"), "p_size"), ["id"], 2_000_000_000)


@query("SELECT count(*) AS batches, CAST(sum(l_quantity) AS BIGINT) AS n_rows, CAST(sum(l_quantity) * 1000 AS BIGINT) AS n_bytes, CASE WHEN sum(l_quantity) * 1000 > 734003200 THEN 'archive_size' WHEN sum(l_quantity) > 50000 THEN 'archive_rows' WHEN count(*) > 100 THEN 'archive_batches' END AS over FROM lineitem", mapped=False)
def archive_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    return B.capacity(load(spark, sf_dir, "lineitem").select(n.alias("n_rows"), (n * 1000).alias("n_bytes")), 0)


@query("SELECT count(*) AS n_rows, count(DISTINCT (p_name, p_brand)) AS n_keys, bool_and(p_type IN ('ECONOMY', 'STANDARD')) AS p_type_allowed, (SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')) AS p_type_other FROM part", mapped=False)
def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.key_checks(_part(spark, sf_dir), ["p_name", "p_brand"], {"p_type": ["ECONOMY", "STANDARD"]}).withColumn("p_type_other", F.array_join("p_type_other", ","))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 AS overlap FROM supplier", mapped=False)
def overlapping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    left = s.select("s_suppkey", F.array(F.lit(1), F.lit(2)).alias("v"))
    right = s.select("s_suppkey", F.array(F.when(k % 3 == 0, 1).otherwise(8), F.when(k % 2 == 0, 2).otherwise(9)).alias("v"))
    return B.shared_values(left, right, "s_suppkey", "v")


@query("SELECT c_custkey, position FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position <= 50", mapped=False)
def numbered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = load(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(50)
    return B.result_positions(page, [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]).select("c_custkey", F.col("position").cast("long").alias("position"))


@query("SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0", mapped=False)
def removed_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without the candidates that haven't changed: every third was a candidate, of which the even ones have another size since."""
    table = _part(spark, sf_dir).select(_key().alias("id"), "p_name", "p_size")
    prints = S.row_fingerprint("id", "p_name", "p_size")
    candidates = table.filter("id % 3 = 0").select("id", prints.alias("fingerprint"))
    now = table.withColumn("p_size", F.when(F.col("id") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return L.remove_checked(now, candidates, prints).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# The client


@query(
    """SELECT owner, term, place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY "at" DESC, lower(term)) AS place FROM (SELECT user_id AS owner, lower(event_type) AS term, max(event_id) AS "at" FROM events GROUP BY ALL)) WHERE place <= 3""",
    mapped=False,
)
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("term"), F.col("event_id").alias("at"))
    return P.recent_searches(e, 3).select("owner", F.lower(F.trim("term")).alias("term"), F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey AS owner, 'k' || c_nationkey AS key FROM customer WHERE NOT (c_custkey = 7 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)) UNION ALL SELECT 8, 'new'", mapped=False)
def toggled_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("owner"), F.concat(F.lit("k"), "c_nationkey").alias("key"))
    mine = f.filter("owner = '7'").first().key  # one row
    return P.toggle(P.toggle(f, "7", mine), "8", "new").select(F.col("owner").cast("long").alias("owner"), "key")


@query("SELECT user_id AS identity, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1", mapped=False)
def appended_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of events as one list of users: the row is that of the last event, the place that of the first."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("identity"), F.expr("event_id div 100").alias("page"), (F.col("event_id") % 100).alias("position"), "event_id")
    firsts = e.groupBy("identity").agg(F.min("event_id").alias("first_event"))
    return P.appended_pages(e).select("identity", F.col("event_id").alias("last_event")).join(firsts, "identity")


@query(
    "SELECT c_custkey AS offer_id, row_number() OVER (ORDER BY CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END NULLS LAST, c_acctbal, c_mktsegment, c_custkey) AS place FROM customer QUALIFY place <= 100",
    mapped=False,
)
def offers_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of distance, unknown ones last, then price."""
    o = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("offer_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("distance_km"), F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("store_slug"), F.lit(0).alias("captured_at"))
    order = P.active_order("distance")
    return B.result_positions(o.orderBy(*order).limit(100), order).select("offer_id", F.col("position").cast("long").alias("place"))


_GROUPS = "SELECT c_nationkey AS group_key, {best} AS best, max(c_acctbal) AS worst, count(DISTINCT c_mktsegment) AS stores, row_number() OVER (ORDER BY {order}) AS place FROM customer GROUP BY 1"


def _groups(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    o = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_key"), F.col("c_custkey").alias("offer_id"), F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("store_slug"), F.col("c_custkey").alias("captured_at"), (F.col("c_custkey") % 101).alias("distance_km"))
    g = P.group_offers(o, sort)
    order = {"price_desc": [F.col("worst").desc()], "stores_desc": [F.col("stores").desc()], "distance": [F.col("nearest").asc()]}.get(sort, [])
    return B.result_positions(g, [*order, F.col("best").asc(), F.col("group_key").asc()]).select("group_key", "best", "worst", "stores", F.col("position").cast("long").alias("place"))


@query(_GROUPS.format(best="min(c_acctbal)", order="min(c_acctbal), c_nationkey"), mapped=False)
def groups_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "price_asc")


@query(_GROUPS.format(best="arg_min(c_acctbal, (-c_acctbal, c_mktsegment, c_custkey))", order="max(c_acctbal) DESC, arg_min(c_acctbal, (-c_acctbal, c_mktsegment, c_custkey)), c_nationkey"), mapped=False)
def groups_by_worst_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "price_desc")


@query(_GROUPS.format(best="min(c_acctbal)", order="count(DISTINCT c_mktsegment) DESC, min(c_acctbal), c_nationkey"), mapped=False)
def groups_by_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "stores_desc")


@query(_GROUPS.format(best="arg_min(c_acctbal, (c_custkey % 101, c_acctbal, c_mktsegment, c_custkey))", order="min(c_custkey % 101), arg_min(c_acctbal, (c_custkey % 101, c_acctbal, c_mktsegment, c_custkey)), c_nationkey"), mapped=False)
def groups_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offer is the nearest, not the cheapest."""
    return _groups(spark, sf_dir, "distance")


# Answers by endpoint


def _answer(answer, *columns: str | Column) -> DataFrame:
    """The rows of an answer with its totals beside each."""
    return answer.rows.select(*columns, F.lit(answer.total).cast("long").alias("total"), F.lit(answer.total_pages).cast("long").alias("total_pages"))


def _cents() -> Column:
    return (F.col("price") * 100).cast("long").alias("price_cents")


@query("SELECT id, slug, (SELECT count(*) FROM stores WHERE enabled AND name ILIKE '%00%') AS total, CAST(ceil((SELECT count(*) FROM stores WHERE enabled AND name ILIKE '%00%') / 5.0) AS BIGINT) AS total_pages FROM stores WHERE enabled AND name ILIKE '%00%' ORDER BY name, id LIMIT 5 OFFSET 5")
def api_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import api

    return _answer(api.stores(tables(spark, sf_dir), {"query": "00", "limit": "5", "page": "2"}), "id", "slug")


@query("SELECT id, name, n AS total, CAST(ceil(n / 20.0) AS BIGINT) AS total_pages FROM products, (SELECT count(*) AS n FROM products WHERE category = 'ECONOMY') WHERE category = 'ECONOMY' ORDER BY name, id LIMIT 20")
def api_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import api

    return _answer(api.products(tables(spark, sf_dir), {"category": "ECONOMY"}), "id", "name")


@query("SELECT id, store_id, name, n AS total, CAST(ceil(n / 50.0) AS BIGINT) AS total_pages FROM branches, (SELECT count(*) AS n FROM branches WHERE city_code = 2) WHERE city_code = 2 ORDER BY name, id, store_id LIMIT 50")
def api_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import api

    return _answer(api.branches(tables(spark, sf_dir), {"city_code": "2", "limit": "50"}), "id", "store_id", "name")


@query("SELECT store_product_id, branch_id, price_cents, n AS total, CAST(ceil(n / 20.0) AS BIGINT) AS total_pages FROM latest_prices, (SELECT count(*) AS n FROM latest_prices WHERE source = 'src1' AND available AND normalized_name ILIKE '%e%') WHERE source = 'src1' AND available AND normalized_name ILIKE '%e%' ORDER BY price_cents, store_product_id, branch_id LIMIT 20 OFFSET 20")
def api_prices_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read: the total counts all rows."""
    from tarifa.plans import api

    return _answer(api.prices(tables(spark, sf_dir), AS_OF, {"source": "src1", "available": "true", "query": " e ", "page": "2"}), "store_product_id", "branch_id", _cents())


@query(
    """, page AS (SELECT * FROM (SELECT *, 6371 * 2 * asin(sqrt(power(sin(radians(latitude - 19.43) / 2), 2) + cos(radians(19.43)) * cos(radians(latitude)) * power(sin(radians(longitude + 99.13) / 2), 2))) AS km FROM latest_prices)
  WHERE km <= 60 AND freshness <> 'old' AND price_cents > 0 AND available AND source = 'src1' ORDER BY km, price_cents, store_product_id, branch_id LIMIT 100),
p AS (SELECT * FROM page ORDER BY price_cents, store_product_id, branch_id LIMIT 20)
SELECT store_product_id, branch_id, price_cents, dense_rank() OVER (PARTITION BY normalized_name ORDER BY price_cents) AS price_rank, (SELECT count(*) FROM p) AS total, 1 AS total_pages FROM p"""
)
def api_compare_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over the page alone; the total is the page's length."""
    from tarifa.plans import api

    asked = {"source": "src1", "lat": "19.43", "lng": "-99.13", "radius_km": "60"}
    return _answer(api.compare(tables(spark, sf_dir), AS_OF, asked), "store_product_id", "branch_id", _cents(), F.col("price_rank").cast("long").alias("price_rank"))


@query("SELECT source, max(captured_at) AS latest_snapshot_at, CASE WHEN date_diff('day', max(captured_at), TIMESTAMP '2001-11-05') < 7 THEN 'healthy' WHEN date_diff('day', max(captured_at), TIMESTAMP '2001-11-05') <= 21 THEN 'stale' ELSE 'old' END AS health FROM snapshots GROUP BY 1")
def api_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import api

    return api.health(tables(spark, sf_dir), AS_OF)


@query(
    """, reg(source, status) AS (VALUES ('src0', 'validated'), ('src9', 'blocked')) SELECT reg.source, status, CAST(count(s.id) AS INTEGER) AS total_snapshots, CASE WHEN max(captured_at) IS NULL THEN 'no_data' WHEN date_diff('day', max(captured_at), TIMESTAMP '2001-11-05') < 7 THEN 'healthy' ELSE 'stale' END AS health
FROM reg LEFT JOIN snapshots s USING (source) GROUP BY 1, 2"""
)
def api_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.plans import api

    catalog = spark.createDataFrame([("src0", "branch", "validated"), ("src9", "online", "blocked")], "source string, capture_scope string, status string")
    return api.sources(tables(spark, sf_dir), catalog, AS_OF).select("source", "status", "total_snapshots", "health")


# Files of records: written into the session's shared folder and read back


def _folder(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="tarifa-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_size FROM part", mapped=False)
def archived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, of which those that a table lacks come back from a verified archive."""
    from tarifa.sources import ndjson

    path, rows = _folder(spark, "archive"), _part(spark, sf_dir).select("p_partkey", "p_name", "p_size")
    ndjson.write_archive(rows.filter("p_partkey % 3 > 0"), path)
    return ndjson.restore_archive(rows.filter("p_partkey % 2 = 0 OR p_partkey % 3 = 0"), path, "p_partkey")


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 10 = 0 THEN 'not_json_object' WHEN p_partkey % 10 = 1 THEN 'invalid_json' END AS error FROM part", mapped=False)
def lines_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON lines; tenths of them no objects or no JSON. Lines are matched by number to what was written."""
    from tarifa.sources import ndjson

    path, k = _folder(spark, "lines"), _key() % 10
    text = F.when(k == 0, F.concat(F.lit("["), _key(), F.lit("]"))).when(k == 1, F.concat(F.lit("{"), _key())).otherwise(F.to_json(F.struct("p_partkey", "p_name")))
    _part(spark, sf_dir).orderBy("p_partkey").select(text.alias("value")).coalesce(1).write.text(path)
    read = ndjson.read_ndjson(spark, path)
    # One file in order of the keys, so a line's number is the key and one.
    return read.select((F.col("line") - 1).alias("p_partkey"), "error").join(_part(spark, sf_dir).select("p_partkey", "p_name"), "p_partkey")


@query("SELECT s_suppkey, p_partkey, p_name FROM supplier JOIN part ON p_partkey % 1000 = s_suppkey % 1000", mapped=False)
def recordset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as base64 arrays of JSON, one for each three last digits, read back as rows."""
    from tarifa.sources import ndjson

    arrays = _part(spark, sf_dir).groupBy((_key() % 1000).alias("d")).agg(F.base64(F.to_json(F.collect_list(F.struct("p_partkey", "p_name"))).cast("binary")).alias("body"))
    rows = ndjson.recordset(arrays, "body", "p_partkey bigint, p_name string", base64=True)
    return load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 1000).alias("d")).join(rows.withColumn("d", _key() % 1000), "d").drop("d")


@query("SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids, true AS within FROM part", mapped=False)
def chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 40 rows and 3,000 bytes hold each record once."""
    from tarifa.sources import ndjson

    rows = ndjson.chunked(_part(spark, sf_dir).select("p_partkey", "p_name"), 40, 3000)
    size = F.sum(F.octet_length(F.to_json(F.struct("p_partkey", "p_name"))))
    return rows.groupBy("part", "chunk").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("ids"), size.alias("size")).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.bool_and((F.col("n") <= 40) & (F.col("size") <= 3000)).alias("within"))


@query("SELECT 'parts' AS source_name, p_name AS name, CAST(CASE WHEN p_name LIKE '%red widget%' THEN 7 ELSE 50 END AS DOUBLE) AS price FROM part UNION ALL SELECT 'suppliers', s_name, 50 FROM supplier", mapped=False)
def sources_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up prices of two sources and a third that fails."""
    named = lambda table, column: lambda: official.mock_prices(load(spark, sf_dir, table).select(F.col(column).alias("name")), {"red widget": 7.0}, 50, AS_OF)
    rows, failed = official.from_sources(spark, {"parts": named("part", "p_name"), "broken": named("part", "no_such_column"), "suppliers": named("supplier", "s_name")}, "name string, price double, currency string, captured_at timestamp, is_synthetic boolean")
    assert [r.source for r in failed.collect()] == ["broken"]
    return rows.select("source_name", "name", "price")


@query(
    """SELECT p_partkey, sha256('{"a":' || p_size || ',"b":{"c":"' || p_name || '","d":null}}') AS hash, p_partkey % 2 = 0 AS has_b, '{"a":' || p_size || ',"x":1}' AS merged, CASE WHEN p_partkey % 3 = 0 THEN 'paint|1x' || CAST(round(p_size * 3785.41) AS BIGINT) || 'ml|MXN' ELSE 'paint|1x' || p_size || 'ml|MXN' END AS compared FROM part""",
    mapped=False,
)
def json_and_gallon_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that don't hang on the order of keys, keys with null values, merged objects, and presentations in gallons."""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    body = F.concat(F.lit('{ "b": {"d": null, "c": "'), name, F.lit('"}, "a": '), size, F.lit("}"))
    maybe = F.when(_key() % 2 == 0, '{"b": null}').otherwise('{"c": 1}')
    merged = S.canonical_json(S.merged_json(F.lit('{"x": 1, "a": "old"}'), F.concat(F.lit('{"a": '), size, F.lit("}"))))
    rows = _part(spark, sf_dir).withColumns({"product_name": F.lit("Paint"), "presentation": F.concat(size, F.when(_key() % 3 == 0, " galones").otherwise(" ml")), "currency": F.lit("MXN")})
    return rows.select("p_partkey", S.canonical_hash(body).alias("hash"), S.has_key(maybe, "b").alias("has_b"), merged.alias("merged"), P.comparison_key(rows).alias("compared"))


@query("SELECT 'u/' || s_suppkey AS store_product_url, 'c' || s_suppkey // 2 AS category, '{\"a\":1,\"reviewed_comparison\":{\"basis\":\"size\",\"canonical_variant_key\":\"reviewed:' || s_suppkey // 2 || '\",\"reviewed_at\":\"2001-11-05\"}}' AS raw_payload FROM supplier WHERE (s_suppkey // 2) * 2 + 1 <= (SELECT max(s_suppkey) FROM supplier) AND (s_suppkey // 2) * 2 >= (SELECT min(s_suppkey) FROM supplier)", mapped=False)
def reviewed_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers as the two listings of an item, all ready; a supplier without the other of its pair is none."""
    k, every = F.col("s_suppkey"), load(spark, sf_dir, "supplier")
    s = every.join(every.groupBy(F.expr("s_suppkey div 2").alias("pair")).count().filter("count = 2"), F.expr("s_suppkey div 2") == F.col("pair"), "left_semi")
    item, url, source = F.expr("s_suppkey div 2"), F.concat(F.lit("u/"), k), F.when(k % 2 == 0, "a").otherwise("b")
    manifest = s.select(F.concat(F.lit("reviewed:"), item).alias("canonical_variant_key"), F.lit("x").alias("label"), source.alias("source"), url.alias("url"), F.col("s_name").alias("observed_name"), F.lit("1 kg").alias("observed_presentation"), F.concat(F.lit("c"), item).alias("category"), F.lit("size").alias("match_basis"))
    rows = s.select(
        source.alias("source"), url.alias("store_product_url"), F.col("s_name").alias("source_product_name"), F.lit("1 kg").alias("presentation"), F.lit("online").alias("price_scope"), F.lit(True).alias("available"), F.lit(False).alias("is_synthetic"), F.lit("accepted").alias("review_status"),
        F.lit('{"a": 1}').alias("raw_payload"), F.lit("old").alias("category"),
    )
    out = validators.prepared_basket(manifest, rows, ("a", "b"), "2001-11-05")
    return out.select("store_product_url", "category", S.canonical_json(F.col("raw_payload")).alias("raw_payload"))


@query("SELECT source, scope AS capture_scope, CASE WHEN source = 's0' THEN 'blocked' ELSE 'validated' END AS status FROM (SELECT 's' || p_size AS source, 'online' AS scope FROM part UNION SELECT 's0', 'branch')", mapped=False)
def registered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame([("s0", "online", "blocked"), ("s1", "branch", "candidate")], "source string, capture_scope string, status string")
    sizes = _part(spark, sf_dir).select(F.concat(F.lit("s"), "p_size").alias("source"), F.lit("online").alias("capture_scope"), F.lit("validated").alias("status")).distinct()
    return B.registered_sources(catalog, sizes.union(spark.createDataFrame([("s0", "branch", "validated")], "source string, capture_scope string, status string")))


@query(
    f"""SELECT 'https://parts.mx/' || p_partkey AS store_product_url, CASE WHEN p_partkey % 2 = 1 THEN 'unknown_listing' WHEN p_partkey % 4 = 2 THEN 'changed_presentation' END AS outcome FROM part WHERE {_ACCEPTED} AND (p_partkey % 2 = 1 OR p_partkey % 4 = 2)
UNION ALL SELECT 'inserted ' || count(*), NULL FROM part WHERE {_ACCEPTED} AND p_partkey % 4 = 0""",
    mapped=False,
)
def refreshed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh in which only the even parts are known, half of them with another presentation."""
    records = ingest.unique_records(ingest.validated(_lines(spark, sf_dir), AS_OF)).select("raw")
    c = F.col
    known = _part(spark, sf_dir).filter("p_partkey % 2 = 0").select(
        F.concat(F.lit("https://parts.mx/"), _key()).alias("store_product_url"), c("p_name").alias("normalized_name"), F.initcap("p_name").alias("external_name"), F.when(_key() % 4 == 0, "1 pieza").otherwise("2 piezas").alias("presentation"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("store_slug"), F.lit("kept").alias("category"), F.lit(None).cast("timestamp").alias("latest_capture"),
    )
    _, report, rejected = B.refreshed(B.empty_state(spark), records, known, "parts", AS_OF)
    return rejected.withColumnRenamed("reject_reason", "outcome").union(report.select(F.concat(F.lit("inserted "), "inserted_snapshots"), F.lit(None).cast("string")))


# Retailers' pages and branch replies


def _ld(value: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), F.to_json(value), F.lit("</script>"))


_PAGE = "SELECT p_partkey AS part, CASE WHEN r IS NULL THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents, CASE WHEN r IS NULL THEN p_size % 2 = 0 END AS available, r AS reject_reason FROM (SELECT *, {} AS r FROM part)"


def _page_outcome(found: DataFrame) -> DataFrame:
    good = F.col("reject_reason").isNull()
    part = F.regexp_extract("url", "-([0-9]+)(?:/p)?$", 1).cast("long")
    return found.select(part.alias("part"), F.when(good, S.cents(F.col("price"))).alias("price_cents"), F.when(good, F.col("available")).alias("available"), "reject_reason")


def _ld_offer(k: Column, **more: Column) -> Column:
    stock = F.when(F.col("p_size") % 2 == 0, "https://schema.org/InStock").otherwise("http://schema.org/OutOfStock")
    fields = {"@type": F.lit("Offer"), "price": F.round("p_retailprice", 2), "priceCurrency": F.lit("MXN"), "availability": stock} | more
    return F.struct(*[v.alias(n) for n, v in fields.items()])


@query(_PAGE.format("CASE p_partkey % 12 WHEN 1 THEN 'url_and_sku_differ' WHEN 2 THEN 'ambiguous_pack' WHEN 3 THEN 'combined_presentation' WHEN 4 THEN 'missing_category' WHEN 5 THEN 'availability_not_confirmed' WHEN 6 THEN 'expired_offer' END"), mapped=False)
def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.sources import retail

    k, url = _key() % 12, F.concat(F.lit("https://m.mx/p-"), _key())
    name = F.concat("p_name", F.when(k == 2, " paquete 500 Grs.").when(k == 3, " 1 kg 2 l").when(k == 7, " 6 x 355 ml").otherwise(" 2 Lts."))
    offer = _ld_offer(k, availability=F.when(k == 5, "PreOrder").when(F.col("p_size") % 2 == 0, "InStock").otherwise("https://schema.org/OutOfStock"), priceValidUntil=F.when(k == 6, "2001-11-01"))
    product = F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.when(k == 1, F.lit("0x")).otherwise(_key().cast("string")).alias("sku"), url.alias("url"), offer.alias("offers"))
    step = lambda item, shown: F.struct(item.alias("item"), shown.alias("name"))
    crumbs = F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(step(F.lit("https://m.mx/"), F.lit("Home")), step(F.when(k == 4, "https://m.mx/x").otherwise("https://m.mx/c/food"), F.col("p_type"))).alias("itemListElement"))
    pages = _dealt_part(spark, sf_dir).select(url.alias("url"), F.concat(_ld(product), _ld(crumbs)).alias("html"))
    return _page_outcome(retail.catalog_pages(pages, "https://m.mx", AS_OF))


def _next(value: Column) -> Column:
    return F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(value), F.lit("</script>"))


@query(_PAGE.format("CASE p_partkey % 12 WHEN 1 THEN 'identity_conflict' WHEN 2 THEN 'price_conflict' WHEN 3 THEN 'availability_conflict' WHEN 4 THEN 'promotion' WHEN 5 THEN 'weighted_or_ambiguous_unit' WHEN 6 THEN 'missing_or_ambiguous_state' WHEN 7 THEN 'stock_conflict' WHEN 8 THEN 'url_conflict' END"), mapped=False)
def corroborated_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data against the storefront's own product."""
    from tarifa.sources import retail

    k, url, stock = _key() % 12, F.concat(F.lit("https://j.mx/p-"), _key()), F.col("p_size") % 2 == 0
    name, price = F.concat("p_name", F.lit(" 1 kg")), F.round("p_retailprice", 2)
    product = F.struct(F.lit("Product").alias("@type"), name.alias("name"), _key().cast("string").alias("sku"), F.when(k == 8, "https://j.mx/other").otherwise(url).alias("url"), _ld_offer(k).alias("offers"))
    state = F.struct(
        F.when(k == 6, "none").otherwise(_key().cast("string")).alias("id"), F.when(k == 1, "other").otherwise(name).alias("name"), F.when(k == 2, price + 1).otherwise(price).alias("price"), F.when(k == 3, ~stock).otherwise(stock).alias("isAvailable"), (k == 4).alias("onSale"),
        F.array(F.struct((k != 5).alias("isPiece"))).alias("variants"),
    )
    rendered = F.struct(state.alias("own"), stock.alias("availability"), F.when(k == 7, F.when(stock, 0).otherwise(5)).when(stock, 3).otherwise(0).alias("stockLevel"))
    data = F.struct(F.struct(F.struct(rendered.alias("product")).alias("pageProps")).alias("props"))
    pages = _dealt_part(spark, sf_dir).select(url.alias("url"), F.concat(_ld(product), _next(data)).alias("html"))
    return _page_outcome(retail.corroborated_pages(pages, AS_OF, "piece"))


@query(_PAGE.format("CASE p_partkey % 12 WHEN 1 THEN 'wrong_storefront' WHEN 2 THEN 'tax_inclusion_unknown' WHEN 3 THEN 'promotion' WHEN 4 THEN 'price_conflict' WHEN 5 THEN 'stock_conflict' END"), mapped=False)
def corroborated_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.sources import retail

    k, url, stock = _key() % 12, F.concat(F.lit("https://r.mx/p-"), _key()), F.col("p_size") % 2 == 0
    price = F.round("p_retailprice", 2)
    product = F.struct(F.lit("Product").alias("@type"), F.concat("p_name", F.lit(" 1 kg")).alias("name"), _key().cast("string").alias("sku"), _ld_offer(k).alias("offers"))
    pricing = F.struct((k != 2).alias("isTaxExempt"), F.when(k == 3, "99").otherwise("").alias("oldPrice"), F.when(k == 4, price + 1).otherwise(price).alias("price"))
    state = F.struct(F.lit("Product").alias("__typename"), _key().cast("string").alias("sku"), F.when((k == 5) != stock, 4).otherwise(0).alias("stock"), pricing.alias("pricing"))
    data = F.struct(F.struct(F.struct(F.when(k == 1, "other").otherwise("own").alias("slug")).alias("vendor"), F.array(state, state).alias("list")).alias("props"))
    pages = _dealt_part(spark, sf_dir).select(url.alias("url"), F.concat(_ld(product), _next(data)).alias("html"))
    return _page_outcome(retail.corroborated_pages(pages, AS_OF, "stock", "own"))


@query(_PAGE.format("CASE p_partkey % 14 WHEN 1 THEN 'no_product_of_this_url' WHEN 2 THEN 'offer_not_bound' WHEN 3 THEN 'combined_presentation' WHEN 4 THEN 'missing_or_ambiguous_quantity' WHEN 5 THEN 'expired_offer' WHEN 9 THEN 'no_product_of_this_url' WHEN 10 THEN 'no_product_of_this_url' END"), mapped=False)
def sku_bound_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marketplace's products: those under 7 in structured data, the others in a normalized graph, of which some are discounted or of another route."""
    from tarifa.sources import retail

    k, stock, number = _key() % 14, F.col("p_size") % 2 == 0, _key().cast("string")
    slug = F.concat(F.lit("s-"), _key())
    url = F.concat(F.lit("https://c.mx/"), slug, F.lit("/p"))
    name, price = F.concat("p_name", F.when(k == 3, " 1 kg 2 l").when(k == 4, " pack 500 ml").otherwise(" 500 ml")), F.round("p_retailprice", 2)
    offer = _ld_offer(k, sku=number, seller=F.struct(F.when(k == 2, "Other").otherwise("House").alias("name")), priceValidUntil=F.when(k == 5, "2001-11-01"))
    product = F.struct(F.lit("Product").alias("@type"), F.when(k == 1, "https://c.mx/").otherwise(url).alias("@id"), number.alias("mpn"), number.alias("sku"), name.alias("name"), offer.alias("offers"))
    ref = lambda key: F.struct(F.lit("id").alias("type"), F.lit(key).alias("id"))
    entry = lambda key, value: F.concat(F.lit('"'), key, F.lit('":'), F.to_json(value))
    terms = F.struct(price.alias("Price"), F.when(k == 9, price + 1).otherwise(price).alias("ListPrice"), F.when(stock, 3).otherwise(0).alias("AvailableQuantity"))
    graph = F.concat(
        F.lit("{"), F.concat_ws(
            ",", entry(F.concat(F.lit("Product:"), slug), F.struct(number.alias("productId"), name.alias("productName"), slug.alias("linkText"), F.array(ref("sku")).alias("items"))),
            entry(F.lit("sku"), F.struct(number.alias("itemId"), F.lit("un").alias("measurementUnit"), F.lit(1).alias("unitMultiplier"), F.array(ref("seller")).alias("sellers"))),
            entry(F.lit("seller"), F.struct(F.lit("1").alias("sellerId"), F.lit("House").alias("sellerName"), ref("offer").alias("commertialOffer"))), entry(F.lit("offer"), terms),
        ), F.lit("}"),
    )
    path = F.concat(F.lit("/"), F.when(k == 10, "elsewhere").otherwise(slug), F.lit("/p"))
    runtime = F.to_json(F.struct(F.lit("house").alias("account"), F.struct(F.lit("MXN").alias("currency")).alias("culture"), F.struct(F.lit("store.product").alias("id"), path.alias("canonicalPath"), F.struct(number.alias("id")).alias("params")).alias("route")))
    template = lambda var, body: F.concat(F.lit(f'<template data-varname="{var}"><script>'), body, F.lit("</script></template>"))
    html = F.when(k < 7, _ld(product)).otherwise(F.concat(template("__RUNTIME__", runtime), template("__STATE__", graph)))
    found = retail.sku_bound_pages(_dealt_part(spark, sf_dir).select(url.alias("url"), html.alias("html")), "House", "house", AS_OF)
    return _page_outcome(found)


@query(
    """SELECT p_partkey AS part, CASE WHEN r IS NULL THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents, CASE WHEN r IS NULL THEN p_size % 2 = 0 END AS available, r AS reject_reason FROM (SELECT *, CASE p_partkey % 7 WHEN 1 THEN 'other_currency' WHEN 2 THEN 'expected_one_product' WHEN 3 THEN 'invalid_price' END AS r FROM part)""",
    mapped=False,
)
def pages_with_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of which every other offer is stated in meta tags alone."""
    from tarifa.sources import retail

    k, url, price = _key() % 7, F.concat(F.lit("https://t.mx/p-"), _key()), F.format_string("%.2f", "p_retailprice")
    in_tags, said = _key() % 2 == 0, F.when(F.col("p_size") % 2 == 0, "instock").otherwise("out of stock")
    currency = F.when(k == 1, "USD").otherwise("MXN")
    offer = F.struct(F.when(~in_tags & (k != 3), price).alias("price"), F.when(~in_tags, currency).alias("priceCurrency"), F.when(~in_tags, said).alias("availability"))
    product = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), _key().cast("string").alias("sku"), F.array(offer).alias("offers"))
    tag = lambda name, value: F.concat(F.lit(f'<meta property="{name}" content="'), value, F.lit('">'))
    tags = F.concat(tag("product:price:currency", currency), tag("product:availability", said), F.when(k != 3, tag("product:price:amount", F.concat(F.lit("$ "), price))).otherwise(""))
    html = F.concat(F.when(k == 2, "").otherwise(_ld(product)), F.when(in_tags, tags).otherwise(""))
    return _page_outcome(retail.pages_with_metas(_part(spark, sf_dir).select(url.alias("url"), html.alias("html")), "Electronica"))


@query(
    """SELECT p_partkey AS part, r AS reject_reason, CASE WHEN r IS NULL THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents, r IS NULL AND p_size % 2 = 0 AND p_partkey % 3 > 0 AS staged FROM (SELECT *, CASE p_partkey % 11 WHEN 1 THEN 'missing_branch_price_field' WHEN 2 THEN 'unexpected_currency:USD'
WHEN 3 THEN 'missing_branch_inventory_field' WHEN 4 THEN 'missing_official_product_url' WHEN 5 THEN 'missing_product_name' WHEN 6 THEN 'physical_store_id_mismatch' END AS r FROM part)""",
    mapped=False,
)
def branch_product_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each part at one of three branches, the first of which lies outside Mexico; and which parts may be staged."""
    from tarifa.sources import retail

    k, store = _key() % 11, (_key() % 3).cast("string")
    branches = spark.createDataFrame([(str(b), f"u{b}", f"b{b}", 19.5 if b else 51.5, -99.0) for b in range(3)], "store_number string, unique_id string, branch_external_key string, latitude double, longitude double")
    price = F.format_string("%.2f", "p_retailprice")
    fields = F.map_from_arrays(
        F.array(F.when(k == 1, "x_prices.9.mxn").otherwise(F.concat(F.lit("x_prices."), store, F.lit(".mxn"))), F.when(k == 3, "inventories.u9.quantity").otherwise(F.concat(F.lit("inventories.u"), store, F.lit(".quantity"))), F.lit("partNumber")),
        F.array(price, F.when(F.col("p_size") % 2 == 0, "3").otherwise("0"), _key().cast("string")),
    )
    rest = F.struct(F.when(k != 5, F.col("p_name")).alias("name"), F.array(F.struct(F.lit("Offer").alias("usage"), F.when(k == 2, "USD").otherwise("MXN").alias("currency"))).alias("price"), F.struct(F.when(k == 4, "https://other.mx/x").otherwise(F.concat(F.lit("/p/"), _key())).alias("href")).alias("seo"))
    item = S.merged_json(F.to_json(fields), F.to_json(rest))
    body = F.concat(F.lit('{"contents": ['), F.when(_key() % 2 == 0, item).otherwise(F.concat(F.lit('{"components": ['), item, F.lit("]}"))), F.lit("]}"))
    url = F.concat(F.lit("https://www.depot.mx/api?physicalStoreId="), F.when(k == 6, "99").otherwise(store))
    responses = _part(spark, sf_dir).select(url.alias("url"), F.lit(AS_OF).alias("observed_at"), body.alias("body"), store.alias("store_number"))
    found = retail.branch_products(responses, branches, "www.depot.mx")
    staged = retail.branch_records(found, F.lit("Herramientas")).select(F.col("external_reference"), F.lit(True).alias("staged"))
    out = found.join(staged, "external_reference", "left")
    return out.select(F.col("external_reference").cast("long").alias("part"), "reject_reason", F.when(F.col("reject_reason").isNull(), S.cents(F.col("price"))).alias("price_cents"), F.coalesce("staged", F.lit(False)).alias("staged"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, date_trunc('day', ts) AS day FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 37) % 1009, event_id) AS n FROM e),
fold AS (SELECT user_id, n, event_id, day AS seen, event_type AS last, 'insert' AS action FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.event_id, greatest(f.seen, o.day), CASE WHEN o.day > f.seen THEN o.event_type ELSE f.last END,
    CASE WHEN o.day < f.seen THEN 'late' WHEN o.day = f.seen AND o.event_type = f.last THEN 'replay' WHEN o.day = f.seen THEN 'conflict' WHEN o.event_type = f.last THEN 'unchanged' ELSE 'insert' END
  FROM fold f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id, action FROM fold""",
    mapped=False,
)
def publish_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of order with the day as their instant, so most meet others of the same instant. The SQL folds them one by one."""
    e = load(spark, sf_dir, "events").withColumn("at", F.date_trunc("day", "ts")).withColumn("place", F.struct(F.col("event_id") * 37 % 1009, "event_id"))
    return U.decided(e, key="user_id", order="place", time="at", state=("event_type",)).select("event_id", "action")
