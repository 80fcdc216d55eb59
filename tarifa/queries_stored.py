"""Queries of what is kept between batches: streams with state, deduplication, stored tables, publishing calls."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.plans import catalog as C
from tarifa.plans import batch, ingest, maintenance, online, reports, trigrams, verify
from tarifa.plans.batch import settled
from tarifa.plans.mapping import AS_OF, dealt, load, tables
from tarifa.plans.stored_batch import StoredCatalog
from tarifa.queries import HISTORY, ORACLES, _product_history, query
from tarifa.queries_records import _folder, _lines
from tarifa.sources import discovery, products
from tarifa.sources.stored import StoredTable
from tarifa.streaming import keyed, seen


def _run(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query(ORACLES["publish_decisions"], mapped=False)
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publisher with keyed state over the events as a stream in three parts; the third starts with a new checkpoint."""
    path = _folder(spark, "stream")
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bounds = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    dealt = events.join(F.broadcast(bounds)).withColumn("third", F.expr("least(2, (event_id - low) * 3 div (high - low + 1))"))
    for n in range(3):
        source = f"{path}/in-{n // 2}"
        dealt.filter(F.col("third") == n).select(*events.columns).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        _run(keyed.publishing(stream, f"{path}/out", f"{path}/checkpoint-{n // 2}", key="user_id", order="event_id", time="ts", state=("event_type",)))
    return keyed.decisions(spark, f"{path}/out").select("event_id", "action")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 1000 ORDER BY o_orderkey % 3, o_orderkey) AS n FROM orders) WHERE n = 1", mapped=False)
def first_seen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three batches, of which each customer's number and priority is kept once; the second batch runs twice."""
    index = seen.SeenIndex(spark, _folder(spark, "seen"), buckets=32)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.md5((F.col("o_custkey") % 1000).cast("string")).alias("content_hash"), "o_orderkey")
    kept = None
    for n in (0, 1, 1, 2):
        found = index.new_rows(orders.filter(F.col("o_orderkey") % 3 == n), f"batch-{n}", ["o_orderkey"]).select("o_orderkey")
        found = found.checkpoint() if n else found
        kept = found if kept is None else kept.union(found).distinct()
    return kept


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 50 = 7 THEN 2 ELSE 1 END AS since FROM part WHERE p_partkey % 90 <> 1""",
    mapped=False,
)
def stored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in a stored table: a merge renames some, a replay writes nothing, a deletion takes those that are as they were."""
    t = StoredTable(spark, _folder(spark, "parts"), ["p_partkey"], buckets=32)
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit(1).alias("since"))
    t.merge(parts)
    some = parts.filter("p_partkey % 50 = 7").select("p_partkey", F.upper("name").alias("name"), F.lit(2).alias("since"))
    t.merge(some)
    if t.merge(some).buckets:
        raise RuntimeError("a replay has written something")
    t.delete(parts.filter("p_partkey % 90 = 1"))
    return t.read()


@query(ORACLES["published_snapshots"], mapped=False)
def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch publisher over stored tables, in two batches and one of them again."""
    catalog = StoredCatalog(spark, _folder(spark, "catalog"), buckets=16)
    records = ingest.unique_records(ingest.validated(_lines(spark, sf_dir), AS_OF)).select("raw").checkpoint()
    even = F.pmod(F.xxhash64("raw"), F.lit(2)) == 0
    for batch in (records.filter(even), records.filter(~even), records.filter(even)):
        _, commits = catalog.publish(batch, AS_OF)
    if commits["snapshots"].buckets:
        raise RuntimeError("a replay has written something")
    s = catalog.read()
    b = s.branches.select(F.col("id").alias("branch_id"), F.col("external_key").alias("branch"))
    return s.snapshots.join(b, "branch_id", "left").select("external_reference", (F.col("price") * 100).cast("long").alias("price_cents"), "price_scope", "branch")


# Publishing calls

_CASES = 16


def _code() -> Column:
    """An eight-digit GTIN of a part."""
    digits = F.lpad((F.col("p_partkey") + 1).cast("string"), 7, "0")
    total = sum((F.substring(digits, i, 1).cast("int") * (3 if i % 2 else 1) for i in range(1, 8)), F.lit(0))
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _calls(spark: SparkSession, sf_dir: str) -> tuple[online.Catalog, DataFrame, DataFrame]:
    """Parts as products with a listing and a snapshot each, one record for each of them, and the sources."""
    c, k = F.col, F.col("p_partkey") % _CASES
    part = dealt(load(spark, sf_dir, "part"), "p_partkey").withColumns({"key": c("p_partkey").cast("string"), "code": _code(), "price": F.round("p_retailprice", 2).cast("decimal(12,2)")})
    null = lambda kind="string": F.lit(None).cast(kind)
    url, seen_at = F.concat(F.lit("https://parts.mx/"), "key"), F.expr(f"timestamp'{AS_OF:%Y-%m-%d %H:%M:%S}' - interval 2 days")
    values = {
        "stores": None,
        "products": {"id": F.concat(F.lit("p"), "key"), "name": c("p_name"), "normalized_name": c("p_name"), "category": c("p_type"), "gtin": c("code"), "pack_count": F.lit(2), "canonical_variant_key": F.concat(F.lit("reviewed:"), "key")},
        "listings": {"id": F.concat(F.lit("l"), "key"), "store_id": F.lit("s"), "product_id": F.concat(F.lit("p"), "key"), "external_name": c("p_name"), "external_url": url, "store_product_url": url, "available": F.lit(True), "source": F.lit("parts"), "last_seen_at": seen_at},
        "snapshots": {"id": F.concat(F.lit("n"), "key"), "store_product_id": F.concat(F.lit("l"), "key"), "captured_at": seen_at, "last_seen_at": seen_at, "price": c("price"), "available": F.lit(True), "source": F.lit("parts"), "membership_required": F.lit(False)},
        "images": {},
    }
    made = {}
    for name, given in values.items():
        schema = spark.createDataFrame([], online.TABLES[name]).schema
        if given is None:
            made[name] = spark.createDataFrame([("s", "parts", "MX", True), ("t", "shut", "MX", False)], schema)
        elif given:
            made[name] = part.select(*[given.get(f.name, null(f.dataType)).cast(f.dataType).alias(f.name) for f in schema])
        else:
            made[name] = spark.createDataFrame([], schema)
    at = lambda days: F.date_format(F.expr(f"timestamp'{AS_OF:%Y-%m-%d %H:%M:%S}' - interval {days} days"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    new = k.isin(8, 9, 10)
    shown = F.when(new, F.concat(F.lit("https://parts.mx/new/"), "key")).when(k == 14, F.concat(F.lit("https://elsewhere.mx/"), "key")).when(k == 7, F.concat(F.lit("https://shut.mx/"), "key")).otherwise(url)
    fields = {
        "source": F.when(k == 11, "nobody").otherwise("parts"), "store_slug": F.when(k == 7, "shut").otherwise("parts"), "price_scope": F.lit("online"), "currency": F.when(k == 12, "USD").otherwise("MXN"), "price": F.when(k.isin(0, 3), c("price") + 1).otherwise(c("price")),
        "is_synthetic": F.lit(False), "review_status": F.lit("accepted"), "available": F.lit(True), "product_name": c("p_name"), "normalized_name": c("p_name"), "presentation": F.lit("1 kg"), "category": c("p_type"), "source_url": shown, "store_product_url": shown,
        "response_sha256": F.sha2("key", 256), "observed_at": F.when(k.isin(2, 3), at(2)).when(k == 4, at(3)).when(k == 13, at(9)).otherwise(at(1)), "pack_count": F.when(k == 5, 3).when(~k.isin(8), 2), "branch_id": F.when(k == 15, "b1"),
        "gtin": F.when(k == 6, "12345678").when(k == 10, c("code")), "canonical_variant_key": F.when(k == 9, F.concat(F.lit("reviewed:"), "key")),
    }
    raw = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    sources = spark.createDataFrame([("parts", "parts", ["parts.mx"], True, "validated", "MX"), ("parts", "shut", ["shut.mx"], True, "validated", "MX")], "source string, store_slug string, hosts array<string>, publisher_enabled boolean, status string, country string")
    return online.Catalog(**made), part.select(c("p_partkey").alias("position"), raw.alias("raw")), sources


@query(
    f"""WITH k AS (SELECT *, p_partkey % {_CASES} AS k FROM part)
SELECT p_partkey AS position, CASE k WHEN 3 THEN 'conflicting_observation' WHEN 5 THEN 'conflicting_identity' WHEN 6 THEN 'invalid_gtin' WHEN 7 THEN 'unknown_store' WHEN 11 THEN 'source_not_enabled' WHEN 12 THEN 'currency' WHEN 13 THEN 'not_current' WHEN 14 THEN 'host_not_allowed' WHEN 15 THEN 'branch_data' END AS error,
CASE WHEN k IN (0, 8, 9, 10) THEN 'insert' WHEN k IN (1, 5) THEN 'unchanged' WHEN k = 2 THEN 'replay' WHEN k = 3 THEN 'conflict' WHEN k = 4 THEN 'late' END AS action,
CASE WHEN k IN (0, 1, 5) THEN 'listing' WHEN k = 8 THEN 'new' WHEN k = 9 THEN 'reviewed_key' WHEN k = 10 THEN 'gtin' END AS rule, CASE WHEN k = 8 THEN p_name || ' [parts:' || md5('https://parts.mx/new/' || p_partkey) || ']' END AS new_name FROM k""",
    mapped=False,
)
def online_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the publishing call finds of a record for each part: an error, or what becomes of it."""
    catalog, records, sources = _calls(spark, sf_dir)
    return online.judged(catalog, records, sources, AS_OF).select("position", "error", "action", "rule", "new_name")


@query(
    f"""WITH k AS (SELECT *, p_partkey % {_CASES} AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)
SELECT 'https://parts.mx/' || p_partkey AS url, 'p' || p_partkey AS product, CASE WHEN k = 0 THEN 2 ELSE 1 END AS snapshots, cents + CASE WHEN k = 0 THEN 100 ELSE 0 END AS price_cents, CASE WHEN k IN (0, 1) THEN 1 ELSE 2 END AS days FROM k
UNION ALL SELECT 'https://parts.mx/new/' || p_partkey, CASE WHEN k = 8 THEN 'new' ELSE 'p' || p_partkey END, 1, cents, 1 FROM k WHERE k IN (8, 9, 10)""",
    mapped=False,
)
def online_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings after a call with the records that have no error: their product, snapshots, newest price and days since it was seen."""
    catalog, records, sources = _calls(spark, sf_dir)
    good = records.filter((F.col("position") % _CASES).isin(0, 1, 2, 4, 8, 9, 10))
    after, _ = online.publish_online(catalog, good, sources, AS_OF, limit=None)
    days = F.datediff(F.lit(AS_OF), F.max("last_seen_at")).alias("days")
    of = after.snapshots.groupBy("store_product_id").agg(F.count("*").alias("snapshots"), F.max_by(F.col("price") * 100, "captured_at").cast("long").alias("price_cents"), days)
    known = catalog.products.select(F.col("id").alias("product_id"), F.lit(True).alias("known"))
    rows = after.listings.join(of, after.listings["id"] == of["store_product_id"]).join(known, "product_id", "left")
    return rows.select(F.col("store_product_url").alias("url"), F.when(F.col("known"), F.col("product_id")).otherwise("new").alias("product"), "snapshots", "price_cents", "days")


@query(
    f"""WITH k AS (SELECT *, p_partkey % {_CASES} AS k FROM part)
SELECT 'https://parts.mx/' || p_partkey AS url, CASE WHEN k IN (0, 1, 4) THEN 2 ELSE 1 END AS snapshots, CASE WHEN k IN (0, 1) THEN 1 ELSE 2 END AS days FROM k UNION ALL SELECT 'https://parts.mx/new/' || p_partkey, 1, 1 FROM k WHERE k IN (8, 9, 10)""",
    mapped=False,
)
def online_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings after a call of the earlier publisher: their snapshots, late ones included, and days since they were last seen."""
    catalog, records, sources = _calls(spark, sf_dir)
    after, _ = online.publish_always(catalog, records.filter((F.col("position") % _CASES).isin(0, 1, 2, 4, 8, 9, 10)), sources, AS_OF, limit=None)
    of = after.snapshots.groupBy("store_product_id").agg(F.count("*").alias("snapshots"))
    rows = after.listings.join(of, after.listings["id"] == of["store_product_id"])
    return rows.select(F.col("store_product_url").alias("url"), "snapshots", F.datediff(F.lit(AS_OF), "last_seen_at").alias("days"))


@query("SELECT t AS searched, p_partkey AS id FROM part, (VALUES ('red'), ('d w%et'), ('_een widg'), ('re'), ('#1%'), ('nothing')) s(t) WHERE p_name ILIKE '%' || t || '%' OR p_brand ILIKE '%' || t || '%'", mapped=False)
def searched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by texts in their name or brand, found through the gram index; a text of two letters goes over all rows."""
    index = trigrams.TrigramIndex(spark, _folder(spark, "grams"), buckets=16)
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    index.add(parts, "p_name", "p_brand")
    found = [trigrams.search(parts, index, text, "p_name", "p_brand").select(F.lit(text).alias("searched"), "id") for text in ("red", "d w%et", "_een widg", "re", "#1%", "nothing")]
    return reduce(DataFrame.union, found)


@query("SELECT p_partkey AS page_id, n AS position, 'https://m.mx/p/' || n || '-' || p_partkey AS url, CASE WHEN n = 1 AND p_partkey % 4 = 1 THEN 'promotion' WHEN n = 1 AND p_partkey % 4 = 2 THEN 'tax_inclusion_unknown' WHEN n = 1 AND p_partkey % 4 = 3 OR n = 3 THEN 'not_in_state' END AS reason FROM part, range(1, 4) t(n)", mapped=False)
def eligible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part with three product links: of the first the state says this or that, of the second that it may be followed, of the third nothing."""
    key = F.col("p_partkey").cast("string")
    slug = lambda n: F.concat(F.lit(f"{n}-"), key)
    item = lambda n, untaxed, before: F.struct(F.lit("Product").alias("__typename"), slug(n).alias("slug"), F.struct(untaxed.alias("isTaxExempt"), before.alias("oldPrice"), F.col("p_retailprice").alias("price")).alias("pricing"))
    k = F.col("p_partkey") % 4
    first = item(1, k != 2, F.when(k == 1, "9").otherwise(""))
    state = F.to_json(F.when(k == 3, F.array(item(2, F.lit(True), F.lit("")))).otherwise(F.array(first, item(2, F.lit(True), F.lit("")))))
    anchors = [F.concat(F.lit('<a href="/p/'), slug(n), F.lit('">x</a>')) for n in (1, 2, 3)]
    html = F.concat(F.lit('<script id="__NEXT_DATA__">{"list":'), state, F.lit("}</script>"), *anchors, F.lit('<a href="/c/food">x</a><a href="/p/1?x">x</a>'))
    pages = dealt(load(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return discovery.product_links(pages, "https://m.mx", "/p/[a-z0-9-]+")


@query(
    HISTORY
    + """, r AS (SELECT * FROM (SELECT *, lead(true) OVER (PARTITION BY store_product_id, branch_id, price_scope ORDER BY captured_at, id) AS newer FROM h) WHERE NOT coalesce(newer AND captured_at < TIMESTAMP '2001-11-05' - INTERVAL 90 DAY, false)),
n AS (SELECT *, lag((available, currency)) OVER w AS a, lead((available, currency)) OVER w AS b FROM r WINDOW w AS (PARTITION BY store_product_id, branch_id, price_scope ORDER BY captured_at, id))
SELECT id, store_product_id, coalesce(branch_id, -1) AS branch_id, captured_at FROM n WHERE NOT coalesce(a IS NOT NULL AND b IS NOT NULL AND a = (available, currency) AND b = (available, currency), false)"""
)
def maintained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after a maintenance run: old rows and repetitions are archived and deleted."""
    path = _folder(spark, "history")
    history = StoredTable(spark, f"{path}/table", ["store_product_id", "id"], by=["store_product_id"], buckets=8)
    history.merge(_product_history(spark, sf_dir))
    report = maintenance.maintain(history, f"{path}/archive", AS_OF, ["available", "currency"], apply=True, batch_rows=1 << 20, max_repeats=1 << 40, max_bytes=1 << 50)
    if report.filter("archived <> deleted").count():
        raise RuntimeError("a row was archived and not deleted")
    return history.read().select("id", "store_product_id", F.coalesce("branch_id", F.lit(-1)).alias("branch_id"), "captured_at")


@query('SELECT * FROM (VALUES (\'equal\', \'cheapest\', 0, 0, 0, true), (\'equal\', \'freshest\', 0, 0, 0, true), (\'shifted\', \'cheapest\', 3, 3, 2, false), (\'shifted\', \'freshest\', 3, 3, 2, false)) t(version, "case", missing, unexpected, repeated, equal)', mapped=False)
def verified_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of two versions of the online search, and of one whose pages overlap by a row."""
    t = tables(spark, sf_dir)
    keys = ["product_name", "store_slug", "price", "captured_at"]
    cases = {"cheapest": {"sort": "price_asc"}, "freshest": {"sort": "fresh_desc"}}
    # Offers of a version are ranked once; its pages are taken from the rows that lead in an order asked for.
    offers = {"v4": C.online_offers(t, AS_OF, None, None, True, 5000), "v3": C.online_offers(t, AS_OF, None, None, True, 5000).select("store_product_id", *C.OFFER)}
    leading = [C.online_leading(o.select("store_product_id", *keys), [c["sort"] for c in cases.values()], 60).withColumn("version", F.lit(v)) for v, o in offers.items()]
    leading = settled(leading[0].union(leading[1]))
    old, same = (lambda page, sort, v=v: C.online_page(leading.filter(F.col("version") == v), 20, page, sort) for v in offers)

    def shifted(page: int, sort: str) -> DataFrame:
        lead = [F.col("price")] if sort == "price_asc" else [F.col("captured_at").desc(), F.col("price")]
        return leading.filter("version = 'v4'").orderBy(*lead, "product_name", "store_slug", "store_product_id").offset((page - 1) * 19).limit(20)

    found = []
    for name, new in (("equal", same), ("shifted", shifted)):
        report = verify.summary(verify.differences(spark, old, new, cases, keys), cases)
        found.append(report.select(F.lit(name).alias("version"), "case", *[F.col(c).cast("int").alias(c) for c in ("missing", "unexpected", "repeated")], "equal"))
    return found[0].union(found[1])


# A staged record of a branch, and what is changed in it with the codes that this earns, in the order of the rules.
_BRANCH_RECORD = {
    "source": "parts", "store_brand": "Parts", "store_slug": "parts", "source_product_name": "Part", "normalized_name": "part", "category": "food", "presentation": "1 kg", "price": 10.5, "currency": "MXN", "available": True, "price_scope": "branch_local",
    "store_product_url": "https://parts.mx/@", "external_reference": "r@", "source_url": "https://parts.mx/@", "evidence_kind": "store_api", "review_status": "accepted", "is_synthetic": False, "confidence_score": 0.9, "content_hash": "hash-000000@",
    "validation_errors": [], "captured_at": "2001-11-04T10:00:00Z", "observed_at": "2001-11-04T10:00:00Z", "image_url": None, "raw_payload": {"id": "@"}, "branch_external_key": "b1", "branch_name": "Centro", "branch_address": "Street 1", "branch_municipality": "Town",
    "branch_state": "State", "latitude": 19.5, "longitude": -99.0,
}
_NO_BRANCH = {f: None for f in ingest.BRANCH_FIELDS} | {"price_scope": "online"}
_DEFECTS: list[tuple[dict, str]] = [
    ({}, ""),
    (_NO_BRANCH, ""),
    *(({f: value}, f"missing_{f}") for f in ingest.REQUIRED if f not in ("currency", "review_status") for value in (None, " ")),
    *(({"review_status": v}, "missing_review_status,review_not_accepted") for v in (None, " ")),
    *(({"price": p}, "invalid_price") for p in (None, 0, -1, "10")),
    ({"currency": None}, "missing_currency,non_mxn"), ({"currency": "mxn"}, "invalid_currency,non_mxn"), ({"currency": "USD"}, "non_mxn"),
    *(({"confidence_score": c}, "invalid_confidence_score") for c in (None, 0.69, 1.01, "0.9")),
    *(({"is_synthetic": v}, "synthetic_record") for v in (True, None, "false")),
    *(({"review_status": v}, "review_not_accepted") for v in ("pending", "Accepted")),
    *(({"available": v}, "invalid_available") for v in (None, "true", 1)),
    ({"price_scope": "national"}, "invalid_price_scope"),
    *((_NO_BRANCH | {f: _BRANCH_RECORD[f]}, "online_has_branch_data") for f in ingest.BRANCH_FIELDS),
    *(({f: None}, f"missing_{f}") for f in ingest.BRANCH_TEXTS),
    ({"latitude": 50}, "invalid_latitude"), ({"latitude": "19.5"}, "invalid_latitude"), ({"longitude": None}, "invalid_longitude"), ({"longitude": -130}, "invalid_longitude"),
    ({"source_url": "ftp://x"}, "invalid_source_url"), ({"store_product_url": "parts.mx"}, "invalid_store_product_url"), ({"image_url": "x"}, "invalid_image_url"), ({"image_url": 5}, "invalid_image_url"), ({"image_url": ""}, ""),
    ({"evidence_kind": "rumour"}, "unknown_evidence"),
    ({"captured_at": "yesterday"}, "invalid_captured_at"), ({"captured_at": "2001-11-04T10:00:00"}, "invalid_captured_at"), ({"observed_at": "2001-11-04"}, "invalid_observed_at"), ({"observed_at": "2001-10-20T10:00:00Z"}, "observation_not_current"), ({"observed_at": "2001-11-05T01:00:00Z"}, "observation_not_current"),
    *(({"raw_payload": v}, "invalid_raw_payload") for v in ([1], "x")),
    ({"validation_errors": ["e"]}, "upstream_validation_errors"), ({"validation_errors": "e"}, "upstream_validation_errors"), ({"validation_errors": None}, ""),
    ({"content_hash": "short"}, "invalid_content_hash"),
    ({"source": "home-depot-mx", "branch_external_key": "home-depot-mx:1"}, "invalid_home_depot_store_slug"), ({"source": "home-depot-mx", "store_slug": "home-depot-mx"}, "invalid_home_depot_branch_key"),
]


@query("SELECT p_partkey AS line, CASE p_partkey % " + str(len(_DEFECTS)) + " " + " ".join(f"WHEN {k} THEN '{codes}'" for k, (_, codes) in enumerate(_DEFECTS)) + " END AS issues FROM part", mapped=False)
def issues_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of parts with every defect that the staging rules know, one each."""
    bodies = [json.dumps(_BRANCH_RECORD | change) for change, _ in _DEFECTS]
    body = F.get(F.array(*[F.lit(b) for b in bodies]), (F.col("p_partkey") % len(bodies)).cast("int"))
    lines = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.replace(body, F.lit("@"), F.col("p_partkey").cast("string")).alias("raw"), F.lit(None).cast("string").alias("error"))
    return ingest.validated(lines, AS_OF).select("line", F.array_join("issues", ",").alias("issues"))


@query(
    r"""WITH t AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN '2001-11-04T10:00:' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'Z' WHEN 1 THEN '2001-11-04T10:00:00-06:00' WHEN 2 THEN '2001-11-04T10:00:00' WHEN 3 THEN '2001-11-04' ELSE 'noon Z' END AS said FROM part)
SELECT p_partkey, p_name LIKE '%red%' AND p_name LIKE '%wid%' AS found, epoch_us(CASE WHEN regexp_matches(said, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN try_cast(said AS TIMESTAMPTZ) END) AS instant,
lpad(lower(to_hex(list_reduce(list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT)::UBIGINT)), 16, '0') AS hash FROM t""",
    mapped=False,
)
def instants_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as instants where they name an offset, all terms of a search, and FNV-1a hashes of names."""
    k, second = F.col("p_partkey") % 5, F.lpad(F.col("p_size").cast("string"), 2, "0")
    said = F.when(k == 0, F.concat(F.lit("2001-11-04T10:00:"), second, F.lit("Z"))).when(k == 1, "2001-11-04T10:00:00-06:00").when(k == 2, "2001-11-04T10:00:00").when(k == 3, "2001-11-04").otherwise("noon Z")
    return load(spark, sf_dir, "part").select("p_partkey", T.demo_search(F.col("p_name"), " RÉD wid ").alias("found"), F.unix_micros(S.parse_instant(said)).alias("instant"), T.stable_hash(F.col("p_name")).alias("hash"))


@query(f"WITH p AS ({ORACLES['product_pages']}), r AS (SELECT count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason IS NOT NULL) AS rejected FROM p) SELECT accepted, rejected, 0 AS repeated_references, CASE WHEN rejected = 0 THEN 'ok' ELSE 'partial' END AS status, rejected = 0 AS publish FROM r", mapped=False)
def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a capture of product pages, and whether it may be published."""
    from tarifa.queries_records import captured_products

    report = products.capture_report(captured_products(spark, sf_dir))
    return report.crossJoin(F.broadcast(reports.gate(report, F.col("status") == "ok").select("publish")))  # a row each


@query("SELECT 'r' || p_partkey AS external_reference, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_size END AS branch FROM part WHERE NOT (p_partkey % 11 = 4 AND p_partkey % 3 = 0)", mapped=False)
def saved_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured products saved without tests of evidence: all parts but those whose branch lies elsewhere."""
    records = _lines(spark, sf_dir).filter("error IS NULL").select("raw")
    state = batch.saved_products(batch.empty_state(spark), batch.prepared(records), AS_OF)
    b = state.branches.select(F.col("id").alias("branch_id"), F.col("external_key").alias("branch"))
    return state.snapshots.join(b, "branch_id", "left").select("external_reference", (F.col("price") * 100).cast("long").alias("price_cents"), "branch")
