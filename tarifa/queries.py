"""Queries over the driver tables, each with the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.operators import latest as L
from tarifa.plans import catalog as C
from tarifa.plans import compare as P
from tarifa.plans import matching as M
from tarifa.plans import publish as U
from tarifa.plans import reconcile
from tarifa.plans import reports as R
from tarifa.plans.mapping import AS_OF, HERE, load, price_cents, sql, tables
from tarifa.sources import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WIDE = 365


def _branch() -> Column:
    """Online rows, which have no branch, as branch -1."""
    return F.coalesce("branch_id", F.lit(-1)).alias("branch_id")


def query(oracle: str | None = None, days: int = 7, mapped: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name. Oracles on the mapped tables get their definitions before them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, days) if mapped else oracle
        return f

    return add


@query("SELECT store_product_id, coalesce(branch_id, -1) AS branch_id, id, price_cents, captured_at FROM latest")
def latest_by_listing_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return price_cents(L.latest_by(t.snapshots, ["store_product_id", "branch_id"]).select("store_product_id", _branch(), "id", "price", "captured_at"))


@query("SELECT store_product_id, product_name, category, store_slug, coalesce(branch_id, -1) AS branch_id, branch_name, price_cents, source, captured_at, days_old FROM current_catalog", WIDE)
def current_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.current_catalog(tables(spark, sf_dir), AS_OF, WIDE)
    return price_cents(rows.select("store_product_id", "product_name", "category", "store_slug", _branch(), "branch_name", "price", "source", "captured_at", "days_old"))


ONLINE = "FROM current_catalog WHERE branch_id IS NULL AND available"


@query(f"SELECT product_name, category, store_slug, price_cents, captured_at, days_old {ONLINE} AND product_name ILIKE '%e%' ORDER BY price_cents, product_name, store_slug, store_product_id LIMIT 50 OFFSET 50", WIDE)
def online_prices_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = C.online_prices(tables(spark, sf_dir), AS_OF, search=" E ", limit=50, page=2, days=WIDE)
    return price_cents(page.select("product_name", "category", "store_slug", "price", "captured_at", "days_old"))


@query(f"SELECT product_name, category, store_slug, price_cents, captured_at {ONLINE} ORDER BY captured_at DESC, price_cents, product_name, store_slug, store_product_id LIMIT 100", WIDE)
def online_prices_freshest(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = C.online_prices_v3(tables(spark, sf_dir), AS_OF, sort="fresh_desc", days=WIDE)
    return price_cents(page.select("product_name", "category", "store_slug", "price", "captured_at"))


@query(
    """, fit AS (SELECT * FROM snapshots s JOIN stores st ON st.id = s.l_suppkey AND st.enabled JOIN products p ON p.id = s.l_partkey
    WHERE price_scope = 'online' AND date_diff('day', CAST(captured_at AS DATE), DATE '2001-11-05') <= 21 AND price_cents > 0),
one AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY store_product_id ORDER BY captured_at DESC, id DESC) = 1)
SELECT name_1 AS product_name, slug AS store_slug, price_cents, captured_at, greatest(0, date_diff('day', CAST(captured_at AS DATE), DATE '2001-11-05')) AS days_old
FROM (SELECT one.*, one.slug, p2.name AS name_1 FROM one JOIN products p2 ON p2.id = one.l_partkey) ORDER BY price_cents, product_name, store_slug, store_product_id LIMIT 100"""
)
def online_prices_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_cents(C.online_prices_v2(tables(spark, sf_dir), AS_OF).select("product_name", "store_slug", "price", "captured_at", "days_old"))


KM = "6371 * 2 * asin(sqrt(power(sin(radians(latitude - 19.43) / 2), 2) + cos(radians(19.43)) * cos(radians(latitude)) * power(sin(radians(longitude + 99.13) / 2), 2)))"


@query(
    f"""SELECT store_product_id, product_name, store_slug, branch_id, price_cents, captured_at, round(km, 6) AS km FROM (SELECT *, {KM} AS km FROM current_catalog WHERE branch_id IS NOT NULL)
WHERE km <= 30 AND available""",
    WIDE,
)
def nearby_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.nearby_offers(tables(spark, sf_dir), AS_OF, *HERE, radius=30, days=WIDE)
    return price_cents(rows.select("store_product_id", "product_name", "store_slug", "branch_id", "price", "captured_at", F.round("distance_km", 6).alias("km")))


@query(
    f"""SELECT product_name, store_slug, branch_id, price_cents, captured_at, round(km, 6) AS km FROM (SELECT *, {KM} AS km FROM current_catalog WHERE branch_id IS NOT NULL)
WHERE km <= 60 AND available ORDER BY round(km, 9), price_cents, product_name, store_slug, store_product_id, branch_id LIMIT 100""",
    WIDE,
)
def nearby_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.nearby_offers(tables(spark, sf_dir), AS_OF, *HERE, radius=60, days=WIDE).withColumn("distance_km", F.round("distance_km", 9))
    page = C.paged(rows, C._sort("distance", True), 100, 1)
    return price_cents(page.select("product_name", "store_slug", "branch_id", "price", "captured_at", F.round("distance_km", 6).alias("km")))


@query(
    f"""SELECT b.id AS branch_id, s.slug AS store_slug, b.name AS branch_name, round({KM}, 6) AS km FROM branches b JOIN stores s ON s.id = b.store_id
WHERE s.enabled AND geocoding_status IN ('manual', 'geocoded') AND {KM} <= 100 ORDER BY round({KM}, 6), store_slug, branch_name, branch_id LIMIT 100"""
)
def nearby_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.nearby_branches(tables(spark, sf_dir), *HERE, radius=100)
    return rows.select("branch_id", "store_slug", "branch_name", F.round("distance_km", 6).alias("km"))


@query(f"SELECT category AS name, count(*) AS count {ONLINE} GROUP BY category", WIDE)
def categories_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.categories(tables(spark, sf_dir), AS_OF, days=WIDE)


@query(f"SELECT category AS name, count(*) AS count FROM current_catalog WHERE branch_id IS NOT NULL AND available AND {KM} <= 30 GROUP BY category", WIDE)
def categories_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.categories(tables(spark, sf_dir), AS_OF, *HERE, radius=30, days=WIDE)


@query("SELECT store_product_id, product_name, store_slug, branch_id, price_cents, captured_at, days_old, freshness FROM latest_prices")
def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.latest_prices(tables(spark, sf_dir), AS_OF)
    return price_cents(rows.select("store_product_id", "product_name", "store_slug", "branch_id", "price", "captured_at", "days_old", "freshness"))


@query(
    """SELECT store_product_id, branch_id, normalized_name, price_cents, dense_rank() OVER (PARTITION BY normalized_name ORDER BY price_cents) AS price_rank,
min(price_cents) OVER (PARTITION BY normalized_name) AS best_price_cents FROM latest_prices WHERE available AND freshness <> 'old'"""
)
def compare_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.compare_prices(tables(spark, sf_dir), AS_OF)
    return price_cents(rows.select("store_product_id", "branch_id", "normalized_name", "price", "price_rank", "best_price"))


@query(
    """SELECT product_id, product_name, category, CAST(count(DISTINCT store_id) AS INTEGER) AS store_count, CAST(count(DISTINCT branch_id) AS INTEGER) AS listing_count,
string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(captured_at) AS oldest_observation_at, max(captured_at) AS last_updated_at FROM latest_prices GROUP BY ALL"""
)
def product_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.product_coverage(C.latest_prices(tables(spark, sf_dir), AS_OF)).drop("normalized_name")
    return rows.withColumn("sources", F.array_join("sources", ","))


@query(
    """SELECT source, CAST(count(*) AS INTEGER) AS total_snapshots, CAST(count(DISTINCT store_product_id) AS INTEGER) AS total_listings, CAST(count(DISTINCT branch_id) AS INTEGER) AS total_branches,
min(captured_at) AS oldest_snapshot_at, max(captured_at) AS latest_snapshot_at FROM snapshots GROUP BY source"""
)
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_stats(tables(spark, sf_dir))


@query(
    """, a AS (SELECT source, count(*) AS n FROM snapshots GROUP BY 1), b AS (SELECT source, count(DISTINCT product_id) AS n FROM listings GROUP BY 1), c AS (SELECT source, count(DISTINCT store_id) AS n FROM listings GROUP BY 1)
SELECT (SELECT CAST(count(*) AS INTEGER) FROM products) AS total_products, (SELECT CAST(count(*) AS INTEGER) FROM stores WHERE enabled) AS total_stores,
CAST(count(DISTINCT branch_id) AS INTEGER) AS total_branches, CAST(count(*) AS INTEGER) AS total_price_snapshots, max(captured_at) AS latest_snapshot_at, min(captured_at) AS oldest_snapshot_at,
(SELECT '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' FROM a) AS snapshots_by_source, (SELECT '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' FROM b) AS products_by_source,
(SELECT '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' FROM c) AS stores_by_source FROM snapshots"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage_summary(tables(spark, sf_dir))


@query(
    """SELECT CAST(count(*) AS INTEGER) AS total_normalized_branches, CAST(count(*) FILTER (geocoding_status IN ('manual', 'geocoded')) AS INTEGER) AS total_geocoded_branches,
CAST(count(*) FILTER (geocoding_status = 'review') AS INTEGER) AS total_review_geocoding, CAST(count(*) FILTER (geocoding_status IN ('pending', 'failed')) AS INTEGER) AS total_pending_geocoding,
CAST(count(DISTINCT city_code) AS INTEGER) AS total_city_codes FROM branches"""
)
def branch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.branch_coverage(tables(spark, sf_dir).branches)


@query(
    """SELECT CAST(count(*) AS INTEGER) AS total_latest_prices, CAST(count(image_url) AS INTEGER) AS with_image, CAST(count(*) AS INTEGER) AS with_official_link,
CAST(count(*) FILTER (freshness = 'fresh') AS INTEGER) AS fresh_prices, CAST(count(*) FILTER (freshness = 'stale') AS INTEGER) AS stale_prices, CAST(count(*) FILTER (freshness = 'old') AS INTEGER) AS old_prices,
CAST(count(*) FILTER (price_cents <= 0 OR price_cents > 10000000) AS INTEGER) AS implausible_prices, CAST(count(DISTINCT source) AS INTEGER) AS direct_sources, CAST(count(DISTINCT product_id) AS INTEGER) AS covered_products,
CAST(count(branch_id) AS INTEGER) AS with_branch, CAST(count(latitude) AS INTEGER) AS with_coordinates FROM latest_prices"""
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_summary(C.latest_prices(tables(spark, sf_dir), AS_OF))


REGISTERED = [("src0", "branch", "validated"), ("src1", "branch", "validated"), ("src3", "online", "blocked"), ("src9", "branch", "blocked"), ("src8", "online", "candidate")]


@query(
    """, reg(source, capture_scope, status) AS (VALUES ('src0', 'branch', 'validated'), ('src1', 'branch', 'validated'), ('src3', 'online', 'blocked'), ('src9', 'branch', 'blocked'), ('src8', 'online', 'candidate')),
bc AS (SELECT source, count(*) FILTER (geocoding_status IN ('manual', 'geocoded')) AS n FROM branches GROUP BY 1),
sc AS (SELECT s.source, count(*) AS total, count(s.branch_id) AS branch, count(*) FILTER (s.branch_id IS NULL) AS online, count(DISTINCT s.branch_id) AS branches, count(DISTINCT l_partkey) AS products, max(captured_at) AS latest,
  count(*) FILTER (price_cents <= 0 OR price_cents > 10000000) AS bad, count(*) FILTER (s.branch_id IS NOT NULL AND coalesce(geocoding_status, '') NOT IN ('manual', 'geocoded')) AS unplaced
  FROM snapshots s LEFT JOIN branches b ON b.id = s.branch_id AND b.store_id = s.l_suppkey GROUP BY 1),
k AS (SELECT source FROM reg UNION SELECT source FROM listings UNION SELECT source FROM snapshots UNION SELECT source FROM branches)
SELECT k.source, CASE WHEN coalesce(branch, 0) > 0 AND coalesce(n, 0) > 0 THEN 'branch_local' WHEN coalesce(online, 0) > 0 AND coalesce(branch, 0) = 0 THEN 'online_only'
  WHEN status = 'blocked' OR (coalesce(total, 0) = 0 AND coalesce(status, 'candidate') NOT IN ('candidate', 'validated')) THEN 'inactive' ELSE 'experimental' END AS mode,
  coalesce(capture_scope, 'unregistered') AS declared_scope, coalesce(status, 'unregistered') AS catalog_status, CAST(coalesce(n, 0) AS INTEGER) AS branches_with_coordinates, CAST(coalesce(branches, 0) AS INTEGER) AS branches_with_snapshots,
  CAST(coalesce(products, 0) AS INTEGER) AS products, CAST(coalesce(total, 0) AS INTEGER) AS prices, latest AS latest_capture,
  CASE WHEN latest IS NULL THEN 'no_data' WHEN latest >= TIMESTAMP '2001-11-05' - INTERVAL 7 DAY THEN 'fresh' WHEN latest >= TIMESTAMP '2001-11-05' - INTERVAL 21 DAY THEN 'stale' ELSE 'old' END AS freshness,
  CASE WHEN coalesce(bad, 0) > 0 THEN 'invalid_prices' WHEN coalesce(unplaced, 0) > 0 THEN 'invalid_branch_evidence' WHEN coalesce(total, 0) = 0 THEN 'no_observations' ELSE 'ok' END AS quality,
  nullif(concat_ws('; ', CASE WHEN coalesce(total, 0) = 0 THEN 'no snapshots' END, CASE WHEN capture_scope = 'branch' AND coalesce(branch, 0) = 0 THEN 'declared branch source without branch snapshots' END,
    CASE WHEN coalesce(online, 0) > 0 AND coalesce(branch, 0) = 0 THEN 'online prices have no branch_id evidence' END, CASE WHEN coalesce(unplaced, 0) > 0 THEN unplaced || ' branch snapshots lack valid coordinates' END,
    CASE WHEN latest < TIMESTAMP '2001-11-05' - INTERVAL 21 DAY THEN 'latest capture is older than 21 days' END, CASE WHEN coalesce(bad, 0) > 0 THEN bad || ' implausible prices' END), '') AS blockers
FROM k LEFT JOIN reg USING (source) LEFT JOIN bc USING (source) LEFT JOIN sc USING (source)"""
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = spark.createDataFrame(REGISTERED, "source string, capture_scope string, status string")
    return R.coverage_matrix(tables(spark, sf_dir), registered, AS_OF)


@query(
    """, twice AS (SELECT source, count(*) AS n FROM (SELECT source, store_product_id, branch_id, captured_at FROM snapshots GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT s.source, count(*) AS snapshots, count(DISTINCT store_product_id) AS listings, count(*) FILTER (price_cents <= 0) AS invalid_prices, count(*) FILTER (currency <> 'MXN') AS other_currencies,
count(*) FILTER (captured_at > TIMESTAMP '2001-11-05') AS future, CAST(0 AS BIGINT) AS scope_conflicts, max(captured_at) AS latest, coalesce(max(twice.n), 0) AS repeated_keys FROM snapshots s LEFT JOIN twice USING (source) GROUP BY 1"""
)
def source_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_verification(tables(spark, sf_dir), AS_OF)


@query("SELECT store_product_id, captured_at, count(*) AS n_rows FROM snapshots GROUP BY ALL HAVING count(*) > 1")
def duplicate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeats(tables(spark, sf_dir).snapshots, ["store_product_id", "captured_at"])


@query("SELECT store_product_id, captured_at, id FROM snapshots QUALIFY row_number() OVER (PARTITION BY store_product_id, captured_at ORDER BY id DESC) = 1")
def deduplicated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_repeats(tables(spark, sf_dir).snapshots, ["store_product_id", "captured_at"], [F.col("id").desc()]).select("store_product_id", "captured_at", "id")


HISTORY = ", h AS (SELECT s.id, l_partkey AS store_product_id, branch_id, price_scope, captured_at, price_cents, available, currency, source FROM snapshots s)"


def _product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by product, so that keys have histories."""
    return tables(spark, sf_dir).snapshots.withColumn("store_product_id", F.expr("store_product_id div 1000000"))


@query(
    HISTORY
    + """ SELECT id, store_product_id, coalesce(branch_id, -1) AS branch_id, captured_at FROM (SELECT *, lead(true) OVER (PARTITION BY store_product_id, branch_id, price_scope ORDER BY captured_at, id) AS newer FROM h)
WHERE newer AND captured_at < TIMESTAMP '2001-11-05' - INTERVAL 90 DAY"""
)
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.retention_candidates(_product_history(spark, sf_dir), AS_OF).select("id", "store_product_id", _branch(), "captured_at")


@query(
    HISTORY
    + """, n AS (SELECT *, lag((available, currency)) OVER w AS a, lead((available, currency)) OVER w AS b FROM h WINDOW w AS (PARTITION BY store_product_id, branch_id, price_scope ORDER BY captured_at, id))
SELECT id, store_product_id, coalesce(branch_id, -1) AS branch_id, captured_at FROM n WHERE a IS NOT NULL AND b IS NOT NULL AND a = (available, currency) AND b = (available, currency)"""
)
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compaction_candidates(_product_history(spark, sf_dir), ["available", "currency"]).select("id", "store_product_id", _branch(), "captured_at")


@query("SELECT user_id, event_type, ts, event_id FROM (SELECT *, lag(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> CAST(floor(value / 20) AS BIGINT)", mapped=False)
def state_change_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("state", F.floor(F.col("value") / 20))
    return L.state_changes(e, ["user_id", "event_type"], ["ts", "event_id"], ["state"]).select("user_id", "event_type", "ts", "event_id")


@query("SELECT event_id, user_id, ts FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 1000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE seen IS NULL OR ts >= seen", mapped=False)
def late_drop_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.on_time(load(spark, sf_dir, "events"), ["user_id"], [F.col("event_id") % 1000, "event_id"], "ts").select("event_id", "user_id", "ts")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.05)", mapped=False)
def anti_new_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return L.without_matches(load(spark, sf_dir, "part"), returned, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", mapped=False)
def semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return L.with_matches(load(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.095 AND l_quantity > 40", mapped=False)
def except_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount > 0.095 AND l_quantity > 40").select("l_suppkey")
    return load(spark, sf_dir, "supplier").select("s_suppkey").subtract(have)


@query(
    """, cur AS (SELECT DISTINCT store_product_id, branch_id, price_cents, currency FROM latest)
SELECT s.source, count(*) AS expected, count(c.store_product_id) AS matched FROM snapshots s LEFT JOIN cur c ON c.store_product_id = s.store_product_id AND c.branch_id IS NOT DISTINCT FROM s.branch_id AND c.price_cents = s.price_cents AND c.currency = s.currency GROUP BY 1"""
)
def expected_vs_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return R.expected_vs_current(t.snapshots, L.latest_by(t.snapshots, ["store_product_id", "branch_id"]), ["store_product_id", "branch_id", "price", "currency"])


@query(
    """SELECT store, CAST(sum(cents * quantity) AS BIGINT) AS total_cents, count(*) AS covered FROM (SELECT normalized_name AS item, l_suppkey AS store, min(price_cents) AS cents FROM latest_prices GROUP BY ALL)
JOIN (SELECT DISTINCT normalized_name AS item, 1 + length(normalized_name) % 3 AS quantity FROM products) USING (item) GROUP BY store"""
)
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    cart = t.products.select(F.col("normalized_name").alias("item")).distinct().withColumn("quantity", 1 + F.length("item") % 3)
    offers = C.latest_prices(t, AS_OF).select(F.col("normalized_name").alias("item"), F.col("store_id").alias("store"), "price")
    return P.store_totals(offers, cart)


@query(
    """, cart AS (SELECT DISTINCT normalized_name AS item, 1 + length(normalized_name) % 3 AS quantity FROM products),
o AS (SELECT l.normalized_name AS item, l_suppkey AS merchant, branch_id AS branch, min(price_cents) AS cents FROM (SELECT s.*, p.normalized_name FROM snapshots s JOIN products p ON p.id = s.l_partkey) l WHERE available AND price_cents > 0 AND currency = 'MXN' GROUP BY ALL)
SELECT merchant, coalesce(branch, -1) AS branch, CAST(sum(cents * quantity) AS BIGINT) AS subtotal_cents, count(*) AS items, (SELECT count(*) FROM cart) AS expected, count(*) = (SELECT count(*) FROM cart) AS complete FROM o JOIN cart USING (item) GROUP BY merchant, branch"""
)
def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    cart = t.products.select(F.col("normalized_name").alias("item")).distinct().withColumn("quantity", 1 + F.length("item") % 3)
    listed = t.listings.select(F.col("id").alias("store_product_id"), "store_id", "product_id").join(t.products.select(F.col("id").alias("product_id"), "normalized_name"), "product_id")
    offers = t.snapshots.join(listed, "store_product_id").select(F.col("id").alias("offer_id"), F.col("normalized_name").alias("item"), F.col("store_id").alias("merchant"), F.col("branch_id").alias("branch"), "price", "available", "currency")
    return P.baskets(offers, cart).withColumn("branch", F.coalesce("branch", F.lit(-1)))


@query(
    f"""SELECT group_key, best_cents, worst_cents, stores, prices, newest FROM (SELECT normalized_name AS group_key, arg_min(price_cents, (captured_at_neg, price_cents, store_slug, store_product_id)) AS best_cents, max(price_cents) AS worst_cents,
count(DISTINCT store_slug) AS stores, count(*) AS prices, max(captured_at) AS newest FROM (SELECT *, -epoch_us(captured_at) AS captured_at_neg {ONLINE}) GROUP BY 1)""",
    WIDE,
)
def comparison_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = C.online_offers(tables(spark, sf_dir), AS_OF, days=WIDE).withColumn("group_key", F.col("normalized_name")).withColumn("offer_id", F.col("store_product_id"))
    g = P.group_offers(offers, "fresh_desc")
    return g.select("group_key", (F.col("best") * 100).cast("long").alias("best_cents"), (F.col("worst") * 100).cast("long").alias("worst_cents"), "stores", "prices", "newest")


@query(f"SELECT normalized_name AS group_key, store_product_id, price_cents, row_number() OVER (PARTITION BY normalized_name ORDER BY price_cents, store_slug, store_product_id) AS place {ONLINE} QUALIFY place <= 4", WIDE)
def cheapest_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = C.online_offers(tables(spark, sf_dir), AS_OF, days=WIDE).withColumn("group_key", F.col("normalized_name")).withColumn("offer_id", F.col("store_product_id"))
    return price_cents(P.cheapest_in_groups(offers).select("group_key", "store_product_id", "price", "place"))


@query(
    f""", page AS (SELECT * {ONLINE} ORDER BY price_cents, product_name, store_slug, store_product_id LIMIT 100)
SELECT product_name, store_slug, price_cents, min(price_cents) OVER (PARTITION BY normalized_name) AS best_price_cents, dense_rank() OVER (PARTITION BY normalized_name ORDER BY price_cents) AS price_rank FROM page""",
    WIDE,
)
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = C.online_prices(tables(spark, sf_dir), AS_OF, days=WIDE)
    return price_cents(P.rank_page(page).select("product_name", "store_slug", "price", "best_price", "price_rank"))


@query("SELECT id, category, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS turn FROM products) ORDER BY turn, category LIMIT 200")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.round_robin(tables(spark, sf_dir).products, "category", [F.col("id").asc()], 200).select("id", "category", F.col("turn").cast("long").alias("turn"))


@query(
    r"""SELECT c_custkey, code, CASE WHEN NOT regexp_matches(code, '^0+$') AND (10 - list_sum(list_transform(range(1, 14), lambda i: CAST(substr(lpad(code, 14, '0'), i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10
  = CAST(substr(lpad(code, 14, '0'), 14, 1) AS INTEGER) THEN lpad(code, 14, '0') END AS gtin FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), CASE c_custkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 13 END, '0') AS code FROM customer)""",
    mapped=False,
)
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    width = F.when(key % 3 == 0, 8).when(key % 3 == 1, 12).otherwise(13)
    c = load(spark, sf_dir, "customer").select("c_custkey", F.lpad((key * 7919 % 100_000_000).cast("string"), width, F.lit("0")).alias("code"))
    return c.withColumn("gtin", S.canonical_gtin(F.col("code")))


@query("SELECT n_nationkey, s_suppkey, md5(concat_ws('|', 'src', CASE WHEN n_nationkey % 2 = 0 THEN n_name END, lower(s_name), lower(n_name))) AS branch_key FROM nation JOIN supplier ON s_nationkey = n_nationkey", mapped=False)
def branch_md5_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("n_nationkey", "s_suppkey", S.branch_key(F.lit("src"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("s_name"), F.col("n_name")).alias("branch_key"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object FROM events", mapped=False)
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", S.json_text(F.col("props"), "k").try_cast("long").alias("k"), (S.json_kind(F.col("props")) == "object").alias("is_object"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(translate(lower(p_name || ' ' || p_brand), 'áàäâãåéèëêíìïîóòöôõúùüûñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', ' ', 'g')) AS name,
replace(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug FROM part""",
    mapped=False,
)
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.normalize_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"), T.slug(F.col("p_brand")).alias("slug"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN 6 ELSE 1 END AS pack_count, CASE p_partkey % 5 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size WHEN 2 THEN p_size * 1000 WHEN 3 THEN p_size ELSE 0 END AS quantity,
CASE p_partkey % 5 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'g' WHEN 3 THEN 'ml' END AS unit FROM part""",
    mapped=False,
)
def presentation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations as shops write them, made from the part's size: litres, grams, kilos, a pack of six, and one without a measure."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(size, F.lit(" Litros"))).when(k == 1, F.concat(F.lit("Bolsa "), size, F.lit("gr"))).when(k == 2, F.concat(size, F.lit(" kg"))).when(k == 3, F.concat(F.lit("6 x "), size, F.lit(" ml"))).otherwise(F.concat(F.lit("caja grande "), size))
    p = T.parse_presentation(F.col("text"))
    out = load(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumn("p", p)
    return out.select("p_partkey", F.coalesce("p.pack_count", F.lit(1)).alias("pack_count"), F.coalesce(F.col("p.quantity").cast("int"), F.lit(0)).alias("quantity"), "p.unit")


@query(
    """SELECT event_id, greatest(0, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')) AS calendar_days, CAST(greatest(0, floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000)) AS INTEGER) AS elapsed_days,
strftime(ts, 'Capturado %Y-%m-%d %H:%M UTC') AS label FROM events""",
    mapped=False,
)
def observation_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return load(spark, sf_dir, "events").select("event_id", S.days_old_calendar(ts, as_of).alias("calendar_days"), S.days_old_elapsed(ts, as_of).alias("elapsed_days"), S.capture_label(ts).alias("label"))


@query(
    """SELECT page_id, u.unnest AS link, u.pos AS position FROM pages, LATERAL (SELECT unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS unnest, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) AS pos) u
QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY position) = 1""",
    mapped=False,
)
def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarifa.sources.web import links

    return links(load(spark, sf_dir, "pages"), r'<a href="(/[^"]*)"')


# The rules over the stored texts: packs of a number before x or de, measures in g and ml, codes with their check digit.
_OFFERS = r"""o AS (SELECT p_partkey AS id, 'r' || p_partkey % 3 AS retailer, CASE WHEN p_partkey % 4 > 0 THEN 'x' || p_size END AS external, p_brand AS brand,
  CASE WHEN p_partkey % 3 = 0 THEN code ELSE NULL END AS gtin, CASE WHEN p_partkey % 7 = 0 THEN '12345678' WHEN p_partkey % 15 = 0 THEN '96385074' END AS ean, p_name || ' ' || measure AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE measure END AS presentation
  FROM (SELECT *, p_size % 4 || '000000' || (10 - p_size % 4 * 3 % 10) % 10 AS code,
    CASE p_partkey % 6 WHEN 0 THEN p_size % 3 + 1 || ' kg' WHEN 1 THEN (p_size % 3 + 1) * 1000 || ' g' WHEN 2 THEN p_size % 3 + 1 || 'L' WHEN 3 THEN '2 x ' || p_size % 3 + 1 || ' kg' WHEN 4 THEN p_size % 3 + 1 || '.0 kg' ELSE 'a granel' END AS measure FROM part)),
m AS (SELECT *, coalesce(presentation, name) AS t, list_filter([gtin, ean], lambda c: c IS NOT NULL) AS codes FROM o),
n AS (SELECT *, regexp_extract(t, '([0-9]+) x ', 1) AS packs, regexp_extract(t, '([0-9.]+) ?(kg|g|L)$', 1) AS amount, regexp_extract(t, '([0-9.]+) ?(kg|g|L)$', 2) AS unit,
  list_distinct(list_filter(codes, lambda c: (substr(c, 1, 1)::INT * 3 + substr(c, 2, 1)::INT + substr(c, 3, 1)::INT * 3 + substr(c, 4, 1)::INT + substr(c, 5, 1)::INT * 3 + substr(c, 6, 1)::INT + substr(c, 7, 1)::INT * 3 + substr(c, 8, 1)::INT) % 10 = 0 AND c <> '00000000')) AS valid FROM m),
s AS (SELECT id, retailer, external, brand, CASE WHEN len(valid) = 1 THEN valid[1] END AS gtin, len(valid) > 1 OR len(list_filter(codes, lambda c: NOT list_contains(valid, c))) > 0 AS fault,
  CASE WHEN amount <> '' THEN (CASE WHEN packs = '' THEN '1' ELSE packs END) || '|' || CAST(amount AS DOUBLE) * CASE unit WHEN 'g' THEN 1 ELSE 1000 END || CASE unit WHEN 'L' THEN 'ml' ELSE 'g' END END AS pack,
  nullif(trim(regexp_replace(name, '([0-9]+ x )?[0-9.]+ ?(kg|g|L)$', '')), '') AS variant FROM n),
p AS (SELECT a.id AS l, b.id AS r, CASE WHEN a.gtin IS NOT NULL AND b.gtin IS NOT NULL THEN CASE WHEN a.gtin = b.gtin THEN 'gtin' END WHEN a.fault OR b.fault THEN NULL WHEN a.retailer = b.retailer AND a.external = b.external THEN 'retailer_external_id'
  WHEN a.brand = b.brand AND a.variant = b.variant AND a.pack = b.pack THEN 'brand_variant_presentation' END AS rule FROM s a JOIN s b ON a.id <> b.id AND NOT coalesce(a.pack <> b.pack, false)
  AND (a.gtin = b.gtin OR a.external = b.external AND a.retailer = b.retailer OR a.variant = b.variant))"""


def _matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as offers: some with one of four GTINs, a wrong one or a second one, of three retailers, with measures in several spellings."""
    c, key = F.col, F.col("p_partkey")
    digit, size = (c("p_size") % 4), (c("p_size") % 3 + 1)
    code = F.concat(digit.cast("string"), F.lit("000000"), ((10 - digit * 3 % 10) % 10).cast("string"))
    spelled = [F.concat(size, F.lit(" kg")), F.concat(size * 1000, F.lit(" g")), F.concat(size, F.lit("L")), F.concat(F.lit("2 x "), size, F.lit(" kg")), F.concat(size, F.lit(".0 kg")), F.lit("a granel")]
    measure = F.coalesce(*[F.when(key % 6 == i, x) for i, x in enumerate(spelled)])
    p = load(spark, sf_dir, "part").withColumn("measure", measure)
    return p.select(
        key.alias("offer_id"), F.concat(F.lit("r"), key % 3).alias("retailer"), F.when(key % 4 > 0, F.concat(F.lit("x"), "p_size")).alias("external_id"), F.when(key % 3 == 0, code).alias("gtin"),
        F.when(key % 7 == 0, "12345678").when(key % 15 == 0, "96385074").alias("ean"), c("p_brand").alias("brand"), F.concat_ws(" ", "p_name", "measure").alias("name"), F.when(key % 5 > 0, c("measure")).alias("presentation"),
    )


@query(f"WITH {_OFFERS} SELECT id AS offer_id, count(*) FILTER (rule = 'gtin') AS gtin_links, count(*) FILTER (rule = 'retailer_external_id') AS external_links, count(*) FILTER (rule = 'brand_variant_presentation') AS variant_links FROM s LEFT JOIN p ON l = id GROUP BY id", mapped=False)
def matched_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other parts each part matches by each of the rules."""
    return M.offer_links(_matchable(spark, sf_dir))


@query(f"WITH {_OFFERS} SELECT l AS left_id, r AS right_id, rule FROM p WHERE rule IS NOT NULL AND l % 100 = 0", mapped=False)
def matched_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of parts, every hundredth, against all others."""
    offers = _matchable(spark, sf_dir)
    return M.match_offers(offers.filter("offer_id % 100 = 0"), offers).filter("left_id <> right_id")


@query(
    """SELECT p_partkey AS key, CAST(coalesce(p_size, 0) + coalesce(n, 0) AS BIGINT) AS quantity, coalesce(p_name, 'item') AS label FROM (SELECT p_partkey, p_size, p_name FROM part WHERE p_size > 25) a
FULL JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) b USING (p_partkey)""",
    mapped=False,
)
def merged_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = load(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("quantity"), F.col("p_name").alias("label"))
    local = load(spark, sf_dir, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("quantity")).withColumn("label", F.lit("item"))
    return P.merge_carts(saved, local)


@query(
    """, old AS (SELECT id, name, category FROM products WHERE id % 3 <> 0), new AS (SELECT id, upper(name) AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE 'renewed' END AS category FROM products WHERE id % 2 = 0)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NOT NULL THEN new.name ELSE old.name END AS name, coalesce(new.category, old.category) AS category FROM old FULL JOIN new ON old.id = new.id"""
)
def merged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir).products.select("id", "name", "category")
    new = p.filter("id % 2 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 4 != 0, "renewed").alias("category"))
    return L.merge_by(p.filter("id % 3 <> 0"), new, ["id"], {"name": "new", "category": "coalesce"})


@query("SELECT id FROM snapshots s WHERE s.branch_id IS NULL AND NOT EXISTS (SELECT 1 FROM snapshots o WHERE o.l_partkey % 2 = 0 AND o.store_product_id = s.store_product_id AND o.captured_at = s.captured_at AND o.branch_id IS NOT DISTINCT FROM s.branch_id)")
def inserted_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir).snapshots
    have = s.filter("store_product_id div 1000000 % 2 = 0")
    return L.insert_new(have, s.filter("branch_id IS NULL"), ["store_product_id", "branch_id", "captured_at"]).select("id")


@query(
    """SELECT product_name, count(*) AS offers, min(price_cents) AS best_price_cents FROM (SELECT *, dense_rank() OVER (PARTITION BY normalized_name ORDER BY price_cents) AS r FROM current_catalog WHERE available AND normalized_name ILIKE '%e%') WHERE r = 1 GROUP BY 1""",
    WIDE,
)
def cheapest_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the cheapest current offers by product name."""
    rows = C.current_catalog(tables(spark, sf_dir), AS_OF, WIDE).filter(F.col("available") & S.matches_search("e", F.col("normalized_name")))
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("normalized_name").orderBy("price"))).filter("r = 1")
    return price_cents(ranked.groupBy("product_name").agg(F.count("*").alias("offers"), F.min("price").alias("best_price")))


@query(
    """SELECT event_id, CASE WHEN seen IS NOT NULL AND ts > seen AND event_type = last THEN 'unchanged' WHEN seen IS NULL OR ts > seen THEN 'insert' WHEN ts < seen THEN 'late' WHEN event_type = last THEN 'replay' ELSE 'conflict' END AS action
FROM (SELECT *, max(ts) OVER w AS seen, arg_max(event_type, ts) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    mapped=False,
)
def publish_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of their user in order of arrival: what the publisher does with each."""
    return U.decided(load(spark, sf_dir, "events"), key="user_id", order="event_id", time="ts", state=("event_type",)).select("event_id", "action")


def _part_replies(spark: SparkSession, sf_dir: str, *products: Column) -> DataFrame:
    """A store's reply for each part: a JSON array with the products given."""
    body = F.to_json(F.array(*products), {"ignoreNullFields": "false"})
    return load(spark, sf_dir, "part").select(F.concat(F.lit("https://parts.mx/api/"), "p_partkey").alias("url"), F.lit(AS_OF).alias("observed_at"), body.alias("body"))


def _feed_outcome(found: DataFrame) -> DataFrame:
    """Good products with their price in cents; of the others the reason alone."""
    good = F.col("reject_reason").isNull()
    return found.select(F.col("external_reference").try_cast("long").alias("part"), F.when(good, F.col("presentation")).alias("presentation"), F.when(good, S.cents(F.col("price"))).alias("price_cents"), F.when(good, F.col("available")).alias("available"), "reject_reason")


@query(
    """SELECT p_partkey AS part, CASE WHEN r IS NULL THEN p_size || ' kg' END AS presentation, CASE WHEN r IS NULL THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents, CASE WHEN r IS NULL THEN p_size % 3 <> 0 END AS available, r AS reject_reason
FROM (SELECT *, CASE WHEN p_type = 'PROMO' THEN 'combined_pack' WHEN p_size % 5 = 0 THEN 'weighted_or_multiplied_unit' WHEN p_partkey % 7 = 0 THEN 'promotion' WHEN p_partkey % 11 = 0 THEN 'availability_contradicts_quantity' END AS r FROM part)""",
    mapped=False,
)
def search_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as search replies: promotions, weighted units and contradicting quantities are rejected."""
    price, quantity = F.round("p_retailprice", 2), F.col("p_size") % 3
    offer = F.struct(price.alias("Price"), F.when(F.col("p_partkey") % 7 == 0, price + 5).otherwise(price).alias("ListPrice"), quantity.alias("AvailableQuantity"), ((quantity > 0) != (F.col("p_partkey") % 11 == 0)).alias("IsAvailable"))
    item = F.struct(F.col("p_partkey").cast("string").alias("itemId"), F.when(F.col("p_size") % 5 == 0, "kg").otherwise("un").alias("measurementUnit"), F.array(F.struct(F.lit("1").alias("sellerId"), offer.alias("commertialOffer"))).alias("sellers"))
    name = F.concat("p_name", F.lit(" "), "p_size", F.lit(" kg"), F.when(F.col("p_type") == "PROMO", " + regalo").otherwise(""))
    product = F.struct(name.alias("productName"), F.concat(F.lit("https://parts.mx/p/"), "p_partkey").alias("link"), F.array(F.concat(F.lit("/"), "p_brand", F.lit("/"))).alias("categories"), F.array(item).alias("items"))
    return _feed_outcome(feeds.search_results(_part_replies(spark, sf_dir, product), "parts.mx", AS_OF, "MXN"))


@query(
    """SELECT p_partkey AS part, CASE WHEN r IS NULL THEN p_size || ' kg' END AS presentation, CASE WHEN r IS NULL THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents, CASE WHEN r IS NULL THEN p_size % 3 <> 0 END AS available, r AS reject_reason
FROM (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'currency_not_declared' WHEN p_type = 'STANDARD' THEN 'variable_unit' WHEN p_partkey % 7 = 0 THEN 'promotion' WHEN p_brand = 'Brand#5' THEN 'weighted_unit' END AS r FROM part)""",
    mapped=False,
)
def store_api_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as replies of a store API: other minor units, variable products, promotions and fresh goods are rejected."""
    no, minor = F.lit(False), S.cents(F.col("p_retailprice")).cast("string")
    prices = F.struct(F.lit("MXN").alias("currency_code"), F.when(F.col("p_partkey") % 13 == 0, 3).otherwise(2).alias("currency_minor_unit"), minor.alias("price"), F.when(F.col("p_partkey") % 7 == 0, F.concat(minor, F.lit("9"))).otherwise(minor).alias("regular_price"))
    category = F.when(F.col("p_brand") == "Brand#5", "Frutas").otherwise(F.col("p_brand"))
    product = F.struct(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_size", F.lit(" kilogramos")).alias("name"), F.when(F.col("p_type") == "STANDARD", "variable").otherwise("simple").alias("type"),
        no.alias("has_options"), no.alias("is_password_protected"), (F.col("p_size") % 3 != 0).alias("is_in_stock"), no.alias("is_on_backorder"), no.alias("on_sale"),
        F.concat(F.lit("https://parts.mx/p/"), "p_partkey").alias("permalink"), F.array(F.struct(category.alias("name"))).alias("categories"), prices.alias("prices"),
    )
    return _feed_outcome(feeds.store_api_products(_part_replies(spark, sf_dir, product), "parts.mx", AS_OF))


@query(
    """WITH b AS (SELECT p_partkey * 2 + k AS position, p_partkey, k, p_partkey || CASE WHEN k = 1 AND p_partkey % 5 = 0 THEN 'x' ELSE '' END AS ref,
  CASE WHEN k = 0 AND p_size % 7 = 0 THEN 'weighted_unit' WHEN k = 1 AND p_partkey % 4 = 0 THEN 'presentation_or_store_changed' END AS own FROM part CROSS JOIN (VALUES (0), (1)) t(k)),
w AS (SELECT *, coalesce(min(ref) FILTER (own IS NULL) OVER (PARTITION BY p_partkey) <> max(ref) FILTER (own IS NULL) OVER (PARTITION BY p_partkey), false) AS refs, row_number() OVER (PARTITION BY p_partkey, own IS NULL ORDER BY k DESC) AS r FROM b),
h AS (SELECT *, coalesce(own, CASE WHEN refs THEN 'several_references_of_identity' WHEN r = 1 AND p_partkey % 6 = 0 THEN 'conflicting_presentations' END) AS hold_reason FROM w)
SELECT position, hold_reason, CASE WHEN hold_reason IS NOT NULL THEN 'held' WHEN r = 1 THEN 'kept' ELSE 'superseded' END AS outcome FROM h""",
    mapped=False,
)
def batch_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of each part against known listings of the even ones, some of which have a namesake in another size."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_partkey").alias("product_name"))
    key, k, size = F.col("p_partkey"), F.col("k"), F.col("p_size").cast("string")
    shop = (F.lit("s").alias("source"), F.lit("parts").alias("store_slug"))
    listed = part.filter("p_partkey % 2 = 0").select(*shop, "product_name", F.col("product_name").alias("normalized_name"), F.lit(None).cast("string").alias("image_url"), F.inline(F.array(
        F.struct(F.concat(F.lit("u/"), key).alias("store_product_url"), F.concat(size, F.lit(" kg")).alias("presentation"), F.lit(True).alias("_there")),
        F.struct(F.concat(F.lit("v/"), key).alias("store_product_url"), F.lit("9999 kg").alias("presentation"), (key % 6 == 0).alias("_there")),
    ))).filter("_there").drop("_there")
    twice = part.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    other = (F.col("p_size") + F.when((k == 1) & (key % 4 == 0), 1).otherwise(0)).cast("string")
    batch = twice.select(
        (key * 2 + k).alias("position"), *shop, F.concat(F.lit("u/"), key).alias("store_product_url"), "product_name", F.col("product_name").alias("normalized_name"), F.concat(other, F.lit(" kilos")).alias("presentation"),
        F.concat(key.cast("string"), F.when((k == 1) & (key % 5 == 0), "x").otherwise("")).alias("external_reference"), F.lit(None).cast("string").alias("image_url"), k.alias("captured_at"), ((k == 0) & (F.col("p_size") % 7 == 0)).alias("weighted"),
    )
    return reconcile.reconciled(batch, listed).select("position", "outcome", "hold_reason")
