"""The catalog tables as projections of the order tables (part, supplier, nation, lineitem), and the same as SQL text.

Products are parts, stores are suppliers, a store has one branch at its nation's place, a listing is a part that a
store sells, and a line item is a snapshot. Prices are whole cents by integer division, so every engine agrees on them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.plans.batch import settled
from tarifa.plans.catalog import Tables

AS_OF = datetime(2001, 11, 5)
HERE = (19.43, -99.13)
#: Rows of a table that a task is dealt where each of them is made into a page or record.
DEALT_ROWS = 20_000

SQL = """
WITH stores AS (SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug, 'MX' AS country, s_acctbal > -900 AS enabled, s_nationkey FROM supplier),
products AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS normalized_name, p_type AS category, p_brand AS brand, CAST(p_size AS INTEGER) AS pack_count FROM part),
branches AS (
  SELECT n_nationkey AS id, s_suppkey AS store_id, n_name AS name, n_name || ' 1' AS address, n_name AS municipality, 19.43 + (n_nationkey % 5 - 2) * 0.2 AS latitude,
         -99.13 + (floor(n_nationkey / 5.0) - 2) * 0.2 AS longitude, CASE n_nationkey % 7 WHEN 0 THEN 'review' WHEN 1 THEN 'manual' ELSE 'geocoded' END AS geocoding_status,
         'src' || CAST(n_nationkey % 3 AS VARCHAR) AS source, n_regionkey AS city_code
  FROM nation JOIN supplier ON s_nationkey = n_nationkey),
snapshots AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS id,
         l_partkey * 1000000 + l_suppkey AS store_product_id, CASE WHEN l_linestatus = 'O' THEN NULL ELSE s_nationkey END AS branch_id, CASE WHEN l_linestatus = 'O' THEN 'online' ELSE 'branch_local' END AS price_scope,
         CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS price_cents, CASE WHEN l_linenumber = 7 AND l_discount > 0.09 THEN 'USD' ELSE 'MXN' END AS currency,
         l_returnflag <> 'R' AS available, 'src' || CAST(l_suppkey % 4 AS VARCHAR) AS source, l_shipdate AS captured_at, 'https://shop.example/p/' || CAST(l_partkey AS VARCHAR) AS external_reference,
         l_linenumber = 6 AND l_tax > 0.07 AS is_synthetic, CASE WHEN l_linenumber = 5 AND l_tax > 0.07 THEN 'rejected' END AS review_status, l_partkey, l_suppkey
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
listings AS (SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS id, l_suppkey AS store_id, l_partkey AS product_id, 'src' || CAST(l_suppkey % 4 AS VARCHAR) AS source FROM lineitem),
latest AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY store_product_id, branch_id ORDER BY captured_at DESC, id DESC) = 1),
current_catalog AS (
  SELECT l.*, p.name AS product_name, p.normalized_name, p.category, s.name AS store_name, s.slug AS store_slug, b.name AS branch_name, b.latitude, b.longitude,
         CAST(floor(epoch(TIMESTAMP '2001-11-05' - l.captured_at) / 86400) AS INTEGER) AS days_old
  FROM latest l JOIN products p ON p.id = l.l_partkey JOIN stores s ON s.id = l.l_suppkey LEFT JOIN branches b ON b.id = l.branch_id AND b.store_id = l.l_suppkey
  WHERE l.captured_at > TIMESTAMP '2001-11-05' - INTERVAL (DAYS) DAY AND l.captured_at <= TIMESTAMP '2001-11-05' + INTERVAL 5 MINUTE AND l.price_cents > 0 AND l.currency = 'MXN'
    AND s.enabled AND NOT l.is_synthetic AND coalesce(l.review_status, 'accepted') = 'accepted'
    AND (l.branch_id IS NULL OR (b.geocoding_status IN ('manual', 'geocoded') AND b.latitude BETWEEN 14 AND 33.5 AND b.longitude BETWEEN -119 AND -86))),
latest_prices AS (
  SELECT l.*, p.id AS product_id, p.name AS product_name, p.normalized_name, p.category, s.id AS store_id, s.name AS store_name, s.slug AS store_slug, b.latitude, b.longitude,
         'https://img.example/' || CAST(l_partkey AS VARCHAR) AS image_url,
         greatest(0, date_diff('day', CAST(l.captured_at AS DATE), DATE '2001-11-05')) AS days_old,
         CASE WHEN date_diff('day', CAST(l.captured_at AS DATE), DATE '2001-11-05') < 7 THEN 'fresh' WHEN date_diff('day', CAST(l.captured_at AS DATE), DATE '2001-11-05') <= 21 THEN 'stale' ELSE 'old' END AS freshness
  FROM latest l JOIN products p ON p.id = l.l_partkey JOIN stores s ON s.id = l.l_suppkey JOIN branches b ON b.id = l.branch_id AND b.store_id = l.l_suppkey
  WHERE s.enabled AND b.geocoding_status IN ('manual', 'geocoded'))
"""


def sql(query: str, days: int = 7) -> str:
    return SQL.replace("DAYS", str(days)) + query


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over as many tasks as their number asks for: a table of narrow rows is a file or two, so one task would make all the pages of it.

    They are settled, as Spark moves a filter on what is made of a row below the dealing.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // DEALT_ROWS)
    return settled(rows.repartition(tasks, key))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    supplier, nation, part, lineitem = (load(spark, sf_dir, n) for n in ("supplier", "nation", "part", "lineitem"))
    stores = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), F.lit("MX").alias("country"), (F.col("s_acctbal") > -900).alias("enabled"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("gtin", "string"), ("variant_label", "string"), ("net_quantity", "decimal(18,6)"), ("unit", "string"), ("canonical_variant_key", "string"))]
    products = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_size").cast("int").alias("pack_count"), *none)
    n = F.col("n_nationkey")
    branches = nation.join(supplier, nation["n_nationkey"] == supplier["s_nationkey"]).select(
        n.alias("id"), F.col("s_suppkey").alias("store_id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(" 1")).alias("address"), F.col("n_name").alias("municipality"),
        (19.43 + (n % 5 - 2) * 0.2).alias("latitude"), (-99.13 + (F.floor(n / 5.0) - 2) * 0.2).alias("longitude"),
        F.when(n % 7 == 0, "review").when(n % 7 == 1, "manual").otherwise("geocoded").alias("geocoding_status"),
        F.concat(F.lit("src"), (n % 3).cast("string")).alias("source"), F.col("n_regionkey").alias("city_code"),
    )
    line = lineitem.join(supplier.select("s_suppkey", "s_nationkey"), lineitem["l_suppkey"] == supplier["s_suppkey"])
    text = lambda c, w: F.lpad(F.col(c).cast("string"), w, "0")
    online = F.col("l_linestatus") == "O"
    source = F.concat(F.lit("src"), (F.col("l_suppkey") % 4).cast("string")).alias("source")
    listing = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    payload = F.to_json(
        F.struct(
            ((F.col("l_linenumber") == 6) & (F.col("l_tax") > 0.07)).alias("is_synthetic"),
            F.when((F.col("l_linenumber") == 5) & (F.col("l_tax") > 0.07), "rejected").alias("review_status"),
        )
    )
    snapshots = line.select(
        F.concat(text("l_orderkey", 12), text("l_linenumber", 3), text("l_partkey", 10), text("l_suppkey", 10)).alias("id"), listing.alias("store_product_id"),
        F.when(~online, F.col("s_nationkey")).alias("branch_id"), F.when(online, "online").otherwise("branch_local").alias("price_scope"),
        (F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)") / F.lit(100)).cast("decimal(12,2)").alias("price"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") > 0.09), "USD").otherwise("MXN").alias("currency"), (F.col("l_returnflag") != "R").alias("available"), source,
        F.col("l_shipdate").cast("timestamp").alias("captured_at"), F.concat(F.lit("https://shop.example/p/"), F.col("l_partkey").cast("string")).alias("external_reference"), payload.alias("raw_payload"),
    )
    listings = lineitem.select("l_partkey", "l_suppkey").distinct().select(
        listing.alias("id"), F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), F.concat(F.lit("https://store.example/"), F.col("l_partkey").cast("string")).alias("store_product_url"),
        F.concat(F.lit("https://img.example/"), F.col("l_partkey").cast("string")).alias("image_url"), F.lit("1 pieza").alias("presentation"), source,
    )
    return Tables(stores, products, listings, branches, snapshots)


def price_cents(df: DataFrame) -> DataFrame:
    """Decimal prices as whole cents."""
    for c in ("price", "best_price"):
        if c in df.columns:
            df = df.withColumn(f"{c}_cents", (F.col(c) * 100).cast("long")).drop(c)
    return df
