"""The catalog's own rules on small fixtures with a fixed clock."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.functions import text as T
from tarifa.operators import latest as L
from tarifa.plans import catalog as C
from tarifa.plans import compare as P
from tarifa.plans import ingest, publish
from tarifa.sources import ndjson, products, web
from tarifa.streaming import observations

NOW = datetime(2026, 6, 28, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def tables(spark):
    """104 products, 101 of them food, online at 10; the last three have a newest row that hides them; product 1 also at a branch."""
    at = NOW - timedelta(hours=1)
    snaps = []
    for i in range(1, 105):
        bad = {102: {"is_synthetic": True}}.get(i, {})
        payload = json.dumps({"source_url": f"https://s.mx/{i}", **bad})
        snaps.append((f"a{i:04d}", f"l{i:04d}", None, "online", 10, "MXN", True, "src", NOW - timedelta(days=8) if i == 103 else at, None, payload))
        if i == 104:
            snaps.append(("b0104", "l0104", None, "online", 10, "MXN", False, "src", at + timedelta(minutes=5), None, payload))
    snaps.append(("c0001", "l0001", "b1", "branch_local", 8, "MXN", True, "src", at, None, '{"source_url": "https://s.mx/b1"}'))
    snapshots = spark.createDataFrame(snaps, "id string, store_product_id string, branch_id string, price_scope string, price int, currency string, available boolean, source string, captured_at timestamp, external_reference string, raw_payload string").withColumn("price", F.col("price").cast("decimal(10,2)"))
    empty = ", ".join(f"{c} string" for c in C.PRODUCT_DETAILS)
    goods = spark.createDataFrame([(f"p{i:04d}", f"Fixture {i}", f"fixture {i}", "Food" if i <= 101 else "Other", *[None] * 7) for i in range(1, 105)], f"id string, name string, normalized_name string, category string, {empty}")
    listings = spark.createDataFrame([(f"l{i:04d}", "s1", f"p{i:04d}", None, None, "1 l") for i in range(1, 105)], "id string, store_id string, product_id string, store_product_url string, image_url string, presentation string")
    stores = spark.createDataFrame([("s1", "Store 1", "store-1", "MX", True), ("s2", "Store 2", "store-2", "MX", True)], "id string, name string, slug string, country string, enabled boolean")
    branches = spark.createDataFrame([("b1", "s1", "Branch", "Street 1", "Town", 19.43, -99.13, "manual")], "id string, store_id string, name string, address string, municipality string, latitude double, longitude double, geocoding_status string")
    return C.Tables(stores, goods, listings, branches, snapshots)


def test_catalog_contract(tables):
    pages = [[r.product_name for r in C.online_prices(tables, NOW, page=k).collect()] for k in (1, 2, 3)]
    assert [len(p) for p in pages] == [100, 1, 0] and not set(pages[0]) & set(pages[1])
    assert C.online_prices(tables, NOW, search=" Fixture 101 ").count() == 1
    assert C.online_prices(tables, NOW, category="Other").count() == 0
    assert C.online_prices(tables, NOW, search="Fixture 104").count() == 0
    assert C.nearby_prices(tables, NOW, 19.43, -99.13).count() == 1 and C.nearby_prices(tables, NOW, 0, 0).count() == 0
    assert [tuple(r) for r in C.categories(tables, NOW).collect()] == [("Food", 101)]
    assert C.categories(tables, NOW, lat=19.43).count() == 0
    for bad in ({"limit": 0}, {"limit": 101}, {"page": 0}, {"page": 10_001}, {"limit": None}):
        with pytest.raises(ValueError, match="Invalid pagination"):
            C.online_prices(tables, NOW, **bad)


def test_scalars(spark):
    assert 3.5 < one(spark, S.distance_km(F.lit(19.4326), F.lit(-99.1332), F.lit(19.427), F.lit(-99.1677))) < 4.5
    assert one(spark, S.freshness(S.days_old_elapsed(F.lit(datetime(2026, 6, 5, 12)), datetime(2026, 6, 11, 12)))) == "fresh"
    assert one(spark, S.freshness(S.days_old_elapsed(F.lit(datetime(2026, 5, 20, 12)), datetime(2026, 6, 11, 12)))) == "old"
    assert one(spark, S.geocode_status(F.lit(0.9), 0.8)) == "geocoded" and one(spark, S.geocode_status(F.lit(0.65), 0.8)) == "review"
    assert tuple(one(spark, T.parse_variant(F.lit("Leche entera 1 litro")))) == ("leche entera", 1.0, "l", None, "leche entera|qty=1l")
    assert tuple(one(spark, T.parse_variant(F.lit("Papel higienico 4 rollos")))) == ("papel higienico", None, None, 4, "papel higienico|pack=4")
    assert one(spark, S.canonical_gtin(F.lit("7501055300075"))) in (None, "07501055300075")
    assert one(spark, S.canonical_gtin(F.lit("00000000"))) is None


# Compaction groups: values of one history each, and the offsets of rows that may go.
GROUPS = {1: ([10] * 5, [1, 2, 3]), 2: ([10, 10, 20, 20, 20, 10, 10], [3]), 3: ([(10, a) for a in "TTFFFT"], [3]), 12: ([1], []), 14: ([10, 10], []), 15: ([None] * 3, [1])}


def test_compaction_and_retention(spark):
    rows = [(f"{g}-{k}", g, None, "online", datetime(2026, 6, 1 + k, 12), str(v)) if v is not None else (f"{g}-{k}", g, None, "online", datetime(2026, 6, 1 + k, 12), None) for g, (vs, _) in GROUPS.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id string, store_product_id int, branch_id string, price_scope string, captured_at timestamp, state string")
    assert {r.id for r in L.compaction_candidates(df, ["state"]).collect()} == {f"{g}-{k}" for g, (_, ks) in GROUPS.items() for k in ks}
    old = L.retention_candidates(df, datetime(2026, 6, 3, 12) + timedelta(days=90)).collect()
    assert {r.id for r in old} == {f"{g}-{k}" for g, (vs, _) in GROUPS.items() for k in range(min(2, len(vs) - 1))}


VALID = {
    "source": "s", "store_brand": "S", "store_slug": "s", "source_product_name": "Leche", "normalized_name": "leche", "category": "c", "presentation": "1 l", "currency": "MXN", "captured_at": "2026-06-28T10:00:00Z",
    "observed_at": "2026-06-28T10:00:00Z", "source_url": "https://s.mx/1", "evidence_kind": "product_page", "store_product_url": "https://s.mx/1", "content_hash": "hash:00001", "external_reference": "r", "review_status": "accepted",
    "price": 26.0, "confidence_score": 0.9, "is_synthetic": False, "available": True, "image_url": None, "raw_payload": {},
}
BRANCH = {"price_scope": "branch_local", "branch_external_key": "k", "branch_name": "n", "branch_address": "a", "branch_municipality": "m", "branch_state": "s", "latitude": 19.4326, "longitude": -99.1332}


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []),
        (BRANCH, []),
        ({**BRANCH, "branch_external_key": None, "latitude": None, "longitude": -120}, ["missing_branch_external_key", "invalid_latitude", "invalid_longitude"]),
        ({"content_hash": None}, ["missing_content_hash"]),
        ({"price": "26"}, ["invalid_price"]),
        ({"currency": "usd"}, ["invalid_currency", "non_mxn"]),
        ({"price_scope": "online", "latitude": 19, "branch_name": "x"}, ["online_has_branch_data", "online_has_branch_data"]),
        ({"confidence_score": 0.5, "is_synthetic": "false", "available": 1}, ["invalid_confidence_score", "synthetic_record", "invalid_available"]),
        ({"observed_at": "2026-06-20T10:00:00Z"}, ["observation_not_current"]),
        ({"captured_at": "2026-06-28T10:00:00", "evidence_kind": "unknown"}, ["unknown_evidence", "invalid_captured_at"]),
        ({"raw_payload": [], "validation_errors": ["x"], "image_url": "ftp://x", "source_url": "nope"}, ["invalid_source_url", "invalid_image_url", "invalid_raw_payload", "upstream_validation_errors"]),
        ({"source": "home-depot-mx", **BRANCH}, ["invalid_home_depot_store_slug", "invalid_home_depot_branch_key"]),
    ],
)
def test_record_issues(spark, change, codes):
    df = spark.createDataFrame([(json.dumps({**VALID, **change}),)], "raw string")
    assert df.select(ingest.record_issues(F.col("raw"), NOW).alias("v")).first().v == codes


def test_preflight_of_a_file(spark, tmp_path):
    lines = [json.dumps(VALID), "", "invalid json", "[1]", json.dumps(VALID), json.dumps({**VALID, "price": -1})]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    read = ndjson.read_ndjson(spark, str(tmp_path / "a.ndjson"))
    assert [(r.line, r.error) for r in read.orderBy("line").collect()] == [(1, None), (3, "invalid_json"), (4, "not_json_object"), (5, None), (6, None)]
    checked = ingest.validated(read, NOW)
    assert tuple(ingest.preflight(checked).first()) == (5, 2, 1, 1, 3)
    assert [r.line for r in ingest.unique_records(checked).collect()] == [1]
    assert [tuple(r) for r in ingest.rejection_histogram(checked).collect()] == [("invalid_json", 1), ("invalid_price", 1), ("not_json_object", 1)]
    assert [tuple(r) for r in ingest.preflight_groups(checked).collect()] == [("s", "<missing>", "c", 3, 2, 1)]


def test_archive_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 10 if k % 2 else None) for k in range(25)], "id long, v string")
    ndjson.write_archive(df, str(tmp_path / "a"))
    back = ndjson.restore_archive(df.filter("id < 5"), str(tmp_path / "a"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sizes = ndjson.chunked(df.coalesce(1), max_rows=10).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [10, 10, 5]


STATE = ("price", "available", "source")
HISTORY = "store_product_id long, captured_at timestamp, last_seen_at timestamp, price int, available boolean, source string"
BATCH = "store_product_id long, position long, observed_at timestamp, price int, available boolean, source string"


def day(k):
    return datetime(2026, 6, k)


ROWS = [(1, 0, day(5), 10, True, "s"), (1, 1, day(6), 12, True, "s"), (1, 2, day(4), 9, True, "s"), (1, 3, day(6), 12, True, "s"), (1, 4, day(7), 12, True, "s"), (2, 5, day(2), 3, True, "s"), (2, 6, day(2), 4, True, "s"), (3, 7, None, 1, True, "s")]
ACTIONS = {0: "unchanged", 1: "insert", 2: "late", 3: "replay", 4: "unchanged", 5: "insert", 6: "conflict", 7: "late"}


def test_publishing(spark):
    history = spark.createDataFrame([(1, day(1), day(3), 10, True, "s")], HISTORY)
    batch = spark.createDataFrame(ROWS, BATCH)
    with pytest.raises(ValueError, match="Conflicting"):
        publish.publish(history, batch, state=STATE)
    after, found = publish.publish(history, batch, strict=False, state=STATE)
    assert {r.position: r.action for r in found.collect()} == ACTIONS
    rows = sorted(tuple(r)[:4] for r in after.collect())
    assert rows == [(1, day(1), day(5), 10), (1, day(6), day(7), 12), (2, day(2), day(2), 3)]
    again, found = publish.publish(after, batch.filter("position < 6"), state=STATE)
    assert not found.filter("action = 'insert'").count() and sorted(tuple(r)[:4] for r in again.collect()) == rows


def test_ties_keep_the_first_state(spark):
    rows = [(1, k, day(1), price, True, "s") for k, price in enumerate((10, 11, 10, 11))] + [(1, 4, day(2), 11, True, "s"), (1, 5, day(2), 10, True, "s"), (1, 6, day(3), 11, True, "s")]
    got = {r.position: r.action for r in publish.decided(spark.createDataFrame(rows, BATCH), state=STATE).collect()}
    assert got == {0: "insert", 1: "conflict", 2: "replay", 3: "conflict", 4: "insert", 5: "conflict", 6: "unchanged"}


def test_stream_decides_like_the_batch(spark, tmp_path):
    r, source, path = random.Random(3), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(r.randrange(4), k, day(1 + k // 8 + r.randrange(3)) if r.random() < 0.95 else None, r.choice([10, 11]), True, r.choice(["s", "t"])) for k in range(60)]
    for part in (rows[:20], rows[20:35], rows[35:]):
        spark.createDataFrame(part, BATCH).coalesce(1).write.mode("append").parquet(source)
        q = observations.publishing(spark.readStream.schema(BATCH).parquet(source), path, state=STATE).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.position: r.action for r in observations.decisions(spark, path).collect()}
    assert got == {r.position: r.action for r in publish.decided(spark.createDataFrame(rows, BATCH), state=STATE).collect()}
    assert {r.position for r in spark.read.parquet(f"{path}/rejected").collect()} == {k for k, a in got.items() if a == "conflict"}


def test_lines_are_numbered_in_files_of_many_blocks(spark, tmp_path):
    from pathlib import Path

    wanted = {}
    for name, n in (("a.json", 400), ("b.json", 90), ("c.json", 3)):
        lines = ["" if k % 17 == 3 else json.dumps({"f": name, "n": k + 1, "x": "y" * (k % 50)}) for k in range(n)]
        Path(tmp_path / name).write_text("\n".join(lines) + "\n")
        wanted[name] = {k + 1 for k in range(n) if k % 17 != 3}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        got = ndjson.read_ndjson(spark, str(tmp_path)).select("line", "file", F.get_json_object("raw", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.line == r.n for r in got)
    assert {name: {r.line for r in got if r.file.endswith(name)} for name in wanted} == wanted


def test_product_identity(spark):
    goods = spark.createDataFrame([("p1", "7501031311309", None, None, None, None), ("p2", None, "reviewed:a", 6, None, None), ("p3", None, None, None, None, None)], "id string, gtin string, canonical_variant_key string, pack_count int, net_quantity double, unit string")
    listings = spark.createDataFrame([("l1", "p3")], "id string, product_id string")
    batch = spark.createDataFrame(
        [(0, "07501031311309", None, None, None), (1, None, "reviewed:a", "l1", 6), (2, None, "reviewed:a", None, 4), (3, None, "automatic:b", "l1", None), (4, None, None, None, None)],
        "position int, gtin string, canonical_variant_key string, store_product_id string, pack_count int",
    ).withColumn("net_quantity", F.lit(None).cast("double")).withColumn("unit", F.lit(None).cast("string"))
    got = {r.position: (r.product_id, r.rule, r.conflict) for r in publish.resolved_products(batch, listings, goods).collect()}
    assert got == {0: ("p1", "gtin", False), 1: ("p2", "reviewed_key", False), 2: ("p2", "reviewed_key", True), 3: ("p3", "listing", False), 4: (None, "new", False)}


def page(**offer):
    data = {"@type": "Product", "name": "Leche &amp; caf&eacute; 6 x 1 l", "sku": "1", "offers": {"@type": "Offer", "price": "20.5", "priceCurrency": "MXN", "availability": "http://schema.org/InStock", **offer}}
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


def test_products_of_pages(spark):
    cases = [page(), page(priceCurrency="USD"), page(availability="x/OutOfStock"), page(price=0), page(priceValidUntil="2026-06-01"), page(priceValidUntil="2026-07-01"), page() + page(), "<p>none", None]
    df = spark.createDataFrame([(f"https://s.mx/{k}", h) for k, h in enumerate(cases)] + [("https://other.mx/", page())], "url string, html string")
    out = products.parsed_products(df, "s.mx", NOW)
    got = {r.url: r for r in out.collect()}
    reasons = [None, "invalid_price_or_name", "availability_not_confirmed", "invalid_price_or_name", "expired_offer", None, "expected_one_product", "expected_one_product", "expected_one_product"]
    assert [got[f"https://s.mx/{k}"].reject_reason for k in range(9)] == reasons and got["https://other.mx/"].reject_reason == "unexpected_origin"
    first = got["https://s.mx/0"]
    assert (first.product_name, first.normalized_name, first.presentation, first.category) == ("Leche & café 6 x 1 l", "leche & cafe 6 x 1 l", "6 x 1 l", "Otros")
    assert tuple(products.capture_report(out).first()) == (2, 8, 1, "partial")


def test_baskets(spark):
    offers = spark.createDataFrame([(1, "a", "m", "b1", 20.0, True, "MXN"), (2, "a", "m", "b1", 12.35, True, "MXN"), (3, "a", "m", "b2", 1.0, False, "MXN"), (4, "a", "m", None, float("nan"), True, "MXN"), (5, "a", "n", None, -1.0, True, "MXN"), (6, "a", "n", None, 5.0, True, "USD")], "offer_id int, item string, merchant string, branch string, price double, available boolean, currency string")
    cart = spark.createDataFrame([("a", 3)], "item string, quantity int")
    assert [(r.merchant, r.branch, r.subtotal_cents, r.complete) for r in P.baskets(offers, cart).collect()] == [("m", "b1", 3705, True)]


def test_sitemaps(spark):
    df = spark.createDataFrame([("s", "<loc> https://s.mx/a?x=1&amp;y=2 </loc><loc>https://s.mx/b-12</loc>")], "name string, xml string")
    assert [r.url for r in web.sitemap_locations(df).orderBy("position").collect()] == ["https://s.mx/a?x=1&y=2", "https://s.mx/b-12"]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "online_prices_page" in e.queries()


def test_entry_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tarifa", tmp_path / "tarifa", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / f).exists():
            shutil.copy(root / f, tmp_path / f)
    said = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'current_catalog' in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
