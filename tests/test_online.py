"""The publishing call: one record's way through it, order within a call, all errors, all or nothing; the batch publisher over stored tables."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarifa.plans import online
from tarifa.plans.stored_batch import StoredCatalog

NOW = datetime(2026, 6, 10, 12)
GTIN, OTHER = "7501031311309", "4006381333931"


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("src", "shop", ["shop.mx"], True, "active", "MX"), ("src", "gone", ["gone.mx"], True, "active", "MX")], "source string, store_slug string, hosts array<string>, publisher_enabled boolean, status string, country string")


def record(n=1, **changes):
    url = f"https://shop.mx/{n}"
    base = {
        "source": "src", "store_slug": "shop", "price_scope": "online", "currency": "MXN", "price": 10.5, "is_synthetic": False, "review_status": "accepted", "available": True, "product_name": f"Product {n}", "normalized_name": f"product {n}",
        "presentation": "1 l", "category": "food", "source_url": url, "store_product_url": url, "response_sha256": "a" * 64, "observed_at": "2026-06-10T10:00:00Z", "external_id": None,
    }
    if "url" in changes:
        changes["source_url"] = changes["store_product_url"] = changes.pop("url")
    return base | changes


def empty(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in online.TABLES.items()}
    return online.Catalog(**tables | {"stores": spark.createDataFrame([("s1", "shop", "MX", True), ("s2", "gone", "MX", False)], online.TABLES["stores"])})


def call(spark, catalog, sources, *records, **options):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "position int, raw string")
    after, found = online.publish_online(catalog, rows, sources, NOW, **options)
    return online.Catalog(*(getattr(after, t).checkpoint() for t in ("stores", "products", "listings", "snapshots", "images"))), {r.position: r for r in found.collect()}


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_new_unchanged_late_and_changed(spark, sources):
    first, found = call(spark, empty(spark), sources, record(image_url="https://img.mx/1.png", gtin=GTIN))
    assert found[0].action == "insert" and found[0].rule == "new"
    assert one(first.products)[1:4] == ("Product 1", "product 1", "food") and one(first.images).image_url == "https://img.mx/1.png"
    later = record(observed_at="2026-06-10T11:00:00Z", brand="B", product_name="Renamed", image_url=None)
    second, found = call(spark, first, sources, later)
    assert found[0].action == "unchanged" and found[0].rule == "listing"
    snapshot, listing = one(second.snapshots), one(second.listings)
    assert (snapshot.captured_at, snapshot.last_seen_at) == (datetime(2026, 6, 10, 10), datetime(2026, 6, 10, 11)) and json.loads(snapshot.raw_payload)["brand"] == "B"
    assert (listing.external_name, listing.image_url, one(second.products).brand, one(second.products).name) == ("Renamed", "https://img.mx/1.png", "B", "Product 1")
    third, found = call(spark, second, sources, record(observed_at="2026-06-10T09:00:00Z", price=1), record(observed_at="2026-06-10T11:00:00Z"), record(observed_at="2026-06-10T11:30:00Z", price=11), record(observed_at="2026-06-10T11:40:00Z", price=11))
    assert [found[i].action for i in range(4)] == ["late", "replay", "insert", "unchanged"]
    assert sorted((r.price, r.last_seen_at.hour, r.last_seen_at.minute) for r in third.snapshots.collect()) == [(10.5, 11, 0), (11, 11, 40)]


def test_records_of_a_call_see_those_before(spark, sources):
    after, found = call(
        spark, empty(spark), sources, record(1, gtin=GTIN), record(2, gtin=GTIN[-13:], brand="B"), record(3, normalized_name="product 1"), record(4, external_id="x"), record(5, external_id="x", observed_at="2026-06-10T11:00:00Z"), record(6, normalized_name="product 1"),
    )
    assert found[0].product == found[1].product and found[3].listing == found[4].listing and found[4].action == "unchanged"
    names = {r.normalized_name for r in after.products.collect()}
    assert "product 1" in names and sum(n.startswith("product 1 [shop:") for n in names) == 2 and len(names) == 4
    assert one(after.products, normalized_name="product 1").brand == "B"
    moved = one(after.listings, external_id="x")
    assert (moved.external_url, moved.store_product_url) == ("https://shop.mx/4", "https://shop.mx/5")


FAULTS = [
    ({"price_scope": "branch_local"}, "not_online"), ({"branch_id": "b"}, "branch_data"), ({"currency": "USD"}, "currency"), ({"price": "10"}, "price_not_a_number"), ({"price": 10.555}, "price"), ({"source": "nobody"}, "source_not_enabled"),
    ({"url": "https://other.mx/1"}, "host_not_allowed"), ({"gtin": "7501031311308"}, "invalid_gtin"), ({"store_slug": "gone", "url": "https://gone.mx/1"}, "unknown_store"), ({"observed_at": "2026-05-01T00:00:00Z"}, "not_current"),
    ({"price": 12}, "conflicting_observation"), ({"observed_at": "2026-06-10T11:00:00Z", "pack_count": 3}, "conflicting_identity"), ({"observed_at": "2026-06-10T11:00:00Z", "gtin": OTHER}, "conflicting_identity"), ({"observed_at": "2026-06-10T11:00:00Z"}, None),
]


def test_a_record_at_fault_refuses_all(spark, sources):
    before, _ = call(spark, empty(spark), sources, *(record(n, pack_count=2, gtin=GTIN if "pack_count" not in change and change.get("gtin") == OTHER else None) for n, (change, _) in enumerate(FAULTS)))
    rows = spark.createDataFrame([(n, json.dumps(record(n, pack_count=change.get("pack_count", 2)) | record(n, **change))) for n, (change, _) in enumerate(FAULTS)], "position int, raw string")
    assert {r.position: r.error for r in online.judged(before, rows, sources, NOW).collect()} == {n: e for n, (_, e) in enumerate(FAULTS)}
    with pytest.raises(online.Refused) as e:
        call(spark, before, sources, record(50), record(51, currency="USD"), record(52, currency=None))
    assert (e.value.position, e.value.error) == (1, "currency")


def test_size_of_a_call(spark, sources):
    for n in (0, 4):
        with pytest.raises(online.Refused, match="Expected 1..3"):
            rows = spark.createDataFrame([(i, json.dumps(record(i))) for i in range(n)], "position int, raw string")
            online.publish_online(empty(spark), rows, sources, NOW, limit=3)


def test_stored_catalog_follows_the_batch(spark, tmp_path):
    def batch(numbers, price=10):
        rows = [
            {
                "source": "src", "store_brand": "Shop", "store_slug": "shop", "source_product_name": f"P {n}", "normalized_name": f"p {n}", "category": "c", "presentation": "1 l", "price": price, "currency": "MXN", "available": True, "price_scope": "online",
                "store_product_url": f"https://shop.mx/{n}", "external_reference": f"r{n}", "source_url": f"https://shop.mx/{n}", "evidence_kind": "sitemap", "review_status": "accepted", "is_synthetic": False, "confidence_score": 0.9,
                "content_hash": f"{n}-{price}", "validation_errors": [], "captured_at": (NOW - timedelta(hours=price)).isoformat() + "Z", "observed_at": (NOW - timedelta(hours=price)).isoformat() + "Z",
            }
            for n in numbers
        ]
        return spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")

    catalog = StoredCatalog(spark, str(tmp_path), buckets=16)
    _, first = catalog.publish(batch(range(60)), NOW)
    assert first["snapshots"].inserted == 60 and first["stores"].inserted == 1
    files = set(Path(tmp_path).rglob("*.parquet"))
    report, again = catalog.publish(batch(range(60)), NOW)
    assert all(not c.buckets for c in again.values()) and set(Path(tmp_path).rglob("*.parquet")) == files
    assert report.first().inserted_snapshots == 0 and report.first().reused_staging == 60
    _, few = catalog.publish(batch([3, 100], price=5), NOW)
    assert {n: (c.inserted, c.updated) for n, c in few.items()} == {"staging": (2, 0), "stores": (0, 0), "products": (1, 0), "branches": (0, 0), "listings": (1, 1), "snapshots": (2, 0)}
    assert max(len(c.buckets) for c in few.values()) <= 2
    state = catalog.read()
    assert (state.products.count(), state.listings.count(), state.snapshots.count(), state.staging.count()) == (61, 61, 62, 62)


def test_the_earlier_publisher_always_inserts(spark, sources):
    rows = [record(1), record(1, observed_at="2026-06-10T11:00:00Z", presentation="2 l"), record(1), record(2, normalized_name="product 1", product_name="Renamed", observed_at="2026-06-10T09:00:00Z")]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "position int, raw string")
    after, n = online.publish_always(empty(spark), df, sources, NOW)
    assert n == 3 and one(after.products).name == "Renamed" and after.listings.count() == 2
    assert one(after.listings, external_url="https://shop.mx/1").presentation == "2 l"
    again, n = online.publish_always(after, df.filter("position = 0"), sources, NOW)
    assert n == 0 and one(again.listings, external_url="https://shop.mx/1").presentation == "2 l"
    with pytest.raises(online.Refused, match="record 0: currency"):
        online.publish_always(after, spark.createDataFrame([(0, json.dumps(record(1, currency="USD")))], "position int, raw string"), sources, NOW)
