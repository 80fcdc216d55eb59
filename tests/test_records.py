"""Requests, reviews, the batch publisher's policies, tokens and graphs on small fixtures."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarifa.plans import api, batch, validators
from tarifa.sources import discovery, markup, official, products, retail

NOW = datetime(2026, 6, 28, 12)


@pytest.mark.parametrize(
    ("params", "wrong"),
    [({"page": "0"}, {"page"}), ({"limit": "51", "radius_km": "0"}, {"limit", "radius_km"}), ({"lat": "19"}, {"lat"}), ({"query": " "}, {"query"}), ({"order_by": "name", "available": "yes"}, {"order_by", "available"}), ({"page": "1.5", "lat": "x", "lng": "0"}, {"page", "lat"})],
)
def test_requests_that_cannot_be_read(params, wrong):
    with pytest.raises(api.InvalidQuery) as found:
        api.price_query(params)
    assert set(found.value.issues) == wrong


def test_requests_that_can():
    q = api.price_query({"query": " leche ", "lat": "19.4", "lng": "-99.1", "radius_km": "5", "available": "false"}, nearby=True)
    assert (q.page, q.limit, q.query, q.radius_km, q.order_by) == (1, 20, "leche", 5.0, "price")
    assert q.filters == {"available": False, "lat": "19.4", "lng": "-99.1"}
    with pytest.raises(api.InvalidQuery):
        api.price_query({"query": "leche"}, nearby=True)


def record(k, **changes):
    r = {
        "source": "s", "store_brand": "Brand", "store_slug": "brand", "source_product_name": f"Name {k}", "normalized_name": f"name {k % 2}", "category": f"c{k}", "presentation": "1 l", "price": 10 + k, "currency": "MXN", "available": True,
        "price_scope": "online", "store_product_url": f"https://s.mx/{k % 2}", "source_url": "https://s.mx/", "external_reference": f"r{k}", "evidence_kind": "store_api", "review_status": "accepted", "is_synthetic": False, "confidence_score": 0.9,
        "content_hash": f"hash{k:04d}", "captured_at": f"2026-06-2{k}T10:00:00Z", "observed_at": f"2026-06-2{k}T10:00:00Z",
    }
    return (json.dumps(r | changes),)


def test_batches_merge_by_the_policy_of_each_column(spark):
    rows = lambda *records: spark.createDataFrame(list(records), "raw string")
    first, _ = batch.publish_batch(batch.empty_state(spark), rows(record(0), record(1)), NOW)
    after, report = batch.publish_batch(first, rows(record(2, category=None, store_brand="A brand"), record(3, confidence_score=0.5), record(1)), NOW)
    assert {(r.normalized_name, r.name, r.category) for r in after.products.collect()} == {("name 0", "Name 2", "c0"), ("name 1", "Name 1", "c1")}
    assert [r.name for r in after.stores.collect()] == ["A brand"] and {r.id for r in first.products.collect()} == {r.id for r in after.products.collect()}
    assert sorted(int(r.price) for r in after.snapshots.collect()) == [10, 11, 12]
    r = report.first()
    assert (r.input_records, r.new_staging_rows, r.reused_staging, r.publishable, r.inserted_snapshots, r.skipped_existing_snapshots) == (3, 2, 1, 2, 1, 1)
    again, report = batch.publish_batch(after, rows(record(0), record(1), record(2)), NOW)
    assert report.first().inserted_snapshots == 0 and again.listings.count() == 2 and again.staging.count() == after.staging.count()
    empty, report = batch.publish_batch(after, rows(record(0)).limit(0), NOW)
    assert report.first().input_records == 0 and empty.snapshots.count() == 3


def test_a_basket_with_anything_open_fails(spark):
    manifest = spark.createDataFrame([("reviewed:x", "l", s, "u", "n", "1 kg", "c", "size") for s in ("a", "b")], "canonical_variant_key string, label string, source string, url string, observed_name string, observed_presentation string, category string, match_basis string")
    row = lambda s, **c: {"source": s, "store_product_url": "u", "source_product_name": "n", "presentation": "1 kg", "price_scope": "online", "available": True, "is_synthetic": False, "review_status": "accepted", "raw_payload": "{}", "category": "old"} | c
    rows = lambda *r: spark.createDataFrame(list(r))
    assert validators.prepared_basket(manifest, rows(row("a"), row("b")), ("a", "b"), "today").count() == 2
    for bad in ([row("a")], [row("a"), row("b", available=False)], [row("a"), row("b"), row("b")], [row("a"), row("b"), row("a", store_product_url="v")]):
        with pytest.raises(ValueError, match="Review required"):
            validators.prepared_basket(manifest, rows(*bad), ("a", "b"), "today")


def test_regions_of_tokens(spark):
    inner = base64.b64encode(b"v2.ABC/1").decode()
    good = base64.urlsafe_b64encode(json.dumps({"regionId": inner}).encode()).decode().rstrip("=")
    bad = [None, "", "%%%", base64.b64encode(b"[1]").decode(), base64.b64encode(b'{"regionId": 5}').decode(), base64.b64encode(b"\xff\xfe").decode()]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([good, *bad])], "k int, t string")
    got = {r.k: r.v for r in rows.select("k", official.region_of_token(F.col("t")).alias("v")).collect()}
    assert got[0] == "v2.ABC/1" and all(got[k] is None for k in (1, 2, 3, 4, 6))


def test_guards(spark):
    rows = spark.range(10).toDF("id")
    assert batch.bounded(rows, ["id"], 10).count() == 10
    with pytest.raises(ValueError, match="More than 9"):
        batch.bounded(rows, ["id"], 9)
    sizes = spark.createDataFrame([(10, 800 << 20)], "n_rows long, n_bytes long")
    assert [batch.capacity(sizes, b).first().over for b in (0, 400 << 20)] == ["archive_size", "database_size"]


def test_graphs_are_followed_where_asked():
    ref = lambda key: {"type": "id", "id": key}
    state = {"a": {"next": ref("b"), "all": [ref(k) for k in "abcde"] * 40}, "b": {"next": ref("a"), "x": 1, "y": {"z": 2}}, "loop": ref("loop"), **{k: {"all": [ref(j) for j in "abcde"]} for k in "cde"}}
    assert markup.followed(state, state["a"], {"next": {"x": None, "next": {"next": {"x": None}}}}) == {"next": {"x": 1, "next": {"next": {"x": 1}}}}
    assert markup.followed(state, ref("loop"), {"x": None}) is None and markup.followed(state, state["b"], {"y": None, "absent": None}) == {"y": None}
    deep = shape = {}
    for _ in range(200):
        shape["next"] = {}
        shape = shape["next"]
    assert markup.followed(state, state["a"], deep)["next"]["next"]


def test_markup_is_read_once():
    page = """<meta name=a content='x &amp; y'><META property="b" content><template data-varname="__STATE__"><script>{"k": 1}</script></template>
    <script type="application/ld+json">{"@type": "Product", "name": "<b>"}</script><script type=application/ld+json>{</script><p>1 < 2"""
    carried = markup.Carried(page)
    assert carried.metas == [{"name": "a", "content": "x & y"}, {"property": "b", "content": ""}]
    assert carried.linked_data() == ([{"@type": "Product", "name": "<b>"}], True)
    assert carried.scripts[0] == ({}, '{"k": 1}', {"data-varname": "__STATE__"})
    assert retail._page("https://s.mx/slug/p", "<script type='application/ld+json'>{</script>")["broken"]


def test_presentations_as_written(spark):
    cases = {"Leche 1 l": "1 l", "Agua 500 ml, 6 x 355 ml": "6 x 355 ml", "Pan 3 piezas": "3 piezas", "6 piezas de 1.5 KG": "6 piezas de 1.5 KG", "4 x 2 piezas": "2 piezas", "Carne por kg": "por kg", "Sin": None, "A10 g": None, "12de 3,5l": "12de 3,5l", "2 rollos 5 l": "2 rollos"}
    rows = spark.createDataFrame(list(cases.items()), "name string, wanted string")
    got = rows.select("name", products.stated_presentation(F.col("name"), F.lit("")).alias("p")).collect()
    assert {r.name: r.p for r in got} == cases
    assert rows.limit(1).select(products.stated_presentation(F.lit("x"), F.lit("y 2 kg")).alias("p")).first().p == "2 kg"


def test_links_are_followed_if_the_state_allows_it(spark):
    def item(slug, **pricing):
        return {"__typename": "Product", "slug": slug, "pricing": {"price": 1, "isTaxExempt": True} | pricing}

    state = json.dumps({"a": [item("one"), item("two", oldPrice="9"), {"deep": item("three", isTaxExempt=None)}, item("one", oldPrice="9"), item("four", oldPrice="")]})
    anchors = ["/p/one", "https://m.mx/p/two", "/p/three", "/p/one", "/p/none", "/p/four?x=1", "/p/four", "/c/one", "https://other.mx/p/one", "http://m.mx/p/one", "p/four#f", "http://["]
    html = f"<script id='__NEXT_DATA__'>{state}</script>" + "".join(f"<a href={a}>x</a>" for a in anchors)
    pages = spark.createDataFrame([(1, html), (2, "<a href='/p/one'>x</a>"), (3, None), (None, html)], "page_id long, html string")
    got = {(r.page_id, r.url.split("/")[-1]): (r.position, r.reason) for r in discovery.product_links(pages, "https://m.mx", r"/p/[a-z0-9-]+").collect()}
    own = {"one": (1, None), "two": (2, "promotion"), "three": (3, "tax_inclusion_unknown"), "none": (5, "not_in_state"), "four": (7, None)}
    assert got == {(p, k): v for p in (1, None) for k, v in own.items()} | {(2, "one"): (1, "not_in_state")}


def test_links_of_the_state(spark):
    def item(n, address, sale=False, pieces=(True,), raw=True):
        inner = {"id": n, "isAvailable": True, "price": 3, "onSale": sale, "variants": [{"isPiece": p} for p in pieces]}
        return {"id": n, "productDetailUrl": address, "raw": inner if raw else {}}

    state = json.dumps([item(1, "/product/a-1/"), item(2, "/product/b-2", sale=True), item(3, "/product/c-3", pieces=(False,)), item(4, "/product/d-4", raw=False), item(5, "/other/e"), item(6, "/product/f-6", pieces=(True, True))])
    pages = spark.createDataFrame([(1, f'<script id="__NEXT_DATA__">{state}</script>')], "page_id long, html string")
    found = discovery.product_links(pages, "https://j.mx", "/product/[a-z0-9-]+-[0-9]+/?", discovery.DETAIL, listed_in_state=True)
    assert {r.url.split("/")[4]: r.reason for r in found.collect()} == {"a-1": None, "b-2": "promotion", "c-3": "weighted_or_ambiguous_unit", "d-4": "not_in_state", "f-6": "weighted_or_ambiguous_unit"}
