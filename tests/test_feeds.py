"""Feeds: one good product a format, and one broken by each rule."""

import copy
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifa.sources import feeds

NOW = datetime(2026, 6, 28, 12)
HOST = "s.mx"


def replies(spark, bodies, urls=None):
    rows = [(urls[k] if urls else f"https://{HOST}/{k}", NOW - timedelta(hours=1), b if isinstance(b, str) or b is None else json.dumps(b)) for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "url string, observed_at timestamp, body string")


def changed(good, **changes):
    """A copy of a JSON value with values at dotted paths replaced."""
    out = copy.deepcopy(good)
    for path, value in changes.items():
        now, keys = out, [int(k) if k.isdigit() else k for k in path.split("__")]
        for k in keys[:-1]:
            now = now[k]
        now[keys[-1]] = value
    return out


def reasons(df):
    return [r.reject_reason for r in df.orderBy("url").collect()]


def test_search_results(spark):
    offer = {"Price": 20.5, "ListPrice": 20.50, "AvailableQuantity": 3, "IsAvailable": True, "PriceValidUntil": "2026-07-01T00:00:00Z"}
    good = {"productName": "Leche 1 lt", "link": "https://s.mx/leche", "categories": ["/Lacteos/Leche/"], "items": [{"itemId": "7", "ean": "7501031311309", "measurementUnit": "un", "unitMultiplier": 1, "images": [{"imageUrl": "https://i.mx/a"}], "sellers": [{"sellerId": "1", "commertialOffer": offer}, {"sellerId": "x"}]}]}
    own = "items__0__sellers__0__commertialOffer__"
    cases = [good, changed(good, productName="Leche 1 l + vaso gratis"), changed(good, items=[]), changed(good, items__0__unitMultiplier=0.5), changed(good, items__0__sellers=[]), changed(good, **{own + "ListPrice": 25}), changed(good, **{own + "AvailableQuantity": "3"}), changed(good, **{own + "IsAvailable": False}), changed(good, **{own + "PriceValidUntil": "2026-06-01"})]
    out = feeds.search_results(replies(spark, [[c] for c in cases]), HOST, NOW, "MXN")
    assert reasons(out) == [None, "combined_pack", "several_variants", "weighted_or_multiplied_unit", "ambiguous_own_offer", "promotion", "quantity_not_explicit", "availability_contradicts_quantity", "expired_offer"]
    r = out.orderBy("url").first()
    assert (r.product_name, r.presentation, float(r.price), r.available, r.category, r.external_reference, r.gtin, r.image_url) == ("Leche 1 lt", "1 l", 20.5, True, "Lacteos", "7", "07501031311309", "https://i.mx/a")
    assert reasons(feeds.search_results(replies(spark, [[good]]), HOST, NOW, None)) == ["currency_not_declared"]
    assert feeds.search_results(replies(spark, ["no json", None, "{}", "[]"]), HOST, NOW, "MXN").count() == 0
    assert feeds.search_results(replies(spark, []), HOST, NOW, "MXN").count() == 0


def test_shared_catalog(spark):
    def product(i, **more):
        return {"id": str(i), "name": f"Arroz {i}", "gramaje": "900 grs", "categoryId": "c", "price": "18.50", "available": True, "image": "img/a.png", "salePrice": None, **more}

    good = {"settings": {"currencyCode": "MXN"}, "categories": [{"id": "c", "name": "old"}, {"id": "c", "name": "Granos"}], "products": [product(1), product(2, name="Frijol"), product(3, name="Frijol"), product(4, salePrice=3), product(5, categoryId="z"), product(6, available=None), product(7, available=False), product(8, gramaje="")]}
    out = feeds.shared_catalog(replies(spark, [good]), HOST, NOW, "https://s.mx/tienda").orderBy("external_reference").collect()
    assert [r.reject_reason for r in out] == [None, "ambiguous_shared_identity", "ambiguous_shared_identity", "promotion", "unknown_category", "missing_identity_or_availability", None, "missing_presentation"]
    assert (out[0].product_name, out[0].presentation, out[0].category, out[0].image_url, out[6].available) == ("Arroz 1 900 g", "900 g", "Granos", "https://s.mx/img/a.png", False)
    twice = changed(good, products=[product(1), product(1)])
    assert set(reasons(feeds.shared_catalog(replies(spark, [twice]), HOST, NOW, "https://s.mx/tienda"))) == {"missing_or_repeated_id"}
    assert set(reasons(feeds.shared_catalog(replies(spark, [changed(good, settings={})]), HOST, NOW, "https://s.mx/tienda"))) == {"currency_not_declared"}


LABEL = r"pieza 1(?: a \d+)?"


def test_storefront_products(spark):
    good = {"id": 5, "title": "Sal 1 kg", "handle": "sal", "product_type": "", "variants": [{"id": 9, "product_id": 5, "title": "Pieza 1 a 11", "price": "10.00", "compare_at_price": "0.00", "available": True, "sku": ""}, {"id": 8, "title": "Caja"}], "images": [{"product_id": 5, "variant_ids": [8], "src": "https://i.mx/8"}, {"product_id": 5, "variant_ids": [], "src": "https://i.mx/placeholder.png"}, {"product_id": 5, "variant_ids": [9], "src": "https://i.mx/9"}]}
    cases = [good, changed(good, handle="S/al"), changed(good, variants=[]), changed(good, variants__0__product_id=4), changed(good, variants__0__compare_at_price="12.00"), changed(good, variants__0__available=1), changed(good, variants__0__price="10.001"), changed(good, title="Sal")]
    out = feeds.storefront_products(replies(spark, [{"products": [c]} for c in cases]), HOST, NOW, "MXN", LABEL)
    assert reasons(out) == [None, "invalid_handle", "ambiguous_piece", "variant_of_another_product", "promotion", "missing_identity_or_availability", "invalid_price", "missing_presentation"]
    r = out.orderBy("url").first()
    assert (r.product_name, r.external_reference, r.image_url, r.product_url, r.category) == ("Sal 1 kg · Pieza 1 a 11", "9", "https://i.mx/9", "https://s.mx/products/sal?variant=9", "Otros")


def test_storefront_product(spark):
    good = {"title": "Sal 1 kg", "handle": "sal", "available": True, "type": "Sal", "featured_image": "//i.mx/a", "variants": [{"id": 9, "title": "PZA/1", "price": 1050, "available": True, "sku": "k"}, {"id": 8, "title": "CJA/12", "available": False}]}
    cases = [good, changed(good, handle="otra"), changed(good, available=False), changed(good, variants__1__title="pza/1"), changed(good, variants__0__price="1050"), changed(good, variants__0__compare_at_price=1200)]
    out = feeds.storefront_product(replies(spark, cases, ["https://s.mx/products/sal.js"] * 6).withColumn("k", F.col("body")), HOST, NOW, "MXN", "PZA/1")
    assert sorted(map(str, reasons(out))) == sorted(["None", "url_conflict", "conflicting_availability", "ambiguous_piece", "promotion", "promotion"])
    r = out.filter("reject_reason IS NULL").first()
    assert (float(r.price), r.external_reference, r.image_url) == (10.5, "k", "https://i.mx/a")


def test_store_api_products(spark):
    good = {"id": 3, "sku": "", "name": "Caf&eacute; 12 pack 355 ml c/u", "type": "simple", "has_options": False, "variation": "", "variations": [], "is_password_protected": False, "is_in_stock": True, "is_on_backorder": False, "on_sale": False, "permalink": "https://s.mx/cafe", "categories": [{"name": "Bebidas"}, {"name": "Café"}], "images": [{"src": "http://i.mx/a"}, {"src": "https://i.mx/b"}], "prices": {"currency_code": "MXN", "currency_minor_unit": 2, "price": "12345", "regular_price": "12345"}}
    cases = [good, changed(good, prices__currency_minor_unit="2"), changed(good, variations=[1]), changed(good, is_password_protected=None), changed(good, is_on_backorder=True), changed(good, prices__regular_price="20000"), changed(good, categories__0__name="Carnes"), changed(good, name="Café 12 pack 355 ml"), changed(good, permalink="https://other.mx/")]
    out = feeds.store_api_products(replies(spark, [[c] for c in cases]), HOST, NOW)
    assert reasons(out) == [None, "currency_not_declared", "variable_unit", "protected", "stock_not_explicit", "promotion", "weighted_unit", "missing_presentation", "unexpected_origin"]
    r = out.orderBy("url").first()
    assert (r.product_name, r.presentation, float(r.price), r.external_reference, r.category, r.image_url) == ("Café 12 pack 355 ml c/u", "12 x 355 ml", 123.45, "3", "Bebidas / Café", "https://i.mx/b")
    summary = replies(spark, [[changed(good, name="Cafe", short_description="<p>500&nbsp;gramos</p>")]])
    assert feeds.store_api_products(summary, HOST, NOW, by_summary=True).first().presentation == "500 g"
    assert reasons(feeds.store_api_products(replies(spark, [[changed(good, name="Cafe caja 1 kg")]]), HOST, NOW, wholesale=True)) == ["weighted_unit"]


@pytest.mark.parametrize(("name", "shown"), [("Agua 2 ltos", "2 l"), ("Jamón por kilo", "por kg"), ("Vasos 6 pzs", "6 pzas"), ("Cerveza 12 pack 355 ml", None), (None, None)])
def test_observed_presentation(spark, name, shown):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(feeds.observed_presentation(F.col("name")).alias("v")).first().v == shown


def test_located_branches(spark):
    good = {"storeName": "8701", "uniqueID": 12, "city": "Tepic", "stateOrProvinceName": "Nayarit", "latitude": "21.5", "longitude": -104.9, "Description": [{"displayStoreName": "Centro"}], "addressLine": ["Calle 1 ", "", None], "Attribute": [{"name": "MarketId", "value": "9"}]}
    stores = [good, changed(good, city=" "), changed(good, latitude="north"), changed(good, longitude=2), "text"]
    out = feeds.located_branches(replies(spark, [{"PhysicalStore": stores}, {"PhysicalStore": []}, {}, None]), "shop", "Shop")
    assert {r.reject_reason: r.n for r in feeds.rejections(out).collect()} == {"missing_branch_municipality": 1, "missing_latitude": 1, "unconfirmed_location": 1, "invalid_branch_object": 1, "missing_branch_list": 2}
    r = out.filter("reject_reason IS NULL").collect()
    assert [(x.branch_external_key, x.branch_name, x.branch_address, x.latitude, x.market_id, x.unique_id) for x in r] == [("shop:8701", "Shop Centro", "Calle 1", 21.5, "9", "12")]
