"""Offer matching against all pairs under the rules; baskets without what can't be bought."""

import itertools
import random
from collections import Counter

from tarifa.plans import compare as P
from tarifa.plans import matching as M

OFFER = "offer_id long, retailer string, external_id string, gtin string, ean string, brand string, name string, presentation string"
PACKS = {"1 l": "1000ml", "1000 ml": "1000ml", "1 litro": "1000ml", "6 x 1 l": "6x1000ml", "500 g": "500g", "0.5 kg": "500g", "": None, "sin medida": None}
CODES = {None: None, "7501031311309": "07501031311309", "07501031311309": "07501031311309", "4006381333931": "04006381333931", "96385074": "00000096385074", "7501031311308": None, "abc": None}


def rule(a, b):
    if a["pack"] and b["pack"] and a["pack"] != b["pack"]:
        return None
    if a["code"] and b["code"]:
        return "gtin" if a["code"] == b["code"] else None
    if a["fault"] or b["fault"]:
        return None
    if a["listing"] and a["listing"] == b["listing"]:
        return "retailer_external_id"
    same = a["brand"] and a["pack"] and a["variant"] and (a["brand"], a["pack"], a["variant"]) == (b["brand"], b["pack"], b["variant"])
    return "brand_variant_presentation" if same else None


def offers(seed, n):
    r, rows, facts = random.Random(seed), [], {}
    for i in range(n):
        gtin, ean = r.choice([None, None, *CODES]), r.choice([None, None, None, *CODES])
        shown, named = r.choice([None, *PACKS]), r.choice(list(PACKS))
        retailer, external, brand, base = r.choice("ab"), r.choice([None, "1", "2", "3"]), r.choice([None, "", "Más", "mas", "Otra"]), r.choice(["Leche", "LECHE", "Pan dulce", ""])
        name = f"{base} {named}".strip()
        rows.append((i, retailer, external, gtin, ean, brand, name, shown))
        valid = {CODES[c] for c in (gtin, ean)} - {None}
        text = {"": "", "sin medida": "sin medida"}.get(named, "")
        facts[i] = {
            "pack": PACKS[shown] if shown else PACKS[named], "code": next(iter(valid)) if len(valid) == 1 else None, "fault": len(valid) > 1 or any(c is not None and CODES[c] is None for c in (gtin, ean)),
            "listing": external and (retailer, external), "brand": (brand or "").lower().replace("á", "a") or None, "variant": f"{base.lower()} {text}".strip() or None,
        }
    return rows, facts


def test_links_equal_all_pairs(spark):
    rows, facts = offers(4, 160)
    pairs = {(i, j): rule(facts[i], facts[j]) for i, j in itertools.permutations(facts, 2)}
    wanted = Counter((i, r) for (i, _), r in pairs.items() if r)
    df = spark.createDataFrame(rows, OFFER)
    for r in M.offer_links(df).collect():
        assert [r.gtin_links, r.external_links, r.variant_links] == [wanted[r.offer_id, x] for x in ("gtin", "retailer_external_id", "brand_variant_presentation")], (rows[r.offer_id], r)
    got = {(r.left_id, r.right_id): r.rule for r in M.match_offers(df, df).filter("left_id <> right_id").collect()}
    assert got == {k: v for k, v in pairs.items() if v} and set(got.values()) == {"gtin", "retailer_external_id", "brand_variant_presentation"}


def test_vetoes_and_spellings(spark):
    rows = [(1, "a", "1", "7501031311309", None, "B", "Leche 1 l", "1 l"), (2, "b", "1", "4006381333931", None, "B", "Leche 1 l", "1 l"), (3, "c", "1", "7501031311309", None, "B", "Leche", "6 x 1 l"), (4, "d", "1", None, None, "B", "Leche 1000 ml", None), (5, "e", "1", "7501031311308", None, "B", "Leche 1 l", "1 l")]
    df = spark.createDataFrame(rows, OFFER)
    got = {(r.left_id, r.right_id): r.rule for r in M.match_offers(df, df).filter("left_id < right_id").collect()}
    assert got == {(1, 4): "brand_variant_presentation", (2, 4): "brand_variant_presentation"}
    assert not M.offer_links(df.limit(0)).collect()


def test_baskets_leave_out_what_cant_be_bought(spark):
    inf = float("inf")
    rows = [(1, "x", "m", "M", 10.0, True, "mxn"), (2, "x", "m", "M", inf, True, "MXN"), (3, "x", "n", " ", 1.0, True, "MXN"), (4, "x", "o", "O", 3.0, True, "USD"), (5, "y", "m", "M", 2.0, True, "MXN"), (6, "x", "p", "P", float("nan"), True, "MXN"), (7, "x", "q", "Q", 4.0, False, "MXN")]
    offers_ = spark.createDataFrame(rows, "offer_id long, item string, merchant string, store_name string, price double, available boolean, currency string").selectExpr("*", "cast(null as string) AS branch")
    cart = spark.createDataFrame([("x", 2), ("y", 0), ("z", -1)], "item string, quantity int")
    assert [(r.merchant, r.subtotal_cents, r["items"], r.expected, r.complete) for r in P.baskets(offers_, cart).collect()] == [("m", 2000, 1, 1, True)]
