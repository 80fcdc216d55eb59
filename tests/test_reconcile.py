"""Reconciliation of a batch, a record for each rule."""

from datetime import datetime, timedelta

from tarifa.plans import reconcile

NOW = datetime(2026, 6, 28, 12)
BATCH = "position int, source string, store_slug string, store_product_url string, product_name string, normalized_name string, presentation string, external_reference string, image_url string, captured_at timestamp, weighted boolean"
KNOWN = "source string, store_slug string, store_product_url string, product_name string, normalized_name string, presentation string, image_url string"


def record(position, url, name, pack="1 l", ref="r", source="s", hours=0, weighted=False, slug="shop"):
    return (position, source, slug, url, name, name.lower(), pack, ref, None, NOW - timedelta(hours=hours), weighted)


def test_every_rule(spark):
    known = [("s", "shop", "u1", "Leche 1 litro", "leche uno", "1 L", "https://i"), ("s", "shop", "u2", "Sal", "sal", "1 kg", None), ("s", "shop", "u3", "Té", "te", "20 g", None), ("s", "shop", "u3", "TE", "te", "20 g", None), ("c", "shop", "all", "Pan", "pan", "500 g", None), ("s", "shop", "u9", "Atun", "atun", "140 g", None)]
    batch = [
        record(0, "u1", "LECHE 1 lt", "1000 ml"),
        record(1, "u1", "LECHE 1 lt", hours=2),
        record(2, "u2", "Sal", "2 kg"),
        record(3, "u2", "Azucar", "1 kg"),
        record(4, "u3", "te", "20 g"),
        record(5, "n1", "Jamon", weighted=True),
        record(6, "n2", "Queso", ref="a"),
        record(7, "n2", "Queso", ref="b"),
        record(8, "n3", "Crema", ref="a"),
        record(9, "n4", "Crema", ref="b"),
        record(10, "n5", "Atun", "80 g"),
        record(11, "all", "Bolillo", "60 g", source="c"),
        record(12, "u1", "LECHE 1 lt", "1 l", slug="other"),
        record(13, "n6", "Vela", "grande"),
        record(14, "n7", "Nada", None),
        record(15, "n7", "Nada", None),
    ]
    out = reconcile.reconciled(spark.createDataFrame(batch, BATCH), spark.createDataFrame(known, KNOWN), shared=("c",))
    got = {r.position: r for r in out.collect()}
    assert len(got) == len(batch)
    assert {k: r.hold_reason or r.outcome for k, r in got.items()} == {
        0: "kept", 1: "superseded", 2: "presentation_or_store_changed", 3: "ambiguous_known_url", 4: "ambiguous_known_url", 5: "weighted_unit", 6: "several_references_of_identity", 7: "several_references_of_identity",
        8: "several_references_of_name", 9: "several_references_of_name", 10: "conflicting_presentations", 11: "kept", 12: "presentation_or_store_changed", 13: "kept", 14: "kept", 15: "superseded",
    }
    assert (got[0].normalized_name, got[0].captured_normalized_name, got[0].image_url) == ("leche uno", "leche 1 lt", "https://i")
    empty = spark.createDataFrame([], KNOWN)
    assert reconcile.reconciled(spark.createDataFrame(batch[:1], BATCH), empty).first().outcome == "kept"
    assert reconcile.reconciled(spark.createDataFrame([], BATCH), empty).count() == 0
