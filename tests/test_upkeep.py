"""The maintenance run with failures between its phases, and the walk over two versions of a search."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifa.plans import maintenance, verify
from tarifa.sources.stored import StoredTable

NOW = datetime(2026, 6, 10)
ROW = "id string, store_product_id string, branch_id string, price_scope string, captured_at timestamp, price double, note string"


def history(spark, tmp_path):
    rows = []
    for listing in range(20):
        for k in range(8):  # four rows before the cutoff, then four with the second and third inside a run
            age = 200 - k if k < 4 else 30 - k
            rows.append((f"{listing}-{k}", f"l{listing}", None if listing % 2 else "b", "online", NOW - timedelta(days=age), 5.0 if k > 3 else float(k), "é" if k % 3 else None))
    t = StoredTable(spark, str(tmp_path / "t"), ["store_product_id", "id"], by=["store_product_id"], buckets=4)
    t.merge(spark.createDataFrame(rows, ROW))
    return t, {r[0]: r for r in rows}


def ids(t):
    return {r.id for r in t.read().collect()}


def test_run_archives_what_it_deletes(spark, tmp_path):
    t, rows = history(spark, tmp_path)
    archive = str(tmp_path / "archive")
    preview = {r.reason: r.archived for r in maintenance.maintain(t, archive, NOW, ["price"]).collect()}
    assert preview == {"retention": 80, "repeated": 40} and ids(t) == set(rows)
    report = maintenance.maintain(t, archive, NOW, ["price"], apply=True, batch_rows=30).collect()
    assert sum(r.deleted for r in report) == 120 and len(report) > 4
    left = {i for i in rows if i.endswith(("-4", "-7"))}
    assert ids(t) == left
    assert not maintenance.maintain(t, archive, NOW, ["price"], apply=True).collect()
    assert maintenance.restored(t, archive) == 120 and maintenance.restored(t, archive) == 0
    assert {tuple(r) for r in t.read().collect()} == set(rows.values())


def test_a_stop_between_the_phases_loses_nothing(spark, tmp_path):
    t, rows = history(spark, tmp_path)
    archive = str(tmp_path / "archive")

    def stop(path):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        maintenance.maintain(t, archive, NOW, ["price"], apply=True, before_delete=stop)
    assert ids(t) == set(rows) and len(maintenance.archives(spark, archive)) == 1
    maintenance.maintain(t, archive, NOW, ["price"], apply=True, batch_rows=1000)
    assert maintenance.restored(t, archive) == 120 and ids(t) == set(rows)


def test_what_changes_meanwhile_stays(spark, tmp_path):
    t, rows = history(spark, tmp_path)

    def change(path):
        other = StoredTable(spark, str(tmp_path / "t"), ["store_product_id", "id"], by=["store_product_id"])
        other.merge(t.read().filter("id = '3-1'").withColumn("note", F.lit("reviewed")))

    with pytest.raises(RuntimeError, match="1 of 80 rows have changed"):
        maintenance.maintain(t, str(tmp_path / "archive"), NOW, ["price"], apply=True, batch_rows=1000, before_delete=change)
    assert "3-1" in ids(t) and len(ids(t)) == 160 - 79


def test_budgets(spark, tmp_path):
    t, _ = history(spark, tmp_path)
    with pytest.raises(maintenance.BudgetReached, match="40 repeated"):
        maintenance.maintain(t, str(tmp_path / "a"), NOW, ["price"], apply=True, batch_rows=1000, max_repeats=39)
    again, _ = history(spark, tmp_path / "other")
    with pytest.raises(maintenance.BudgetReached, match="space"):
        maintenance.maintain(again, str(tmp_path / "a"), NOW, ["price"], apply=True, batch_rows=1000, max_bytes=10)


def test_versions_are_compared_page_by_page(spark):
    rows = spark.createDataFrame([(n, None if n == 3 else f"n{n}") for n in range(30)], "n int, name string").coalesce(1)
    old = lambda page, size: rows.orderBy("n").offset((page - 1) * size).limit(size)
    cases = {"five": {"size": 5}, "seven": {"size": 7}}
    assert not verify.differences(spark, old, old, cases, ["n", "name"]).collect()
    new = lambda page, size: old(page, size).filter("n <> 3").union(rows.filter("n = 29 AND %s" % ("true" if page < 3 else "false")))
    found = verify.differences(spark, old, new, cases, ["n", "name"])
    got = {(r.case, r.page, r.n, r.finding) for r in found.collect()}
    assert got == {x for c in cases for x in ((c, 1, 3, "missing"), (c, 1, 29, "unexpected"), (c, 2, 29, "unexpected"), (c, 2, 29, "repeated"))}
    assert [(r.missing, r.unexpected, r.repeated, r.equal) for r in verify.summary(found, cases).collect()] == [(1, 2, 1, False)] * 2


def test_offers_of_a_version_are_ranked_once_for_all_its_pages(spark, monkeypatch):
    from tarifa import queries_stored
    from tarifa.plans import catalog, mapping

    computed, offers = spark.sparkContext.accumulator(0), catalog.online_offers

    @F.udf("long")
    def counted(listing):
        computed.add(1)
        return listing

    monkeypatch.setattr(catalog, "online_offers", lambda *a, **b: offers(*a, **b).withColumn("store_product_id", counted("store_product_id")))
    report = queries_stored.verified_versions(spark, "/root/testdata/sf0.001").collect()
    n = offers(mapping.tables(spark, "/root/testdata/sf0.001"), mapping.AS_OF, None, None, True, 5000).count()
    assert len(report) == 4 and 0 < computed.value <= 2 * n


def test_pages_of_the_leading_offers_are_those_of_all(spark):
    from tarifa.plans import catalog, mapping

    t = mapping.tables(spark, "/root/testdata/sf0.001")
    offers = catalog.online_offers(t, mapping.AS_OF, None, None, True, 5000)
    leading = catalog.online_leading(offers, ["price_asc", "price_desc", "fresh_desc", "name"], 21).checkpoint()
    assert 21 < leading.count() <= 84
    for sort in ("price_asc", "price_desc", "fresh_desc", "name"):
        assert catalog.online_page(leading, 7, 3, sort).collect() == catalog.online_prices(t, mapping.AS_OF, limit=7, page=3, days=5000, sort=sort).collect()
    with pytest.raises(ValueError, match="1,000"):
        catalog.online_leading(offers, ["name"], 1001)
