"""What holds at sizes that the other tests don't have: keys beyond the numbers that a query adds, tables of one file, large buckets."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

PART = "SELECT i AS p_partkey, 'red widget ' || i % 7 AS p_name, 'Brand#' || i % 5 AS p_brand, 'ECONOMY' AS p_type, CAST(1 + i % 50 AS INTEGER) AS p_size, CAST(900 + i % 100 AS DOUBLE) AS p_retailprice FROM range({}, {}) t(i)"


def parts(path, begin, end):
    con = duckdb.connect()
    con.execute(f"COPY ({PART.format(begin, end)}) TO '{path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet'")
    return con


def test_saved_parts_with_keys_over_a_million(spark, tmp_path):
    import __spark_entry__ as e

    con = parts(tmp_path, 999_950, 1_000_050)
    found = e.queries()["saved_snapshots"](spark, str(tmp_path))
    wanted = con.execute(f"SELECT external_reference, price_cents, branch FROM ({e.oracle_sql()['saved_snapshots']})").fetchall()
    assert sorted((tuple(r) for r in found.select("external_reference", "price_cents", "branch").collect()), key=str) == sorted(wanted, key=str)
    assert len(wanted) == len({w[0] for w in wanted}) > 90


def test_records_of_a_small_file_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    from tarifa import queries_records as Q
    from tarifa.plans import ingest, mapping

    monkeypatch.setattr(mapping, "DEALT_ROWS", 10)
    parts(tmp_path, 0, 400)
    lines = Q._lines(spark, str(tmp_path))
    busy = lines.select(F.spark_partition_id().alias("task"), "line").filter("line < 1000000").groupBy("task").count().collect()
    assert len(busy) > 30 and sum(r["count"] for r in busy) == 400
    # A filter on what validation finds stays above the dealing.
    plan = ingest.unique_records(ingest.validated(lines, mapping.AS_OF))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "parquet" not in plan.lower()


def test_lines_are_validated_once_for_the_histogram(spark):
    from tarifa.plans import ingest
    from tarifa.plans.mapping import AS_OF

    lines = spark.createDataFrame([("f", 1, "{}", None), ("f", 2, None, "invalid_json")], "file string, line long, raw string, error string")
    found = ingest.rejection_histogram(ingest.validated(lines, AS_OF))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert {r.code: r.n for r in found.collect()}["invalid_json"] == 1


def test_a_large_bucket_is_written_in_several_files(spark, tmp_path):
    from tarifa.sources.stored import StoredTable

    t = StoredTable(spark, str(tmp_path / "t"), ["k", "n"], by=["k"], buckets=4)
    # A bucket is cut between what the tasks before have written of it, so these must be several.
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "256k"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        assert t.merge(spark.range(40_000, numPartitions=4).select(F.lit("common").alias("k"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("v"))).inserted == 40_000
    finally:
        for name in small:
            spark.conf.unset(name)
    assert len(list((tmp_path / "t" / "data").rglob("*.parquet"))) > 1
    assert t.read().agg(F.count_distinct("n")).first()[0] == 40_000


def test_python_gets_few_rows_at_a_time(spark):
    from tarifa.llm.common import small_batches

    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["id"]) for b in batches)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with small_batches(spark, 100):
        found = spark.range(0, 1000, 1, 2).mapInArrow(sizes, "id long").collect()
    assert max(r.id for r in found) <= 100 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_field_of_a_line_is_read_once_for_all_rules(spark):
    from tarifa.plans import ingest
    from tarifa.plans.mapping import AS_OF

    lines = spark.createDataFrame([("f", 1, '{"currency": "USD"}', None)], "file string, line long, raw string, error string")
    found = ingest.validated(lines, AS_OF)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("$.currency") == 2  # as a variant for its kind, and as a text
    assert {"non_mxn", "missing_source"} <= set(found.first().issues)


def test_a_batch_adds_to_staging_and_snapshots_without_writing_them_again(spark, tmp_path):
    import pytest

    from tarifa.plans.mapping import AS_OF
    from tarifa.plans.stored_batch import StoredCatalog
    from tarifa.plans import ingest
    from tarifa.queries_records import _lines

    parts(tmp_path, 0, 60)
    records = ingest.unique_records(ingest.validated(_lines(spark, str(tmp_path)), AS_OF)).select("raw").checkpoint()
    catalog = StoredCatalog(spark, str(tmp_path / "catalog"), buckets=1)
    some = records.filter("raw LIKE '%parts.mx/1%'")
    _, first = catalog.publish(records.exceptAll(some), AS_OF)
    _, second = catalog.publish(some, AS_OF)
    for name in ("staging", "snapshots"):
        table = catalog.tables[name]
        (newest,) = [w for w in table._state()[1]["buckets"]["0"] if w not in table._state(0)[1]["buckets"]["0"]]
        written = spark.read.parquet(f"{table.path}/data/{newest}").count()
        assert written == second[name].inserted == some.count() > 0 and table.read().count() == written + first[name].inserted
    with pytest.raises(ValueError, match="repeat a key"):
        StoredCatalog(spark, str(tmp_path / "other"), buckets=1).publish(some.union(some), AS_OF)
