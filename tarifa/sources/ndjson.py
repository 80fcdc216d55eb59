"""Records as JSON lines: reading with line numbers and reasons, writing, archives with manifests, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa.functions.scalars import json_kind, row_fingerprint


def numbered(lines: DataFrame) -> DataFrame:
    """lines of a text scan with file and line, the number (from 1) of each row in its file.

    A scan reads files in blocks, each whole in one task but in no order of the files. So a row's place is
    counted within its block, and the lines of the blocks before it are added: a table with a row for each block.
    """
    place = lines.withColumn("file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())
    blocks = place.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_begin"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    blocks = blocks.select("file", "_block", "_begin", before.alias("_before"))
    return place.join(blocks, ["file", "_block"]).withColumn("line", F.col("_at") - F.col("_begin") + F.col("_before") + 1).drop("_block", "_at", "_begin", "_before")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """file, line, raw and error (null, invalid_json or not_json_object) of the lines that aren't blank."""
    lines = numbered(spark.read.text(path)).filter(F.trim("value") != "")
    kind = json_kind(F.col("value"))
    error = F.when(kind.isNull(), "invalid_json").when(kind != "object", "not_json_object")
    return lines.select("file", "line", F.col("value").alias("raw"), error.alias("error"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema; a line that isn't one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_ndjson(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def recordset(rows: DataFrame, column: str, schema: str, base64: bool = False) -> DataFrame:
    """Typed rows out of a column of JSON arrays, plain or as base64 text."""
    text = F.decode(F.unbase64(column), "UTF-8") if base64 else F.col(column)
    return rows.select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def write_archive(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows as compressed JSON lines, reads them back, and gives the manifest (n_rows, fingerprint), which both must share."""
    spark, columns = rows.sparkSession, rows.columns
    rows.write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/rows")
    expected, found = (manifest(x).first() for x in (rows, spark.read.schema(rows.schema).json(f"{path}/rows").select(*columns)))
    if tuple(expected) != tuple(found):
        raise ValueError("Archive doesn't read back as written")
    out = spark.createDataFrame([tuple(found)], "n_rows long, fingerprint string")
    out.coalesce(1).write.json(f"{path}/manifest")
    return out


def manifest(rows: DataFrame) -> DataFrame:
    """How many rows, and a sum over row fingerprints that doesn't depend on their order."""
    part = F.conv(F.left(row_fingerprint(*rows.columns), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def restore_archive(table: DataFrame, path: str, key: str = "id") -> DataFrame:
    """table with the archived rows whose key it doesn't have. A changed archive or repeated keys are an error."""
    spark = table.sparkSession
    rows = spark.read.schema(table.schema).json(f"{path}/rows")
    said = spark.read.schema("n_rows long, fingerprint string").json(f"{path}/manifest").first()
    if tuple(said) != tuple(manifest(rows).first()):
        raise ValueError("Archive doesn't match its manifest")
    if not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("Archive repeats a key")
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def chunked(records: DataFrame, max_rows: int = 400, max_bytes: int = 1_500_000) -> DataFrame:
    """records with part and chunk: in order within each task, a chunk closes before it has too many rows or bytes of JSON.

    A record over max_bytes is a chunk of its own.
    """
    sized = records.withColumn("part", F.spark_partition_id().cast("long")).withColumn("_bytes", F.octet_length(F.to_json(F.struct(*records.columns))))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = rows = size = 0
        for batch in batches:
            out = []
            for n in batch["_bytes"]:
                if rows and (rows == max_rows or size + n > max_bytes):
                    chunk, rows, size = chunk + 1, 0, 0
                rows, size = rows + 1, size + n
                out.append(chunk)
            yield batch.drop(columns="_bytes").assign(chunk=out)

    schema = sized.drop("_bytes").withColumn("chunk", F.lit(0).cast("long")).schema
    return sized.mapInPandas(deal, schema)
