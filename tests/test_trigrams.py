"""Searches through the gram index against the scan."""

import random

from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.plans import trigrams


def test_runs_between_wildcards():
    assert trigrams.literal_runs("leche%ent_ra 1l") == ["leche", "ent", "ra 1l"]
    assert trigrams.literal_runs("a%b_c") == [] and trigrams.literal_runs(r"abc\%def") == ["abc", "def"] and trigrams.literal_runs("") == []


def test_search_equals_the_scan(spark, tmp_path):
    r = random.Random(6)
    words = ["Leche", "ENTERA", "pan", "Ñandú", "1 l", "100%", "a_b", "x\\y", "日本語", "İstanbul", ""]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 5))) if i % 9 else None, r.choice(words).lower()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, other string")
    index = trigrams.TrigramIndex(spark, str(tmp_path / "i"), buckets=8)
    assert trigrams.search(df, index, "leche", "name", "other").count() == df.filter(S.matches_search("leche", F.col("name"), F.col("other"))).count()
    index.add(df.filter("id < 120"), "name", "other")
    index.add(df.filter("id >= 100"), "name", "other")
    assert not index.add(df, "name", "other").buckets
    for text in ["leche", " LECHE ", "che ent", "le%ra", "l_che", "ñandú", "100%", "a_b", "日本語", "語", "pan 1 l", "zzz", "", None, "%%%", "e p", "tera%pan"]:
        wanted = S.matches_search(text, F.col("name"), F.col("other"))
        scan = df if wanted is None else df.filter(wanted)
        assert sorted(x.id for x in trigrams.search(df, index, text, "name", "other").collect()) == sorted(x.id for x in scan.collect()), text
    assert index.candidates("leche entera").count() < 40
