"""Stored tables: merges by bucket, versions, two writers, deletion, and the publisher over them."""

import random
from pathlib import Path

import pytest

from tarifa.sources.stored import ConcurrentWrite, StoredTable

ROW = "k string, n long, name string, note string"


def table(spark, tmp_path, **options):
    return StoredTable(spark, str(tmp_path / "t"), ["k"], **{"buckets": 8} | options)


def rows(spark, data):
    return spark.createDataFrame(data, ROW)


def content(df):
    return {r.k: tuple(r)[1:] for r in df.collect()}


def written_files(tmp_path):
    return {p for p in Path(tmp_path).rglob("*.parquet") if "staged" not in p.parts}


def test_merge_touches_only_changed_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read() is None and t.lookup(rows(spark, [])) is None
    data = [(f"k{i}", i, f"n{i}", None) for i in range(200)] + [(None, -1, "null key", None)]
    first = t.merge(rows(spark, data))
    assert (first.version, first.inserted, len(first.buckets)) == (0, 201, 8)
    before = written_files(tmp_path)
    replay = t.merge(rows(spark, data))
    assert replay == (0, 0, 0, 0, []) and written_files(tmp_path) == before and t.versions() == [0]
    change = t.merge(rows(spark, [("k3", 3, "renamed", None), ("k4", 4, "n4", None), ("new", 9, "new", None)]), {"name": "new", "n": "old", "note": "coalesce"})
    assert (change.version, change.inserted, change.updated) == (1, 1, 1) and len(change.buckets) <= 2
    assert len(written_files(tmp_path) - before) == len(change.buckets)
    wanted = {k: (n, name, note) for k, n, name, note in data} | {"k3": (3, "renamed", None), "new": (9, "new", None)}
    assert content(t.read()) == wanted
    assert content(t.read(0)) == {k: (n, name, note) for k, n, name, note in data}
    assert content(t.lookup(rows(spark, [("k7", 0, "", ""), (None, 0, "", ""), ("absent", 0, "", "")]))) == {k: wanted[k] for k in ("k7", None)}


def test_merges_equal_a_dictionary(spark, tmp_path):
    r, t, held = random.Random(5), table(spark, tmp_path), {}
    for _ in range(5):
        batch = {f"k{r.randrange(60)}": (r.choice([None, 1, 2]), r.choice([None, "a", "b"]), r.choice([None, "x"])) for _ in range(20)}
        t.merge(rows(spark, [(k, *v) for k, v in batch.items()]), {"n": "coalesce", "name": "old", "note": "new"})
        for k, (n, name, note) in batch.items():
            old = held.get(k, (None, None, None))
            held[k] = (old[0] if n is None else n, name if old[1] is None else old[1], note)
        assert content(t.read()) == held


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.merge(rows(spark, [("x", 1, "first", None)]))
    since = b.versions()[-1]
    a.merge(rows(spark, [("x", 2, "second", None)]))
    files = written_files(tmp_path)
    with pytest.raises(ConcurrentWrite):
        b.merge(rows(spark, [("x", 3, "third", None)]), since=since)
    assert content(b.read()) == {"x": (2, "second", None)} and written_files(tmp_path) == files
    assert b.merge(rows(spark, [("x", 3, "third", None)])).version == 2


def test_racing_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def add(i):
        t, tries = table(spark, tmp_path), 0
        while True:
            try:
                t.merge(rows(spark, [(f"w{i}", i, "", "")]))
                return tries
            except ConcurrentWrite:
                tries += 1

    table(spark, tmp_path).merge(rows(spark, [("start", 0, "", "")]))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, range(6)))
    assert set(content(table(spark, tmp_path).read())) == {"start", *(f"w{i}" for i in range(6))}


def test_repeated_keys_and_unchanged_only_deletion(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError, match="repeat"):
        t.merge(rows(spark, [("x", 1, "", ""), ("x", 2, "", "")]))
    assert t.delete(rows(spark, [])).version == -1
    t.merge(rows(spark, [("x", 1, "a", None), ("y", 2, "b", None), ("z", 3, None, None)]))
    gone = t.delete(rows(spark, [("x", 1, "a", None), ("y", 2, "was otherwise", None), ("z", 3, None, None)]))
    assert gone.deleted == 2 and content(t.read()) == {"y": (2, "b", None)}
    assert t.delete(rows(spark, [("x", 1, "a", None)])) == (1, 0, 0, 0, [])
    t.merge(rows(spark, [("y", 5, "b", None)]))
    assert t.vacuum(keep=1) >= 1 and t.versions() == [2] and content(t.read()) == {"y": (5, "b", None)}
