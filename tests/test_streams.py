"""The publisher with keyed state against the batch fold; deduplication over any time."""

import random

import numpy as np

from tarifa.plans import publish
from tarifa.streaming import keyed, seen

from test_core import BATCH, STATE, day  # noqa: I001


def stream(spark, source):
    return spark.readStream.schema(BATCH).parquet(str(source))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def observed(seed, n, keys=4):
    r = random.Random(seed)
    return [(r.randrange(keys), k, day(1 + k // 8 + r.randrange(3)) if r.random() < 0.95 else None, r.choice([10, 11]), True, r.choice(["s", "t", None])) for k in range(n)]


def test_keyed_state_decides_like_the_batch_over_restarts(spark, tmp_path):
    rows, source, out = observed(3, 90), tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate((rows[:20], rows[20:35], rows[35:50], rows[50:])):
        spark.createDataFrame(part, BATCH).coalesce(2).write.mode("append" if n < 2 else "overwrite").parquet(str(source))
        # The third part starts a stream with a new checkpoint, the fourth goes on with it.
        run(keyed.publishing(stream(spark, source), out, str(tmp_path / ("first" if n < 2 else "second")), state=STATE))
    got = {r.position: r.action for r in keyed.decisions(spark, out).collect()}
    assert got == {r.position: r.action for r in publish.decided(spark.createDataFrame(rows, BATCH), state=STATE).collect()}


def test_fold_equals_a_loop():
    r = np.random.default_rng(1)
    for _ in range(300):
        at = np.where(r.random(12) < 0.1, keyed.NEVER, r.integers(0, 5, 12))
        facts = np.array([("a", "b")[i] for i in r.integers(0, 2, 12)], object)
        seen_, known = (None, None) if r.random() < 0.5 else (int(r.integers(0, 4)), "a")
        wanted, top, held = [], seen_, known
        for t, f in zip(at.tolist(), facts, strict=True):
            if t == keyed.NEVER:
                wanted.append("late")
            elif top is None or t > top:
                wanted.append("unchanged" if top is not None and f == held else "insert")
                top, held = t, f
            else:
                wanted.append("late" if t < top else "replay" if f == held else "conflict")
        action, after, facts_after = keyed.folded(at, facts, seen_, known)
        assert (action.tolist(), after, facts_after) == (wanted, top, held)


KEYS = "source string, content_hash string, n long"


def test_repeats_are_found_over_any_time(spark, tmp_path):
    r, held, index = random.Random(2), set(), seen.SeenIndex(spark, str(tmp_path / "i"), buckets=8)
    for number in range(4):
        batch = [(r.choice(["s", "t", None]), r.choice([None, *(f"h{r.randrange(60)}" for _ in range(9))]), number * 100 + k) for k in range(40)]
        wanted, fresh = set(), set()
        for source, content, n in batch:
            if (source, content) not in held | fresh:
                fresh.add((source, content))
                wanted.add(n)
        for _ in range(2 if number == 2 else 1):  # a batch that runs again gives the same
            got = index.new_rows(spark.createDataFrame(batch, KEYS), f"b{number}", ["n"])
            assert got.columns == ["source", "content_hash", "n"] and {x.n for x in got.collect()} == wanted
        held |= fresh
    assert {(x.source, x.content_hash) for x in index.index.read().collect()} == held and index.index.read().count() == len(held)
    index.compact(writes=1)
    assert {x.n for x in index.new_rows(spark.createDataFrame([(*k, 1) for k in held] + [("new", "x", 2)], KEYS), "last", ["n"]).collect()} == {2}


def test_filters_spare_the_index(spark, tmp_path):
    index = seen.SeenIndex(spark, str(tmp_path / "i"), buckets=4)
    index.new_rows(spark.range(4000).selectExpr("'s' AS source", "cast(id AS string) AS content_hash", "id AS n"), "a", ["n"])
    other = index._hashed(spark.range(4000, 8000).selectExpr("'s' AS source", "cast(id AS string) AS content_hash"))
    assert index.maybe_seen(other).filter("maybe").count() < 120
    assert index.maybe_seen(index._hashed(spark.range(4000).selectExpr("'s' AS source", "cast(id AS string) AS content_hash"))).filter("maybe").count() == 4000


def test_stream_keeps_each_key_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for n, (part, checkpoint) in enumerate([([("s", "a", 1), ("s", "b", 2)], "x"), ([("s", "a", 3), ("t", "a", 4)], "x"), ([("s", "b", 5), ("s", "c", 6)], "y")]):
        source = tmp_path / f"in{0 if n < 2 else 1}"
        spark.createDataFrame(part, KEYS).coalesce(1).write.mode("append").parquet(str(source))
        run(seen.first_seen_ever(spark.readStream.schema(KEYS).parquet(str(source)), out, str(tmp_path / checkpoint), ["n"], buckets=4))
    assert {r.n for r in spark.read.parquet(f"{out}/rows").collect()} == {1, 2, 4, 6}
