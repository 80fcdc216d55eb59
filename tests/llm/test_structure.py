"""Conversation repair, centroid clustering and the n-gram join against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarifa.llm import centroids, ngram_join, turn_repair
from tarifa.llm import queries as Q

SPACE = " \t\n\x0b\x0c\r"


# Conversation repair


def damage(rows):
    """conv_id: its rows after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv] += []
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    place = lambda r: (r[0] is not None, r[0] or 0, r[1][:16], r[2][:16], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(v, key=place) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By automaton, a turn at a time: state: (cost, audit, repaired lines), all edits in all orders, up to three inserts in a row."""
    kinds = faults(rows)
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for at, (cost, audit, lines) in list(out.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if at in step[initial]:
                        put(out, step[initial][at], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return out

    best = inserted(best)
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for at, (cost, audit, lines) in best.items():
            put(after, at, (cost + 3, audit + "D", lines))
            if kind in ("blank", "duplicate"):
                continue
            more = kind == "truncated"
            if at in step.get(role[:1], {}):
                put(after, step[role[:1]][at], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for initial, new in (("u", "user"), ("a", "assistant")):
                if at in step[initial]:
                    put(after, step[initial][at], (cost + 2 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = inserted(after)
    return min(v for k, v in best.items() if k in (0, 3))


def judged(conv, rows):
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    kinds = faults(rows)
    cost, audit, lines = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def op12(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS copies", "1 AS place", "2 AS `a.b`").repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in Q.op12_turn_repair(spark, str(tmp_path)).select(*columns).collect()), key=str)


def conversations(seed, n, longest):
    r = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "usher"]
    texts = ["Yes.", "no", "What? ", " ", "", None, "Ünï!", "a\n", "…", "Go on!\t"]
    rows = []
    for conv in range(n):
        for turn in range(int(r.integers(1, longest))):
            good = r.random() < 0.6
            role = ("user", "assistant")[turn % 2] if good else roles[r.integers(len(roles))]
            text = f"{conv} {turn}." if r.random() < 0.5 else texts[r.integers(len(texts))]
            number = None if r.random() < 0.05 else int(turn if r.random() < 0.9 else r.integers(-5, 40))
            rows += [(conv if conv else None, number, role, text)] * (3 if r.random() < 0.05 else 1)
    return rows


def test_repair_equals_brute_force(spark, tmp_path):
    rows = conversations(1, 150, 12)
    assert op12(spark, tmp_path, rows) == sorted((judged(c, v) for c, v in damage(rows).items()), key=str)


def test_long_conversation_over_many_tasks(spark, tmp_path):
    rows = conversations(2, 6, 8) + [(7, i, ("user", "assistant", "assistant", "user", "user")[i % 5], ("Yes.", f"{i}!", f"{i}", "ok.")[i * i % 4]) for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = op12(spark, tmp_path, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == sorted((judged(c, v) for c, v in damage(rows).items()), key=str)


def test_conversation_without_turns_and_empty_table(spark, tmp_path):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert op12(spark, tmp_path / "a", [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert op12(spark, tmp_path / "b", []) == []


def test_products_are_associative():
    r = np.random.default_rng(3)
    turns = [(i, k) for i in ("s", "u", "a", "") for k in range(3)]
    for _ in range(200):
        picked = tuple(turns[i] for i in r.integers(len(turns), size=r.integers(2, 9)))
        cut = int(r.integers(1, len(picked)))
        whole = turn_repair.word(picked)
        assert whole == turn_repair.product(turn_repair.word(picked[:cut]), turn_repair.word(picked[cut:]))


# Centroid clustering


def lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(float(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centres = [v for _, v in sorted(named)[:k]]
    if not centres:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    by = defaultdict(int)
    for d, c in of:
        by[c] += d
    total, fits = sum(by.values()), lambda x: x if x < 1 << 63 else None
    if any(fits(d) is None for d, _ in of):
        total = None
        by = {c: None if any(fits(d) is None for d, x in of if x == c) else s for c, s in by.items()}
    shown = [(i, c, fits(d), by[c], total if total is None else fits(total), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, of, strict=True)]
    return sorted(shown, key=str)


def op11(spark, tmp_path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS cluster", "2 AS looked", "3 AS `a.b`").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in Q.op11_centroids(spark, str(tmp_path)).collect()), key=str)


def vectors(n, seed, spread=1.0):
    r = np.random.default_rng(seed)
    middles = r.normal(0, 1, (9, 64))
    return [(int(i), [float(np.float32(x)) for x in middles[i % 9] + r.normal(0, spread, 64)]) for i in range(n)]


def test_clusters_equal_full_scans(spark, tmp_path):
    rows = vectors(400, 1, 0.7) + [(900 + i, [0.0] * 64) for i in range(20)]
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [None] + [0.0] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [float("inf")] * 64), (None, [0.25] * 64), (None, [0.25] * 64), (5, [0.5] * 64), (5, [0.5] * 64)]
    assert op11(spark, tmp_path, rows) == lloyd(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_ties_and_close_vectors(spark, tmp_path, seed):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) / 64 for x in r.integers(0, 2, 64)]) for i in range(300)]
    assert op11(spark, tmp_path, rows) == lloyd(rows)


def test_huge_components_are_exact(spark, tmp_path):
    rows = vectors(40, 4) + [(100 + i, [float(np.float32(x * 10.0 ** (i % 30 + 5))) for x in v]) for i, v in vectors(40, 5)]
    assert op11(spark, tmp_path, rows) == lloyd(rows)


def test_few_or_no_vectors(spark, tmp_path):
    assert op11(spark, tmp_path / "a", []) == []
    few = vectors(3, 6)
    assert op11(spark, tmp_path / "b", few) == lloyd(few)
    assert op11(spark, tmp_path / "c", few[:1], "double") == lloyd(few[:1])
    assert op11(spark, tmp_path / "d", [(None, [0.0] * 64)]) == []


def test_bounds_spare_most_of_the_measuring():
    rows = np.floor(np.array([v for _, v in vectors(2000, 7, 0.2)]) * 64)
    centres = [list(map(int, v)) for v in rows[:16]]
    state = centroids.Bounds(rows, centres, 4)
    moved = [[x + (i < j % 3) for i, x in enumerate(c)] for j, c in enumerate(centres)]
    drift = np.array([np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) for p, q in zip(centres, moved, strict=True)])
    state.moved(drift, moved)
    assert (state.cluster == centroids._squares(rows, moved).argmin(axis=1)).all()
    assert (state.looked < 16).mean() > 0.9


# N-gram join


def joined(rows, shingle=4, percent=85):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            of[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def family(seed, n, length, edits, vocabulary=3000):
    """Copies of one text with some words changed."""
    r = np.random.default_rng(seed)
    base = r.integers(0, vocabulary, length)
    out = []
    for _ in range(n):
        own = base.copy()
        own[r.integers(0, length, int(r.integers(0, edits)))] = r.integers(0, vocabulary)
        out.append(" ".join(f"w{x}" for x in own))
    return out


def op13(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS rid", "'x' AS key", "2 AS `a.b`", "3L AS size").repartition(3)
    found = ngram_join.join(docs, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=str)


ODD = [None, "", " \n\t", "one", "One", "one two", "ONE  two\n", "one two three", "a b c d", "A b\x0bc d", "x" * 70_000, "ünï cödé 東京 😀  nbsp", "a b c d e"]


def test_join_equals_all_pairs(spark):
    texts = ODD + family(1, 25, 60, 4) + family(2, 25, 9, 2) + family(3, 12, 400, 40) + family(4, 10, 7, 2) + ODD[3:6]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "nobody's text is here")]
    expected = joined(rows)
    assert op13(spark, rows) == expected
    assert op13(spark, rows, rare=1, share=8, cell=7, block_chars=500, range_chars=64) == expected


@pytest.mark.parametrize("options", [{"rare": 1}, {"rare": 3, "k": 3, "share": 16}, {"rare": 2, "cell": 3, "block_chars": 1}])
def test_frequent_tokens_are_found_by_combinations(spark, options):
    shared = [f"licence {i}" for i in range(40)]
    r = np.random.default_rng(5)
    texts = family(6, 40, 80, 9) + [" ".join([*shared, *(f"q{x}" for x in r.integers(0, 10**6, n))]) for n in (1, 2, 3, 5, 9, 12, 14, 15, 30, 60)]
    rows = list(enumerate(texts))
    assert op13(spark, rows, **options) == joined(rows)


@pytest.mark.parametrize("percent", [50, 70, 100])
def test_other_thresholds(spark, percent):
    texts = family(7, 20, 30, 12) + family(8, 20, 5, 3, 6) + ["a", "a b", "b a", "a a a a a", "a a a a a b"]
    rows = list(enumerate(texts))
    assert op13(spark, rows, percent=percent, shingle=2, rare=2) == joined(rows, 2, percent)


def test_join_of_nothing(spark):
    assert op13(spark, []) == []
    assert op13(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 19, 20, 39, 40, 41])
def test_exactly_at_the_threshold(n):
    """Of all sets of n tokens and k more or others, exactly the similar ones share a key."""
    levels = ngram_join.Levels(85, 2, 32, 1 << 40)
    tokens = np.arange(1000, 1200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for m in range(n, n + 9):
        for common in range(n + 1):
            if 100 * common >= 85 * (n + m - common) and (n, m) != (common, common):
                a, b = tokens[:n], np.concatenate([tokens[n - common : n], tokens[100 : 100 + m - common]])
                for often in (False, True):
                    keys = [ngram_join.index_keys(np.sort(x), np.full(len(x), often), 0, len(x), 85, 2, levels) for x in (a, b)]
                    assert len(np.intersect1d(*keys)), (n, m, common)
