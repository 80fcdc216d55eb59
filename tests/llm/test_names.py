"""Extra columns with names that the operators use themselves, or that need quoting."""

from tarifa.llm import decontaminate, quality_rules, simhash

NAMES = ["doc_id", "text", "a.b", "n_words", "kept", "rule", "row", "rid", "keys", "key", "check", "fingerprint", "place"]


def test_extra_columns_come_back_as_they_are(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{words} d{k} {' '.join(f'x{k}y{j}' for j in range(100))}", *[f"{name}{k}" for name in NAMES[2:]]) for k in range(6)]
    rows += [(6, rows[0][1], *rows[0][2:]), (None, None, *[None] * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES[2:]))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, " ".join(f"x3y{j}" for j in range(40)))], "item_id long, text string")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == NAMES and {tuple(r) for r in kept.collect()} == set(rows[:7])
    judged = quality_rules.quality_rules(docs, labels)
    assert judged.count() == 8 and judged.columns[0] == "doc_id"
    assert quality_rules.judge(docs, []).count() == 8
    one = simhash.drop_near_duplicates(docs)
    assert one.columns == NAMES and {tuple(r) for r in one.collect()} == {*rows[:6], rows[7]}
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == NAMES and {tuple(r) for r in clean.collect()} == {*rows[:3], *rows[4:]}
