"""Quality rules: a base rule on word statistics, then a decision list learned from labelled documents.

Everything on documents is Spark SQL functions within a row, so nothing is shuffled but the labelled sample.
The list is learned by sequential covering: while rejected documents are left, a conjunction of thresholds
grows by information gain on two thirds of the labelled sample, is pruned on the other third, and is kept
if precise enough; the documents that it covers go, and the next one grows. The result is an ordered list
of Spark conditions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import GAP, whole_row

SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _windows(words: Column) -> Column:
    """A hash for each 5-word window; none for texts that have only one window."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 5, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) < 6, F.array().cast("array<bigint>")).otherwise(hashes)


def _repeated(windows: Column) -> Column:
    """Words in windows found twice or more. A sort and its walk are made only for texts that repeat a window."""

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, j)["w"] == F.get(s, i)["w"]
        twice = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    # Each place in order adds the words up to the next one, five at most.
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    numbered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(numbered, lambda s: _let(places(s), covered))).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """The base counts of a text, null as empty, as a struct. Windows are equal if their 64-bit hashes are."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    counts = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(_windows(w), _repeated).cast("long").alias("n_repeat_words"),
    )
    return F.transform(F.array(words), counts)


#: What the list may test: ratios of the counts, so that no rule hangs on a text's length alone.
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}

#: Columns that judge() gives.
GIVEN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts as columns. They come out of inline(), below which no filter on them is pushed."""
    return docs.select("*", F.inline(statistics(F.col(text))))


@dataclass
class Rule:
    """Rejects where all tests (feature, '<=' or '>', threshold) hold."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)
    precision: float = 0.0

    def condition(self) -> Column:
        out = F.lit(True)
        for feature, sign, threshold in self.tests:
            value = F.expr(FEATURES[feature])
            out = out & (value <= threshold if sign == "<=" else value > threshold)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{f} {s} {t:g}" for f, s, t in self.tests)


def _bits(flags: list[bool]) -> int:
    return int("".join("1" if x else "0" for x in reversed(flags)) or "0", 2)


def _gain(now: tuple[int, int], then: tuple[int, int]) -> float:
    (p0, n0), (p1, n1) = now, then
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def learn_rules(rows: list[dict], min_precision: float = 0.9, min_covered: int = 5, max_rules: int = 8, max_tests: int = 3, cuts: int = 24) -> list[Rule]:
    """A decision list from labelled rows: the FEATURES and ``bad``. Rows are sets of bits, so a test is an AND.

    Every third row prunes; the others grow. Ties go to the feature that comes first, then to the lower
    threshold. No rows, or rows of one label only, give no rules.
    """
    tests: list[tuple[tuple, int]] = []
    for feature in FEATURES:
        values = sorted({r[feature] for r in rows})
        between = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]  # halfway, so that neither side is close
        for t in sorted({between[len(between) * k // cuts] for k in range(cuts)}) if between else []:
            above = _bits([r[feature] > t for r in rows])
            tests.append(((feature, ">", t), above))
            tests.append(((feature, "<=", t), ((1 << len(rows)) - 1) ^ above))
    bad = _bits([r["bad"] for r in rows])
    prune = _bits([i % 3 == 2 for i in range(len(rows))])
    left = (1 << len(rows)) - 1
    count = lambda bits: ((bits & bad).bit_count(), (bits & ~bad).bit_count())
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad & ~prune).bit_count() >= min_covered:
        chosen, covered = [], left
        while len(chosen) < max_tests and count(covered & ~prune)[1]:
            now = count(covered & ~prune)
            best = max(tests, key=lambda x: _gain(now, count(covered & ~prune & x[1])))
            if _gain(now, count(covered & ~prune & best[1])) <= 0:
                break
            chosen.append(best)
            covered &= best[1]
        if not chosen:
            break

        def worth(tests: list[tuple]) -> tuple[float, int]:
            bits = left & prune
            for _, b in tests:
                bits &= b
            p, n = count(bits)
            return ((p - n) / (p + n) if p + n else -1.0, -len(tests))

        chosen = max((chosen[:k] for k in range(1, len(chosen) + 1)), key=worth)
        covered = left
        for _, b in chosen:
            covered &= b
        p, n = count(covered)
        pp, pn = count(covered & prune)
        if p < min_covered or p / (p + n) < min_precision or (pp + pn and pp / (pp + pn) < min_precision):
            break
        rules.append(Rule([t for t, _ in chosen], p / (p + n)))
        left &= ~covered
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list[dict]:
    """Features and labels of labelled documents: those of at most max_labelled labels, the first by hash of the id.

    Labels without an id or a quality are left out; where an id has more labels, any that says 0 counts.
    """
    asked = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
        .dropna()
        .groupBy("doc_id")
        .agg((F.min("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    # At most max_labelled rows of two small columns, by the limit above.
    sample = with_statistics(texts.join(F.broadcast(asked), "doc_id")).filter(f"NOT ({BASE_FAILED})")
    rows = sample.select("doc_id", "bad", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])
    return [r.asDict() for r in rows.orderBy(F.xxhash64("doc_id"), *FEATURES).limit(2 * max_labelled).collect()]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed, rule (the number of the first learned rule that rejects, else null) and kept.

    docs has text; its own columns of these names are replaced. A null text has no words, so the base rule
    fails it. Without rules the base rule decides alone.
    """
    out = with_statistics(docs.drop(*GIVEN)).withColumn("base_failed", F.expr(BASE_FAILED))
    listed = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        listed = F.when(rules[k].condition(), F.lit(k + 1)).otherwise(listed)
    return out.withColumn("rule", F.when(~F.col("base_failed"), listed)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Judges every whole text of docs (doc_id, text) by rules learned from labels (doc_id, quality; 0 is bad).

    The rules are learned from the documents of at most max_labelled labels. One row per row of docs, repeated
    ones included; an empty table gives none; unlabelled tables leave the base rule.
    """
    rules = learn_rules(labelled_rows(docs, labels, max_labelled))
    return judge(docs.select("doc_id", "text"), rules)


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """The rows of docs that the rules keep, with all columns of docs as they are."""
    rules = learn_rules(labelled_rows(docs, labels, max_labelled))
    return judge(docs.select(whole_row(docs), docs["text"].alias("text")), rules).filter("kept").select("row.*")
