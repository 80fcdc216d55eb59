"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask selects some positions of a window of words and ignores the others, so a substituted word spoils only
the windows where it stands at a selected position. The hashes under fixed masks of all windows of the
benchmark and of the documents are joined. A hit aligns an item with a document; there the words are held
against each other one by one, substitutions allowed, insertions not (the parts around one align by themselves).

Items shorter than the compared window have contiguous seeds too: as many parts as substitutions are allowed, and
one, so that one part has none. The documents are seeded by the lengths of these parts, where there are any.

The benchmark's seeds are broadcast while they are few (max_broadcast, by count), as are candidates;
beyond that they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import GAP, checkpointed, whole_row

#: Selected positions of each mask; both span eight words.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 7))
SPAN = 8
#: What a word is made of; all else but white space is taken out first.
NOISE = r"[^\p{L}\p{N}\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words without punctuation; null as empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOISE, "")
    return F.transform(F.filter(F.split(plain, GAP), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(hashes: Column) -> Column:
    """The hashes under all masks, window by window; none for fewer words than a mask spans."""
    at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - SPAN, F.lit(0)))
    each = F.transform(at, lambda i: F.array(*[F.xxhash64(F.lit(m), *[F.get(hashes, i + k) for k in mask]) for m, mask in enumerate(MASKS)]))
    return F.when(F.size(hashes) < SPAN, F.array().cast("array<bigint>")).otherwise(F.flatten(each))


def run_seeds(hashes: Column, n: int) -> Column:
    """The hashes of all runs of n words in order; none for fewer words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0)))
    return F.when(F.size(hashes) < n, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.lit(-n), *[F.get(hashes, i + k) for k in range(n)])))


def parts(n: int, least: int) -> list[tuple[int, int]]:
    """Begin and end of the parts of an item of n words, one more than the substitutions that ``least`` per cent allow."""
    count = min(n - -(-n * least // 100) + 1, n)
    return [(n * i // count, n * (i + 1) // count) for i in range(count)]


def _limited(df: DataFrame, max_broadcast: int) -> DataFrame:
    """df, for broadcasting if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= max_broadcast else df


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, least: int = 80, max_broadcast: int = 400_000) -> DataFrame:
    """Benchmark items (item_id, text) in docs (doc_id, text): a row for each pair of row contents and item_id.

    An item is in a document if, aligned by a seed, at least ``least`` per cent of the words agree in some ``window``
    neighbouring words of the item (in all of a shorter item). Gives key, check (hashes of the document's row), doc_id,
    item_id, start (the document's word where the overlap begins), overlap and n_matches, of the alignment with
    most matches, the first of those. Items shorter than ``window`` are found under any substitutions allowed.
    Null texts have no words; null ids are kept as null; repeated rows count once; empty tables give no rows.
    """
    items = checkpointed(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), word_hashes(benchmark["text"]).alias("item")).distinct())
    item_seeds = items.select("item_id", "item", F.posexplode(seeds(F.col("item"))).alias("at", "seed"))
    item_seeds = item_seeds.select("seed", "item_id", (F.col("at") / len(MASKS)).cast("int").alias("item_at"), F.xxhash64("item").alias("item_key"))
    short = sorted(r.n for r in items.select(F.size("item").alias("n")).filter((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())
    for n in short:
        runs = [F.struct(F.xxhash64(F.lit(a - b), *[F.get("item", F.lit(k)) for k in range(a, b)]).alias("seed"), F.lit(a).alias("at")) for a, b in parts(n, least)]
        item_seeds = item_seeds.union(items.filter(F.size("item") == n).select("item_id", F.xxhash64("item").alias("item_key"), F.explode(F.array(*runs)).alias("r")).select("r.seed", "item_id", F.col("r.at").alias("item_at"), "item_key"))
    item_seeds = checkpointed(item_seeds.distinct())
    row = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    keyed = row.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", word_hashes(F.col("text")).alias("words"))
    found = keyed.select("key", "check", "doc_id", F.posexplode(seeds(F.col("words"))).alias("at", "seed")).withColumn("at", (F.col("at") / len(MASKS)).cast("int"))
    for n in sorted({b - a for m in short for a, b in parts(m, least)}):
        found = found.union(keyed.select("key", "check", "doc_id", F.posexplode(run_seeds(F.col("words"), n)).alias("at", "seed")))
    hits = found.join(_limited(item_seeds, max_broadcast), "seed")
    aligned = hits.select("key", "check", "doc_id", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    aligned = _limited(checkpointed(aligned), max_broadcast)
    words = keyed.drop("doc_id").join(aligned, ["key", "check"])
    own = items.select(F.xxhash64("item").alias("item_key"), F.col("item_id").alias("own_id"), "item")
    both = words.join(_limited(own, max_broadcast), "item_key").filter(F.col("own_id").eqNullSafe(F.col("item_id")))
    first = F.greatest(-F.col("shift"), F.lit(0))
    until = F.least(F.size("item"), F.size("words") - F.col("shift"))
    same = F.transform(F.sequence(first, until - 1), lambda k: (F.get(F.col("item"), k) == F.get(F.col("words"), k + F.col("shift"))).cast("int"))
    checked = both.select("key", "check", "doc_id", "item_id", (first + F.col("shift")).alias("start"), same.alias("same"), F.least(F.size("item"), F.lit(window)).alias("width"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = F.sequence(F.lit(1), F.size("same") - F.col("width") + 1)
    good = F.exists(windows, lambda i: total(F.slice(F.col("same"), i, F.col("width"))) * 100 >= F.col("width") * least)
    kept = checked.filter(F.size("same") >= F.col("width")).filter(good)
    best = F.min(F.struct((-total(F.col("same"))).alias("less"), "start", F.size("same").alias("overlap"))).alias("best")
    pairs = kept.groupBy("key", "check", "doc_id", "item_id").agg(best)
    return pairs.select("key", "check", "doc_id", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "overlap")], (-F.col("best.less")).cast("long").alias("n_matches"))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that tell rows apart by doc_id and text, never null."""
    return [F.xxhash64(doc_id, text).alias("key"), F.hash(text, doc_id).alias("check")]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, least: int = 80) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all columns of docs as they are."""
    found = checkpointed(leaks(docs, benchmark, window, least).select("key", "check").distinct())
    row = docs.select(whole_row(docs), *row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return row.join(_limited(found, 400_000), ["key", "check"], "left_anti").select("row.*")
