"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams, of single tokens and of the uniform distribution:

    P(w | h) = l2(b) c(hw) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1),    b = the bucket of c(h), by powers of two

with weights for each bucket learned by expectation-maximisation on held-out counts: an eighth of the training
documents is kept apart, and its tokens are predicted from the counts of the others. The mixed estimates are
then taken over all training documents.

Counting goes over blocks of whole documents. A task reads a block, numbers its words, and gives the block's
distinct n-grams (as sorted 64-bit hashes) with their counts, one row for each range of hashes, so a frequent
word or word pair is one entry a block. Ranges are summed up, and each block gets back the totals of its own
n-grams in the order in which it gave them; nothing else about the corpus travels. Blocks are made by a hash
of the document, so every pass makes the same ones.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import written

#: Hash seed of the words; the end token has a hash of its own.
SEED, END = 42, 0
#: Every so many-th block is held out for the weights.
FOLD = 8
#: Steps a doubling in which ratios of probabilities are told apart when the weights are learned.
STEPS = 8


def held_out(doc_id: Column) -> Column:
    """Documents the model doesn't learn from: crc32 of the id as text leaves 1 by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, the last of all bytes first: shuffles compress that."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Block:
    """The tokens of some documents: for each token the place of its word and of its bigram among the sorted keys."""

    def __init__(self, texts: pa.ChunkedArray):
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        end = number[None]
        parts = []
        for text in texts:
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            parts.append(np.fromiter((*map(number.__getitem__, words), end), np.int32, len(words) + 1))
        self.lens = np.array([len(x) for x in parts], np.int64)
        words = np.concatenate([np.zeros(0, np.int32), *parts])
        del parts
        digest = xxhash.xxh64_intdigest
        hashes = np.array([END if w is None else digest(w, SEED) for w in number], np.uint64)
        number.default_factory = None  # else the two refer to each other, and stay
        del number
        self.words, place = np.unique(hashes, return_inverse=True)
        self.word = place.astype(np.int32)[words]
        # A document's first token stands after the end of the one before.
        self.context = np.roll(self.word, 1)
        codes, pair = np.unique(self.context.astype(np.int64) * len(self.words) + self.word, return_inverse=True)
        keys = _mixed(self.words[codes // len(self.words)], self.words[codes % len(self.words)])
        order = np.argsort(keys)
        self.pairs = keys[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair = place[pair]

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.cumsum(self.lens) - self.lens) if len(self.lens) else values[:0]


_RANGES = "range long, block long, words binary, word_counts array<long>, pairs binary, pair_counts array<long>"
_TOTALS = "range long, block long, words array<long>, words_held array<long>, pairs array<long>, pairs_held array<long>"
_LONGS = pa.list_(pa.int64())


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(np.int64)))


def _counts(blocks: DataFrame, ranges: int) -> DataFrame:
    bits = ranges.bit_length() - 1
    range_of = lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

    def count(rows: pa.Table) -> pa.Table:
        block = Block(rows.column("text"))
        learned = np.repeat(rows.column("learned").to_numpy(), block.lens).astype(np.float64)
        # Only ranges with a key of this block, so a block gives no more rows than it has keys.
        of = {"word": range_of(block.words), "pair": range_of(block.pairs)}
        have = np.union1d(of["word"], of["pair"])
        out = {"range": pa.array(have, pa.int64()), "block": pa.array(np.full(len(have), rows.column("block")[0].as_py(), np.int64))}
        for name, keys, place in (("word", block.words, block.word), ("pair", block.pairs, block.pair)):
            cuts = np.append(np.searchsorted(of[name], have), len(keys))
            out[f"{name}s"] = pa.array([_packed(keys[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
            out[f"{name}_counts"] = _lists(np.bincount(place, learned, len(keys)), cuts)
        return pa.table(out)

    def total(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        held = blocks % FOLD == 0
        out, sums = {}, []
        for name in ("word", "pair"):
            keys = [_unpacked(x.as_py()) for x in rows.column(f"{name}s")]
            lens = np.array([len(k) for k in keys], np.int64)
            counts = rows.column(f"{name}_counts").combine_chunks().flatten().to_numpy().astype(np.float64)
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sum_all = np.bincount(place, counts, len(distinct))
            sum_held = np.bincount(place, counts * np.repeat(held, lens), len(distinct))
            cuts = np.concatenate([[0], np.cumsum(lens)])
            out[f"{name}s"] = _lists(sum_all[place], cuts)
            asked = np.repeat(held, lens)
            out[f"{name}s_held"] = _lists(sum_held[place][asked], np.concatenate([[0], np.cumsum(lens * held)]))
            sums += [sum_all.sum(), sum_held.sum(), np.count_nonzero(sum_all), np.count_nonzero(sum_all > sum_held)] if name == "word" else []
        own = rows.column("range")[0].as_py()
        table = pa.table({"range": pa.array([own] * len(blocks), pa.int64()), "block": pa.array(blocks), "words": out["words"], "words_held": out["words_held"], "pairs": out["pairs"], "pairs_held": out["pairs_held"]})
        empty = pa.array([[]], _LONGS)
        summed = pa.table({"range": pa.array([own]), "block": pa.array([-1]), "words": pa.array([[int(x) for x in sums]], _LONGS), "words_held": empty, "pairs": empty, "pairs_held": empty})
        return pa.concat_tables([table, summed])

    return blocks.groupBy("block").applyInArrow(count, _RANGES).groupBy("range").applyInArrow(total, _TOTALS)


def _ordered(totals: pa.Table, name: str) -> np.ndarray:
    return totals.sort_by("range").column(name).combine_chunks().flatten().to_numpy()


def _context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def _estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), word / max(n, 1)


def _ratios(blocks: DataFrame, totals: DataFrame, n: int, v: int) -> DataFrame:
    """How often held-out training tokens have which ratios of the estimates to the uniform one, by context bucket."""

    def count(rows: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(rows.column("text"))
        words = _ordered(totals, "words") - _ordered(totals, "words_held")
        pairs = _ordered(totals, "pairs") - _ordered(totals, "pairs_held")
        asked = np.repeat(rows.column("learned").to_numpy(), block.lens)
        context = words[block.context][asked]
        steps = [np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) * (v + 1))), -1e4).astype(np.int64) for p in _estimates(pairs[block.pair][asked], context, words[block.word][asked], n)]
        bins, counts = np.unique(np.stack([_context_bucket(context), *steps], axis=1), axis=0, return_counts=True)
        return pa.table({"bucket": bins[:, 0], "r2": bins[:, 1], "r1": bins[:, 2], "n": counts})

    found = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(count, "bucket long, r2 long, r1 long, n long")
    return found.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))


def learn_weights(bins: list[tuple[int, int, int, int]], rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Weights (l2, l1, l0) by context bucket, from (bucket, r2, r1, count); 64 rows.

    All buckets together come first; each bucket then starts from their weights, which count like ``prior``
    held-out tokens, so rare buckets stay near them and no l0 is 0. Contexts never seen leave nothing to bigrams.
    """
    data = np.array(bins, np.int64).reshape(-1, 4)
    parts = np.stack([np.where(data[:, k] <= -10_000, 0.0, 2.0 ** (np.maximum(data[:, k], -9000) / STEPS)) for k in (1, 2)] + [np.ones(len(data))], axis=1)

    def em(rows: np.ndarray, start: np.ndarray, strength: float) -> np.ndarray:
        weights = start
        for _ in range(rounds):
            share = weights * parts[rows]
            share /= share.sum(axis=1, keepdims=True)
            weights = (data[rows, 3] @ share + strength * start) / (data[rows, 3].sum() + strength)
        return weights

    pooled = em(np.arange(len(data)), np.array([1 / 3, 1 / 3, 1 / 3]), 3.0)
    out = np.stack([em(np.flatnonzero(data[:, 0] == b), pooled, prior) for b in range(64)])
    out[0, 1:] /= out[0, 1:].sum()
    out[0, 0] = 0
    return out


def lm_scores(docs: DataFrame, block_bytes: int = 8_000_000, range_bytes: int = 8_000_000) -> DataFrame:
    """Scores every whole text of docs (doc_id, text) with a model of those that held_out() leaves.

    A-Z lower-cased; tokens: runs without ASCII white space, then an end token. Gives doc_id, held_out, n_tokens,
    n_known (tokens seen in training), train_tokens (N), base_score (single tokens, add 0.5), score (the model's)
    as log10. A null text counts as empty (the end token); a null doc_id is kept; repeated rows are learned from
    and scored each; an empty table gives no rows; other columns are ignored. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(FOLD, math.ceil(size / block_bytes))
    ranges = 1 << max(0, math.ceil(math.log2(max(size, 1) / range_bytes)))
    blocks = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").withColumn("learned", ~F.col("held_out"))

    totals = written(_counts(blocks.select("block", "learned", "text"), ranges), "lm-counts")
    part = totals.filter("block = -1").select(*[F.coalesce(F.sum(F.get("words", F.lit(k))), F.lit(0)) for k in range(4)]).first()
    n, n_held, v, v_kept = map(int, part)
    own = totals.filter("block >= 0")
    # As many rows as there are bins at most, whatever the input.
    bins = _ratios(blocks.filter(F.col("block") % FOLD == 0).select("block", "learned", "text"), own.filter(F.col("block") % FOLD == 0), n - n_held, v_kept).collect()
    weights = learn_weights([tuple(r) for r in bins])

    def score(rows: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(rows.column("text"))
        words, pairs = _ordered(totals, "words"), _ordered(totals, "pairs")
        word, context = words[block.word], words[block.context]
        mix = weights[_context_bucket(context)]
        p2, p1 = _estimates(pairs[block.pair], context, word, n)
        p = mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (v + 1)
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "n_tokens": block.lens,
                "n_known": block.by_doc((word > 0).astype(np.int64)),
                "train_tokens": np.full(len(block.lens), n, np.int64),
                "base_score": block.by_doc(base),
                "score": block.by_doc(np.log10(p)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.drop("learned").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, schema)
