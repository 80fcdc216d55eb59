"""Similarity join of documents by their sets of word n-grams: prefixes of token combinations, then exact checks.

A token is the hash of an n-gram. Sets are sorted by document frequency, rare tokens first. Two sets of n and m tokens with a Jaccard
similarity of at least t have at least t * max(n, m) tokens in common, so their prefixes of n - ceil(t n) + s tokens have s in common.
Frequent tokens belong to g groups by hash. With s = 1 + g (k - 1), the common tokens of two prefixes include a rare one, or k frequent
ones of one group: so rare tokens are indexed one by one, frequent ones as combinations of k of a group, and nothing is missed.
g grows with the size of a set, so that a group has few tokens of a prefix; sizes are cut into levels, and a set is indexed for its own
level and the next, the only ones its partners can have.

Frequencies are counted without a row for each token: a block of documents sends each range of hashes what it has there, sorted, and gets back
the frequencies of the tokens that are in other documents too. Tokens of one document are in no index.

Candidates meet in buckets of equal keys. A parity bitmap of each set bounds how much two sets differ, so few candidates are read for
the exact check. Members of a bucket are compared with its first member, and then, between those that links don't connect yet, with each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import checkpointed, small_batches, written
from tarifa.llm.shingle_sets import may_link, shingle_sets, similar
from tarifa.llm.shingle_sets import ODD, mix, shingle_keys
from tarifa.llm.simhash import _buckets, components

#: Bits of a token that are sent; the range adds what it stands for.
REST = 40


def at_least(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The fewest tokens in common of a set of that size with any similar one."""
    return -(-size * percent // 100)


class Levels:
    """Sizes of sets by level: partners differ by one level at most. groups[i] is the number of groups of frequent tokens, 0 for a level whose sets are too
    small for combinations of k: there all tokens are indexed one by one."""

    def __init__(self, percent: int, k: int, share: int, upto: int):
        starts = [1]
        while percent < 100 and starts[-1] <= upto:  # at 100 only equal sets are similar
            starts.append(starts[-1] * 100 // percent + 1)
        starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts)
        lowest = [starts[max(i - 1, 0)] for i in range(len(starts))]
        groups = [-(-s // share) for s in starts]
        self.groups = np.array([g if 1 + g * (k - 1) <= at_least(low, percent) else 0 for g, low in zip(groups, lowest, strict=True)])

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1


def index_keys(tokens: np.ndarray, frequent: np.ndarray, unshared: int, size: int, percent: int, k: int, levels: Levels) -> np.ndarray:
    """The keys of a set under which all similar sets are found. tokens: those that other documents have, in the global order;
    frequent: which of them are; unshared: how many others the set has, all before them."""
    out, begin = [], size - at_least(size, percent) - unshared
    top = levels.of(size)
    for level in (top, top + 1):
        groups = int(levels.groups[level])
        prefix = max(0, begin + 1 + groups * (k - 1))
        own, common = tokens[:prefix], frequent[:prefix]
        out.append(mix(own[~common]))
        many = own[common]
        if not groups:
            out.append(mix(many + np.uint64(level)) ^ np.uint64(1))
            continue
        group = (many >> np.uint64(11)) % np.uint64(groups)
        order = np.lexsort((many, group))
        many, group = many[order], group[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(many)]])
        for a, b in itertools.pairwise(cuts.tolist()):
            if b - a >= k:
                chosen = np.array(list(itertools.combinations(range(a, b), k)), np.int64).reshape(-1, k)
                key = np.full(len(chosen), level, np.uint64)
                for i in range(k):
                    key = mix(key * ODD[i] + many[chosen[:, i]])
                out.append(key)
    return np.unique(np.concatenate(out))


#: What blocks of documents and ranges of tokens tell each other: part is who gets it. A message has a document (digest or size 0), or the
#: tokens of a range, or groups: the documents of the tokens that several documents of the block have.
MESSAGE = "part long, block long, kind int, at binary, tokens binary, counts binary, place int, doc_id long, digest binary, text_hash binary, size long"
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
DOCUMENT, TOKENS, GROUPS = range(3)


def _messages(kind: int, **columns: list) -> pa.RecordBatch:
    n = len(columns["block"])
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    return list(itertools.pairwise([0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]))


def _sent(docs: DataFrame, shingle: int, ranges: int, block_chars: int) -> DataFrame:
    """The messages of blocks of docs (doc_id, text_hash, text)."""
    shift = 64 - (ranges - 1).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            chars, begin = pc.utf8_length(batch.column("text")).to_pylist(), 0
            while begin < len(chars):
                end, size = begin, 0
                while end < len(chars) and (end == begin or size + (chars[end] or 0) <= block_chars):
                    size, end = size + (chars[end] or 0), end + 1
                n = end - begin
                keys, counts = shingle_keys(batch.column("text").slice(begin, n).to_pylist(), shingle)
                ends = np.cumsum(counts)
                sets = [np.unique(keys[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                own = batch.slice(begin, n)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                to = [int.from_bytes(hashlib.blake2b(b"%d" % (block + i), digest_size=6).digest()) for i in range(n)]
                yield _messages(DOCUMENT, part=to, block=[block] * n, place=list(range(n)), doc_id=own.column("doc_id").to_pylist(), digest=digests, text_hash=own.column("text_hash").to_pylist(), size=[len(x) for x in sets])
                tokens = np.concatenate(sets)
                at = np.repeat(np.arange(n, dtype="<u4"), [len(x) for x in sets])
                order = np.argsort(tokens, kind="stable")
                tokens, at = tokens[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(tokens)))
                several = many > 1
                owner = np.where(several, n + np.cumsum(several) - 1, at[first]).astype("<u4")
                if several.any():
                    yield _messages(GROUPS, part=to[:1], block=[block], at=[at[np.repeat(several, many)].tobytes()], counts=[many[several].astype("<u4").tobytes()])
                tokens = tokens[first]
                where = (tokens >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(tokens), np.int64)
                rest = np.ascontiguousarray((tokens >> np.uint64(max(shift - REST, 0))).view(np.uint8).reshape(-1, 8)[:, : REST // 8])
                narrow = "<u2" if len(sets) + several.sum() <= 1 << 16 else "<u4"
                spans = _spans(where)
                yield _messages(
                    TOKENS, part=[int(where[a]) for a, _ in spans], block=[block] * len(spans), at=[owner[a:b].astype(narrow).tobytes() for a, b in spans],
                    tokens=[rest[a:b].tobytes() for a, b in spans], counts=[many[a:b][several[a:b]].astype("<u4").tobytes() for a, b in spans], size=[n] * len(spans),
                )
                block, begin = block + n, end

    return docs.mapInArrow(send, MESSAGE)


def _counted(sent: DataFrame) -> DataFrame:
    """The messages back to the blocks: of each range, the tokens that several documents have, with their document frequency; the others as they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answer() -> pa.RecordBatch:
            lengths = [len(t) * 8 // REST for _, _, t, _, _ in held]
            whole = np.zeros((sum(lengths), 8), np.uint8)
            whole[:, : REST // 8] = np.frombuffer(b"".join(t for _, _, t, _, _ in held), np.uint8).reshape(-1, REST // 8)
            tokens = whole.view("<u8").ravel()
            at = np.concatenate([np.frombuffer(a, "<u2" if len(a) == 2 * n else "<u4").astype("<u4") for (_, a, _, _, _), n in zip(held, lengths, strict=True)])
            many = np.ones(len(tokens), np.int64)
            many[at >= np.repeat([n for *_, n in held], lengths)] = np.frombuffer(b"".join(c for _, _, _, c, _ in held), "<u4")
            order = np.argsort(tokens, kind="stable")
            run = np.cumsum(np.concatenate([[False], np.diff(tokens[order]) != 0]))
            total = np.zeros(len(tokens), np.int64)
            total[order] = np.bincount(run, many[order]).astype(np.int64)[run]
            back = np.flatnonzero(total > 1)
            owner = np.repeat(np.arange(len(held)), lengths)[back]
            full = (np.uint64(now) << np.uint64(REST)) + tokens[back]
            spans = _spans(owner)
            return _messages(
                TOKENS, part=[now] * len(spans), block=[held[owner[a]][0] for a, _ in spans], at=[at[back[a:b]].tobytes() for a, b in spans],
                tokens=[full[a:b].tobytes() for a, b in spans], counts=[np.minimum(total[back[a:b]], (1 << 32) - 1).astype("<u4").tobytes() for a, b in spans],
            )

        for batch in batches:
            asked = pc.equal(batch.column("kind"), TOKENS)
            yield batch.filter(pc.invert(asked)).select(_NAMES)
            asking = batch.filter(asked)
            for part, *message in zip(*(asking.column(c).to_pylist() for c in ("part", "block", "at", "tokens", "counts", "size")), strict=True):
                if part != now:
                    if held:
                        yield answer()
                    now, held = part, []
                held.append(message)
        if held:
            yield answer()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, MESSAGE)


SET = "rid long, doc_id long, digest binary, text_hash binary, size long, keys array<long>"


def _indexed(counted: DataFrame, percent: int, k: int, share: int, rare: int) -> DataFrame:
    """One row for each document: its set's size, digest and index keys."""
    levels = Levels(percent, k, share, 1 << 40)
    names = [x.split()[0] for x in SET.split(", ")]

    def gather(messages: list[dict]) -> pa.RecordBatch:
        docs = [m for m in messages if m["kind"] == DOCUMENT]
        told = [m for m in messages if m["kind"] == TOKENS]
        joint = lambda c, kind, of: np.frombuffer(b"".join(m[c] for m in of), kind)
        at, tokens, counts = joint("at", "<u4", told).astype(np.int64), joint("tokens", "<u8", told), joint("counts", "<u4", told)
        for m in messages:
            if m["kind"] == GROUPS:
                n = len(docs)
                members, sizes = np.frombuffer(m["at"], "<u4").astype(np.int64), np.frombuffer(m["counts"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                single = at < n
                group = at[~single] - n
                times = np.where(single, 1, 0)
                times[~single] = sizes[group]
                who = np.repeat(at, times)
                inside = ~np.repeat(single, times)
                begin = np.repeat((ends - sizes)[group], sizes[group])
                step = np.arange(len(begin)) - np.repeat(np.cumsum(sizes[group]) - sizes[group], sizes[group])
                who[inside] = members[begin + step]
                at, tokens, counts = who, np.repeat(tokens, times), np.repeat(counts, times)
        order = np.lexsort((tokens, counts, at))
        at, tokens, counts = at[order], tokens[order], counts[order]
        begins, ends = np.searchsorted(at, range(len(docs))), np.searchsorted(at, range(len(docs)), side="right")
        docs.sort(key=lambda m: m["place"])
        keys = []
        for m, a, b in zip(docs, begins.tolist(), ends.tolist(), strict=True):
            size = m["size"]
            links = size and 100 * size >= percent * (size + 1)
            keys.append(index_keys(tokens[a:b], counts[a:b] > rare, size - (b - a), size, percent, k, levels).view(np.int64) if links else np.zeros(0, np.int64))
        columns = [[m["block"] + m["place"] for m in docs], *([m[c] for m in docs] for c in names[1:-1])]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], strict=True)), pa.array(keys, pa.list_(pa.int64()))], names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for m in batch.to_pylist():
                if held and held[0]["block"] != m["block"]:
                    yield gather(held)
                    held = []
                held.append(m)
        if held:
            yield gather(held)

    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(index, SET)


def _across(members: DataFrame, percent: int, cell: int) -> DataFrame:
    """Pairs a, b of different parts in a bucket that their bitmaps don't rule out: members (key, rid, part, n, bitmap). Buckets are split into cells,
    and each pair of cells is a group of its own."""
    members = written(members, "members")
    sizes = written(members.groupBy("key").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")).filter("cells > 1"), "cells")
    own = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("cells")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))
    split = members.join(sizes, "key", "left").select("key", "rid", "part", "n", "bitmap", own.alias("own"), other.alias("other"))
    grouped = split.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rid", "part", "n", "bitmap")

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rid, part, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        bits = np.frombuffer(b"".join(r[6] for r in rows), "<u8").reshape(len(rows), -1)
        for i in range(len(rows) - 1):
            later = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
            later = later[(100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i]))]
            if len(later):
                differ = np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int64)
                hit = rid[later[may_link(n[later], n[i], differ, percent)]]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(hit, rid[i])), pa.array(np.maximum(hit, rid[i]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "rid", "part", "n", "bitmap")), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from compare(held)
                    held = []
                held.append(row)
        if held:
            yield from compare(held)

    order = ["key", "low", "high"]
    return grouped.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, shingle: int = 4, percent: int = 85, k: int = 2, rare: int = 32, share: int = 32, cell: int = 1024, range_chars: int = 1 << 23, block_chars: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    The set of a text is its distinct word n-grams (A-Z lower-cased; with fewer words, the whole sequence). Two texts are linked when 100 times the size of the
    intersection is at least percent times that of the union; component_id is the smallest doc_id that links reach, its own included. A null or
    empty text and one without words has an empty set and is linked with nothing. Equal sets are linked, so repeated rows have one component. A null doc_id is
    nobody's smallest (a component of such rows alone has a null id). An empty table gives none; other columns are ignored.

    ``rare`` is the document frequency up to which a token is indexed by itself, ``k`` how many of the others make a key, ``share`` how many tokens of a set give
    one group of them. ``cell`` bounds the members of a bucket compared at once; range_chars and block_chars are what a range of
    hashes and a block of documents stand for.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_hash"), text.alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(4, min(64 - REST, int(chars // range_chars).bit_length()))
    with small_batches(docs.sparkSession, 4096):
        every = written(_indexed(_counted(_sent(rows, shingle, ranges, block_chars)), percent, k, share, rare), "sets")

    # Of equal sets the first stands for all.
    classes = checkpointed(every.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("rid", "text_hash")).alias("first"), F.min("doc_id").alias("doc_id")).select("digest", "first.rid", "first.text_hash", "doc_id"))
    keyed = every.filter(F.size("keys") > 0).select("rid", "keys").join(classes.select("rid"), "rid", "left_semi").select(F.explode("keys").alias("key"), "rid")
    buckets = written(_buckets(keyed), "buckets")
    wanted = classes.select("rid", "text_hash").join(buckets.select("rid").union(buckets.select("lead")).distinct(), "rid", "left_semi")
    # A text may be repeated many times: tasks keep one of each.
    once = rows.select("text_hash", "text").join(wanted.select("text_hash"), "text_hash", "left_semi").groupBy("text_hash").agg(F.any_value("text").alias("text"))
    with small_batches(docs.sparkSession, 128):
        sets = written(shingle_sets(once.join(wanted, "text_hash"), shingle), "shingles")

    near = similar(buckets.select(F.col("rid").alias("a"), F.col("lead").alias("b")).distinct(), sets, percent)
    linked = checkpointed(components(near).withColumnRenamed("node", "rid"))
    parts = written(buckets.join(linked, "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("part")), "parts")
    several = parts.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("key")
    members = parts.join(several, "key", "left_semi").join(sets.select("rid", "n", "bitmap"), "rid")
    more = similar(written(_across(members, percent, cell), "pairs"), sets, percent)
    if not more.isEmpty():
        linked = checkpointed(components(near.union(more)).withColumnRenamed("node", "rid"))

    of_root = linked.join(classes, "rid").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    reached = linked.join(of_root, "root").select("rid", "smallest")
    named = written(classes.join(reached, "rid", "left").select("digest", F.coalesce("smallest", "doc_id").alias("component_id")), "classes")
    found = every.select("doc_id", "size", "digest").join(named, "digest", "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
