"""SimHash near-duplicates: links between 64-bit fingerprints found by pigeonring filtering.

A fingerprint is a ring of max_distance + 1 segments of equal width. If two differ in at most max_distance
bits, then by the pigeonring principle there is a segment from which every chain of l consecutive segments
differs in at most l - 1 bits (its share l * max_distance / segments, rounded down). Chains of one and two
segments make the join key: the first segment is equal, and so is one half of the second, since that has one
differing bit at most. Longer chains prune the candidates one length after the other; the last is the whole
ring, the Hamming check.

Fingerprints are made distinct before they are joined, so copies add nothing. Keys that many share are split
into cells, each pair of cells a group of its own, so a task holds few fingerprints at once. A task gives a
spanning forest of its links, not the links, so groups of near copies give about as many rows as they have members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import checkpointed, small_batches, whole_row, written
from tarifa.llm.shingle_sets import ODD, SEED, mix, shingle_keys
from tarifa.llm.tokens import release


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a text in order, A-Z lower-cased; of the whole sequence for fewer words; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - shingle + 1)].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(begins, ends, strict=True)], "<u8")


def simhash(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text: word shingles, repeats included; no words: zero."""
    hashes = shingle_hashes(text, shingle)
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        set_in += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """rows, whose last column is a text, with the text's fingerprint (a long) in its place."""
    text = rows.columns[-1]
    schema = rows.drop(text).withColumn("fingerprint", F.lit(0).cast("long")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fingerprint"])

    return rows.mapInArrow(add, schema)


class _Forest(dict):
    """Union-find by smallest member."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self[x]
        return top

    def link(self, a: int, b: int) -> bool:
        """Whether that connects what wasn't connected."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _edges(pairs: list[tuple[int, int]], kind: type) -> Iterator[pa.RecordBatch]:
    rows = np.array(pairs, kind).reshape(-1, 2).view(np.int64)
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + 10_000, 0]), pa.array(rows[at : at + 10_000, 1])], ["a", "b"])


def _linked(start: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Which pairs pass every chain from their start segment; the last chain is the whole ring."""
    turn = (start * width).astype(np.uint64)
    x = a ^ b
    x = x >> turn | x << (np.uint64(64) - turn) % np.uint64(64)
    keep = np.arange(len(x))
    for n in range(2, 64 // width + 1):
        mask = np.uint64((1 << width * n) - 1)
        keep = keep[np.bitwise_count(x[keep] & mask) < n]
    return keep


def links(distinct: DataFrame, max_distance: int = 3, cell: int = 4096, pairs: int = 1 << 21) -> DataFrame:
    """Links a, b that connect all that are at most max_distance apart among distinct fingerprints (a long column).

    max_distance + 1 must divide 64. ``cell`` is the size of the cells that common keys are split into.
    """
    segments = max_distance + 1
    if 64 % segments or 64 // segments < 2:
        raise ValueError("max_distance + 1 must divide 64 and be 32 at most")
    width, half = 64 // segments, 32 // segments
    f = F.col("fingerprint")
    bits = lambda at, n: F.shiftrightunsigned(f, at % 64).bitwiseAND(F.lit((1 << n) - 1))
    keys = [
        (F.lit((i * 2 + h) << 40) + F.shiftleft(bits(i * width, width), half) + bits((i + 1) % segments * width + h * half, half)).alias("key")
        for i in range(segments)
        for h in range(2)
    ]
    keyed = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    common = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("cells")).cast("int")
    other = F.explode(F.when(F.col("cells").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
    split = keyed.join(common, "key", "left").select("key", "fingerprint", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    grouped = split.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kept = _Forest(), []

        def compare(run: np.ndarray, start: np.ndarray, f: np.ndarray) -> None:
            # Each row against the rows after it in its run, so many pairs at a time.
            ends = np.append(np.flatnonzero(np.diff(run)) + 1, len(run))
            after = ends[run] - np.arange(len(run)) - 1
            upto = np.cumsum(after)
            at = 0
            while at < len(run):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs, side="right")))
                n = after[at:to]
                first = np.repeat(np.arange(at, to), n)
                second = first + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for k in _linked(start[first], f[first], f[second], width).tolist():
                    pair = int(f[first[k]]), int(f[second[k]])
                    if found.link(*pair):
                        kept.append(pair)
                at = to

        held: list[pa.RecordBatch] = []

        def flush(rest: bool) -> None:
            t = pa.Table.from_batches(held)
            key, low, high, f = (t.column(i).combine_chunks().to_numpy() for i in range(4))
            new = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            run = np.concatenate([[0], np.cumsum(new)])
            done = len(run) if rest else int(np.searchsorted(run, run[-1]))  # the last run may go on
            held.clear()
            if done:
                compare(run[:done], key[:done] >> 41, f[:done].view(np.uint64))
            if done < len(run):
                held.extend(t.slice(done).combine_chunks().to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                flush(False)
        if held:
            flush(True)
        yield from _edges(kept, np.uint64)

    order = ["key", "low", "high"]
    return grouped.repartition(*order).sortWithinPartitions(*order).mapInArrow(forest, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the same for all of a component) of every node of the edges a, b.

    Each round every node hooks onto its neighbour with the smallest hash, if smaller than its own, and the
    edges move to what was hooked onto; hashes make that a random order, so chains shrink by a constant factor.
    """
    spark = edges.sparkSession
    named = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    now = checkpointed(edges.select(named("a").alias("a"), named("b").alias("b")).filter("a <> b").distinct())
    hooks: list[DataFrame] = []
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        hook = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        hooks.append(hook)
        moved = now.join(hook.withColumnRenamed("node", "a").withColumnRenamed("up", "c"), "a").join(hook.withColumnRenamed("node", "b").withColumnRenamed("up", "d"), "b")
        now = checkpointed(moved.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).filter("a <> b").distinct())
    if not hooks:
        return spark.createDataFrame([], "node long, root long")
    roots = hooks[-1]
    for hook in reversed(hooks[:-1]):
        above = roots.select(F.col("node").alias("up"), F.col("up").alias("top"))
        roots = hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return roots.select(F.col("node.id").alias("node"), F.col("up.id").alias("root"))


def groups(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """fingerprint and component_id of every distinct fingerprint of prints (doc_id, fingerprint)."""
    first = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = checkpointed(components(links(first.select("fingerprint"), max_distance)).withColumnRenamed("node", "fingerprint"))
    linked = first.join(roots, "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    of_linked = linked.join(smallest, "root").select("fingerprint", "smallest")
    return first.join(of_linked, "fingerprint", "left").select("fingerprint", F.coalesce("smallest", "first").alias("component_id"))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. A null or empty text has fingerprint zero and links
    like any other. A null doc_id is nobody's smallest (a component of such rows alone has a null id).
    Repeated rows give a row each; an empty table gives none; other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), shingle))
    # Both sides of the last join come anew from shuffles, so a fingerprint that very many share is split.
    found = prints.join(written(groups(prints, max_distance), "components"), "fingerprint")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprints(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its keys."""
    has = np.flatnonzero(counts)
    ends = np.cumsum(counts[has])
    sums = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(keys), 65536):
        bits = np.unpackbits(keys[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, [at, at + len(bits) - 1], side="right")
        cuts = np.concatenate([[0], ends[first:last] - at])
        sums[has[first : last + 1]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _band_keys(keys: np.ndarray, counts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A key for each text and band of hash functions (odd: bands by functions): of the smallest shingle under each of them."""
    has = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[has]
    out = np.zeros((len(counts), len(odd)), np.uint64)
    for band, functions in enumerate(odd):
        for k, f in enumerate(functions):
            least = np.full(len(counts), np.iinfo(np.uint64).max)
            if len(has):
                least[has] = np.minimum.reduceat(keys * f, starts)
            out[:, band] += mix(least) * ODD[k]
        out[:, band] = mix(out[:, band] + np.uint64(band))
    return out


def _sketched(rows: DataFrame, shingle: int, bands: int, per_band: int, slice_chars: int = 500_000) -> DataFrame:
    """rows, whose last column is a text, with fingerprint and keys in its place: those of the bands, and the fingerprint as one more."""
    text = rows.columns[-1]
    odd = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(bands * per_band)], np.uint64).reshape(bands, per_band)
    schema = rows.drop(text).withColumns({"fingerprint": F.lit(0).cast("long"), "keys": F.array(F.lit(0).cast("long"))}).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts, begin = batch.column(batch.num_columns - 1).to_pylist(), 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= slice_chars):
                    size, end = size + len(texts[end] or ""), end + 1
                keys, counts = shingle_keys(texts[begin:end], shingle)
                prints = _fingerprints(keys, counts)
                every = np.concatenate([_band_keys(keys, counts, odd), mix(prints ^ np.uint64(1))[:, None]], axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - begin + 1) * every.shape[1], pa.int32()), pa.array(every.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns[:-1]), pa.array(prints.view(np.int64)), lists], [*batch.schema.names[:-1], "fingerprint", "keys"])
                begin = end

    return rows.mapInArrow(add, schema)


def _buckets(keyed: DataFrame) -> DataFrame:
    """key, rid and lead of the rows of keyed (key, rid) that share their key with a smaller rid; lead is the smallest.

    Rows are dealt by ranges of (key, rid), so a key that very many share lies in many tasks. A task gives each
    row the first of its key there; the firsts of keys at the ends of tasks, two a task, are put in order after.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_lead, begun = None, None, False
        names = ["key", "rid", "lead", "at_end"]
        give = lambda k, r, x, e: pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(x), pa.array(np.full(len(k), e))], names)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rid = (batch.column(i).to_numpy() for i in range(2))
            new = np.concatenate([[key[0] != last_key or not begun], key[1:] != key[:-1]])
            if not begun:
                begun = True
                yield give(key[:1], rid[:1], rid[:1], True)
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            leads = np.where(at >= 0, rid[at], last_lead if last_lead is not None else 0)
            yield give(key[~new], rid[~new], leads[~new], False)
            last_key, last_lead = key[-1], leads[-1]
        if begun:
            one = np.array([last_key], np.int64), np.array([last_lead], np.int64)
            yield give(one[0], one[1], one[1], True)

    order = ["key", "rid"]
    found = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lead, "key long, rid long, lead long, at_end boolean"), "buckets")
    # Two rows for each task at most.
    ends = F.broadcast(found.filter("at_end").groupBy("key").agg(F.min("lead").alias("top")))
    return found.join(ends, "key", "left").select("key", "rid", F.coalesce("top", "lead").alias("lead")).filter("rid <> lead")


def _similar(pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, text, leader) whose shingle sets have a Jaccard similarity of at least ``percent`` per cent."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = object(), None
        for batch in batches:
            kept = []
            for text, b in zip(batch.column(2), batch.column(3), strict=True):
                if (b := b.as_py()) != last:
                    last, leader = b, np.unique(shingle_keys([b], shingle)[0])
                own = np.unique(shingle_keys([text.as_py()], shingle)[0])
                both = len(np.intersect1d(own, leader, assume_unique=True))
                kept.append(100 * both >= percent * (len(own) + len(leader) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "text", "leader").mapInArrow(check, "a long, b long")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """rid, n and shingles (the distinct shingles, sorted, as bytes) of texts (rid, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_keys([t.as_py()], shingle)[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rid", "n", "shingles"])

    return texts.select("rid", "text").mapInArrow(cut, "rid long, n long, shingles binary")


def _similar_within(members: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links a, b that connect all parts whose members in a common bucket are similar: members (key, rid, part, n, shingles).

    Members of one part are connected already. Buckets are split into cells of about ``cell`` shingles, and each
    pair of cells is a group of its own. In it each member is held against all others at once, unless one part
    is left. Gives a spanning forest of the links of a task, between parts.
    """
    # Both come anew from a table, so a bucket of very many is split by the join too.
    members = written(members, "members")
    sizes = written(members.groupBy("key").agg(F.ceil(F.sum("n") / cell).cast("int").alias("cells")).filter("cells > 1"), "cells")
    own = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("cells")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))
    split = members.join(sizes, "key", "left").select("key", "part", "shingles", own.alias("own"), other.alias("other"))
    grouped = split.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "part", "shingles")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kept = _Forest(), []

        def compare(parts: list[int], sets: list[bytes]) -> None:
            roots = np.array([found.root(p) for p in parts])
            if (roots == roots[0]).all():
                return
            words, at = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
            sizes = np.array([len(x) // 8 for x in sets])
            ends = np.cumsum(sizes)
            has = np.flatnonzero(sizes)
            mark = np.zeros(len(words), np.int64)
            for i in range(len(parts) - 1):
                if (roots[i + 1 :] == roots[i]).all():
                    continue
                own = at[ends[i] - sizes[i] : ends[i]]
                mark[own] = 1
                both = np.zeros(len(parts), np.int64)
                both[has] = np.add.reduceat(mark[at], (ends - sizes)[has]) if len(has) else 0
                mark[own] = 0
                for k in np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (roots != roots[i])).tolist():
                    if found.link(parts[i], parts[k]):
                        kept.append((parts[i], parts[k]))
                    roots[(roots == roots[i]) | (roots == roots[k])] = found.root(parts[i])

        run, parts, sets = None, [], []
        for batch in batches:
            key, low, high, part, shingles = batch.columns
            for now in zip(key.to_pylist(), low.to_pylist(), high.to_pylist(), part.to_pylist(), shingles.to_pylist(), strict=True):
                if now[:3] != run:
                    if len(parts) > 1:
                        compare(parts, sets)
                    run, parts, sets = now[:3], [], []
                parts.append(now[3])
                sets.append(now[4])
        if len(parts) > 1:
            compare(parts, sets)
        yield from _edges(kept, np.int64)

    order = ["key", "low", "high"]
    return grouped.repartition(*order).sortWithinPartitions(*order).mapInArrow(forest, "a long, b long")


def _connected(cells: DataFrame, also: DataFrame, text_of: DataFrame, shingle: int, percent: int, cell: int) -> DataFrame:
    """rid and root of the texts in cells (key, rid, lead) that similar texts with a common key connect.

    First each is compared with the lead of its bucket, and the pairs ``also`` (a, b). What that leaves in several parts is
    then compared within the buckets, all pairs but those of one part and those with the lead.
    """
    pairs = cells.select(F.col("rid").alias("a"), F.col("lead").alias("b")).union(also).distinct()
    texts_a, texts_b = text_of.select(F.col("rid").alias("a"), "text"), text_of.select(F.col("rid").alias("b"), F.col("text").alias("leader"))
    with small_batches(cells.sparkSession, 256):
        near = checkpointed(_similar(pairs.join(texts_a, "a").join(texts_b, "b"), shingle, percent))
    linked = checkpointed(components(near).withColumnRenamed("node", "rid"))
    parts = written(cells.join(linked, "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("part")), "parts")
    several = written(parts.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("key"), "several")
    parts = checkpointed(parts.join(several, "key", "left_semi"))
    if parts.isEmpty():
        return linked
    with small_batches(cells.sparkSession, 256):
        sets = checkpointed(_shingle_sets(text_of.join(parts.select("rid").distinct(), "rid", "left_semi"), shingle))
        more = checkpointed(_similar_within(parts.join(sets, "rid"), percent, cell))
    return linked if more.isEmpty() else components(near.union(more)).withColumnRenamed("node", "rid")


def drop_near_duplicates(docs: DataFrame, max_distance: int = 3, shingle: int = 5, percent: int = 80, bands: int = 30, per_band: int = 5, cell: int = 1 << 17) -> DataFrame:
    """The rows of docs (doc_id, text and any others, all returned as they are) without near copies.

    Of equal texts the first by doc_id stays (null last). Texts whose fingerprints (of five-word shingles) are linked
    within ``max_distance`` bits are compared. Fingerprints can't find all that are alike: at a similarity of 0.8 they differ in
    about 10 of 64 bits. So texts whose smallest shingles are the same under each of the ``per_band`` hash functions of one of
    ``bands`` bands are candidates too, and compared, all pairs of them that nothing connects yet. A similarity of the
    shingle sets of at least ``percent`` per cent is a link; of texts that links connect, the first stays. Two texts at similarity s miss each
    other with a chance of (1 - s ** per_band) ** bands: 7e-6 at 0.8, 3e-8 at 0.85. Null texts count as empty: one of the texts
    without words stays. ``cell`` bounds the shingles compared at once.
    """
    row = docs.select(whole_row(docs), F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # rid must not change between uses, so the rows are written once.
    with small_batches(docs.sparkSession, 1024):
        settled = written(_sketched(row.select("row", "rid", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text"), shingle, bands, per_band), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    place = checkpointed(settled.groupBy("fingerprint", "digest").agg(F.min(order).alias("place")).select("fingerprint", F.col("place.rid").alias("rid"), "place"))
    prints = checkpointed(place.groupBy("fingerprint").agg(F.min("rid").alias("rid")))
    between = checkpointed(links(prints.select("fingerprint"), max_distance))
    rid_of = lambda c, name: prints.select(F.col("fingerprint").alias(c), F.col("rid").alias(name))
    also = checkpointed(between.join(rid_of("a", "x"), "a").join(rid_of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))

    keyed = settled.select("rid", "keys").join(place.select("rid"), "rid", "left_semi").select(F.explode("keys").alias("key"), "rid")
    cells = written(_buckets(keyed), "candidates")
    compared = cells.select("rid").union(cells.select("lead")).union(also.select("a")).union(also.select("b")).distinct()
    text_of = written(settled.join(compared, "rid", "left_semi").select("rid", "row.text"), "simhash-texts")
    linked = checkpointed(_connected(cells, also, text_of, shingle, percent, cell).join(place.drop("fingerprint"), "rid"))
    firsts = linked.groupBy("root").agg(F.min("place").alias("lead"))
    gone = linked.join(firsts, "root").filter("place <> lead").select("rid")
    kept = place.select("rid").join(gone, "rid", "left_anti")
    return settled.join(kept, "rid", "left_semi").select("row.*")
