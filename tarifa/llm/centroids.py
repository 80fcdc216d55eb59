"""K-means over integer vectors with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds for its b next centroids one by one,
and one lower bound for all that remain. When centroids move, bounds move with them; the least number of listed
centroids whose bounds don't certify the order is measured anew, all centroids only where no bound holds. Bounds are
widened by what rounding can add, and a tie is never certified, so assignments are those of a full scan.

Vectors stay where they are: a round is one pass over their table, which carries the bounds, and a task adds to
it one row of sums for each of its clusters. Only those sums are shuffled; the driver holds the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import new_path, removed

#: Integers of at most this size have exact squared distances in doubles at up to 64 components: (2 * 2 ** 22) ** 2 * 64 = 2 ** 52.
SMALL = 1 << 22
#: Relative widening of bounds, far above the rounding of one square root and one sum.
SLACK = 1e-12
LIMB = 1 << 32


def kept_vectors(embeddings: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and embedding of the rows with exactly dim components, none null or not finite, itself or scaled."""
    whole = F.col("embedding")
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].alias("embedding"))
    return rows.filter((F.size(whole) == dim) & ~bad)


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the components as doubles, which hold it exactly."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(flat * scale)


def _squares(vectors: np.ndarray, centroids: list[list[int]], listed: np.ndarray | None = None) -> np.ndarray:
    """Exact squared distances of each vector from the centroids listed for it (None: all): doubles while all is small, else Python integers."""
    if listed is None:
        listed = np.broadcast_to(np.arange(len(centroids)), (len(vectors), len(centroids)))
    used = np.unique(listed).tolist()
    small = vectors.shape[1] <= 64 and np.abs(vectors).max(initial=0) <= SMALL and max((abs(c) for k in used for c in centroids[k]), default=0) <= SMALL
    out = np.zeros(listed.shape, np.float64 if small else object)
    for k in used:
        row, place = np.nonzero(listed == k)
        if small:
            d = vectors[row] - np.array(centroids[k], np.float64)
            out[row, place] = np.einsum("ij,ij->i", d, d)
        else:
            out[row, place] = [sum((int(x) - y) ** 2 for x, y in zip(v, centroids[k], strict=True)) for v in vectors[row].tolist()]
    return out


def _ranked(vectors: np.ndarray, centroids: list[list[int]], listed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector, the centroids listed for it (None: all) by distance, ties by number, and their distances."""
    number = np.broadcast_to(np.arange(len(centroids)), (len(vectors), len(centroids))) if listed is None else np.sort(listed, axis=1)
    squares = _squares(vectors, centroids, number)
    order = np.argsort(squares, axis=1, kind="stable")
    return np.take_along_axis(number, order, 1), np.sqrt(np.take_along_axis(squares, order, 1).astype(np.float64))


class Bounds:
    """The bounds of some vectors: cluster, upper, near (the b next centroids), lower (theirs and, last, that of all others)."""

    def __init__(self, vectors: np.ndarray, centroids: list[list[int]], b: int):
        n = len(vectors)
        self.vectors, self.b = vectors, min(b, len(centroids) - 1)
        self.cluster, self.upper = np.zeros(n, np.int64), np.zeros(n)
        self.near, self.lower = np.zeros((n, self.b), np.int64), np.zeros((n, self.b + 1))
        self.looked = np.zeros(n, np.int64)
        self.scan(np.arange(n), centroids)

    @classmethod
    def stored(cls, vectors, cluster, upper, near, lower) -> Bounds:
        self = cls.__new__(cls)
        self.vectors, self.cluster, self.upper, self.near, self.lower = vectors, cluster, upper, near, lower
        self.b = near.shape[1]
        return self

    def scan(self, rows: np.ndarray, centroids: list[list[int]]) -> None:
        """All centroids anew for these vectors."""
        if not len(rows):
            return
        order, far = _ranked(self.vectors[rows], centroids)
        self.cluster[rows], self.upper[rows] = order[:, 0], far[:, 0] * (1 + SLACK)
        self.near[rows] = order[:, 1 : self.b + 1]
        self.lower[rows, : self.b] = far[:, 1 : self.b + 1] * (1 - SLACK)
        self.lower[rows, self.b] = far[:, self.b + 1] * (1 - SLACK) if len(centroids) > self.b + 1 else np.inf
        self.looked[rows] = len(centroids)

    def moved(self, drift: np.ndarray, centroids: list[list[int]]) -> None:
        """After each centroid has moved by its drift: bounds follow, and what they leave open is measured."""
        self.looked = np.zeros(len(self.vectors), np.int64)
        self.upper = (self.upper + drift[self.cluster]) * (1 + SLACK)
        step = np.concatenate([drift[self.near], np.full((len(self.vectors), 1), drift.max(initial=0.0))], axis=1)
        self.lower = np.maximum(self.lower * (1 - SLACK) - step * (1 + SLACK), 0)
        # least[:, j]: below what j listed centroids and the rest can be.
        least = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]
        sure = self.upper[:, None] < least
        first = np.where(sure.any(axis=1), sure.argmax(axis=1), self.b + 1)
        for j in range(1, self.b + 1):
            rows = np.flatnonzero(first == j)
            if not len(rows):
                continue
            listed = np.concatenate([self.cluster[rows, None], self.near[rows, :j]], axis=1)
            order, far = _ranked(self.vectors[rows], centroids, listed)
            self.cluster[rows], self.upper[rows] = order[:, 0], far[:, 0] * (1 + SLACK)
            self.near[rows, :j] = order[:, 1:]
            self.lower[rows, :j] = far[:, 1:] * (1 - SLACK)
            self.looked[rows] = j
        self.scan(np.flatnonzero(first > self.b), centroids)

    def narrowed(self, b: int) -> None:
        """Keeps b listed centroids; the others join the rest."""
        if b < self.b:
            self.lower = np.concatenate([self.lower[:, :b], self.lower[:, b:].min(axis=1, keepdims=True)], axis=1)
            self.near, self.b = self.near[:, :b], b


def _sums(vectors: np.ndarray, cluster: np.ndarray, into: dict[tuple[int, int], list]) -> None:
    """Adds to into, by cluster and limb (of 32 bits, with the sign), the number of vectors and the sums of components."""
    for k in np.unique(cluster).tolist():
        own = vectors[cluster == k]
        parts = {0: own.astype(np.int64)} if not own.size or np.abs(own).max() < LIMB else {}
        if not parts:
            big = [[int(x) for x in v] for v in own]
            limbs = max(1, -(-max(abs(x) for v in big for x in v).bit_length() // 32))
            for i in range(limbs):
                parts[i] = np.array([[(1 if x >= 0 else -1) * (abs(x) >> 32 * i & LIMB - 1) for x in v] for v in big], np.int64)
        for limb, p in parts.items():
            held = into.setdefault((k, limb), [0, np.zeros(vectors.shape[1], object)])
            held[0] += len(own) * (limb == 0)
            held[1] = held[1] + p.sum(axis=0).astype(object)


STATE = "vec_id long, embedding array<{kind}>, cluster int, upper double, near array<int>, lower array<double>, looked int, limb int, n long, sums array<long>"


def _round(rows: DataFrame, path: str, before: list[list[int]] | None, now: list[list[int]], b: int, dim: int, scale: int, last: bool) -> DataFrame:
    """Assigns every vector to the nearest of the centroids now. What is written to path: vectors with bounds and the sums of each task,
    or, last, vectors with their squared distance."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    drift = None
    if before is not None:
        square = [sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) for p, q in zip(before, now, strict=True)]
        drift = np.sqrt(np.array([float(s) for s in square])) * (1 + SLACK)
    value = {"float": pa.float32(), "double": pa.float64()}[kind]
    names = ["vec_id", "embedding", "cluster", "upper", "near", "lower", "looked", "limb", "n", "sums"]
    kinds = [pa.int64(), pa.list_(value), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def lists(table: np.ndarray, of: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel(), of))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _integers(batch.column("embedding"), dim, scale)
            if drift is None:
                state = Bounds(vectors, now, b)
            else:
                table = lambda c, t: batch.column(c).flatten().to_numpy().astype(t)
                lower = table("lower", np.float64).reshape(batch.num_rows, -1)
                near = table("near", np.int64).reshape(batch.num_rows, lower.shape[1] - 1)
                state = Bounds.stored(vectors, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), near, lower)
                state.moved(drift, now)
                state.narrowed(b)
            if last:
                squares = np.zeros(batch.num_rows, object)
                squares[:] = _squares(vectors, now, state.cluster[:, None])[:, 0]
                fits = pa.array([int(x) if x < 1 << 63 else None for x in squares], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(state.cluster, pa.int32()), fits], ["vec_id", "cluster", "distance"])
                continue
            _sums(vectors, state.cluster, total)
            empty = [pa.nulls(batch.num_rows, t) for t in kinds[7:]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding").cast(kinds[1]), pa.array(state.cluster, pa.int32()), pa.array(state.upper), lists(state.near, pa.int32()), lists(state.lower, pa.float64()), pa.array(state.looked, pa.int32()), *empty], names)
        if total:
            keys = list(total)
            blank = [pa.nulls(len(keys), t) for t in kinds]
            blank[2] = pa.array([k for k, _ in keys], pa.int32())
            blank[7], blank[8] = pa.array([x for _, x in keys], pa.int32()), pa.array([total[x][0] for x in keys], pa.int64())
            blank[9] = pa.array([total[x][1].tolist() for x in keys], kinds[9])
            yield pa.RecordBatch.from_arrays(blank, names)

    rows.mapInArrow(assign, "vec_id long, cluster int, distance long" if last else STATE.format(kind=kind)).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _means(state: DataFrame, now: list[list[int]], dim: int) -> tuple[list[list[int]], int]:
    """The centroids moved to the floor of the mean of their vectors, and the most centroids (but the own) that a certified vector looked at."""
    parts = state.filter("limb IS NOT NULL").select("cluster", "limb", "n", F.posexplode("sums").alias("at", "v"))
    found = parts.groupBy("cluster", "limb", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect()
    sums, counts = [[0] * dim for _ in now], [0] * len(now)
    for r in found:
        sums[r.cluster][r["at"]] += int(r.v) << 32 * r.limb
        counts[r.cluster] = max(counts[r.cluster], r.n)
    most = state.filter(F.col("looked") < len(now)).agg(F.max("looked")).first()[0]
    return [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, now, strict=True)], most or 0


def seeds(vectors: DataFrame, k: int, salt: str = "1:", scale: int = 64) -> list[list[int]]:
    """The integer vectors with the k smallest sha256 of salt and vec_id; equal hashes by components. A null vec_id is no seed."""
    first = vectors.filter("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "embedding").limit(k).collect()
    return [[int(np.floor(float(x) * scale)) for x in r.embedding] for r in first]


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over all) and centroid
    (its final components, joined by commas) of every kept vector of embeddings (vec_id, embedding).

    Rows whose embedding is null, has other than dim components, or one that is null or not finite, are no vectors. Components x count as
    floor(scale * x). Of equal distances the smaller centroid number counts, and a cluster without vectors keeps its centroid.
    Repeated rows are vectors each, also with a null vec_id; with fewer than k rows that have an id there are as many centroids; without any, the
    result is empty. A distance or sum that no long holds is null. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = kept_vectors(embeddings, dim, scale)
    if rows.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    now = seeds(rows, k, scale=scale)
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string")
    b, before, old = max(1, len(now) // 4), None, None
    for step in range(rounds):
        path = new_path(spark, "centroids")
        state = _round(rows, path, before, now, b, dim, scale, last=False)
        if old:
            removed(spark, old)  # the new table has all that it had
        old, rows, before = path, state.filter("limb IS NULL").drop("looked", "limb", "n", "sums"), now
        now, most = _means(state, now, dim)
        if step:  # as many listed centroids as were of use
            b = min(b, max(1, len(now) // 8, most))
    found = _round(rows, new_path(spark, "clusters"), before, now, b, dim, scale, last=True)
    if old:
        removed(spark, old)
    # At most k rows come to the driver, and at most k go out.
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("distance") == F.count("*")).alias("whole")).collect()
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    by = {r.cluster: int(r.s) if r.whole else None for r in sums}
    total = fits(sum(by.values())) if None not in by.values() else None
    centres = [(i, fits(by.get(i)), total, ",".join(map(str, c))) for i, c in enumerate(now)]
    centre = spark.createDataFrame(centres, "cluster int, cluster_inertia long, inertia long, centroid string")
    return found.join(F.broadcast(centre), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
