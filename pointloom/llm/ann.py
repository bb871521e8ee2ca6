"""Approximate nearest neighbours by collision counting (operator 5).

Vectors are unit length inside the search, so the largest cosine is the smallest distance. Each block
of vectors keeps one sorted array for each of ``PROJECTIONS`` random directions. A query opens a window
around its own projection in every array; windows grow in steps of ``GROWTH`` (virtual rehashing: the
same arrays serve every radius), and vectors that fall into more than ``COLLISIONS`` of the windows
are verified with the exact cosine. At half-width r a vector at distance r falls into a window with
probability 0.683, so nearly all vectors within r pass the threshold; a query stops once its k-th best
verified distance is at most r, or when its windows hold everything. What a query has found in earlier blocks
of a task bounds its radius in the later ones: a later block is read once, at the distance of its k-th best so far.

Every row is indexed where it lies: blocks are local to a partition, and nothing about data rows is
collected. Queries come to the blocks in chunks of at most ``QUERY_CHUNK`` vectors, whatever their number.

Each vector is scaled by a power of two, which is exact, before anything is squared: components of any
finite size neither overflow nor vanish, and the cosine is that of the original vectors.

Defined results: null vectors, zero vectors and vectors with null or non-finite components take no part;
vectors of unlike length are never compared; rows with the query's vec_id are its own; a vec_id that
repeats counts once, with its best score; equal scores go to the smaller vec_id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import ship, table

NEIGHBOURS = 5
PROJECTIONS = 96
#: Share of the windows that a vector must exceed to be verified.
COLLISIONS = 0.65
FIRST_RADIUS, GROWTH = 0.3, 1.2
BLOCK_ROWS = 8192
#: Queries sent to the blocks at a time: 2**15 vectors of 64 components are 16 MB.
QUERY_CHUNK = 1 << 15
#: Queries that search a block together.
QUERY_GROUP = 256
SEED = 20240501


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component into [0.5, 1)."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Block:
    """The sorted arrays of one block of vectors (scaled ones)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], projections))
        placed = (vectors / self.norms[:, None]) @ self.directions
        self.order = np.ascontiguousarray(np.argsort(placed, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(placed, self.order.T, axis=0).T)

    def cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        # Sums run along each row alike, so equal vectors get equal scores.
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.sqrt((query * query).sum()))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = NEIGHBOURS, bounds: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, ids, cosines) of the verified vectors that may be among its k nearest.

        ``bounds``: the cosine of each query's k-th best so far, -inf without one. Vectors below it need not be found.
        """
        bounds = np.full(len(queries), -np.inf) if bounds is None else bounds
        n, m = len(self.ids), len(self.values)
        centres = ((queries / np.sqrt((queries * queries).sum(axis=1))[:, None]) @ self.directions).T
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centres, strict=True)])
        high = low.copy()
        hits = {q: np.zeros(n, np.int64) for q in range(len(queries))}
        found = {q: ([], [], np.zeros(n, bool)) for q in hits}
        # The distance beyond which nothing is needed; a query with one starts and ends there.
        need = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(bounds, -1)))
        radius = np.where(np.isfinite(bounds), np.maximum(need, 1e-9), FIRST_RADIUS)
        while hits:
            below = np.stack([np.searchsorted(v, c - radius) for v, c in zip(self.values, centres, strict=True)])
            above = np.stack([np.searchsorted(v, c + radius) for v, c in zip(self.values, centres, strict=True)])
            for q in list(hits):
                new = [x for o, a, b, c, d in zip(self.order, below[:, q].tolist(), low[:, q].tolist(), high[:, q].tolist(), above[:, q].tolist(), strict=True) for x in (o[a:b], o[c:d])]
                hits[q] += np.bincount(np.concatenate(new), minlength=n)
                rows, scores, done = found[q]
                whole = bool((above[:, q] - below[:, q]).min() == n)
                fresh = np.flatnonzero(~done if whole else (hits[q] > COLLISIONS * m) & ~done)
                done[fresh] = True
                fresh = fresh[self.ids[fresh] != query_ids[q]]
                if len(fresh):
                    rows.append(fresh)
                    scores.append(self.cosines(queries[q], fresh))
                over = whole or radius[q] >= need[q]
                if sum(map(len, scores)) >= k and not over:
                    top = best_of(self.ids[np.concatenate(rows)], np.concatenate(scores), k)[1]  # a repeated id counts once
                    over = len(top) == k and 2 - 2 * top[-1] <= radius[q] * radius[q]
                if over:
                    yield q, self.ids[np.concatenate(rows)] if rows else self.ids[:0], np.concatenate(scores) if rows else np.zeros(0)
                    del hits[q], found[q]
            low, high = below, above
            radius = radius * GROWTH


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, each id once, highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def _searching(queries: list[tuple[int, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[int, list] = {}

        def search(size: int):
            ids = np.array([i for i, _ in held[size]], np.int64)
            block = Block(ids, scaled(np.array([v for _, v in held[size]], np.float64)))
            held[size] = []
            same = [n for n, (_, v) in enumerate(queries) if len(v) == size]
            for start in range(0, len(same), QUERY_GROUP):
                numbers = same[start : start + QUERY_GROUP]
                query_ids, matrix = np.array([queries[n][0] for n in numbers], np.int64), scaled(np.array([queries[n][1] for n in numbers]))
                bounds = np.array([best[n][1][-1] if n in best and len(best[n][1]) == k else -np.inf for n in numbers])
                for q, ids, scores in block.search(query_ids, matrix, k, bounds):
                    if numbers[q] in best:
                        ids, scores = np.concatenate([best[numbers[q]][0], ids]), np.concatenate([best[numbers[q]][1], scores])
                    best[numbers[q]] = best_of(ids, scores, k)

        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
            ends = ends - ends[0]
            for j, i in enumerate(batch.column(0).to_pylist()):
                v = flat[ends[j] : ends[j + 1]]
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= BLOCK_ROWS:
                    search(len(v))
        for size in [s for s, rows in held.items() if rows]:
            search(size)
        rows = [(queries[n][0], i, s) for n, (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` for each vec_id of ``queries``."""
    data, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Half a chunk on average, so that no chunk of a hash exceeds the bound by more than chance.
    chunks, found = max(1, -(-2 * asked.count() // QUERY_CHUNK)), None
    for c in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()
        part = sorted(((r.vec_id, np.array(r.embedding)) for r in part), key=lambda x: x[0])
        near = data.mapInArrow(_searching(part, k), "query_id long, vec_id long, score double")
        found = near if found is None else found.unionByName(near)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ship(__name__)
