"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest
norm, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0) give |q' - v'|^2 = |q|^2 +
M^2 - 2 q.v, so the nearest v' has the highest score and the triangle
inequality holds.

Index: every vector is keyed by its nearest pivot and its distance to it, the
table is sorted by both and cut into blocks; a pivot's distances fall into
rings (annuli). Search: for each query the rings are sorted by their bound (how
near the pivot's ring can come to the query, and half the way beyond its own
pivot), and are expanded in rounds; a query stops where no ring left can reach
its k-th score. Rings are never dropped otherwise, so the result is exact. A
ring of any size is many blocks; queries meet blocks in a join on the ring,
whose large rings Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean_shuffles, materialise, shared_dir, table

#: Components are floor(SCALE * x).
SCALE = 1024
#: Vectors in a block, queries in a pack: one product of two such matrices at a time.
BLOCK, PACK = 512, 128
#: Rings that each round adds after the first; the last takes all that are left.
ROUNDS = (0, 14, None)
#: Beyond this a component is taken as this: products stay in Python's integers, scores in 64 bits.
LARGEST = 1 << 62


def quantised(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and their components as integers (64 bits).

    A vector that is null or holds a null, NaN or infinite component takes no part.
    """
    column = column.cast(pa.list_(pa.float64()))
    values = column.flatten()
    sizes = np.array(column.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - sizes])
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST)
    whole = np.where(np.isnan(whole), 0, whole).astype(np.int64)
    return good, [whole[e - n : e] for e, n, g in zip(ends, sizes, good, strict=True) if g]


@dataclass(frozen=True)
class Space:
    """What all workers know: dimension, storage type, largest norm, pivots with the added coordinate, inner edges of rings [pivot, ring - 1]."""

    dim: int
    kind: str
    exact: str
    norm: float
    pivots: np.ndarray
    edges: np.ndarray

    def matrix(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Rows of equal length: shorter vectors end in zeros."""
        out = np.zeros((len(vectors), self.dim), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def distances(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """[n, pivots] in the space with one more coordinate, which is 0 for queries."""
        v = vectors.astype(np.float64)
        square = (v * v).sum(axis=1)
        more = np.zeros(len(v)) if queries else np.sqrt(np.maximum(self.norm**2 - square, 0))
        dots = v @ self.pivots[:, :-1].T + more[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum((square + more**2)[:, None] + (self.pivots**2).sum(axis=1) - 2 * dots, 0))

    def slack(self) -> float:
        """More than the rounding of any distance; those of queries may exceed the largest norm of vectors."""
        return 1e-5 * (self.norm + 1)

    def reach(self, vectors: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Highest score that a vector at least ``gap`` away can have with each query [n, ...]."""
        square = (vectors.astype(np.float64) ** 2).sum(axis=1)
        slack = 1e-5 * (self.norm + np.sqrt(square) + 1)
        near = np.maximum(gap - slack[:, None], 0)
        return (square[:, None] + self.norm**2 - near**2) / 2 * (1 + 1e-12) + 1e-9 * (square[:, None] + self.norm**2) + 1

    def scores(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        if self.exact == "float":
            return np.rint(queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
        if self.exact == "long":
            return queries @ vectors.T
        wide = queries.astype(object) @ vectors.astype(object).T
        return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: number, dimension, largest component and largest squared norm of a batch."""
    for rows in batches:
        _, vectors = quantised(rows.column(0))
        if vectors:
            large = max((int(np.abs(v).max(initial=0)) for v in vectors))
            square = max(float((v.astype(np.float64) ** 2).sum()) for v in vectors)
            yield pa.RecordBatch.from_pydict({"n": [len(vectors)], "dim": [max(map(len, vectors))], "large": [large], "square": [square]})


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``count`` clusters of the sample's rows, by a few rounds of k-means from spread-out rows."""
    spread = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(spread) < min(count, len(sample)) and far.max() > 0:
        spread.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[spread[-1]]) ** 2).sum(axis=1))
    centres = sample[spread].copy()
    for _ in range(rounds):
        nearest = ((sample**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            if (nearest == c).any():
                centres[c] = sample[nearest == c].mean(axis=0)
    return centres


def fit_space(vectors: DataFrame, pivots: int, rings: int, sample_rows: int) -> Space | None:
    """Bounds over all rows; pivots and inner ring edges from at most ``sample_rows`` of them, least hash of the id first."""
    kinds = "n long, dim long, large long, square double"
    n, dim, large, square = vectors.select("vector").mapInArrow(_measured, kinds).agg(F.sum("n"), F.max("dim"), F.max("large"), F.max("square")).first()
    if not n:
        return None
    kind = "<i2" if large < 1 << 15 else "<i4" if large < 1 << 31 else "<i8"
    bound = dim * large * large
    exact = "float" if bound < 1 << 53 else "long" if bound < 1 << 63 else "wide"
    norm = float(np.sqrt(square)) * (1 + 1e-12)
    draft = Space(dim, kind, exact, norm, np.zeros((1, dim + 1)), np.zeros((1, 0)))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    kept = [v for chunk in picked.column(0).chunks for v in quantised(chunk)[1]]
    rows = draft.matrix(kept).astype(np.float64) if kept else np.zeros((1, dim))
    sample = np.concatenate([rows, np.sqrt(np.maximum(norm**2 - (rows**2).sum(axis=1), 0))[:, None]], axis=1)
    centres = fit_pivots(sample, pivots)
    away = np.sqrt(((sample[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)) if len(sample) * len(centres) * dim < 1 << 24 else np.stack([np.sqrt(((sample - c) ** 2).sum(axis=1)) for c in centres], axis=1)
    nearest = away.argmin(axis=1)
    cuts = np.linspace(0, 1, rings + 1)[1:-1]
    edges = np.stack([np.quantile(own, cuts) if len(own := away[nearest == c, c]) else np.zeros(rings - 1) for c in range(len(centres))])
    return Space(dim, kind, exact, norm, centres, edges)


def _keyed(space: Space):
    """Worker: nearest pivot, ring, distance and bytes of each vector."""
    names = ["cell", "ring", "away", "vec_id", "vector"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            good, vectors = quantised(rows.column(1))
            if not vectors:
                continue
            matrix = space.matrix(vectors)
            distances = space.distances(matrix, False)
            cell = distances.argmin(axis=1)
            away = distances[np.arange(len(cell)), cell]
            ring = (away[:, None] > space.edges[cell]).sum(axis=1)
            stored = [v.tobytes() for v in matrix.astype(space.kind)]
            ids = rows.column(0).filter(pa.array(good))
            arrays = [pa.array(cell, pa.int32()), pa.array(cell * (space.edges.shape[1] + 1) + ring, pa.int32()), pa.array(away), ids, pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return work


BLOCK_SCHEMA = "ring int, cell int, low double, high double, n long, ids binary, vectors binary"


def _blocked(rows_limit: int):
    """Worker over sorted rows: up to ``rows_limit`` neighbours of one ring as one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            cells, rings, away, ids, vectors = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({
                "ring": pa.array([rings[0]], pa.int32()), "cell": pa.array([cells[0]], pa.int32()), "low": [min(away)], "high": [max(away)],
                "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [b"".join(vectors)],
            })

        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if held and (row[1] != held[0][1] or len(held) >= rows_limit):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return work


QUERY_SCHEMA = "query_id long, query binary"


def _queries(space: Space):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            good, vectors = quantised(rows.column(1))
            if vectors:
                # A query longer than all vectors meets zeros there.
                stored = [v.tobytes() for v in space.matrix([v[: space.dim] for v in vectors])]
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(good)), pa.array(stored, pa.binary())], ["query_id", "query"])

    return work


PACK_SCHEMA = "ring int, numbers binary, query_ids binary, queries binary, least binary"
LEAST = -(1 << 63)


def _packed(space: Space, ring_ids: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray, k: int, turn: int, pack: int):
    """Worker: which rings each query expands in a round, as packs of queries by ring.

    Rings are sorted by the score that they can reach. The first round takes at
    least two and so many that k vectors besides the query's own lie in them;
    round ``turn`` goes on from where the one before has stopped.
    """
    per = space.edges.shape[1] + 1
    cells = ring_ids // per

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            numbers, ids = (np.array(rows.column(i).to_pylist(), np.int64) for i in (0, 1))
            if not len(numbers):
                continue
            queries = np.stack([np.frombuffer(x, np.int64) for x in rows.column(2).to_pylist()])
            least = np.array(rows.column(3).fill_null(LEAST).to_pylist(), np.int64)
            away = space.distances(queries, True)
            own = away[:, cells]
            gap = np.maximum.reduce([np.zeros_like(own), own - high, low - own, (own - away.min(axis=1)[:, None]) / 2])
            reach = space.reach(queries, gap)
            order = np.argsort(-reach, axis=1, kind="stable")
            enough = (np.cumsum(counts[order], axis=1) < k + 1).sum(axis=1) + 1
            start = np.maximum(enough, 2)
            lo = np.zeros_like(start) if turn == 0 else start + sum(ROUNDS[1:turn])
            hi = start if turn == 0 else np.full_like(start, len(ring_ids)) if ROUNDS[turn] is None else lo + ROUNDS[turn]
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            wanted = (rank >= lo[:, None]) & (rank < hi[:, None]) & (reach >= least[:, None].astype(np.float64))
            for j in np.flatnonzero(wanted.any(axis=0)):
                who = np.flatnonzero(wanted[:, j])
                parts = [who[i : i + pack] for i in range(0, len(who), pack)]
                yield pa.RecordBatch.from_pydict({
                    "ring": pa.array([ring_ids[j]] * len(parts), pa.int32()), "numbers": [numbers[p].tobytes() for p in parts], "query_ids": [ids[p].tobytes() for p in parts],
                    "queries": [queries[p].astype(space.kind if np.abs(queries[p]).max(initial=0) < 1 << 15 else "<i8").tobytes() for p in parts],
                    "least": [least[p].tobytes() for p in parts],
                })

    return work


FOUND_SCHEMA = "q long, query_id long, vec_id long, score long"


def _scored(space: Space, k: int):
    """Worker over (block, pack): the k best of the block for each query whose bound it can reach."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = [rows.column(i) for i in range(rows.num_columns)]
            for i in range(rows.num_rows):
                cell, low, high, ids, vectors, numbers, query_ids, queries, least = (c[i].as_py() for c in columns)
                ids, numbers, query_ids, least = (np.frombuffer(x, np.int64) for x in (ids, numbers, query_ids, least))
                kind = space.kind if len(queries) == len(numbers) * space.dim * np.dtype(space.kind).itemsize else "<i8"
                q = np.frombuffer(queries, kind).reshape(len(numbers), space.dim).astype(np.int64)
                own = space.distances(q, True)[:, cell]
                gap = np.maximum.reduce([np.zeros_like(own), own - high, low - own])
                some = np.flatnonzero(space.reach(q, gap[:, None])[:, 0] >= least.astype(np.float64))
                if not len(some):
                    continue
                score = space.scores(q[some], np.frombuffer(vectors, space.kind).reshape(len(ids), space.dim).astype(np.int64))
                itself = query_ids[some][:, None] == ids
                bar = least[some]
                if len(ids) > k:
                    # k others have at least this score: the query's own row may be among the k + 1 highest.
                    bar = np.maximum(bar, np.partition(score, max(len(ids) - k - 1, 0), axis=1)[:, max(len(ids) - k - 1, 0)])
                who, at = np.nonzero((score >= bar[:, None]) & ~itself)
                best = np.lexsort((ids[at], -score[who, at].astype(object) if space.exact == "wide" else -score[who, at], who))
                who, at = who[best], at[best]
                starts = np.searchsorted(who, who)
                kept = np.arange(len(who)) - starts < k
                who, at = who[kept], at[kept]
                yield pa.RecordBatch.from_pydict({"q": numbers[some][who], "query_id": query_ids[some][who], "vec_id": ids[at], "score": score[who, at]})

    return work


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = 32, rings: int = 8, sample_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, vector) of highest score for each row of ``queries`` (query_id, vector).

    Score: inner product of floor(1024 * component), exact. Returns query_id,
    rank from 1, vec_id, score; equal scores go to the smaller vec_id. A row of
    the query's own id is no candidate. Fewer than k candidates: all of them.

    Rows with a null id or a vector that is null or holds null or non-finite
    components take no part. Shorter vectors count as ending in zeros, empty
    ones score 0. Repeated candidate rows are separate candidates; repeated
    query rows are one query, different vectors under one id are queries of
    their own under that id. Components beyond 2^62 count as that, scores
    beyond 64 bits as the largest. Other columns aren't read.

    Pivots and ring edges are fitted on at most ``sample_rows`` rows; all rows
    are indexed, and the result doesn't depend on the fit. The driver holds the
    pivots and two bounds for each of ``pivots * rings`` rings.
    """
    spark = vectors.sparkSession
    base = shared_dir(spark)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector")
    with lean_shuffles(spark):
        space = fit_space(rows, pivots, rings, sample_rows)
        if space is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        keyed = rows.mapInArrow(_keyed(space), "cell int, ring int, away double, vec_id long, vector binary")
        sorted_rows = keyed.repartitionByRange("cell", "away", "vec_id").sortWithinPartitions("cell", "away", "vec_id")
        index = materialise(sorted_rows.mapInArrow(_blocked(BLOCK), BLOCK_SCHEMA), base, "index")
        bounds = index.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("ring").toArrow()
        ring_ids, low, high, counts = (np.array(bounds.column(i)) for i in range(4))
        numbered = asked.mapInArrow(_queries(space), QUERY_SCHEMA).distinct().select(F.monotonically_increasing_id().alias("q"), "query_id", "query")
        known = materialise(numbered, base, "queries")
        best = None
        for turn in range(len(ROUNDS)):
            if best is None:
                state = known.withColumn("least", F.lit(None).cast("long"))
            else:
                state = known.join(best.where(F.col("rank") == k).select("q", F.col("score").alias("least")), "q", "left")
            packs = state.select("q", "query_id", "query", "least").mapInArrow(_packed(space, ring_ids, low, high, counts, k, turn, PACK), PACK_SCHEMA)
            packs = materialise(packs, base, f"packs-{turn}")
            if packs.isEmpty():
                continue
            met = index.select("ring", "cell", "low", "high", "ids", "vectors").join(packs, "ring").drop("ring")
            found = met.mapInArrow(_scored(space, k), FOUND_SCHEMA)
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = materialise(_best(found, k), base, f"best-{turn}")
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of each vector whose id is divisible by 100, over all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = vectors.where(F.pmod("vec_id", F.lit(100)) == 0).withColumnRenamed("vec_id", "query_id")
    return search(vectors, queries, 10)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, c AS own FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, own, vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(own), len(c)) + 1), lambda i: own[i] * c[i])), 0) AS score
  FROM q JOIN v ON v.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
