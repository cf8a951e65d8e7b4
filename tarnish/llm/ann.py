"""Approximate nearest neighbours: stable projections under a kd-tree.

Unit vectors are projected to ``m`` Gaussian coordinates.  For two points at
distance d the squared projected distance over d**2 follows a chi-square law
with m degrees of freedom, so once a query's k-th best verified distance is
d, every point beyond the projected radius ``d * sqrt(chi2_quantile)`` is
nearer than d only with a probability under ``1 - confidence``.  Candidates
are taken in rising projected distance, verified on the original vectors,
and the search ends when the next one lies beyond that radius.

The kd-tree has two layers: an upper one whose cells deal the rows to tasks
(its splits are fitted on a bounded sample; every row is indexed), and one
built in each task over its cell.  A query first searches its own cell,
which gives it a radius, and then only those cells whose true box the radius
reaches.  Cells over ``cell_rows`` rows are searched in chunks, and the
queries of a cell in parts.  A task verifies a query's candidates by rising
projected distance, in chunks, each of which shrinks the radius, until the
next candidate lies beyond it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

#: Parameters: projected coordinates (even), confidence of the stopping test,
#: rows in a cell, rows that the upper splits are fitted on, and kd-tree leaf size.
M, CONFIDENCE, CELL_ROWS, SAMPLE_ROWS, LEAF = 8, 0.98, 4096, 1 << 17, 32
#: Queries that a task takes for a cell, and projects at once; candidates
#: verified first, twice as many after each time.
PART_ROWS, BLOCK, FIRST = 4096, 128, 16


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for even ``m``, by bisection on the closed-form distribution."""
    if m % 2:
        raise ValueError("m must be even")

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 20.0 * m
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def fit_splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits in heap order; each node cuts its widest coordinate."""
    axis, cut = np.zeros(2**depth, dtype=np.int64), np.zeros(2**depth)
    parts = {1: points}
    for node in range(1, 2**depth):
        p = parts.pop(node)
        if len(p):
            a = int(np.argmax(np.ptp(p, axis=0)))
            axis[node], cut[node] = a, np.median(p[:, a])
        right = p[:, axis[node]] >= cut[node]
        parts[2 * node], parts[2 * node + 1] = p[~right], p[right]
    return axis, cut


def cell_of(points: np.ndarray, axis: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    for _ in range(depth):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] >= cut[node])
    return node - 2**depth


class LocalTree:
    """kd-tree over one cell: leaves of about ``LEAF`` points with their boxes."""

    def __init__(self, points: np.ndarray):
        parts, done = [np.arange(len(points))], []
        while parts:
            p = parts.pop()
            if len(p) <= LEAF:
                done.append(p)
                continue
            a = int(np.argmax(np.ptp(points[p], axis=0)))
            order = p[np.argsort(points[p, a], kind="stable")]
            parts += [order[: len(p) // 2], order[len(p) // 2 :]]
        self.points, self.leaves = points, done
        self.lo = np.array([points[p].min(0) for p in done])
        self.hi = np.array([points[p].max(0) for p in done])

    def reached(self, queries: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Rows of all leaves that the squared radius of a query reaches."""
        hit = box_distances(queries, self.lo, self.hi) <= limit[:, None]
        return np.concatenate([self.leaves[i] for i in np.flatnonzero(hit.any(0))] or [np.empty(0, dtype=np.int64)])

    def search(self, queries: np.ndarray, unit: np.ndarray, unit_queries: np.ndarray, k: int, bound: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (-1: none) and squared distances of the k nearest verified of
        each query, and how many were verified; ``bound`` are squared
        distances reached elsewhere."""
        rows, n = self.reached(queries, bound * quantile), len(queries)
        best, dist, verified = np.full((n, k), -1), np.full((n, k), np.inf), np.zeros(n, dtype=np.int64)
        if not len(rows):
            return best, dist, verified
        here = self.points[rows]
        step = np.maximum(0, (queries * queries).sum(1)[:, None] + (here * here).sum(1) - 2 * queries @ here.T)
        for q in range(n):
            near, limit = step[q], bound[q]
            first = np.argpartition(near, FIRST - 1)[:FIRST] if len(near) > FIRST else np.arange(len(near))
            chunk, rest, at = first[near[first] <= limit * quantile], None, 0
            while len(chunk):
                take = rows[chunk]
                found, names = np.r_[dist[q], 2 - 2 * unit[take] @ unit_queries[q]], np.r_[best[q], take]
                keep = np.argsort(found, kind="stable")[:k]
                best[q], dist[q] = names[keep], found[keep]
                verified[q] += len(chunk)
                limit = min(limit, dist[q, k - 1])  # the stopping test shrinks the radius
                if rest is None:  # only what the first chunk's radius leaves is sorted
                    inside = near <= limit * quantile
                    inside[first] = False
                    rest = np.flatnonzero(inside)
                    rest = rest[np.argsort(near[rest], kind="stable")]
                chunk = rest[at : at + verified[q]]
                at += len(chunk)
                chunk = chunk[near[chunk] <= limit * quantile]
        return best, dist, verified


def box_distances(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    total = np.zeros((len(points), len(lo)))
    for j in range(points.shape[1]):
        gap = np.maximum(0, np.maximum(lo[None, :, j] - points[:, None, j], points[:, None, j] - hi[None, :, j]))
        total += gap * gap
    return total


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, largest components between 1/2 and 1: sums
    of squares can't overflow, and cosines are the same to the last bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One (id, vec) row for each id: vectors that are null, empty, zero, or
    hold null or non-finite components go, as do null ids and vectors of
    another length than the most frequent one (the shorter, in a tie).  Of
    different vectors under one id the smallest stays."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & ok)
    sizes = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return good
    return good.where(F.size("vec") == sizes["dim"]).groupBy("id").agg(F.min("vec").alias("vec"))


def nearest_neighbours(df: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", is_query=None, m: int = M, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` rows of largest cosine for each query row.

    ``is_query`` is a condition on the column ``id``; every other valid row
    is a candidate.  Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id.  Equal vectors are indexed once, with their
    ``k + 1`` smallest ids: no more of them can appear in any answer.
    Invalid vectors (see ``valid_vectors``) take no part; a query with fewer
    candidates gets all of them; an empty table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    is_query = F.col("id") % 50 == 0 if is_query is None else is_query
    rows = written(valid_vectors(df, id_col, vec_col), "ann-rows")
    first = Window.partitionBy("vec").orderBy("id")
    index = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    head = rows.first()
    dim = len(head["vec"]) if head else 1
    turn, quantile = projection(dim, m), chi_square_quantile(confidence, m)

    def project(batches):
        for b in batches:
            p = _unit(_matrix(b.column("vec"))) @ turn if b.num_rows else np.empty((0, m))
            yield b.append_column("p", pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), m).cast(pa.list_(pa.float64())))

    index = written(index.mapInArrow(project, "vec array<double>, ids array<long>, p array<double>"), "ann-index")
    total = index.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = index.where(F.pmod(F.xxhash64("ids"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("p").limit(2 * SAMPLE_ROWS).toArrow()
    depth = max(0, min(math.ceil(math.log2(max(1, total / cell_rows))), int(math.log2(max(1, sample.num_rows / 16)))))
    axis, cut = fit_splits(_matrix(sample.column("p")).reshape(-1, m), depth)

    def place(batches):
        for b in batches:
            yield b.append_column("cell", pa.array(cell_of(_matrix(b.column("p")), axis, cut, depth) if b.num_rows else [], pa.int64()))

    celled = index.mapInArrow(place, "vec array<double>, ids array<long>, p array<double>, cell long")
    sides = [f(F.col("p")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(m)]
    cells = written(celled.groupBy("cell").agg(F.count("*").alias("count"), *sides), "ann-cells")  # at most SAMPLE_ROWS / 8 rows
    boxes = sorted(cells.collect(), key=lambda r: r["cell"])
    lo, hi = (np.array([[r[f"{f}{j}"] for j in range(m)] for r in boxes]).reshape(-1, m) for f in ("min", "max"))
    numbers = np.array([r["cell"] for r in boxes], dtype=np.int64)
    counts = F.broadcast(cells.select("cell", F.ceil(F.col("count") / (2 * cell_rows)).cast("int").alias("chunks")))
    celled = celled.join(counts, "cell").withColumn("chunk", F.pmod(F.xxhash64("ids"), "chunks").cast("int"))
    asked = written(rows.where(is_query), "ann-queries")
    wanted = asked.groupBy("vec").agg(F.min("id").alias("q"))
    wanted = wanted.mapInArrow(project, "vec array<double>, q long, p array<double>").mapInArrow(place, "vec array<double>, q long, p array<double>, cell long")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "score": [], "ids": [], "d": []}
        if left.num_rows and right.num_rows:
            raw, qraw = _scaled(_matrix(right.column("vec"))), _scaled(_matrix(left.column("vec")))
            unit, qunit, qp = _unit(raw), _unit(qraw), _matrix(left.column("p"))
            tree, ids = LocalTree(_matrix(right.column("p"))), right.column("ids").to_pylist()
            norms = np.sqrt((raw * raw).sum(1))
            names, bound = left.column("q").to_pylist(), left.column("bound").to_numpy()
            qnorms = np.sqrt((qraw * qraw).sum(1))
            for a in range(0, len(qp), BLOCK):
                # one more than k: a query's own vector is among those found
                best, dist, _ = tree.search(qp[a : a + BLOCK], unit, qunit[a : a + BLOCK], k + 1, bound[a : a + BLOCK], quantile)
                for i, j in zip(*np.nonzero(best >= 0), strict=True):
                    r, q = int(best[i, j]), a + int(i)
                    out["q"].append(names[q])
                    out["score"].append(float((raw[r] * qraw[q]).sum()) / float(qnorms[q] * norms[r]))
                    out["ids"].append(ids[r])
                    out["d"].append(float(dist[i, j]))
        return pa.table(out, schema=pa.schema({"q": pa.int64(), "score": pa.float64(), "ids": pa.list_(pa.int64()), "d": pa.float64()}))

    shape = "q long, score double, ids array<long>, d double"

    def searched(asks: DataFrame, rows: DataFrame) -> DataFrame:
        """The queries of a cell in parts of about ``PART_ROWS``."""
        parts = asks.groupBy("cell", "chunk").count().select("cell", "chunk", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
        parts = F.broadcast(written(parts, "ann-parts"))  # a row for each cell and chunk
        asks = asks.join(parts, ["cell", "chunk"]).withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int")).drop("parts")
        rows = rows.join(parts, ["cell", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        by = ("cell", "chunk", "part")
        return asks.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(answer, shape)

    home = wanted.withColumns({"chunk": F.lit(0), "bound": F.lit(float("inf"))})
    own = written(searched(home, celled.where("chunk = 0")), "ann-home")
    # the k + 1 nearest vectors found at home bound the rest of the search
    bound = own.groupBy("q").agg(F.when(F.count("*") > k, F.max("d")).otherwise(float("inf")).alias("bound"))
    bounded = wanted.join(bound, "q", "left").fillna(float("inf"), ["bound"])

    def reach(batches):
        for b in batches:
            p, limit = _matrix(b.column("p")), b.column("bound").to_numpy(zero_copy_only=False)
            take, cells = [], []
            for a in range(0, b.num_rows, BLOCK):
                at, cell = np.nonzero(box_distances(p[a : a + BLOCK], lo, hi) <= limit[a : a + BLOCK, None] * quantile)
                take += (a + at).tolist()
                cells += numbers[cell].tolist()
            near = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([near.column(c) for c in ("vec", "q", "p", "bound")] + [near.column("cell"), pa.array(cells, pa.int64())], names=["vec", "q", "p", "bound", "home", "cell"])

    around = bounded.mapInArrow(reach, "vec array<double>, q long, p array<double>, bound double, home long, cell long")
    around = around.join(counts, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    around = around.where((F.col("cell") != F.col("home")) | (F.col("chunk") != 0)).drop("home", "chunks")
    rest = searched(around, celled)
    found = own.unionByName(rest).select("q", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    queries = asked.join(asked.groupBy("vec").agg(F.min("id").alias("q")), "vec").select(F.col("id").alias("query_id"), "q")
    out = queries.join(found, "q").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
