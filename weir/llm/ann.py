"""Approximate nearest neighbours: stable projections in a kd-tree.

Vectors are projected to ``DIMS`` dimensions with Gaussian (2-stable) weights.
For two vectors at distance d the squared projected distance is d^2 times a
chi-square variable of ``DIMS`` degrees, so a kd-tree over the projections
yields candidates in order of projected distance and each is verified with its
true distance.  The search of a query stops when the chance that a vector
nearer than the k-th found still lies beyond the projected frontier is below
``1 - CONFIDENCE`` by the chi-square test.

The tree has two levels.  The upper one is fitted on a sample of at most about
``SAMPLE_ROWS`` rows and cuts the projected space once, into cells of about
``CELL_ROWS`` rows; every row is sent to its cell.  A cell that the sample says
is larger (many equal vectors) is dealt to several blocks.  The lower level is
a kd-tree over the rows of a block.

A query first meets one block of its own cell.  The k-th distance found there
bounds the rest: it is then sent to those cells only whose box passes the
chi-square test with this bound, and there meets leaf after leaf, nearest box
first, until the test fails.  All queries of a block advance together, so the
distances are matrix products; what might be among the k best is computed again
from the differences in double precision.  A block with more than
``QUERY_ROWS`` queries is copied for each group of so many.

How many cells a query meets depends on the data: where the k-th distance is
near the mean distance no projection of so few dimensions separates them, and
nearly all cells pass.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, neither as query nor as candidate; vectors of another length than
the query's are no candidates of it; ties go to the smaller id; rows of the
query's own id are not its candidates; an id that stands in several rows is one
candidate, at its smallest distance, and one query, that of its smallest
vector; with fewer candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import cut, small_batches, table

DIMS = 8
CONFIDENCE = 0.97
SAMPLE_ROWS = 1 << 16
CELL_ROWS = 8192
QUERY_ROWS = 2048
LEAF = 256
K = 10

ASKED = "cell int, block int, id long, v array<double>, bound double"
FOUND = "query_id long, vec_id long, score double"


def chi_square_limit(dims: int, confidence: float) -> float:
    """The quantile of the chi-square distribution (even ``dims``), by bisection of its closed form."""
    half = dims // 2

    def below(x: float) -> float:
        return 1.0 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(half))

    low, high = 0.0, 40.0 * dims
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < confidence else (low, mid)
    return high


def projection(width: int, dims: int = DIMS, seed: int = 3) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dims))


class KdTree:
    """Leaves of a kd-tree over points: ``order[bounds[k] : bounds[k + 1]]`` with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        low, high, ends = [], [], [0]
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[self.order[a:b]]
            least, most = own.min(0), own.max(0)
            axis = int((most - least).argmax())
            if b - a > leaf and most[axis] > least[axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                todo += [(a + mid, b), (a, a + mid)]
            else:
                low.append(least)
                high.append(most)
                ends.append(b)
        self.low, self.high, self.bounds = np.array(low), np.array(high), ends


def box_distances(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of every point (rows) to every box (columns)."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - points[:, None, j], points[:, None, j] - high[None, :, j]), 0)
        out += gap * gap
    return out


class Cells:
    """The upper tree of one vector length: splits, boxes, and the blocks of each cell; ``first`` numbers its cells."""

    def __init__(self, sample: np.ndarray, n_rows: float, cell_rows: int, first: int = 0, least: int = 16) -> None:
        dims = sample.shape[1]
        self.first = first
        self.split: list[tuple[int, float, int, int]] = []  # axis, threshold, children (below 0: cell -1 - child)
        low, high, self.blocks = [], [], []
        per_row = n_rows / max(len(sample), 1)

        def grow(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(dims)
            axis = int(spread.argmax())
            if len(points) * per_row > cell_rows and len(points) >= 2 * least and spread[axis] > 0:
                at = float(np.median(points[:, axis]))
                left = points[:, axis] < at
                if not left.any():  # half of them equal the smallest
                    at = float(points[points[:, axis] > at, axis].min())
                    left = points[:, axis] < at
                me = len(self.split)
                self.split.append((axis, at, 0, 0))
                below, above = hi.copy(), lo.copy()
                below[axis] = above[axis] = at
                self.split[me] = (axis, at, grow(points[left], lo, below), grow(points[~left], above, hi))
                return me
            low.append(lo)
            high.append(hi)
            self.blocks.append(max(1, math.ceil(len(points) * per_row / cell_rows)))
            return -len(low)

        self.root = grow(sample, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(low), np.array(high)
        self.n_blocks = np.array(self.blocks)

    def locate(self, points: np.ndarray) -> np.ndarray:
        """Index of the cell of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                axis, at, left, right = self.split[node]
                less = points[rows, axis] < at
                todo += [(left, rows[less]), (right, rows[~less])]
        return out


class Best:
    """The k nearest found of some queries; each candidate id counts once, at its smallest distance."""

    def __init__(self, bounds: np.ndarray, k: int) -> None:
        self.k, self.n = k, len(bounds)
        self.first_bound = bounds  # squared; of what was found elsewhere
        self.query, self.far, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bound = bounds.copy()

    def add(self, query: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        query, far, ids = (np.concatenate(x) for x in ((self.query, query), (self.far, far), (self.id, ids)))
        order = np.lexsort((far, ids, query))
        query, far, ids = query[order], far[order], ids[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
        query, far, ids = query[new], far[new], ids[new]
        order = np.lexsort((ids, far, query))
        query, far, ids = query[order], far[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        last = rank == self.k - 1
        self.bound = self.first_bound.copy()
        self.bound[query[last]] = np.minimum(self.bound[query[last]], far[last])
        self.query, self.far, self.id = query[top], far[top], ids[top]


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray, limit: float, k: int = K, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows found of every query within its squared bound: query ids, ids, distances."""
    if len(np.unique(ids)) < len(ids):  # equal rows once
        _, keep = np.unique(np.concatenate((ids[:, None].view(np.float64), vectors), axis=1), axis=0, return_index=True)
        vectors, ids = vectors[keep], ids[keep]
    repeated = len(np.unique(ids)) < len(ids)
    points, asked = vectors @ weights, queries @ weights
    tree = KdTree(points, leaf)
    vectors, ids, points = vectors[tree.order], ids[tree.order], points[tree.order]
    sizes, query_sizes = np.einsum("ij,ij->i", vectors, vectors), np.einsum("ij,ij->i", queries, queries)
    slack = 1e-12 * (sizes.max() + query_sizes)  # of the distances by products
    far = box_distances(tree.low, tree.high, asked)
    order = np.argsort(far, axis=1, kind="stable")
    best = Best(bounds, k)
    active = np.arange(len(queries))
    for step in range(order.shape[1]):
        leaves = order[active, step]
        # vectors within the k-th distance would, by the test, have shown up before the frontier
        go = far[active, leaves] <= limit * best.bound[active]
        active, leaves = active[go], leaves[go]
        if not len(active):
            break
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_leaf = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.diff(leaves[by_leaf], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(by_leaf)], strict=True):
            own = active[by_leaf[a:b]]
            here = slice(tree.bounds[leaves[by_leaf[a]]], tree.bounds[leaves[by_leaf[a]] + 1])
            near = points[here]
            near = np.einsum("ij,ij->i", near, near)[None] - 2 * asked[own] @ near.T + np.einsum("ij,ij->i", asked[own], asked[own])[:, None]
            d = sizes[here][None] - 2 * queries[own] @ vectors[here].T + query_sizes[own][:, None]
            most = best.bound[own]
            d[(near > (limit * most + 1e-9 * (1 + np.abs(most)))[:, None]) | (ids[here][None] == query_ids[own][:, None])] = np.inf
            if d.shape[1] > k and not repeated:
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            q, r = np.nonzero(d <= (most + slack[own])[:, None])
            fine = np.isfinite(d[q, r])
            q, r = own[q[fine]], r[fine] + here.start
            for s in range(0, len(q), 1 << 15):
                diff = vectors[r[s : s + (1 << 15)]] - queries[q[s : s + (1 << 15)]]
                pairs.append((q[s : s + (1 << 15)], np.einsum("ij,ij->i", diff, diff), ids[r[s : s + (1 << 15)]]))
        if pairs:
            best.add(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
    return query_ids[best.query], best.id, np.sqrt(best.far)


def usable(vector: Column) -> Column:
    """Not null or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length in a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        yield width, rows, flat[starts[rows][:, None] + np.arange(width)]


def fit_cells(sample: pa.Array, n_rows: int, dims: int = DIMS, cell_rows: int = CELL_ROWS) -> dict[int, Cells]:
    """The upper tree of every vector length in the sample."""
    out: dict[int, Cells] = {}
    first = 1  # cell 0 is that of lengths that the sample lacks
    for width, rows, vectors in _by_width(sample):
        out[width] = Cells(vectors @ projection(width, dims), n_rows * len(rows) / len(sample), cell_rows, first)
        first += len(out[width].low)
    return out


def nearest(base: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest rows of ``base`` found for every query id: query_id, rank, vec_id, score."""
    spark = base.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    base = ready(base)
    queries = cut(ready(queries).groupBy("id").agg(F.min("v").alias("v")))
    n_rows = base.count()
    share = min(1.0, SAMPLE_ROWS / max(n_rows, 1))
    sample = (base.sample(share, 7) if share < 1 else base).select("v").limit(2 * SAMPLE_ROWS).toArrow()["v"].combine_chunks()
    cells = spark.sparkContext.broadcast(fit_cells(sample, n_rows, dims, cell_rows))  # bounded by the sample
    limit = chi_square_limit(dims, confidence)
    block = lambda ids, counts: (np.abs(ids * 0x9E3779B1 >> 7) % counts).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, or queries without a bound, with cell and block."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cell, own = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
            for width, rows, vectors in _by_width(batch.column(1)):
                tree = cells.value.get(width)
                if tree is not None:
                    at = tree.locate(vectors @ projection(width, dims))
                    cell[rows] = at + tree.first
                    # equal ids with equal vectors may be most of a cell: the place in the batch deals them, too
                    own[rows] = block(ids[rows] + rows, tree.n_blocks[at])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own), *batch.columns], names=["cell", "block", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with all blocks that the test can't exclude, but the one they have met."""
        for batch in batches:
            ids, met_cell, met_block = (batch.column(c).to_numpy() for c in (0, 2, 3))
            bounds = batch.column(4).to_numpy(zero_copy_only=False)
            for width, rows, vectors in _by_width(batch.column(1)):
                tree = cells.value.get(width)
                if tree is None:
                    continue
                points = vectors @ projection(width, dims)
                for a in range(0, len(rows), 64):
                    some = rows[a : a + 64]
                    q, c = np.nonzero(box_distances(tree.low, tree.high, points[a : a + 64]) <= limit * bounds[some][:, None])
                    many = tree.n_blocks[c]
                    q, c = np.repeat(some[q], many), np.repeat(c, many)
                    b = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many)
                    new = (c + tree.first != met_cell[q]) | (b != met_block[q])
                    q, c, b = q[new], c[new], b[new]
                    yield pa.RecordBatch.from_arrays([pa.array(c + tree.first, pa.int32()), pa.array(b, pa.int32()), pa.array(ids[q]), batch.column(1).take(pa.array(q)), pa.array(bounds[q])], names=["cell", "block", "id", "v", "bound"])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            own_size, size = left["v"].map(len).to_numpy(), right["w"].map(len).to_numpy()
            for width in np.unique(size).tolist():
                mine, theirs = left[own_size == width], right[size == width]
                if len(mine):
                    vectors, wanted = np.stack(mine["v"].to_list()), np.stack(theirs["w"].to_list())
                    found = search(vectors, mine["id"].to_numpy(), wanted, theirs["asked"].to_numpy(), theirs["bound"].to_numpy(), projection(width, dims), limit, k)
                    out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True))))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    dealt = small_batches(base).mapInArrow(deal, "cell int, block int, id long, v array<double>")

    def match(asked: DataFrame) -> DataFrame:
        """What the rows of the asked blocks give; blocks nobody asks are dropped before they are sent."""
        place = ["cell", "block", "part"]
        parts = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
        rows = dealt.join(parts, ["cell", "block"]).select(*place[:2], F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "id", "v")
        wanted = asked.join(parts, ["cell", "block"]).select(*place[:2], F.expr("CAST(pmod(xxhash64(id), parts) AS INT)").alias("part"), "id", "v", "bound").toDF(*place, "asked", "w", "bound")
        return rows.groupBy(*place).cogroup(wanted.groupBy(*place)).applyInPandas(meet, FOUND)

    home = cut(queries.mapInArrow(deal, "cell int, block int, id long, v array<double>"))
    near = cut(match(home.withColumn("bound", F.lit(float("inf")))))
    full = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score") * F.max("score")).alias("bound"))
    known = home.join(full, "id", "left").select("id", "v", "cell", "block", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    rest = match(cut(known.mapInArrow(spread, ASKED)))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    each = near.union(rest).repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
