"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each half is quantised by its own centroids,
and a cell is a pair of centroids.  A query walks the cells by the sum of its
products with their two centroids, best first, with a heap over the two
sorted lists, until the cells hold its budget of vectors; these are reranked
by exact products.  The budget is a share of all vectors: the smallest one
that reached the target recall on a bounded sample.

Cells are packed into bins of bounded size, large cells cut by a hash.  Queries
are routed to the bins that they walk in; the queries of a bin are cut into
blocks, and every (bin, block) is one small matrix product.  A vector is sent
once for each block of its own bin's queries, never to blocks of others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm.common import checkpoint, quoted, rows_about

#: Vectors in the sample (about), vectors in a bin, queries in a block.
SAMPLE, BIN_ROWS, BLOCK_QUERIES = 8192, 8192, 4096
#: Centroids of each half: least and most, and vectors that a cell should hold.
CENTROIDS, MOST_CENTROIDS, CELL_ROWS = 64, 256, 64
TARGET_RECALL = 0.97
#: Every query gets this many candidates at least.
LEAST_CANDIDATES = 256


@dataclass
class Index:
    halves: tuple[np.ndarray, np.ndarray]
    cut: int
    share: float
    sizes: np.ndarray | None = None
    first_bin: np.ndarray | None = None
    bins: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: its nearest centroid in both halves."""
        parts = []
        for half, own in zip(self.halves, (x[:, : self.cut], x[:, self.cut :]), strict=True):
            parts.append((own @ half.T - 0.5 * (half * half).sum(1)).argmax(1))
        return parts[0] * len(self.halves[1]) + parts[1]

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.cut] @ self.halves[0].T, q[:, self.cut :] @ self.halves[1].T


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
    """Cells in falling order of ``left[i] + right[j]`` until they hold ``budget`` vectors."""
    a, b = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
    high, low = left[a].tolist(), right[b].tolist()
    count = sizes.tolist()
    heap = [(-(high[0] + low[0]), 0, 0)]
    out, held, width = [], 0, len(b)
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if count[cell]:
            out.append(cell)
            held += count[cell]
        if j + 1 < width:
            heapq.heappush(heap, (-(high[i] + low[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(high[i + 1] + low[0]), i + 1, 0))
    return out


def _centroids(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds from distinct sample rows."""
    own = np.unique(x, axis=0)
    centres = own[draw.choice(len(own), min(k, len(own)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def fit(sample: np.ndarray, neighbours: int, recall: float = TARGET_RECALL, seed: int = 3, centroids: int = CENTROIDS) -> Index:
    """Quantisers from a bounded sample, and the share of vectors a query must walk for ``recall``."""
    draw = np.random.Generator(np.random.PCG64(seed))
    cut = sample.shape[1] // 2
    index = Index((_centroids(sample[:, :cut], centroids, draw), _centroids(sample[:, cut:], centroids, draw)), cut, 1.0)
    probes = draw.choice(len(sample), min(256, len(sample)), replace=False)
    if len(sample) > 4 * neighbours:
        cell = index.cells(sample)
        sizes = np.bincount(cell, minlength=len(index.halves[0]) * len(index.halves[1]))
        left, right = index.products(sample[probes])
        needed = []
        for k, p in enumerate(probes.tolist()):
            scores = sample @ sample[p]
            scores[p] = -np.inf
            top = np.argpartition(-scores, neighbours)[:neighbours]
            sums = (left[k][:, None] + right[k][None, :]).ravel()
            order = np.argsort(-sums, kind="stable")
            before = np.empty(len(order))
            before[order] = np.cumsum(sizes[order])
            needed += (before[cell[top]] / len(sample)).tolist()
        index.share = float(np.quantile(needed, recall))
    return index


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", neighbours: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row where ``queries`` holds.

    Score is the inner product of the original vectors in double precision;
    ties go to the smaller key.  Rows without key, unusable vectors and
    vectors of another length than most take no part; of rows that repeat a
    key the one with the smallest vector counts.  A query's own key is no
    candidate of it.  Fewer candidates than asked for: all.
    """
    spark = vectors.sparkSession
    rows = vectors.select(quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"), queries.alias("asks")).where(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    widths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], empty)
    width, total = widths[0]["n"], widths[0]["rows"]
    rows = rows.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks"))
    sample = np.array([r["v"] for r in rows_about(rows, F.col("id"), SAMPLE, total).orderBy("id").limit(4 * SAMPLE).collect()], np.float64)
    centroids = int(min(MOST_CENTROIDS, max(CENTROIDS, (total / CELL_ROWS) ** 0.5)))  # cells grow with the vectors
    index = fit(sample, neighbours, centroids=centroids)
    budget = max(LEAST_CANDIDATES, int(np.ceil(index.share * total)) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = index.cells(_matrix(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "v", "asks", "cell"])

    placed = checkpoint(rows.mapInArrow(place, "id long, v array<double>, asks boolean, cell int"))
    sizes = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared rows
        sizes[r["cell"]] = r["count"]
    index.sizes = sizes
    index.bins = np.maximum(1, -(-sizes // BIN_ROWS))
    index.first_bin = np.zeros(len(sizes), np.int64)
    held = bin_number = 0
    for c in np.flatnonzero(sizes).tolist():
        if held and held + sizes[c] > BIN_ROWS:
            bin_number, held = bin_number + 1, 0
        index.first_bin[c] = bin_number
        held += int(sizes[c])
        if index.bins[c] > 1:
            bin_number, held = bin_number + int(index.bins[c]), 0

    def bin_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index
        for batch in batches:
            if batch.num_rows:
                cell = batch.column(2).to_numpy()
                part = own.first_bin[cell] + batch.column(3).to_numpy() % own.bins[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part, pa.int32())], names=["id", "v", "cell", "bin"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bin in which a query walks, with the sum at which its walk ended."""
        own = index
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), width)
            left, right = own.products(q)
            rows, bins, stops = [], [], []
            for k in range(len(q)):
                cells = np.array(walk(left[k], right[k], own.sizes, budget), np.int64)
                last = cells[-1]
                stop = left[k][last // right.shape[1]] + right[k][last % right.shape[1]]
                walked = set()
                for c in cells.tolist():
                    walked.update(range(int(own.first_bin[c]), int(own.first_bin[c] + own.bins[c])))
                rows += [k] * len(walked)
                bins += sorted(walked)
                stops += [stop] * len(walked)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(stops, pa.float64()), pa.array(bins, pa.int32())], names=["id", "stop", "bin"]
            )

    asking_rows = placed.where("asks").select("id", "v")
    routed = checkpoint(asking_rows.mapInArrow(route, "id long, stop double, bin int"))
    blocks = routed.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    stored = (
        placed.select("id", "v", "cell", F.pmod(F.xxhash64("id", F.lit("bin")), F.lit(1 << 30)).alias("draw"))
        .mapInArrow(bin_of, "id long, v array<double>, cell int, bin int")
        .join(blocks, "bin")
        .select("id", "v", "cell", "bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    asked = routed.join(blocks, "bin").select("id", "stop", "bin", F.pmod(F.xxhash64("id", "bin"), F.col("blocks")).cast("int").alias("block"))
    asked = asked.join(asking_rows, "id").select("id", "v", "stop", "bin", "block")

    def rerank(here: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if here.num_rows and asks.num_rows:
            own = index
            here = here.sort_by("id")
            ids, cells = here["id"].to_numpy(), here["cell"].to_numpy()
            x = _matrix(here["v"].combine_chunks(), width)
            q_ids, stops = asks["id"].to_numpy(), asks["stop"].to_numpy()
            q = _matrix(asks["v"].combine_chunks(), width)
            right_width = len(own.halves[1])
            longest = float(np.sqrt((x * x).sum(1).max()))
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                left, right = own.products(part)
                sums = left[:, cells // right_width] + right[:, cells % right_width]
                scores = part @ x.T
                blur = 1e-10 * longest * np.sqrt((part * part).sum(1))  # more than rounding can differ
                scores[(sums < (stops[a : a + 256] - blur)[:, None]) | (ids[None, :] == q_ids[a : a + 256, None])] = -np.inf
                for k in range(len(part)):
                    row = scores[k]
                    if len(row) > neighbours:
                        floor = np.partition(row, len(row) - neighbours)[len(row) - neighbours]
                        near = np.flatnonzero((row >= floor - blur[k]) & (row > -np.inf))
                    else:
                        near = np.flatnonzero(row > -np.inf)
                    exact = (x[near] * part[k]).sum(1)
                    best = near[np.lexsort((ids[near], -exact))[:neighbours]]
                    out_q.append(np.full(len(best), q_ids[a + k]))
                    out_v.append(ids[best])
                    out_s.append((x[best] * part[k]).sum(1))
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": join(out_q, pa.int64()), "vec_id": join(out_v, pa.int64()), "score": join(out_s, pa.float64())})

    found = stored.groupBy("bin", "block").cogroup(asked.groupBy("bin", "block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
