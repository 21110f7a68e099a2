"""Exact top-k by inner product with M-trees and best-first search.

Vectors are turned to integers; the largest inner products with a query are the smallest
Euclidean distances once every vector x gets one more component, sqrt(M - |x|^2), and every
query a zero there, with M the largest squared length: d^2 = |q|^2 + M - 2 q.x. That is a
metric, so an M-tree applies: pages of entries, each with its distance to the page's
routing object, and on each page's own entry above a covering radius.

Rows are dealt to shards by a hash of their id and of the input's partition, so neither a
vector nor an id that a third of all rows repeat falls into one shard, and each shard (of ``SHARD`` rows or so) builds its tree in one
task. All queries then stream past every shard's tree; each searches it best first: a
heap of pages by their lower bound, an entry's distance computed only if the stored
distance to its parent leaves it in reach by the triangle inequality, until no page can
hold anything better. Ties in the score go to the smaller id, so bounds prune only what is
strictly worse. The shards' best are merged by query, combined before the shuffle.

Scores are exact integers; distances are floating point and are given a margin of their
rounding, so no bound cuts off a true answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, SHARD, PAGE = 256, 4096, 64
SAFE = 2.0**52


class MTree:
    """A tree over the rows of an integer matrix.

    ``levels[0]`` has the leaf pages' entries, the rows of ``points`` in page order;
    ``levels[i]`` above has the routing objects: (first entry below, one past the last,
    centre, covering radius). ``up[i]`` has each entry's distance to its page's centre.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, bound: float, page: int = PAGE, seed: int = 0) -> None:
        self.points, self.ids = points, ids
        x = points.astype(np.float64)
        self.square = bound
        self.x = np.concatenate([x, np.sqrt(np.maximum(bound - (x * x).sum(1), 0.0))[:, None]], 1)
        self.margin = 1e-6 * (1.0 + np.sqrt(bound))
        rng = np.random.default_rng(seed)
        order, cuts = self._pages(self.x, np.arange(len(x)), page, rng)
        self.x, self.points, self.ids = self.x[order], self.points[order], self.ids[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # first, stop, centre, radius
        self.up: list[np.ndarray] = []
        below, reach = self.x, np.zeros(len(x))
        while True:
            first, stop = cuts[:-1], cuts[1:]
            centre = np.stack([self._centre(below[a:b]) for a, b in zip(first, stop, strict=True)])
            of = np.repeat(np.arange(len(first)), stop - first)
            up = np.sqrt(((below - centre[of]) ** 2).sum(1))
            radius = np.zeros(len(first))
            np.maximum.at(radius, of, up + reach)
            self.up.append(up)
            if len(first) == 1:
                self.levels.append((first, stop, centre, radius))
                break
            order, cuts = self._pages(centre, np.arange(len(centre)), page, rng)
            self.levels.append((first[order], stop[order], centre[order], radius[order]))
            below, reach = centre[order], radius[order]

    @staticmethod
    def _centre(x: np.ndarray) -> np.ndarray:
        """The entry nearest to the mean, so that routing objects are objects."""
        return x[((x - x.mean(0)) ** 2).sum(1).argmin()]

    @staticmethod
    def _pages(x: np.ndarray, rows: np.ndarray, page: int, rng) -> tuple[np.ndarray, np.ndarray]:
        """Rows in page order and the pages' cuts: halves by nearness to two distant objects, down to pages of at most ``page``."""
        out, cuts, todo = [], [0], [rows]
        while todo:
            part = todo.pop()
            if len(part) <= page:
                out.append(part)
                cuts.append(cuts[-1] + len(part))
                continue
            y = x[part]
            a = y[rng.integers(len(part))]
            a = y[((y - a) ** 2).sum(1).argmax()]
            b = y[((y - a) ** 2).sum(1).argmax()]
            side = np.argsort(y @ (a - b), kind="stable")
            todo += [part[side[: len(part) // 2]], part[side[len(part) // 2 :]]]
        return (np.concatenate(out) if out else rows), np.array(cuts)

    def search(self, query: np.ndarray, own, k: int) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (score, id) but for id ``own``, best first, and how many distances were computed."""
        q = np.append(query.astype(np.float64), 0.0)
        length = float(query.astype(np.float64) @ query.astype(np.float64))
        top = len(self.levels) - 1
        first, stop, centre, radius = self.levels[top]
        d = float(np.sqrt(((centre[0] - q) ** 2).sum()))
        heap: list[tuple[float, int, int, float]] = [(d - radius[0], top, 0, d)]
        best: list[tuple[int, int]] = []  # as a heap: worst first, (score, -id)
        reach, done = np.inf, 1
        while heap and heap[0][0] <= reach:
            _, level, entry, d = heapq.heappop(heap)
            a, b = int(self.levels[level][0][entry]), int(self.levels[level][1][entry])
            apart = np.abs(d - self.up[level][a:b])
            if level == 0:
                near = np.flatnonzero(apart <= reach)
                done += len(near)
                if not len(near):
                    continue
                score = exact_products(self.points[a:b][near], query)
                if len(best) == k:
                    keep = score >= best[0][0]
                    near, score = near[keep], score[keep]
                if len(near) > 2 * k + 2:  # only those at least as good as the last that can enter
                    least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    keep = score >= least
                    near, score = near[keep], score[keep]
                for s, i in sorted(zip(score.tolist(), (-self.ids[a:b][near]).tolist(), strict=True), reverse=True):
                    if -i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, i))
                    elif (s, i) > best[0]:
                        heapq.heapreplace(best, (s, i))
                    elif s < best[0][0]:
                        break
                if len(best) == k:
                    reach = np.sqrt(max(length + self.square - 2.0 * best[0][0], 0.0)) + self.margin * (1.0 + np.sqrt(length) / (1.0 + np.sqrt(self.square)))
            else:
                _, _, centre, radius = self.levels[level - 1]
                near = np.flatnonzero(apart - radius[a:b] <= reach) + a
                done += len(near)
                far = np.sqrt(((centre[near] - q) ** 2).sum(1))
                for e, f, r in zip(near.tolist(), far.tolist(), radius[near].tolist(), strict=True):
                    if f - r <= reach:
                        heapq.heappush(heap, (f - r, level - 1, e, f))
        return [(s, -i) for s, i in sorted(best, reverse=True)], done


def exact_products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the range of a long they stay at its ends."""
    if points.dtype != object:
        p, q = points.astype(np.float64), query.astype(np.float64)
        if float(np.abs(p).max(initial=0.0)) * float(np.abs(q).sum()) < SAFE:
            return (p @ q).astype(np.int64)
    q = [int(v) for v in query]
    return np.array([max(min(sum(int(a) * b for a, b in zip(p, q, strict=True)), (1 << 63) - 1), -(1 << 63) + 1) for p in points], dtype=np.int64)


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers as float64, which holds them exactly; shorter vectors end in zeros."""
    offsets = vectors.offsets.to_numpy()
    flat, size = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def top_inner_products(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, shard: int = SHARD) -> DataFrame:
    """For each query, the ``k`` rows with the highest inner product but for rows of its own id.

    Components are floor(256 x) as integers. ``queries`` has the columns of ``vectors``; if
    None, the rows whose id is divisible by 50. Returns query_id, rank (from 1), ``id_col``,
    score. Equal scores go to the smaller id.

    Rows with a null id, and vectors that are null or hold a null or non-finite component,
    take no part. Vectors of unequal lengths count as if the shorter ended in zeros. If an id
    repeats, each of its rows is a candidate; as a query an id counts once (its smallest
    vector). Fewer candidates than ``k`` return all; empty tables give no rows. Scores beyond
    a long stay at its ends. Other columns are not read.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
        ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    rows = usable(vectors)
    asked = usable(queries if queries is not None else vectors.where(F.col(id_col) % 50 == 0)).groupBy("id").agg(F.min("v").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, bound, width = rows.agg(F.count(F.lit(1)), F.max(length), F.max(F.size("v"))).first()
    wider = asked.agg(F.max(F.size("v"))).first()[0]
    width, bound = max(width or 0, wider or 0), float(bound or 0.0)
    shards = max(1, -(-(n or 0) // shard))
    stored = rows.select(F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(shards)).cast("int").alias("s"), F.lit(0).alias("kind"), "id", "v")
    sought = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.lit(1).alias("kind"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, tree = None, [], None
        for b in batches:
            shard_of, kind, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.append(True, (shard_of[1:] != shard_of[:-1]) | (kind[1:] != kind[:-1]))) if b.num_rows else []
            for low, high in zip(edges, [*edges[1:], b.num_rows], strict=True):
                if shard_of[low] != at:
                    at, points, tree = shard_of[low], [], None
                own, x = ids[low:high], _matrix(b.column(3).slice(low, high - low), width)
                if kind[low] == 0:
                    points.append((own, x))
                    continue
                if not points:
                    continue
                if tree is None:
                    tree = MTree(np.concatenate([p[1] for p in points]), np.concatenate([p[0] for p in points]), bound)
                out = [(q, i, score) for q, v in zip(own.tolist(), x, strict=True) for score, i in tree.search(v, q, k)[0]]
                columns = zip(*out, strict=True) if out else ((),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    # a shard's rows come first, then the queries stream past its tree
    dealt = stored.union(sought).repartition(shards, "s").sortWithinPartitions("s", "kind", "id", "v")
    found = dealt.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
