"""Exact search of the k largest inner products with KD-trees.

Vectors are dealt into shards by median splits of a bounded sample, so that a shard's vectors lie near each other;
leaves that hold too many (such as equal ones) are dealt further by row. A shard's tree splits at the median of its
widest dimension and keeps a tight box for each node. A search visits nodes best bound first; a box's bound is the
largest inner product that any point of it could have. It ends when the best bound is under the k-th best score, which
is propagated: each query first searches the shard with the best bound, and its k-th score there is the least that
counts in all others. It is sent only to shards whose own box reaches that score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import join_back, stage_table

#: Vectors of one shard, about; of a leaf at most; queries that meet a shard in one task, about.
SHARD, LEAF, QUERIES = 20_000, 256, 20_000
#: Vectors that the shards' splits are taken from; most splits in a row; lengths of vectors that get splits and boxes, the commonest ones.
SAMPLE, DEPTH, LENGTHS = 4096, 12, 16
_LEAST = -(2**63)


class KdTree:
    """Integer points with ids; equal points and any number of points are allowed."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.nodes: list[tuple[int, int, int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.order = np.arange(len(ids))
        if len(ids):
            self._split(0, len(ids))
        self.ids, self.points = self.ids[self.order], self.points[self.order]
        exact = np.abs(points).max(initial=0) < 2**20
        self.work = self.points.astype(np.float64) if exact else self.points

    def _split(self, start: int, end: int) -> int:
        at = len(self.nodes)
        part = self.points[self.order[start:end]]
        low, high = part.min(axis=0), part.max(axis=0)
        self.nodes.append((start, end, -1, -1))
        self.low.append(low.astype(np.float64)), self.high.append(high.astype(np.float64))
        widest = int(np.argmax(high.astype(np.float64) - low.astype(np.float64))) if part.shape[1] else 0
        if end - start > LEAF and part.shape[1] and high[widest] > low[widest]:
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(part[:, widest], middle)]
            left = self._split(start, start + middle)
            self.nodes[at] = (start, end, left, self._split(start + middle, end))
        return at

    def bound(self, node: int, query: np.ndarray) -> float:
        """No point in the node's box has a larger inner product."""
        b = float(np.maximum(query * self.low[node], query * self.high[node]).sum())
        return b + abs(b) * 1e-9 + 1e-6

    def search(self, own: int, query: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, id) of the k best points by score, then smaller id, whose score is ``least`` or more, without ``own``."""
        if not self.nodes:
            return []
        q = query.astype(np.float64)
        asked = q if self.work.dtype == np.float64 and np.abs(query).max(initial=0) < 2**20 else query
        work = self.work if asked is q else self.points
        best: list[tuple[int, int]] = []
        open_nodes = [(-self.bound(0, q), 0)]
        while open_nodes:
            b, node = heapq.heappop(open_nodes)
            if -b < least:
                break
            start, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if (c := self.bound(child, q)) >= least:
                        heapq.heappush(open_nodes, (-c, child))
                continue
            scores = work[start:end] @ asked
            for i in np.flatnonzero(scores >= least).tolist():
                vec = int(self.ids[start + i])
                if vec != own:
                    best.append((int(scores[i]), vec))
            if len(best) >= k:
                best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
                least = max(least, best[-1][0])
        return sorted(best, key=lambda x: (-x[0], x[1]))[:k]


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def _whole(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _packed(v: np.ndarray) -> bytes:
    """The smallest of 2, 4 and 8 bytes for each component that holds all of them."""
    most = int(np.abs(v).max(initial=0))
    return v.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8").tobytes()


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // dim}").astype(np.int64) if dim else np.empty(0, np.int64)


def splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of 2**depth - 1 splits in heap order: at the median of the widest dimension of what comes to each."""
    dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1, np.int64)
    parts: dict[int, np.ndarray] = {0: points}
    for node in range(len(dims)):
        part = parts.pop(node)
        if len(part):
            dims[node] = np.argmax(part.max(axis=0).astype(np.float64) - part.min(axis=0))
            cuts[node] = np.median(part[:, dims[node]])
        over = part[:, dims[node]] >= cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~over], part[over]
    return dims, cuts


def _dealt(rows: DataFrame, trees: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(row, vec_id, asks, dim, leaf, v): packed vectors and the leaf of their length's splits; 0 where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, leaf, packed = b.column(3).to_numpy(), np.zeros(b.num_rows, np.int32), []
            lists = b.column(4)
            flat, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(dims)))
            for i in range(b.num_rows):
                packed.append(_packed(flat[offsets[i] : offsets[i + 1]]))
            for dim in np.unique(dims).tolist():
                if dim not in trees:
                    continue
                at = np.flatnonzero(dims == dim)
                points = flat[offsets[at][:, None] + np.arange(dim)]
                axis, cuts = trees[dim]
                node = np.zeros(len(at), np.int64)
                while len(cuts) and node[0] < len(cuts):
                    node = 2 * node + 1 + (points[np.arange(len(at)), axis[node]] >= cuts[node])
                leaf[at] = node - len(cuts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(leaf), pa.array(packed, pa.binary())], ["row", "vec_id", "asks", "dim", "leaf", "v"])

    return rows.select("row", "vec_id", "asks", "dim", "v").mapInArrow(run, "row long, vec_id long, asks boolean, dim int, leaf int, v binary")


_KEY = ["dim", "leaf", "sub"]


def _boxes(dealt: DataFrame) -> DataFrame:
    """(dim, leaf, sub, low, high): each shard's tight box. Tasks send one box for each shard that they have rows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for *key, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low, high = _unpacked(low, key[0]), _unpacked(high, key[0])
                got = held.get(tuple(key))
                held[tuple(key)] = (np.minimum(got[0], low), np.maximum(got[1], high)) if got else (low, high)
        for key, (low, high) in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([_packed(low)], pa.binary()), pa.array([_packed(high)], pa.binary())], [*_KEY, "low", "high"])

    schema = "dim int, leaf int, sub int, low binary, high binary"
    each = dealt.select(*_KEY, F.col("v").alias("low"), F.col("v").alias("high")).mapInArrow(run, schema)
    return each.repartition(*_KEY).mapInArrow(run, schema)


def _targets(queries: DataFrame, boxes: dict[int, tuple[list[tuple[int, int]], np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """queries (row, vec_id, dim, v, least) -> the same with leaf and sub: the shard with the best bound, or all others whose bound is ``least`` or more."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, (dim, v, least) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                shards, low, high = shared.value[dim]
                q = _unpacked(v, dim).astype(np.float64)
                bound = np.maximum(q * low, q * high).sum(axis=1)
                bound += np.abs(bound) * 1e-9 + 1e-6
                home = int(np.argmax(bound))
                for s in [home] if first else [s for s in np.flatnonzero(bound >= least).tolist() if s != home]:
                    at.append(i)
                    keys.append(shards[s])
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([k[j] for k in keys], pa.int32()) for j in (0, 1))], [*rows.schema.names, "leaf", "sub"])

    return queries.select("row", "vec_id", "dim", "v", "least").mapInArrow(run, "row long, vec_id long, dim int, v binary, least long, leaf int, sub int")


def _search(index: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of each target's shard. A shard with many queries is copied for every QUERIES of them."""
    targets = stage_table(targets, "targets")
    per_shard = targets.groupBy(*_KEY).agg(F.count("*").alias("q"))
    parts = F.ceil(F.col("q") / QUERIES).cast("int")
    right = join_back(targets, per_shard, _KEY, ["q"], "q", max(1, targets.count()), F.col("row"))
    right = right.select(*_KEY, F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), F.lit(True).alias("asks"), "row", "vec_id", "least", "v")
    left = index.join(per_shard, _KEY).select(*_KEY, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(False).alias("asks"), "row", "vec_id", F.lit(0).cast("long").alias("least"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, points, tree = None, [], [], None
        for b in batches:
            out = []
            for dim, leaf, sub, part, asks, row, vec, least, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (dim, leaf, sub, part) != key:
                    key, ids, points, tree = (dim, leaf, sub, part), [], [], None
                if not asks:
                    ids.append(vec)
                    points.append(_unpacked(v, dim))
                elif ids:
                    if tree is None:
                        tree, points = KdTree(np.array(ids, np.int64), np.stack(points)), []
                    out += [(row, vec, x, score) for score, x in tree.search(vec, _unpacked(v, dim), k, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "query_id", "vec_id", "score"])

    rows = left.unionByName(right).repartition(*_KEY, "part").sortWithinPartitions(*_KEY, "part", "asks", "vec_id", "row")
    return rows.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): each query row's k largest integer inner products.

    Components are quantised to floor(256 * x). All rows but those with the query's own id are candidates; ties go to
    the smaller id, and a query has fewer rows if there are fewer candidates. Rows that repeat a vec_id are queries,
    and candidates, of their own: each gets its own ranks from 1. Vectors that are null, hold null or non-finite
    components, or have no id take no part; vectors of different lengths aren't compared. Empty input: no rows.
    """
    rows = vectors.where(_whole(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage_table(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "asks", F.size("v").alias("dim"), "v"), "vectors")
    found = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    common = {r["dim"]: r["n"] for r in found}
    boxed = F.col("dim").isin(list(common)) if common else F.lit(False)
    sample = rows.where(boxed).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "v").collect()  # SAMPLE rows at most
    trees = {}
    for dim, n in common.items():
        points = np.array([r["v"] for r in sample if r["dim"] == dim], np.int64).reshape(-1, dim)
        if dim and len(points):
            trees[dim] = splits(points, min(DEPTH, max(0, -(-n // SHARD) - 1).bit_length()))
    dealt = _dealt(rows, trees)
    sizes = dealt.groupBy("dim", "leaf").agg(F.count("*").alias("c"))
    dealt = join_back(dealt, sizes, ["dim", "leaf"], ["c"], "c", max(1, sum(common.values())), F.col("row"))
    index = stage_table(dealt.select("row", "vec_id", "asks", "dim", "leaf", F.pmod(F.xxhash64("row"), F.ceil(F.col("c") / (2 * SHARD))).cast("int").alias("sub"), "v"), "dealt")
    boxes: dict[int, tuple] = {}
    for r in _boxes(index.where(boxed)).collect():  # one for about SHARD vectors
        keys, low, high = boxes.setdefault(r["dim"], ([], [], []))
        keys.append((r["leaf"], r["sub"])), low.append(_unpacked(r["low"], r["dim"])), high.append(_unpacked(r["high"], r["dim"]))
    boxes = {d: (keys, np.array(low, np.float64), np.array(high, np.float64)) for d, (keys, low, high) in boxes.items()}

    asked = index.where("asks").select("row", "vec_id", "dim", "v", F.lit(_LEAST).alias("least"))
    first = stage_table(_search(index, _targets(asked.where(boxed), boxes, True), k), "first")
    kth = first.groupBy("row").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") >= k)
    known = asked.where(boxed).join(kth, "row", "left").withColumn("least", F.coalesce("s", "least"))
    others = _targets(known, boxes, False)
    if len(common) == LENGTHS:  # vectors of other lengths meet all shards of their length
        rare = index.where(~boxed).select(*_KEY).distinct()
        others = others.unionByName(asked.where(~boxed).join(rare, "dim").select(*others.columns))
    every = first.unionByName(_search(index, others, k))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
