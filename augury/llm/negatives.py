"""Hard-negative mining: a vantage-point tree over norm-augmented vectors, searched nearest-first inside distance annuli.

Each vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and each query q a zero. The squared distance is then |q|^2 + M^2 - 2 q.x, so a higher score is a nearer
row, and a window of scores is an annulus of distances. A top tree, fitted on ``sample`` rows, deals the rows into leaves; leaves of more than ``block_rows`` rows (repeated vectors among them) are split by
a hash of the row. Of each leaf the driver holds the range of distances to the vantage points on its path (256 leaves at most). A query goes first to its nearest leaf, then, with the window narrowed to what
k rows found there leave open, to the leaves that the triangle inequality can't exclude. A task builds a tree of its block in turn, sorts its leaves by their lower bounds for a query, and takes them
nearest-first until the bound passes the kth row found, or the annulus ends. Bounds are floating-point numbers with a margin and only say what to skip; scores and windows are integers and exact.

Two searches: an anchor's best rows of its own label, and, for each of these positives, the best rows of other labels in the window of its score. On vectors spread evenly over the sphere hardly
any leaf can be skipped (see README); the result is the same.

Defined results: rows whose label or vector is null, or whose vector has null or non-finite components, take no part; shorter vectors count as filled up with zeros; an empty vector scores 0 with all; repeated ids are
rows of their own, each an anchor or candidate for itself (ties of score and id go by row, and their results don't differ); an anchor with no row of its label gives no rows; a negative positive
score gives an empty window; scores beyond 64 bits are cut to its ends in the result; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from augury.llm.common import dropped, stored
from augury.llm.topk import integer_vector, usable

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def matrix(v: pa.Array, dims: int) -> np.ndarray:
    """List array to rows of ``dims`` integers, filled up with zeros."""
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    at = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at, size)] = flat
    return out


class Tree:
    """A balanced tree of vantage points in heap order; leaves are numbered from left to right, and ``low`` and ``high`` hold, by leaf and level, the range of distances of the leaf's rows to the vantage point there."""

    def __init__(self, points: np.ndarray, depth: int):
        """``points``: augmented rows."""
        self.depth, nodes = depth, (1 << depth) - 1
        self.vantage = np.zeros((nodes, points.shape[1]))
        self.radius = np.zeros(nodes)
        level = np.arange(1 << depth)
        self.path = np.stack([(1 << j) - 1 + (level >> (depth - j)) for j in range(depth)], 1) if depth else np.zeros((1, 0), np.int64)
        groups = [np.arange(len(points))]
        for node in range(nodes):
            own = groups[node]
            if len(own):
                centre = points[own].mean(0)
                self.vantage[node] = points[own[np.argmax(((points[own] - centre) ** 2).sum(1))]]  # a row on the edge parts the others best
                d = self.distance(points[own], self.vantage[node])
                self.radius[node] = np.median(d)
                groups += [own[d <= self.radius[node]], own[d > self.radius[node]]]
            else:
                groups += [own, own]

    @staticmethod
    def distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - to) ** 2).sum(-1))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances to the vantage points on its path) of each row."""
        node, out = np.zeros(len(points), np.int64), np.zeros((len(points), self.depth))
        for j in range(self.depth):
            out[:, j] = self.distance(points, self.vantage[node])
            node = 2 * node + 1 + (out[:, j] > self.radius[node])
        return node - len(self.vantage), out

    def ranges(self, leaf: np.ndarray, distances: np.ndarray) -> None:
        self.low, self.high = np.full(self.path.shape, np.inf), np.full(self.path.shape, -np.inf)
        np.minimum.at(self.low, leaf, distances)
        np.maximum.at(self.high, leaf, distances)

    def bounds(self, q: np.ndarray, most_norm: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible distance of each query (rows of ``q``, not augmented) to each leaf's rows."""
        square = (q**2).sum(1)[:, None] + most_norm**2
        if not self.depth:
            return np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        d = np.sqrt(np.maximum(0, square - 2 * q @ self.vantage[:, :-1].T))[:, self.path]
        low = np.maximum(0, np.maximum(d - self.high, self.low - d).max(2))
        return low, (d + self.high).min(2)


class Block:
    """Rows of one block under a tree of their own, in the order of its leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray, most_norm: float, leaf_rows: int = 64):
        points = augmented(v, most_norm)
        self.tree = Tree(points, max(0, math.ceil(math.log2(max(1, len(v)) / leaf_rows))))
        leaf, d = self.tree.route(points)
        self.tree.ranges(leaf, d)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.rows, self.labels, self.v = ids[order], rows[order], labels[order], v[order]
        self.cut = np.searchsorted(leaf[order], np.arange((1 << self.tree.depth) + 1))
        self.real, self.most, self.most_norm = self.v.astype(np.float64), int(np.abs(self.v.astype(object)).max(initial=0)), most_norm

    def nearest(self, q: np.ndarray, own: int, label: int, same: bool, lo: int, hi: int, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, leaves taken) of the k best rows with lo <= score <= hi, other than the row ``own``, of the label or of others; ``low`` and ``high`` bound the leaves' distances."""
        square = float((q.astype(np.float64) ** 2).sum()) + self.most_norm**2
        margin = 1e-6 * (1 + math.sqrt(square))
        away = lambda score: math.sqrt(max(0.0, square - 2 * float(score)))
        exact = self.most * int(np.abs(q.astype(object)).max(initial=0)) * max(1, len(q)) < 1 << 53
        v, w = (self.real, q.astype(np.float64)) if exact else (self.v.astype(object), q.astype(object))
        leaves = np.flatnonzero((low <= away(lo) + margin) & (high >= away(hi) - margin) & (np.diff(self.cut) > 0))
        leaves = leaves[np.argsort(low[leaves], kind="stable")]
        best, scores = np.zeros(0, np.int64), np.zeros(0, v.dtype)
        at, step = 0, 1
        while at < len(leaves):
            new = np.concatenate([np.arange(self.cut[x], self.cut[x + 1]) for x in leaves[at : at + step]])
            new = new[(self.rows[new] != own) & ((self.labels[new] == label) == same)]
            s = v[new] @ w
            inside = ((s >= lo) & (s <= hi)).astype(bool)
            best, scores = np.concatenate((best, new[inside])), np.concatenate((scores, s[inside]))
            if len(best) > k:
                first = np.lexsort((self.rows[best], self.ids[best], -scores))[:k]
                best, scores = best[first], scores[first]
            at, step = at + step, 2 * step
            if len(best) == k and at < len(leaves) and low[leaves[at]] > away(min(scores)) + margin:
                break
        return best, scores, min(at, len(leaves))


def augmented(v: np.ndarray, most_norm: float) -> np.ndarray:
    real = v.astype(np.float64)
    return np.concatenate((real, np.sqrt(np.maximum(0, most_norm**2 - (real**2).sum(1)))[:, None]), 1)


class Index:
    """Rows (row, id, label, v) dealt into blocks by the top tree, stored."""

    def __init__(self, rows: DataFrame, block_rows: int = 8192, sample: int = 2048, tile: int = 65536):
        """``tile``: most queries that meet a block in one task; with more queries blocks are sent to several."""
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, square, dims = rows.agg(F.count("*"), F.max(size), F.max(F.size("v"))).first()
        self.block_rows, self.tile, self.dims, self.most_norm = block_rows, tile, max(1, dims or 0), math.sqrt(square or 0.0)
        depth = min(8, max(0, math.ceil(math.log2(max(1, n) / block_rows))))
        few = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(sample).toArrow() if depth else pa.table({"v": pa.array([], pa.list_(pa.int64()))})
        self.tree = tree = Tree(augmented(matrix(few.column("v").combine_chunks(), self.dims), self.most_norm), depth)
        dims, most_norm = self.dims, self.most_norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf, d = tree.route(augmented(matrix(b.column("v"), dims), most_norm))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32()), pa.array(list(d), pa.list_(pa.float64()))], names=[*b.schema.names, "leaf", "d"])

        placed = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "v")
        self.rows = stored(placed.mapInArrow(run, "row long, id long, label long, v array<long>, leaf int, d array<double>"), "negatives-rows")
        held = {r["leaf"]: r for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.get("d", F.lit(j))).alias(f"{f.__name__}{j}") for j in range(depth) for f in (F.min, F.max)]).collect()}
        leaves = range(1 << depth)
        tree.low = np.array([[held[x][f"min{j}"] if x in held else np.inf for j in range(depth)] for x in leaves]).reshape(len(leaves), depth)
        tree.high = np.array([[held[x][f"max{j}"] if x in held else -np.inf for j in range(depth)] for x in leaves]).reshape(len(leaves), depth)
        chunks = [math.ceil(held[x]["n"] / block_rows) if x in held else 0 for x in leaves]
        self.first = np.concatenate(([0], np.cumsum(chunks)))
        of = lambda x: F.get(F.array(*[F.lit(int(c)) for c in x]), F.col("leaf"))
        self.blocks = self.rows.select("row", "id", "label", "v", (of(self.first[:-1]) + F.pmod(F.xxhash64("row", "id"), F.greatest(of(chunks), F.lit(1)))).cast("int").alias("block"))

    def routed(self, asks: DataFrame, nearest: bool) -> DataFrame:
        """Queries with the ``block`` each goes to: those of its nearest leaf within its window, or of all the others that may hold a row of it."""
        tree, first, dims, most_norm = self.tree, self.first, self.dims, self.most_norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = matrix(b.column("v"), dims).astype(np.float64)
                low, high = tree.bounds(q, most_norm)
                square = (q**2).sum(1) + most_norm**2
                margin = 1e-6 * (1 + np.sqrt(square))
                away = lambda c: np.sqrt(np.maximum(0, square - 2 * b.column(c).to_numpy().astype(np.float64)))
                may = (low <= (away("lo") + margin)[:, None]) & (high >= (away("hi") - margin)[:, None]) & (np.diff(first) > 0)
                best = np.argmin(np.where(may, low, np.inf), 1)
                own = np.zeros_like(may)
                own[np.arange(len(q)), best] = may.any(1)
                out = [np.concatenate([np.arange(first[x], first[x + 1]) for x in np.flatnonzero(m)] or [np.zeros(0, np.int64)]).tolist() for m in (own if nearest else may & ~own)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "blocks"])

        return asks.mapInArrow(run, "ask long, own long, label long, same boolean, lo long, hi long, v array<long>, blocks array<int>").withColumn("block", F.explode("blocks")).drop("blocks")

    def visit(self, routed: DataFrame, n_asks: int, k: int) -> DataFrame:
        """(ask, row, id, score): of every block a query goes to, its k best rows."""
        dims, most_norm = self.dims, self.most_norm
        groups = max(1, math.ceil(n_asks / self.tile))
        ones = self.blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("tile"), F.lit(0).alias("kind"), F.col("row").alias("ask"), F.col("id").alias("own"), "label", F.lit(True).alias("same"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "v")
        asks = routed.select("block", F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int").alias("tile"), F.lit(1).alias("kind"), "ask", "own", "label", "same", "lo", "hi", "v")
        parts = max(groups * int(self.first[-1]), int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        both = ones.unionByName(asks).repartition(parts, "block", "tile").sortWithinPartitions("block", "tile", "kind", "ask")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, block = None, [], None
            for b in batches:
                keys = list(zip(b.column("block").to_pylist(), b.column("tile").to_pylist(), b.column("kind").to_pylist(), strict=True))
                edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
                for x, y in zip(edges, edges[1:], strict=False):
                    if x == y:
                        continue
                    part = b.slice(x, y - x)
                    if keys[x][:2] != at:
                        at, held, block = keys[x][:2], [], None
                    if keys[x][2] == 0:
                        held.append((part.column("own").to_numpy(), part.column("ask").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), dims)))
                        continue
                    if block is None:
                        if not held:
                            continue
                        block, held = Block(*(np.concatenate(c) for c in zip(*held, strict=True)), most_norm), []
                    q = matrix(part.column("v"), dims)
                    low, high = block.tree.bounds(q.astype(np.float64), most_norm)
                    out = []
                    for i, (ask, own, label, same, lo, hi) in enumerate(zip(*(part.column(c).to_pylist() for c in ("ask", "own", "label", "same", "lo", "hi")), strict=True)):
                        best, scores, _ = block.nearest(q[i], own, label, same, lo, hi, k, low[i], high[i])
                        out.append((np.full(len(best), ask), block.rows[best], block.ids[best], np.array([min(MOST, max(LEAST, int(s))) for s in scores], np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["ask", "row", "id", "score"])

        return both.mapInArrow(run, "ask long, row long, id long, score long")

    def nearest(self, asks: DataFrame, k: int) -> DataFrame:
        """Queries (ask, own, label, same, lo, hi, v) to (ask, row, id, score, rank): the k best rows of their windows, by score and then id."""
        n = asks.count()
        order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "id", "row")
        top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = stored(top(self.visit(self.routed(asks, True), n, k)), "negatives-near")
        if len(self.first) == 2:  # one leaf
            return near
        full = near.where(F.col("rank") == k).select("ask", F.col("score").alias("kth"))
        narrowed = asks.join(full, "ask", "left").withColumn("lo", F.greatest("lo", F.coalesce("kth", "lo"))).select(*asks.columns)
        out = stored(top(near.drop("rank").unionByName(self.visit(self.routed(narrowed, False), n, k))), "negatives-best")
        dropped(near)
        return out


def mine(rows: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, block_rows: int = 8192, tile: int = 65536) -> DataFrame:
    """``rows`` (id, label, v: array<long>) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``anchor`` holds. A positive is one of the best ``positives`` rows of its anchor's label; its negatives are the best rows of other labels that score ``low`` to 100 percent of it.
    """
    index = Index(rows.select("id", F.col("label").cast("long").alias("label"), "v"), block_rows, tile=tile)
    anchors = index.rows.where(anchor).select("row", "id", "label", "v")
    wide = lambda x: F.lit(x).cast("long")
    good = index.nearest(anchors.select(F.col("row").alias("ask"), F.col("row").alias("own"), "label", F.lit(True).alias("same"), wide(LEAST).alias("lo"), wide(MOST).alias("hi"), "v"), positives)
    pairs = good.select(F.col("ask").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("row").alias("positive_row")).join(anchors.withColumnRenamed("id", "anchor_id"), "row")
    pairs = stored(pairs.withColumn("ask", F.monotonically_increasing_id()), "negatives-pairs")
    least = F.ceil(F.col("positive_score").cast("decimal(38,0)") * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    asks = pairs.where("positive_score >= 0").select("ask", F.col("row").alias("own"), "label", F.lit(False).alias("same"), least.alias("lo"), F.col("positive_score").alias("hi"), "v")
    bad = index.nearest(asks, negatives)
    out = bad.join(pairs.select("ask", "anchor_id", "positive_id", "positive_score"), "ask")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows that take part, as (id, label, v)."""
    e = embeddings.where(F.col("label").isNotNull() & usable(F.col(vector)))
    return e.select(F.col(key).cast("long").alias("id"), F.col("label").cast("long").alias("label"), integer_vector(F.col(vector), scale).alias("v"))
