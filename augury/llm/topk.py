"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are dealt into blocks by a hash of id and vector; of rows equal in both, k at most are needed and kept. A task holds one block's columns as lists sorted by
value; a query walks every list from its favourable end in step, at depths that double, scores each vector it meets in full, and stops once the sum of the values at the current
depth, times the query's own, can't reach the kth score, or every vector has been met. Blocks' results merge by score and id. Queries go to every block in rows of their own,
so neither side is ever gathered whole.

Defined results: vectors that are null or hold null or non-finite components take no part, as candidates or queries; shorter
vectors count as filled up with zeros; an all-zero query scores every candidate 0; ties go to the smaller id; repeated ids are separate candidates, but none
meets a query of its own id; fewer candidates than k: all of them; components and scores beyond 64 bits count as the nearest 64-bit integer; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def integer_vector(v: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(v: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


LOW, HIGH = -(1 << 63), (1 << 63) - 1


def largest(x: np.ndarray) -> int:
    """The largest absolute value; that of the lowest integer has no 64-bit form."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class SortedLists:
    """One block: its vectors and, for each dimension, the rows in ascending order of that component."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        wide = max(map(len, vectors), default=0)
        self.v = np.zeros((len(ids), wide), np.int64)
        for i, x in enumerate(vectors):
            self.v[i, : len(x)] = x
        self.order = np.argsort(self.v, axis=0, kind="stable").T.copy()
        self.most = largest(self.v)
        self.real = self.v.astype(np.float64)

    def search(self, own: int, q: np.ndarray, k: int, first: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, number of rows met) of the k best rows, by score and then id; rows whose id is ``own`` are left out."""
        n, dims = self.v.shape
        q = np.concatenate((q, np.zeros(max(0, dims - len(q)), np.int64)))[:dims]
        exact = self.most * largest(q) * max(1, dims) < 1 << 53
        v, w = (self.real, q.astype(np.float64)) if exact else (self.v.astype(object), q.astype(object))
        used = np.flatnonzero(q)
        unmet = np.ones(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, v.dtype)
        at, step = 0, first
        while unmet.any():
            to = min(n, at + step) if len(used) else n  # the lists order nothing for an all-zero query
            met = np.full(n, to == n)
            met[self.order[used[q[used] > 0], n - to : n - at].ravel()] = True
            met[self.order[used[q[used] < 0], at:to].ravel()] = True
            new = np.flatnonzero(met & unmet)
            unmet[new] = False
            new = new[self.ids[new] != own]
            got = v[new] @ w
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, got if exact else np.clip(got, LOW, HIGH)))
            best = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            at, step = to, step * 2
            if len(rows) == k and at < n:
                d = self.order[used, np.where(q[used] > 0, n - at, at - 1)]
                if max(LOW, (v[d, used] * w[used]).sum()) < scores[-1]:
                    break
        return rows, scores, n - int(np.count_nonzero(unmet))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "v", block_rows: int = 4096) -> DataFrame:
    """``vectors`` and ``queries`` (key, vector: array<long>) to (query_id, rank, key, score): each query's k highest inner products among the vectors of other ids."""
    spark = vectors.sparkSession
    n = max(1, math.ceil(vectors.count() / block_rows))
    once = vectors.groupBy(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).agg(F.count("*").alias("copies"))
    once = once.select("id", "v", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))).alias("copy"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())])
    ones = once.select(F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("kind"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    parts = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ones.unionByName(asks).repartition(parts, "block").sortWithinPartitions("block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists = None, None
        ids: list[int] = []
        held: list[np.ndarray] = []
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            cut = np.concatenate(([0], np.cumsum(b.column("v").value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, (at, kind, own) in enumerate(zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), b.column("id").to_pylist(), strict=True)):
                if at != block:
                    block, lists, ids, held = at, None, [], []
                v = flat[cut[i] : cut[i + 1]]
                if kind == 0:
                    ids.append(own)
                    held.append(v.copy())
                    continue
                if lists is None:
                    lists, held = SortedLists(np.array(ids, np.int64), held), []
                found, scores, _ = lists.search(own, v, k)
                out.append((np.full(len(found), own), lists.ids[found], scores.astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], schema=pa.schema([(f.name, pa.int64()) for f in schema.fields]))

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
