"""Toxicity: a factorization machine over hashed terms.

Besides a weight per term the model has a vector per term; the inner product of two terms' vectors is their pairwise weight, so combinations that additive weights miss (an insult together with a
group's name) get a score of their own. Terms are runs of letters in lower case and their first four and five letters, which join the inflected forms of a stem; they are hashed to
``n_features`` places, present or not. Places whose chi-squared statistic against the labels is at least ``least_chi2`` go into the machine.

The fit is Spark ML's. It takes at most ``most_rows`` labelled rows, chosen by a hash of their ids over all of them, so its cost doesn't grow with the corpus; those
ids are few enough to be broadcast to the pass that reads their texts. Scoring is one pass over whole texts with the machine's weights.

Defined results: null and empty texts are scored by the bias alone; rows without a label, or with a label other than 0 and 1, don't train; repeated rows score alike; if no
row can train, all have one label, or no term passes the test, every score is the label share (0.5 without any); an empty table gives an empty result. Other columns are never inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, stored, texts

WORD = re.compile(r"[^\W\d_]+")


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that never train: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Terms:
    """Hashed terms of a text; what a word gives is remembered, up to ``most`` words."""

    def __init__(self, n_features: int, most: int = 400_000):
        self.n, self.most, self.known = n_features, most, {}

    def of_word(self, w: str) -> tuple[int, ...]:
        return tuple(zlib.crc32(x.encode()) % self.n for x in (w, f"4 {w[:4]}", f"5 {w[:5]}"))

    def of_words(self, text: str) -> Iterator[tuple[int, ...]]:
        known = self.known
        for w in set(WORD.findall(text.lower())):
            got = known.get(w)
            if got is None:
                if len(known) >= self.most:
                    known.clear()
                got = known[w] = self.of_word(w)
            yield got

    def __call__(self, text: str) -> list[int]:
        return sorted({t for ts in self.of_words(text) for t in ts})


class Machine(Terms):
    """A fitted machine: scores texts."""

    def __init__(self, n_features: int, places: list[int], bias: float, linear: np.ndarray, factors: np.ndarray):
        super().__init__(n_features)
        self.column = {p: i for i, p in enumerate(places)}
        self.bias, self.linear, self.factors = bias, linear, factors

    def of_word(self, w: str) -> tuple[int, ...]:
        return tuple(self.column[t] for t in super().of_word(w) if t in self.column)

    def score(self, text: str) -> float:
        cols = list({c for cs in self.of_words(text) for c in cs})
        v = self.factors[cols]
        margin = self.bias + self.linear[cols].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


class Toxicity:
    def __init__(self, *, n_features: int = 1 << 16, least_chi2: float = 24.0, factors: int = 4, iterations: int = 60, step: float = 0.1, reg: float = 1e-3, most_rows: int = 12_000, seed: int = 17):
        self.n_features, self.least_chi2, self.most_rows = n_features, least_chi2, most_rows
        self.fm = FMClassifier(featuresCol="x", labelCol="label", factorSize=factors, maxIter=iterations, stepSize=step, seed=seed, regParam=reg)
        self.machine, self.share = None, 0.5

    def fit(self, docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Toxicity:
        given = labels.select(F.col(key), F.col(label).cast("double").alias("__label")).where(F.col(key).isNotNull() & F.col("__label").isin(0.0, 1.0))
        chosen = given.where(~held_out(F.col(key))).dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(self.most_rows)
        n = self.n_features

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms(n)
            for b in small_batches(batches, "__text"):
                yield pa.RecordBatch.from_arrays([b.column("__label"), pa.array([terms(t) for t in texts(b, "__text")], pa.list_(pa.int32()))], names=["label", "terms"])

        rows = docs.select(key, docs[text].alias("__text")).join(F.broadcast(chosen), key).select("__label", "__text")
        rows = stored(rows.mapInArrow(hashed, "label double, terms array<int>"), "toxic").coalesce(8)
        total, ones = rows.agg(F.count("*"), F.sum("label")).first()
        self.machine, self.share = None, ones / total if total else 0.5
        if not total or not 0 < ones < total:
            return self
        c, p, m, o = F.col("c"), F.col("p"), F.lit(float(total)), F.lit(float(ones))
        chi2 = m * F.pow(p * m - c * o, 2) / (c * (m - c) * o * (m - o))
        counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("c"), F.sum("label").alias("p"))
        places = [r[0] for r in counts.where((c < m) & (chi2 >= self.least_chi2)).select("term").orderBy("term").collect()]  # n_features at most
        if not places:
            return self

        sparse = CountVectorizerModel.from_vocabulary([str(p) for p in places], "terms", "x").setBinary(True)
        model = self.fm.fit(sparse.transform(rows.select("label", F.col("terms").cast("array<string>"))).drop("terms"))
        self.machine = Machine(n, places, model.intercept, model.linear.toArray(), model.factors.toArray())
        return self

    def score(self, docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
        """Columns ``keep`` with score (0 to 1) and predicted (1 from 0.5 on), under other ``names`` where they clash."""
        machine, share = self.machine, float(self.share)
        schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, "__text"):
                s = [machine.score(t) if machine else share for t in texts(b, "__text")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=schema.names)

        return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
