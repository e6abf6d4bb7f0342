"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w.x - t_k): one weight vector over hashed text features for all grades, and an ordered threshold for each step between grades. The likelihood of a rating is the
difference of two such probabilities. It is maximised by L-BFGS over weights, the first threshold and the logarithms of the gaps between thresholds, so their order holds by construction; each
evaluation is one pass over the stored training features, which returns one gradient per task. Expected grade and tail probabilities follow in closed form.

Features: the shape of each word (runs of capitals, small letters and digits as one sign each, other signs as they are), of each pair of neighbours, and whether a word
repeats its neighbour, hashed to ``n_features`` places, as square roots of shares of the text; the share of distinct words, by tenths for short, middling and long texts; and hashed terms (words
and their first four and five letters), present or not, of those ``n_terms`` places whose chi-squared statistic at some step between grades is at least ``least_chi2``.

The fit takes at most ``most_rows`` ratings, chosen by a hash of their ids over all of them. Defined results: null, empty and wordless texts have nothing to be graded by: the lowest grade, and
zero for every tail; ratings that are null don't train; a single grade: that grade for all; no ratings: null grade; repeated rows alike, whether rated or not; null ids are scored and never train;
only the columns asked for are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, stored, texts
from augury.llm.toxicity import Terms, held_out

RUNS = re.compile(r"([^\W\d_]+)|(\d+)")


class Shapes:
    """Feature vectors of texts; a word's shape is remembered, up to ``most`` words."""

    VARIETY = 33

    def __init__(self, n_features: int, most: int = 400_000):
        self.n, self.most, self.known = n_features, most, {}

    @staticmethod
    def shape(w: str) -> str:
        def one(m):
            if m[2]:
                return "9"
            return "A" if m[1].isupper() else "a" if m[1].islower() else "Aa"

        return RUNS.sub(one, w)

    def vector(self, text: str) -> np.ndarray:
        out = np.zeros(self.n + self.VARIETY)
        words = text.split()
        if not words:
            return out
        known = self.known
        if len(known) > self.most:
            known.clear()
        kinds = set(words)
        for w in kinds:
            if w not in known:
                known[w] = zlib.crc32(self.shape(w).encode())
        ids = np.array([known[w] for w in words], np.int64)
        again = np.array([a == b for a, b in zip(words, words[1:])], np.int64)  # noqa: B905
        pairs = (ids[1:] * 31 + ids[:-1] * 17 + again * 7919) % 0x7FFFFFFF
        count = np.bincount(np.concatenate((ids, pairs)) % self.n, minlength=self.n)
        out[: self.n] = np.sqrt(count / (2 * len(words)))
        length = 0 if len(words) < 60 else 1 if len(words) < 400 else 2
        out[self.n + length * 11 + len(kinds) * 10 // len(words)] = 1
        return out


#: How large the two kinds of features are, which sets what the penalty takes from each: shares of a text are small numbers, and terms should speak only where shapes don't.
SHAPE_SCALE, TERM_SCALE = 10.0, 0.3


class Features(Terms):
    """Feature vectors: shapes, then indicators of the chosen ``places``."""

    def __init__(self, n_features: int, n_terms: int, places: list[int]):
        super().__init__(n_terms)
        self.shapes, self.column = Shapes(n_features), {p: i for i, p in enumerate(places)}

    def of_word(self, w: str) -> tuple[int, ...]:
        return tuple(self.column[t] for t in super().of_word(w) if t in self.column)

    def parts(self, text: str) -> tuple[np.ndarray, list[int]]:
        return self.shapes.vector(text) * SHAPE_SCALE, list({c for cs in self.of_words(text) for c in cs})

    def vector(self, text: str) -> np.ndarray:
        shapes, cols = self.parts(text)
        terms = np.zeros(len(self.column))
        terms[cols] = TERM_SCALE
        return np.concatenate((shapes, terms))


def minimum(f, x: np.ndarray, iterations: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        d, back = -g.copy(), []
        for s, y in reversed(steps):
            back.append((s @ d) / (s @ y))
            d -= back[-1] * y
        if steps:
            d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), a in zip(steps, reversed(back), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        t = 1.0 if steps else min(1.0, 1 / np.abs(g).sum())
        while True:
            new, g_new = f(x + t * d)
            if new <= value + 1e-4 * t * (g @ d) or t < 1e-6:
                break
            t /= 3
        s, y = t * d, g_new - g
        done = value - new <= 1e-7 * max(1.0, abs(value))
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y)]
        x, value, g = x + s, new, g_new
        if done:
            break
    return x


def ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds of a first one and logarithms of gaps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(np.clip(free[1:], -30, 30)))))


def likelihood(eta: np.ndarray, c: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log likelihood, its slope by each row's ``eta``, its gradient by free thresholds) summed over rows with grade places ``c``."""
    t = ordered(free)
    k = len(t)
    at = lambda i: 1 / (1 + np.exp(-np.clip(eta - t[np.clip(i, 0, k - 1)], -40, 40)))
    over, under = np.where(c > 0, at(c - 1), 1.0), np.where(c < k, at(c), 0.0)
    p = np.maximum(over - under, 1e-12)
    slope_over, slope_under = over * (1 - over) / p, under * (1 - under) / p
    by_t = np.zeros(k)
    np.add.at(by_t, np.clip(c - 1, 0, k - 1), np.where(c > 0, slope_over, 0))
    np.add.at(by_t, np.clip(c, 0, k - 1), np.where(c < k, -slope_under, 0))
    tail = np.cumsum(by_t[::-1])[::-1]  # a gap moves all thresholds from its own on
    return float(-np.log(p).sum()), slope_under - slope_over, np.concatenate((tail[:1], tail[1:] * np.exp(np.clip(free[1:], -30, 30))))


class Quality:
    def __init__(self, *, n_features: int = 1 << 10, n_terms: int = 1 << 16, least_chi2: float = 24.0, iterations: int = 40, reg: float = 1e-4, most_rows: int = 12_000):
        self.n_features, self.n_terms, self.least_chi2, self.iterations, self.reg, self.most_rows = n_features, n_terms, least_chi2, iterations, reg, most_rows
        self.grades: list[int] = []
        self.places: list[int] = []
        self.weights, self.thresholds = None, np.zeros(0)

    def chosen_places(self, rows: DataFrame) -> list[int]:
        """Places whose presence goes with a grade above some step; ``n_terms`` at most."""
        n = self.n_terms

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms(n)
            for b in small_batches(batches, "__text"):
                yield pa.RecordBatch.from_arrays([b.column("__grade"), pa.array([terms(t) for t in texts(b, "__text")], pa.list_(pa.int32()))], names=["grade", "terms"])

        steps = self.grades[:-1]
        above = [F.sum((F.col("grade") > k).cast("double")).alias(f"p{i}") for i, k in enumerate(steps)]
        total = rows.select(F.col("__grade").alias("grade")).agg(F.count("*").alias("m"), *above).first()
        counts = rows.mapInArrow(hashed, "grade int, terms array<int>").select("grade", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("c"), *above)
        c, m = F.col("c"), F.lit(float(total["m"]))
        ones = [float(total[f"p{i}"]) for i in range(len(steps))]
        chi2 = [m * F.pow(F.col(f"p{i}") * m - c * o, 2) / (c * (m - c) * o * (m - o)) for i, o in enumerate(ones)]
        return [r[0] for r in counts.where((c < m) & (F.greatest(*chi2, F.lit(0.0)) >= self.least_chi2)).select("term").orderBy("term").collect()]

    def fit(self, docs: DataFrame, ratings: DataFrame, *, text: str = "text", key: str = "doc_id", grade: str = "grade") -> Quality:
        given = ratings.select(F.col(key), F.col(grade).cast("int").alias("__grade")).where(F.col(key).isNotNull() & F.col("__grade").isNotNull())
        chosen = given.where(~held_out(F.col(key))).dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(self.most_rows)
        rows = stored(docs.select(key, docs[text].alias("__text")).join(F.broadcast(chosen), key).select("__grade", "__text"), "rated").coalesce(8)
        self.grades, self.weights, self.places = sorted(r[0] for r in rows.select("__grade").distinct().collect()), None, []
        if len(self.grades) < 2:
            return self
        self.places = self.chosen_places(rows)
        n_features, n_terms, places, grades = self.n_features, self.n_terms, self.places, np.array(self.grades)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(n_features, n_terms, places)
            for b in small_batches(batches, "__text", 1 << 20):
                c = np.searchsorted(grades, b.column("__grade").to_numpy())
                at, value = zip(*((np.flatnonzero(v), v[v != 0]) for v in map(features.vector, texts(b, "__text"))), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["c", "at", "value"])

        x = stored(rows.mapInArrow(measured, "c int, at array<int>, value array<float>"), "quality").coalesce(8)
        n, k = x.count(), len(grades) - 1
        start = np.array([r[1] for r in sorted(x.groupBy("c").count().collect())], float)
        odds = np.clip(1 - np.cumsum(start)[:-1] / n, 1e-6, 1 - 1e-6)  # P(grade > k) without features
        first = -np.log(odds / (1 - odds))
        width = n_features + Shapes.VARIETY + len(places)

        def evaluated(v: np.ndarray) -> tuple[float, np.ndarray]:
            weights, free = v[:width], v[width:]

            def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(1 + width + k)
                for b in batches:
                    row = np.repeat(np.arange(b.num_rows), b.column("at").value_lengths().to_numpy(zero_copy_only=False))
                    at, value = (b.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("at", "value"))
                    eta = np.bincount(row, value * weights[at], minlength=b.num_rows)
                    loss, slope, by_free = likelihood(eta, b.column("c").to_numpy(zero_copy_only=False), free)
                    total += np.concatenate(([loss], np.bincount(at, value * slope[row], minlength=width), by_free))
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

            total = sum(np.frombuffer(r[0]) for r in x.mapInArrow(one, "g binary").collect()) / n  # one gradient a task, eight tasks at most
            total = total.copy()
            total[0] += self.reg * (weights @ weights) / 2
            total[1 : 1 + width] += self.reg * weights
            return float(total[0]), total[1:]

        best = minimum(evaluated, np.concatenate((np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-6)))), self.iterations)
        self.weights, self.thresholds = best[:width], ordered(best[width:])
        return self

    def over(self, grade: int) -> Column:
        """P(grade > ``grade``) out of ``tail``, by the grade's value and not its place: 1 under the lowest rating seen, 0 from the highest on, null if none was seen."""
        seen = [i for i, g in enumerate(self.grades) if g <= grade]
        if not self.grades:
            return F.lit(None).cast("double")
        return F.lit(1.0) if not seen else F.lit(0.0) if len(seen) == len(self.grades) else F.get("tail", F.lit(seen[-1]))

    def score(self, docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """Columns ``keep`` with expected_grade and tail: array of P(grade > k) for each step in order."""
        weights, thresholds, grades, places, n, n_terms = self.weights, self.thresholds, np.array(self.grades, float), self.places, self.n_features, self.n_terms
        schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(n, n_terms, places)
            for b in small_batches(batches, "__text"):
                if weights is None:
                    grade, tail = [float(grades[0]) if len(grades) else None] * b.num_rows, [[]] * b.num_rows
                else:
                    cut = n + Shapes.VARIETY
                    margin, some = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
                    for i, t in enumerate(texts(b, "__text")):
                        shapes, cols = features.parts(t)
                        margin[i], some[i] = shapes @ weights[:cut] + TERM_SCALE * weights[cut:][cols].sum(), shapes.any()
                    tail = some[:, None] / (1 + np.exp(-np.clip(margin[:, None] - thresholds[None, :], -40, 40)))
                    grade, tail = grades[0] + tail @ np.diff(grades), list(tail)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(grade, pa.float64()), pa.array(tail, pa.list_(pa.float64()))], names=schema.names)

        return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
