"""Causal features of signal streams and logistic scores from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("conf", "sev", "prior_count", "days_since", "prior_conf", "prior_sev")


def sixth(total_thousandths: Column, n: Column) -> Column:
    """A mean of thousandths to six places, half up, in whole numbers; 0 of nothing. So every engine rounds alike."""
    return F.when(n > 0, F.floor((total_thousandths * 2000 + n) / (n * 2)) / F.lit(1000000.0)).otherwise(F.lit(0.0))


def history(df: DataFrame, key: str, day: str, tie: str | list[str], means: dict[str, str]) -> DataFrame:
    """``df`` with prior_count, days_since the last and, for each value column in ``means``, the mean of the earlier ones: all from strictly earlier rows of the key, by (day, tie). Rows alike in these have no order of their own: ``tie`` has to tell all different rows apart if a run is to repeat the last.

    Two levels of prefix sums: windows run inside (key, month) only, so that a key with a third of all rows is spread over its months, and the months' totals, few per key, are carried over by a join.
    """
    month = F.date_format(day, "yyyy-MM")
    milli = {v: F.round(F.col(v) * 1000).cast("long") for v in means}
    rows = df.withColumn("__m", month)
    totals = rows.groupBy(key, "__m").agg(F.count("*").alias("__n"), F.max(day).alias("__last"), *[F.sum(c).alias(f"__s_{v}") for v, c in milli.items()])
    before = Window.partitionBy(key).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)  # a row per month
    carried = totals.select(key, "__m", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_c") for c in ("__n", *(f"__s_{v}" for v in means))], F.max("__last").over(before).alias("__last_c"))
    inside = Window.partitionBy(key, "__m").orderBy(day, *([tie] if isinstance(tie, str) else tie))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    j = rows.join(carried, [key, "__m"])
    n = F.count("*").over(earlier) + F.col("__n_c")
    out = j.withColumns({"prior_count": n, "days_since": F.coalesce(F.datediff(day, F.coalesce(F.lag(day).over(inside), F.col("__last_c"))), F.lit(0)), **{f"__t_{v}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"__s_{v}_c") for v, c in milli.items()}})
    return out.select(*df.columns, "prior_count", "days_since", *[sixth(F.col(f"__t_{v}"), F.col("prior_count")).alias(name) for v, name in means.items()])


def one_hot(df: DataFrame, column: str, most: int = 1000) -> tuple[list[str], Column]:
    """The categories of all rows in order, null as "none", and the array that marks a row's own; more than ``most`` are an error."""
    c = F.coalesce(F.col(column).cast("string"), F.lit("none"))
    names = sorted(r[0] for r in df.select(c.alias("c")).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"over {most} categories in {column}")
    return names, F.array(*[(c == n).cast("double") for n in names])


def group_sums(stats: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, sums of squares about them and summed labels of each group, as arrays in the order of ``stats``."""
    n = np.array([s["n"] for s in stats.values()], float)
    mean = np.array([[s[f"m{i}"] or 0.0 for i in range(d)] for s in stats.values()]).reshape(len(n), d)
    square = np.array([[s[f"v{i}"] or 0.0 for i in range(d)] for s in stats.values()]).reshape(len(n), d) * n[:, None]
    return n, mean, square, np.array([s["ones"] or 0 for s in stats.values()], float)


def newton_sums(rows: DataFrame, d: int, place: dict, centre: np.ndarray, spread: np.ndarray, beta: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold, over the rows that aren't its own: loss, gradient and upper half of the Hessian at ``beta`` (folds x features and intercept), for features less ``centre`` over ``spread``.
    One pass for all folds; tasks send a row per fold, which are summed by fold before they come to the driver."""
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(beta), 2 + d + len(upper[0])))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = np.column_stack([*((part.column(f"x{i}").to_numpy(zero_copy_only=False) - centre[i]) / spread[i] for i in range(d)), np.ones(part.num_rows)])
                y = part.column("y").to_numpy(zero_copy_only=False)[:, None]
                own = np.array([place.get(g, -1) for g in part.column("g").to_pylist()])[:, None]
                teaches = own != np.arange(len(beta))
                t = x @ beta.T
                p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
                total[:, 0] += ((np.logaddexp(0, t) - y * t) * teaches).sum(0)
                total[:, 1 : d + 2] += ((p - y) * teaches).T @ x
                total[:, d + 2 :] += (p * (1 - p) * teaches).T @ (x[:, upper[0]] * x[:, upper[1]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(beta)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["fold", "v"])

    sent = rows.where("y is not null").mapInArrow(run, "fold int, v array<double>").select("fold", F.posexplode("v").alias("i", "v"))
    out = {}
    for r in sent.groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():  # folds times numbers of a fold
        out.setdefault(r["fold"], np.zeros(2 + d + len(upper[0])))[r["i"]] = r["v"]
    return out


def penalised_fits(rows: DataFrame, d: int, place: dict, mean: np.ndarray, spread: np.ndarray, centre: np.ndarray, scale: np.ndarray, passes: int = 60) -> np.ndarray:
    """Weights and intercept of each fold on its own standardised features (``mean``, ``spread``: folds x features), with an L2 penalty of 1 on the weights, by Newton's method with halved steps
    where a step raised the loss. All folds take their steps in the same pass over the rows."""
    folds = len(mean)
    # own standardised features out of commonly standardised ones: z = turn x
    turn = np.zeros((folds, d + 1, d + 1))
    turn[:, np.arange(d), np.arange(d)] = scale / spread
    turn[:, :d, d] = (centre - mean) / spread
    turn[:, d, d] = 1
    penalty = np.append(np.ones(d), 0.0)
    w, last, best = np.zeros((folds, d + 1)), np.zeros((folds, d + 1)), np.full(folds, np.inf)
    upper = np.triu_indices(d + 1)
    done = np.zeros(folds, bool)
    for _ in range(passes):
        sums = newton_sums(rows, d, place, centre, scale, np.einsum("fi,fij->fj", w, turn))
        for f, s in sums.items():
            if done[f]:
                continue
            loss = s[0] + 0.5 * (penalty * w[f] ** 2).sum()
            if loss > best[f] + 1e-9 * (1 + abs(best[f])):
                w[f] = (w[f] + last[f]) / 2
                continue
            h = np.zeros((d + 1, d + 1))
            h[upper] = s[d + 2 :]
            h = turn[f] @ (h + np.triu(h, 1).T) @ turn[f].T + np.diag(penalty)
            step = np.linalg.lstsq(h, turn[f] @ s[1 : d + 2] + penalty * w[f], rcond=None)[0]
            best[f], last[f], w[f] = loss, w[f], w[f] - step
            done[f] = np.abs(step).max() < 1e-8
        if done.all() or not sums:
            break
    return w


def taught(df: DataFrame, features: list[str], label: str, group: Column) -> tuple[DataFrame, dict]:
    """The numbers that fits read, x0, x1, ..., y and g, and the sums of each group that teach; null features count as 0, rows with a null label teach nothing."""
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select(*xs, F.col(label).cast("double").alias("y"), group.alias("g"))
    known = F.col("y").isNotNull()
    of = lambda f, i: f(F.when(known, F.col(f"x{i}")))
    sums = [F.count("y").alias("n"), F.sum("y").alias("ones"), *[of(F.avg, i).alias(f"m{i}") for i in range(len(features))], *[of(F.var_pop, i).alias(f"v{i}") for i in range(len(features))]]
    return rows, {r["g"]: r for r in rows.groupBy("g").agg(*sums).collect()}


def pooled(n: np.ndarray, mean: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (population, 1 where it is 0) of groups taken together."""
    total = max(1.0, n.sum())
    m = (n[:, None] * mean).sum(0) / total
    v = np.sqrt((square + n[:, None] * (mean - m) ** 2).sum(0) / total)
    return m, np.where(v > 1e-12 * (1 + np.abs(m)), v, 1.0)


def held_out_scores(df: DataFrame, features: list[str], label: str, group: str, least: int = 10, block: int = 64) -> DataFrame:
    """``df`` with score: each group's probability of label 1 by a logistic model of all other groups, on features standardised there, with an L2 penalty of 1 over all rows together but none on
    the intercept; 0.5 where these have under ``least`` rows or one label.

    The models of ``block`` groups are fitted side by side, a pass over the rows for each Newton step of all of them; groups' sums and models come to the driver, so groups are events, few. Null
    groups are a group of their own; null features count as 0, rows with a null label are scored but teach nothing; an empty table gives an empty result.
    """
    d = len(features)
    rows, stats = taught(df, features, label, F.col(group))
    n, mean, square, ones = group_sums(stats, d)
    names, models = list(stats), []
    fit = [i for i in range(len(names)) if n.sum() - n[i] >= least and 0 < ones.sum() - ones[i] < n.sum() - n[i]]
    rows = rows.persist()  # read once per step
    centre, scale = pooled(n, mean, square) if names else (np.zeros(d), np.ones(d))
    for at in range(0, len(fit), block):
        folds = fit[at : at + block]
        m, v = (np.array(x) for x in zip(*[pooled(np.delete(n, i), np.delete(mean, i, 0), np.delete(square, i, 0)) for i in folds], strict=True))
        w = penalised_fits(rows, d, {names[i]: k for k, i in enumerate(folds)}, m, v, centre, scale)
        for k, i in enumerate(folds):
            slope = w[k, :d] / v[k]
            models.append((names[i], slope.tolist(), float(w[k, d] - slope @ m[k])))
    rows.unpersist()
    fields = [df.schema[group].dataType, T.ArrayType(T.DoubleType()), T.DoubleType()]
    known = df.sparkSession.createDataFrame(models, T.StructType([T.StructField(c, t) for c, t in zip(("__g", "__slope", "__at"), fields, strict=True)]))
    logit = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.get("__slope", F.lit(i)) for i, c in enumerate(features)), F.col("__at"))
    scored = df.join(F.broadcast(known), F.col(group).eqNullSafe(F.col("__g")), "left")
    return scored.select(*[df[c] for c in df.columns], F.coalesce(1 / (1 + F.exp(-logit)), F.lit(0.5)).alias("score"))


def coefficients(df: DataFrame, features: list[str], label: str, top: int = 8) -> DataFrame:
    """(feature, coef) of the ``top`` largest by size, from a fit on all rows; all 0 without both labels. Sizes alike to nine places, such as those of two opposite categories, go by name: their last digits differ from run to run."""
    d = len(features)
    rows, stats = taught(df, features, label, F.lit(0))
    n, mean, square, ones = group_sums(stats, d)
    w = np.zeros(d)
    if 0 < ones.sum() < n.sum():
        m, v = pooled(n, mean, square)
        rows = rows.persist()
        w = penalised_fits(rows, d, {}, m[None], v[None], m, v)[0, :d]
        rows.unpersist()
    ranked = sorted(zip(features, map(float, w), strict=True), key=lambda r: (-round(abs(r[1]), 9), r[0]))[:top]
    return df.sparkSession.createDataFrame(ranked, "feature string, coef double")
