"""Metrics over scored signals: ``DataFrame -> DataFrame``, each an aggregate that Spark can combine before its shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.text import foresight, wilson

SIX = 6


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def pre_onset(df: DataFrame, days: int = 180) -> DataFrame:
    return df.where(F.col("lead").between(1, days))


def post_onset(df: DataFrame, days: int = 14) -> DataFrame:
    return df.where((-F.col("lead")).between(1, days))


def fwgs(v: str, tau: float = 30.0, lam: float = 0.5) -> Column:
    """A signal's foresight-weighted grounding score from lead, is_tp, g and conf. v1: penalty with confidence on every signal; v3: false positives only, without it; no_w, no_g, no_lam: ablations of v1."""
    w, g, tp = foresight(F.col("lead"), tau), F.col("g"), F.col("is_tp").cast("int")
    if v == "v3":
        return F.when(F.col("is_tp"), w * g).otherwise(-lam * (1 - g))
    gain = g * tp if v == "no_w" else w * tp if v == "no_g" else w * g * tp
    loss = F.lit(0.0) if v in ("no_lam", "no_g") else lam * (1 - g) * F.col("conf")
    return gain - loss


def cell(df: DataFrame, by: list[str], v: str = "v3") -> DataFrame:
    """n, tp, fp, precision and mean score of each group."""
    tp = F.col("is_tp").cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(tp).alias("tp"), F.sum(1 - tp).alias("fp"), F.round(F.avg(tp.cast("double")), SIX).alias("prec"), F.round(F.avg(fwgs(v)), SIX).alias("fwgs"))


def bins(df: DataFrame, by: list[str] | None = None, n: int = 10) -> DataFrame:
    """Calibration bins of equal width, closed on the left, the last on both sides; edges are the literals i/n, as floor(conf * n) errs at some of them."""
    b = sum((F.when(F.col("conf") >= F.lit(i / n), 1).otherwise(0) for i in range(1, n)), F.lit(0))
    return df.groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(F.col("is_tp").cast("double")).alias("acc"))


def ece(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error, overall or by stratum."""
    by = by or []
    return bins(df, by).groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean_conf"))) / F.sum("n"), SIX).alias("ece"))


def beta0(df: DataFrame, windows: list[int], by: list[str] | None = None) -> DataFrame:
    """Share of forward-looking labels strictly after the onset, for each window length: one pass, as a signal joins every window that holds it."""
    w = df.where(F.col("lead") < 0).select("*", F.explode(F.filter(F.array(*map(F.lit, windows)), lambda p: -F.col("lead") <= p)).alias("post_days"))
    return w.groupBy(*(by or []), "post_days").agg(F.count("*").alias("n"), F.sum(F.col("forward").cast("int")).alias("n_forward"), F.round(share(F.col("forward")), SIX).alias("beta0"))


def running(c: DataFrame, score: str, sums: list[str], by: list[str], buckets: int = 200) -> DataFrame:
    """``c`` (a row per distinct score, many at scale) with <sum>_under: totals over strictly lower scores of the same group. Two levels: scores are cut into ranges at approximate quantiles, windows run
    inside a range, and the ranges' own totals, few, are carried over by a join; no task takes all scores."""
    cuts = sorted(set(c.stat.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    c = c.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x <= F.col(score))) if cuts else F.lit(0))
    below = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = c.groupBy(*by, "__b").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    totals = totals.select(*by, "__b", *[F.coalesce(F.sum(f"__{s}").over(below), F.lit(0)).alias(f"__{s}") for s in sums])
    inside = Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    j = c.join(totals, [*by, "__b"])
    return j.select(*[x for x in c.columns if x != "__b"], *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"__{s}")).alias(f"{s}_under") for s in sums])


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """P(score of a positive > of a negative) + half of ties, exact: counts per distinct score, then running counts, never pairs."""
    by = by or []
    c = df.groupBy(*by, score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    c = running(c, score, ["q"], by)
    return c.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.round(F.sum(F.col("p") * (F.col("q_under") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0)), SIX).alias("auc"))


def survival(df: DataFrame, days: int = 14) -> DataFrame:
    """Share of forward labels among post-onset signals at each lag of ``days`` or less and later."""
    lag = post_onset(df, days).groupBy((-F.col("lead")).alias("lag")).agg(F.count("*").alias("n"), F.sum(F.col("forward").cast("int")).alias("f"))
    onward = Window.orderBy(F.col("delta").desc()).rowsBetween(Window.unboundedPreceding, 0)  # ``days`` rows
    grid = df.sparkSession.range(1, days + 1).select(F.col("id").cast("int").alias("delta"))
    all_ = grid.join(F.broadcast(lag), grid.delta == lag.lag, "left").select("delta", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0)).alias("f"))
    all_ = all_.select("delta", F.sum("n").over(onward).alias("n"), F.sum("f").over(onward).alias("f"))
    return all_.select("delta", "n", F.round(F.when(F.col("n") > 0, F.col("f") / F.col("n")), SIX).alias("s"))


def with_wilson(df: DataFrame, k: str = "tp", n: str = "n") -> DataFrame:
    lo, hi = wilson(F.col(k), F.col(n))
    return df.withColumns({"lo": F.round(lo, SIX), "hi": F.round(hi, SIX)})


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 labels; 1 if chance agreement is complete, null without rows."""
    s = df.agg(F.count("*").alias("n"), share(F.col(a) == F.col(b)).alias("po"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.round("po", SIX).alias("po"), F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), SIX).alias("kappa"))


def thresholds(df: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """fired, tp, fp, precision and mean lead of true positives at each threshold. Signals are counted per distinct confidence first, so the grid multiplies counts, not signals."""
    by = by or []
    tp = F.col("is_tp").cast("int")
    c = df.groupBy(*by, "conf").agg(F.count("*").alias("n"), F.sum(tp).alias("tp"), F.sum(F.when(F.col("is_tp"), F.col("lead")).otherwise(0)).alias("lead_sum"))
    t = c.select("*", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda x: F.col("conf") >= x)).alias("theta"))
    t = t.groupBy(*by, "theta").agg(F.sum("n").alias("fired"), F.sum("tp").alias("tp"), F.sum("lead_sum").alias("lead_sum"))
    return t.select(*by, "theta", "fired", "tp", (F.col("fired") - F.col("tp")).alias("fp"), F.round(F.col("tp") / F.col("fired"), SIX).alias("prec"), F.round(F.col("lead_sum") / F.nullif(F.col("tp"), F.lit(0)), SIX).alias("mean_lead"))


def kde(df: DataFrame, value: str, grid: list[int], least_width: float = 5.0) -> DataFrame:
    """Gaussian density of ``value`` at the grid's points, width max(1.06 s n^-0.2, ``least_width``). Distinct values are counted first, so the grid multiplies counts."""
    c = df.groupBy(value).agg(F.count("*").alias("n"))
    s = df.agg(F.count("*").alias("all"), F.greatest(1.06 * F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2)), F.lit(least_width)).alias("h"))
    x = c.join(s).select("*", F.explode(F.array(*map(F.lit, grid))).alias("x"))
    part = F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col(value)) / F.col("h"), F.lit(2)))
    return x.groupBy("x").agg(F.round(F.sum(part) / F.first(F.col("all") * F.col("h")) / (2 * math.pi) ** 0.5, 8).alias("density"))


def at_k(df: DataFrame, score: str, key: str, ks: list[int]) -> DataFrame:
    """Precision and recall among the k highest scores, ties by key: the top rows are a sorted limit, at most max(ks)."""
    top = df.select("is_tp", score, key).orderBy(F.col(score).desc(), key).limit(max(ks))
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.col(score).desc(), key)))
    hits = ranked.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.count_if((F.col("rk") <= k) & F.col("is_tp")).alias("tp")) for k in ks]).alias("x")).select(F.inline("x"))
    return hits.join(df.agg(F.count_if("is_tp").alias("all"))).select("k", "tp", F.round(F.col("tp") / F.col("k"), SIX).alias("prec"), F.round(F.col("tp") / F.nullif("all", F.lit(0)), SIX).alias("recall"))


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Sum of precision times gained recall over the distinct scores from high to low, ties together."""
    c = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    all_ = c.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))  # one row
    c = running(c, score, ["n", "p"], []).join(F.broadcast(all_))
    prec = (F.col("all_p") - F.col("p_under")) / (F.col("all_n") - F.col("n_under"))
    return c.agg(F.sum("p").alias("n_pos"), F.round(F.sum(F.col("p") * prec) / F.nullif(F.sum("p"), F.lit(0)), SIX).alias("ap"))


def drift(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Gap of each feature's means between the two groups in pooled population standard deviations, and whether it is over 0.5. All features in one pass."""
    one = lambda c: F.abs(F.avg(F.when(F.col(group), F.col(c))) - F.avg(F.when(~F.col(group), F.col(c)))) / F.nullif(F.stddev_pop(c), F.lit(0.0))
    x = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), one(c).alias("gap")) for c in features]).alias("x")).select(F.inline("x"))
    return x.select("feature", F.round("gap", SIX).alias("gap"), (F.col("gap") > 0.5).alias("flagged"))


def rollup(df: DataFrame, by: str, pooled: str = "POOLED") -> DataFrame:
    """``cell`` of every group and of all rows together, from one pass."""
    tp = F.col("is_tp").cast("int")
    r = df.rollup(by).agg(F.grouping(by).alias("all"), F.count("*").alias("n"), F.sum(tp).alias("tp"))
    return r.select(F.when(F.col("all") == 1, pooled).otherwise(F.col(by).cast("string")).alias(by), "n", "tp", F.round(F.col("tp") / F.col("n"), SIX).alias("prec"))
