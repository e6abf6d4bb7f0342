"""Bootstraps. Draws come from an arithmetic hash of (replicate, slot, item), so that any engine repeats them; intervals are order statistics of the replicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.operators.metrics import SIX
from augury.sources.shared import stored

PRIME = 2147483647
#: Multipliers of replicate, slot and item, then the seed.
STEP = (1000003, 7919, 69621)
SEED = 42
#: Places of the hash's order that a task takes at once.
BLOCK = 1 << 20


def with_drawn(df: DataFrame, name: str, n: str, *terms: str) -> DataFrame:
    """``df`` with a number from 0 to n - 1 as ``name``: two rounds of the fifth power, which permutes the numbers below ``PRIME``, over a sum of multiples of the columns ``terms``.
    Each step is a column of its own, so that it stays in generated code."""
    x = (sum((F.col(t) * k for t, k in zip(terms, STEP, strict=False)), F.lit(0)) + SEED) % PRIME
    df = df.withColumn("__x", x)
    for _ in range(2):
        df = df.withColumn("__s", (F.col("__x") * F.col("__x")) % PRIME)
        df = df.withColumn("__x", ((F.col("__s") * F.col("__s")) % PRIME * F.col("__x") + 12345) % PRIME)
    return df.withColumn(name, F.col("__x") % F.col(n)).drop("__x", "__s")


def event_draws(e: DataFrame, by: str, replicates: int) -> DataFrame:
    """``e`` (a row per event) drawn with replacement, as many events as there are in each replicate: its columns with rep and slot. Only the table of draws, events times replicates,
    is made; it meets the events by their number."""
    names = e.agg(F.array_sort(F.collect_set(by)).alias("all"))  # a name per event
    e = e.join(names.select(F.posexplode("all").alias("__i", by)), by)
    draws = e.sparkSession.range(replicates).withColumnRenamed("id", "rep").join(F.broadcast(names.select(F.size("all").cast("long").alias("__n"))))  # one row; replicates lie in all tasks
    draws = draws.select("__n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("slot"))
    draws = with_drawn(draws, "__i", "__n", "rep", "slot").select("rep", "slot", F.col("__i").cast("int").alias("__i"))
    return draws.join(e, "__i").drop("__i")


def interval(v: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """(n, lo, hi): the values at the two tails of the replicates in order."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    n = F.size("v")
    at = lambda q: F.when(n > 0, F.get("v", F.least((n * F.lit(q)).cast("int"), n - 1)))
    return v.agg(F.array_sort(F.collect_list(value)).alias("v")).select(n.cast("long").alias("n"), at(lo).alias("lo"), at(hi).alias("hi"))


def shares(df: DataFrame, by: str, flag: str, replicates: int = 2000) -> DataFrame:
    """(rep, share) of ``flag``, resampling events only. Events are counted first, so draws join rows per event, not per signal."""
    e = df.groupBy(by).agg(F.sum(F.col(flag).cast("int")).alias("k"), F.count("*").alias("n"))
    return event_draws(e, by, replicates).groupBy("rep").agg(F.round(F.sum("k") / F.sum("n"), SIX).alias("share"))


def permuted(x: np.ndarray) -> np.ndarray:
    """The two rounds of ``with_drawn``."""
    for _ in range(2):
        s = x * x % PRIME
        x = (s * s % PRIME * x + 12345) % PRIME
    return x


def two_stage_shares(df: DataFrame, by: str, flag: str, replicates: int = 2000) -> DataFrame:
    """(rep, share) of ``flag``, resampling events and then the signals in each: of n signals with k flags, a drawn number below k is a flag, so signals are counted once and never joined."""
    e = df.groupBy(by).agg(F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0)).alias("k"), F.count("*").alias("n"))
    return counted_shares(stored(e, "events"), by, replicates)


def counted_shares(e: DataFrame, by: str, replicates: int, block: int = BLOCK) -> DataFrame:
    """``two_stage_shares`` of events given as (by, k, n).

    The items of a drawn event go through the hash in steps of ``STEP[2]``, that is, they are a run of n places in one fixed order of all numbers below ``PRIME``. This order is cut into blocks; a task hashes a
    block once for all runs in it, or only the runs where these are shorter, and takes each run's flags from running counts. So the work is replicates times items or, if less, the order's length times events, however many
    signals there are, in tasks of equal size.
    """
    start = (F.col("rep") * STEP[0] + F.col("slot") * STEP[1] + SEED) % PRIME * pow(STEP[2], -1, PRIME) % PRIME
    d = event_draws(e, by, replicates).select("rep", "k", "n", start.alias("a")).withColumn("b", F.col("a") + F.col("n"))
    for name, size in (("lap", PRIME), ("block", block)):  # runs are cut where the order begins anew, then at the blocks
        at = F.lit(size).cast("long")
        d = d.withColumn(name, F.explode(F.sequence(F.expr(f"a div {size}L"), F.expr(f"(b - 1) div {size}L"))))
        d = d.withColumns({"a": F.greatest(F.col("a"), F.col(name) * at) - F.col(name) * at, "b": F.least(F.col("b"), (F.col(name) + 1) * at) - F.col(name) * at})

    def hits(f: pd.DataFrame) -> pd.DataFrame:
        first = int(f["block"].iat[0]) * block
        whole = permuted((first + np.arange(block)) * STEP[2] % PRIME) if (f["b"] - f["a"]).sum() >= block else None
        out = []
        for (n, k), g in f.groupby(["n", "k"]):
            a, b = g["a"].to_numpy(), g["b"].to_numpy()
            size = b - a
            if size.sum() < block:  # only the runs
                end = np.cumsum(size)
                i = np.arange(end[-1]) + np.repeat(a - (end - size), size)
                x, a, b = permuted((first + i) * STEP[2] % PRIME) if whole is None else whole[i], end - size, end
            else:
                x = whole
            x = x.astype(np.uint32)
            r = x - x // np.uint32(n) * np.uint32(n) if n < PRIME else x
            under = np.concatenate([[0], np.cumsum(r < k)])
            out.append(pd.DataFrame({"rep": g["rep"].to_numpy(), "hits": under[b] - under[a], "items": size}))
        return pd.concat(out).groupby("rep", as_index=False).sum()

    tasks = 4 * e.sparkSession.sparkContext.defaultParallelism  # few rows, much work: not for the planner to put together
    per = d.select("rep", "k", "n", "a", "b", "block").repartition(tasks, "block").groupBy("block").applyInPandas(hits, "rep long, hits long, items long")
    return per.groupBy("rep").agg(F.round(F.sum("hits") / F.sum("items"), SIX).alias("share"))


def paired(df: DataFrame, by: str, arm: str, a: str, b: str, replicates: int = 2000) -> DataFrame:
    """Event resampling of two arms by the same draws: (rep, counts of each arm, d_prec, d_tp, d_fp, c_star)."""
    n = lambda x, tp: F.count_if((F.col(arm) == x) & (F.col("is_tp") == tp))
    e = df.groupBy(by).agg(*[n(x, t).alias(f"{k}_{m}") for x, m in ((a, "a"), (b, "b")) for k, t in (("tp", True), ("fp", False))])
    cols = ["tp_a", "fp_a", "tp_b", "fp_b"]
    d = event_draws(e, by, replicates).groupBy("rep").agg(*[F.sum(c).alias(c) for c in cols])
    prec = lambda m: F.col(f"tp_{m}") / F.nullif(F.col(f"tp_{m}") + F.col(f"fp_{m}"), F.lit(0))
    tp, fp = F.col("tp_b") - F.col("tp_a"), F.col("fp_b") - F.col("fp_a")
    infinite = F.lit(float("inf"))
    c = F.when(fp == 0, F.when(tp < 0, infinite).otherwise(0.0)).when(tp >= 0, 0.0).otherwise(-tp / -fp)
    return d.select("rep", *cols, F.round(prec("b") - prec("a"), SIX).alias("d_prec"), tp.alias("d_tp"), fp.alias("d_fp"), F.round(c, SIX).alias("c_star"))


def paired_summary(d: DataFrame, prices: list[float]) -> DataFrame:
    """(measure, value) of the replicates of ``paired``: how often precision rises and false alarms fall, the share of finite break-even prices, and at each price how often b is worth more than a."""
    worth = lambda m, c: F.col(f"tp_{m}") - c * F.col(f"fp_{m}")
    rows = [("P(precision rises)", F.col("d_prec") > 0), ("P(FP falls)", F.col("d_fp") < 0), ("finite c*", F.col("c_star") < float("inf"))]
    rows += [(f"P(b better | {c:g})", worth("b", c) > worth("a", c)) for c in prices]
    x = d.agg(F.array(*[F.struct(F.lit(name).alias("measure"), F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), SIX).alias("value")) for name, c in rows]).alias("x"))
    return x.select(F.inline("x"))


def weighted_means(df: DataFrame, by: str, value: Column, replicates: int = 2000) -> DataFrame:
    """(rep, mean) of ``value`` over all signals of the drawn events."""
    e = df.groupBy(by).agg(F.sum(F.round(value * 1000000).cast("long")).alias("s"), F.count("*").alias("n"))
    return event_draws(e, by, replicates).groupBy("rep").agg(F.round(F.sum("s") / F.sum("n") / 1000000, SIX).alias("mean"))


def curve(df: DataFrame, by: str, value: str, grid: list[int], replicates: int = 2000, level: float = 0.95) -> DataFrame:
    """(x, mean, lo, hi): mean over events of the share of ``value`` at or under each point, with its pointwise interval over drawn events."""
    e = df.groupBy(by).agg(F.array(*[F.avg((F.col(value) <= x).cast("double")) for x in grid]).alias("y"))
    point = e.select(F.posexplode("y").alias("i", "y")).groupBy("i").agg(F.round(F.avg("y"), SIX).alias("mean"))
    reps = event_draws(e, by, replicates).select("rep", F.posexplode("y").alias("i", "y")).groupBy("rep", "i").agg(F.round(F.avg("y"), SIX).alias("m"))
    v = reps.groupBy("i").agg(F.array_sort(F.collect_list("m")).alias("v"))
    at = lambda q: F.get("v", (F.size("v") * F.lit(q)).cast("int"))
    xs = F.array(*map(F.lit, grid))
    return v.join(point, "i").select(F.get(xs, F.col("i")).alias("x"), "mean", at((1 - level) / 2).alias("lo"), at((1 + level) / 2).alias("hi"))
