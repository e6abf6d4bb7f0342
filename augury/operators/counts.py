"""Bootstraps by counts: resampling n items with replacement is one multinomial draw over their distinct values, so no item is ever a row.

Values are counted first. Each group's distinct values are dealt into blocks of ``BLOCK`` at most; a first draw per replicate says how many items fall into each block, a second one, in the block's own task, which of its
values they are. The work is replicates times distinct values, in tasks of bounded size however large a group is. Every draw has a generator of its own, seeded by the group, block and replicates it is for, so a task
that runs again draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.sources.shared import stored

BLOCK = 4096
STEP = 250
SCALE = 1_000_000


def generator(*key: int) -> np.random.Generator:
    """A generator for one draw."""
    return np.random.default_rng([k % (1 << 63) for k in key])


def tallied(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(*by, v, weight): how often each distinct value stands in each group, stored, so that all that follows reads a row per value instead of ``df``."""
    return stored(df.groupBy(*by, value.alias("v")).agg(F.count("*").alias("weight")), "tally")


def counted(df: DataFrame, by: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """(group, v, n): how often each distinct value (in millionths, whole numbers) stands in each group, a row counting ``weight`` times; ``group`` is a struct of ``by``. Null values are left out. Stored, as
    each draw reads it more than once."""
    w = F.lit(1) if weight is None else weight
    c = df.select(F.struct(*by).alias("group"), F.round(value * SCALE).cast("long").alias("v"), w.alias("w")).where("v is not null")
    return stored(c.groupBy("group", "v").agg(F.sum("w").alias("n")), "counts")


def blocks(counts: DataFrame) -> DataFrame:
    """(group, id, block, vs, ns, total): the distinct values of each group in blocks, each in order."""
    sizes = counts.groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK / 2)).alias("parts"))
    placed = counts.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    b = placed.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("x"), F.sum("n").alias("total"))
    return b.select("group", F.xxhash64("group").alias("id"), "block", F.col("x.v").alias("vs"), F.col("x.n").alias("ns"), "total")


def totals(b: DataFrame) -> DataFrame:
    """(group, id, parts, n): the blocks of each group as an array of (block, total)."""
    return b.groupBy("group", "id").agg(F.array_sort(F.collect_list(F.struct("block", "total"))).alias("parts"), F.sum("total").alias("n"))


def drawn(b: DataFrame, asked: DataFrame, seed: int) -> DataFrame:
    """(group, rep, s): the sum of ``m`` values drawn from each group, for every row (group, rep, m) of ``asked``."""
    groups = asked.join(totals(b), "group").withColumn("part", F.floor(F.col("rep") / STEP)).groupBy("id", "part", "parts").agg(F.array_sort(F.collect_list(F.struct("rep", "m"))).alias("reps"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                block, total = np.array([x["block"] for x in r.parts]), np.array([x["total"] for x in r.parts], float)
                rep, m = np.array([x["rep"] for x in r.reps]), np.array([x["m"] for x in r.reps], np.int64)
                out = generator(seed, 1, r.id, r.part).multinomial(m, total / total.sum())
                i, j = np.nonzero(out)
                yield pd.DataFrame({"id": r.id, "block": block[j], "part": r.part, "rep": rep[i], "m": out[i, j]})

    per = groups.mapInPandas(deal, "id long, block int, part long, rep long, m long").groupBy("id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("rep", "m"))).alias("reps"))
    met = per.join(b, ["id", "block"]).select("id", "block", "part", "reps", "vs", "ns")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                rep, m = np.array([x["rep"] for x in r.reps]), np.array([x["m"] for x in r.reps], np.int64)
                p = np.asarray(r.ns, float)
                out = generator(seed, 2, r.id, r.block, r.part).multinomial(m, p / p.sum())
                yield pd.DataFrame({"id": r.id, "rep": rep, "s": out @ np.asarray(r.vs, np.int64)})

    sums = met.mapInPandas(draw, "id long, rep long, s long").groupBy("id", "rep").agg(F.sum("s").alias("s"))
    return sums.join(b.select("group", "id").distinct(), "id").select("group", "rep", "s")


def replicates(spark, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "rep")


def group_means(df: DataFrame, by: list[str], value: Column, n: int = 2000, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """(*by, rep, mean): each group's items resampled within it; a row stands for ``weight`` items."""
    b = blocks(counted(df, by, value, weight))
    sizes = totals(b).select("group", F.col("n").alias("m"))
    asked = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return drawn(b, asked, seed).join(sizes, "group").select("group.*", "rep", (F.col("s") / F.col("m") / SCALE).alias("mean"))


def pooled_means(df: DataFrame, by: str, value: Column, within: list[str] | None = None, n: int = 2000, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """(*within, rep, mean): groups of ``by`` drawn with replacement, as many as there are, then the items of each drawn group; pooled. Separately for each value of ``within``; a row stands for ``weight`` items."""
    within = within or []
    b = blocks(counted(df, [*within, by], value, weight))
    sizes = totals(b).select("group", "n", *[F.col(f"group.{w}").alias(w) for w in within], F.col(f"group.{by}").alias(by))
    names = sizes.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct(by, "n"))).alias("groups"))
    names = names.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // STEP).cast("long")))).withColumn("id", F.xxhash64(*within, F.lit(seed)))
    key = df.select(*within, by).schema

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                groups = len(r["groups"])
                reps = np.arange(r["part"] * STEP, min(n, (r["part"] + 1) * STEP))
                times = generator(seed, 3, int(r["id"]), int(r["part"])).multinomial(groups, np.full(groups, 1 / groups), len(reps))
                i, j = np.nonzero(times)
                out = pd.DataFrame({by: [r["groups"][x][by] for x in j], "rep": reps[i], "m": times[i, j] * np.array([g["n"] for g in r["groups"]], np.int64)[j]})
                for w in within:
                    out[w] = r[w]
                yield out[[*within, by, "rep", "m"]]

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in key.fields) + ", rep long, m long"
    asked = names.repartition(*within, "part").mapInPandas(pick, schema).select(F.struct(*within, by).alias("group"), *within, "rep", "m")
    means = drawn(b, asked.select("group", "rep", "m"), seed).select("group", "rep", "s").join(asked, ["group", "rep"])
    return means.groupBy(*within, "rep").agg((F.sum("s") / F.sum("m") / SCALE).alias("mean"))


def bounds(means: DataFrame, by: list[str], level: float = 0.95, ends: str = "inner") -> DataFrame:
    """(*by, replicates, lo, hi): order statistics of the replicates; ``inner`` takes the upper one before the place that ``outer`` takes."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    n = F.size("v")
    at = lambda i: F.round(F.get("v", F.least(F.greatest(i, F.lit(0)), n - 1)), 6)
    return means.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("v")).select(*by, n.cast("long").alias("replicates"), at((n * F.lit(lo)).cast("int")).alias("lo"), at((n * F.lit(hi)).cast("int") - (1 if ends == "inner" else 0)).alias("hi"))
