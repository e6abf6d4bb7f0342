"""Corpus upkeep: dedup, merge, resume, invalidation, sampling, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in order. An aggregate, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def best_body(df: DataFrame, key: str, junk: Column, size: Column, order: str) -> DataFrame:
    """The body to keep per key: clean before junk, then the longest, then the first."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(junk.cast("int"), -size, order)).alias("r")).select(key, "r.*")


def merged(corpus: DataFrame, bodies: DataFrame, key: str, title: Column, body: Column) -> DataFrame:
    """Corpus with the body where there is one, else the title, and where it came from."""
    j = corpus.join(bodies, key, "left")
    return j.select(*corpus.columns, F.coalesce(body, title).alias("text"), F.when(body.isNull(), "title_fallback").otherwise("ok").alias("body_status"))


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; done rows in error are to be done again."""
    return rows.join(done.where("status <> 'error'").select(key).distinct(), key, "left_anti")


def invalidated(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows left after those of changed keys are deleted."""
    return rows.join(changed.select(key).distinct(), key, "left_anti")


def schema_fate(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """How labels fare from one schema to another: kept, relabelled, dropped, admitted."""
    j = old.select(key, F.col(label).alias("a")).join(new.select(key, F.col(label).alias("b")), key, "full_outer")
    fate = F.when(F.col("a").isNull(), "admitted").when(F.col("b").isNull(), "dropped").when(F.col("a") == F.col("b"), "kept").otherwise("relabelled")
    return j.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def stratified(df: DataFrame, strata: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """Up to k rows of each stratum in an arithmetic random order of their integer keys; the window keeps k rows per task before its shuffle."""
    order = (F.col(key).cast("long") % 2147483647 * 1103515245 + F.lit(seed) * 12345) % 2147483647
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).where(F.col("rn") <= k)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def flips(df: DataFrame, before: Column, after: Column) -> DataFrame:
    kind = F.when(before.isNull() | after.isNull(), "unlabelled").when(before == after, "same").when(before == 1, "1to0").otherwise("0to1")
    return df.groupBy(kind.alias("flip")).agg(F.count("*").alias("n"))


def adjudicated(d: Column, z: Column, ruling: Column) -> Column:
    return F.when(d.eqNullSafe(z), d).otherwise(ruling)
