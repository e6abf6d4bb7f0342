"""Which event a record belongs to, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_windows(events: DataFrame, event: str, order: str, start: str, days: int) -> DataFrame:
    """(day, event): for each day in any event's window of ``days`` days from ``start`` on, both ends included, the first such event in ``order``. A row per day of the windows,
    so that records join it by equality and no range join is needed."""
    day = F.explode(F.sequence(F.col(start), F.date_add(start, days))).alias("day")
    return events.where(F.col(start).isNotNull()).select(event, order, day).groupBy("day").agg(F.min_by(event, order).alias(event))


def attributed(records: DataFrame, day: str, windows: DataFrame, event: str, unmatched: str | None = None) -> DataFrame:
    """Records with the event of their day; those of no window go, or with ``unmatched`` stay under that name."""
    j = records.join(windows.withColumnRenamed("day", "__day"), F.col(day) == F.col("__day"), "left" if unmatched else "inner").drop("__day")
    return j.withColumn(event, F.coalesce(event, F.lit(unmatched))) if unmatched else j


def contamination(df: DataFrame, by: str, day: str, onset: str, forward: Column, conf: str) -> DataFrame:
    """Of attributed signals, per event and pooled: those strictly after the onset and on its day, the share of forward labels after it, and mean confidences of both kinds."""
    post = F.col(day) > F.col(onset)
    mean = lambda c: F.round(F.avg(F.when(c, F.col(conf))), 6)
    r = df.where(F.col(day) >= F.col(onset)).rollup(by).agg(
        F.grouping(by).alias("__all"), F.count_if(post).alias("n_post"), F.count_if(~post).alias("n_onset_day"), F.count_if(post & forward).alias("n_forward"),
        F.round(F.count_if(post & forward) / F.nullif(F.count_if(post), F.lit(0)), 6).alias("beta0"), mean(post & forward).alias("conf_forward"), mean(post & ~forward).alias("conf_other"),
    )
    return r.select(F.when(F.col("__all") == 1, "POOLED").otherwise(F.col(by)).alias(by), *[c for c in r.columns if c not in (by, "__all")])


def article_text(text: Column, title: Column) -> Column:
    """The body, else the title, else nothing."""
    return F.coalesce(F.nullif(text, F.lit("")), title, F.lit(""))


def human_precision(df: DataFrame, by: str, label: str) -> DataFrame:
    """Share of label 1 among labels 1 and 0, per group and pooled; any other label counts as unsure and is left out."""
    ok = F.col(label) == "1"
    r = df.rollup(by).agg(F.grouping(by).alias("__all"), F.count_if(ok).alias("tp"), F.count_if(F.col(label).isin("1", "0")).alias("n"), F.count_if(~F.coalesce(F.col(label), F.lit("")).isin("1", "0")).alias("unsure"))
    return r.select(F.when(F.col("__all") == 1, "POOLED").otherwise(F.col(by)).alias(by), "tp", "n", "unsure", F.round(F.col("tp") / F.nullif("n", F.lit(0)), 6).alias("prec"))


def nominal_kappa(a: DataFrame, b: DataFrame, key: str, label: str, categories: tuple[str, ...] = ("1", "0", "?")) -> DataFrame:
    """Cohen's kappa of two annotators over their shared keys, with any number of categories."""
    j = a.select(key, F.col(label).alias("a")).join(b.select(key, F.col(label).alias("b")), key)
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    s = j.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), sum((share(F.col("a") == c) * share(F.col("b") == c) for c in categories), F.lit(0.0)).alias("pe"))
    return s.select("n", F.round("po", 6).alias("po"), F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))
