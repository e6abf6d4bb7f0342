"""Ingest ranges, fetched bodies, annotation worksheets and paired gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_slots(ranges: DataFrame, start: str, end: str, slots: tuple[str, ...]) -> DataFrame:
    """A row per day of [start, end) and time slot, with the stamp of its file; an empty or reversed range gives none."""
    days = F.explode(F.when(F.col(start) < F.col(end), F.sequence(start, F.date_sub(end, 1)))).alias("day")
    return ranges.select("*", days).select("*", F.explode(F.array(*map(F.lit, slots))).alias("slot")).withColumn("stamp", F.concat(F.date_format("day", "yyyyMMdd"), "slot"))


def day_plan(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The keys whose range [start, end) needs each day, in order: a day is read once for all of them."""
    days = ranges.select(key, F.explode(F.when(F.col(start) < F.col(end), F.sequence(start, F.date_sub(end, 1)))).alias("day"))
    return days.groupBy("day").agg(F.array_sort(F.collect_set(key)).alias("needed_by"))


def era_guard(ranges: DataFrame, onset: str, start: str, first_day: str) -> DataFrame:
    """Without events before the source's first day; windows start on that day at the earliest."""
    first = F.to_date(F.lit(first_day))
    return ranges.where(F.col(onset) >= first).withColumn(start, F.greatest(start, first))


def numbered_per_day(df: DataFrame, day: str, order: list[str], hot: str, parts: int = 64) -> DataFrame:
    """``seq``: the number of a row within its day, from 1, in order of ``order``, whose first column, ``hot``, is a number.

    Two levels, so that no task holds a day: numbers inside ranges of ``hot``, carried over by the few counts of the ranges before.
    """
    low = df.groupBy(day).agg(F.min(hot).alias("__lo"), F.max(hot).alias("__hi"))
    cut = F.floor((F.col(hot) - F.col("__lo")) * parts / (F.col("__hi") - F.col("__lo") + 1)).alias("__part")
    ranged = df.join(low, day).select(*df.columns, cut)
    before = F.sum("__n").over(Window.partitionBy(day).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy(day, "__part").agg(F.count("*").alias("__n")).select(day, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(day, "__part").orderBy(*order))
    return ranged.withColumn("__seq", inside).join(counts, [day, "__part"]).select(*df.columns, (F.col("__seq") + F.col("__before")).cast("long").alias("seq"))


def best_fetch(df: DataFrame, key: str, status: str, size: str, order: str) -> DataFrame:
    """One fetch per key: one that is ok before any that failed, then the longest ok one, then the first."""
    ok = F.startswith(status, F.lit("ok"))
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((~ok).cast("int"), F.when(ok, -F.col(size)), order)).alias("r")).select(key, "r.*")


def worksheet_bodies(sheet: DataFrame, bodies: DataFrame, key: str, body: str, most: int = 1500) -> DataFrame:
    """A worksheet with the first ``most`` characters of each body; rows without one say so."""
    j = sheet.join(bodies.select(key, F.col(body).alias("__body")), key, "left")
    return j.select(*sheet.columns, F.coalesce(F.substring("__body", 1, most), F.lit("")).alias("body"), F.when(F.col("__body").isNull(), "no_fetch").otherwise("ok").alias("fetch"))


def carried_over(status: Column, new: Column, old: Column) -> Column:
    """The label of a row: where nothing was fetched and none is given, the old one stays."""
    return F.when((status == "no_fetch") & new.isNull(), old).otherwise(new)


def extended_sample(rows: DataFrame, kept: DataFrame, event: str, key: str, hit: Column, hits: int, most: int, seed: int = 42) -> DataFrame:
    """``kept`` rows, and for each event new ones up to ``most`` in all: at most ``hits`` hits first, then at most ``most - hits`` others, in an arithmetic random order of integer keys."""
    order = [(F.col(key).cast("long") % 2147483647 * 1103515245 + F.lit(seed) * 12345) % 2147483647, F.col(key)]
    fresh = rows.withColumn("__hit", F.coalesce(hit, F.lit(False))).join(kept.select(key).distinct(), key, "left_anti")
    first = lambda c, n: fresh.where(c).withColumn("__rn", F.row_number().over(Window.partitionBy(event).orderBy(*order))).where(F.col("__rn") <= F.lit(n))
    drawn = first(F.col("__hit"), hits).unionByName(first(~F.col("__hit"), most - hits))  # limits are literals, so tasks cut a hot event before the shuffle
    have = kept.groupBy(event).agg(F.count("*").alias("__have"))
    picked = drawn.withColumn("__at", F.row_number().over(Window.partitionBy(event).orderBy(F.col("__hit").desc(), "__rn"))).join(have, event, "left")
    picked = picked.where(F.col("__at") <= most - F.coalesce("__have", F.lit(0)))
    return kept.select(event, key, F.lit(True).alias("adjudicated")).unionByName(picked.select(event, key, F.lit(False).alias("adjudicated")))


def paired_gain(first: DataFrame, second: DataFrame, event: str, key: str) -> DataFrame:
    """Per event, the keys that two schemas hit, those only one of them does, and the net gain of the second. One shuffle: flags are unioned, not joined."""
    flags = first.select(event, key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select(event, key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    a, b = F.col("a"), F.col("b")
    out = flags.groupBy(event, key).agg(F.max("a").alias("a"), F.max("b").alias("b")).groupBy(event)
    return out.agg(F.sum("a").alias("h1"), F.sum("b").alias("h2"), F.sum(a * (1 - b)).alias("gain1"), F.sum(b * (1 - a)).alias("gain2"), F.sum(b - a).alias("net"))


def gain_by_type(gains: DataFrame, kind: str) -> DataFrame:
    """Mean net gain by event type, and how many events each schema wins."""
    n = F.col("net")
    return gains.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg("net"), 6).alias("mean_net"), F.count_if(n > 0).alias("second_wins"), F.count_if(n < 0).alias("first_wins"), F.count_if(n == 0).alias("ties"))


def backfilled(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of ``rows`` filled where blank from ``source``, whose keys are unique; a key without a source row fails the job."""
    j = rows.join(source.select(key, F.col(column).alias("__new"), F.lit(1).alias("__there")), key, "left")
    blank = F.trim(F.coalesce(column, F.lit(""))) == ""
    known = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no source row for key "), F.col(key).cast("string"))).cast("string")).when(blank, F.col("__new")).otherwise(F.col(column))
    return j.select(*[known.alias(c) if c == column else F.col(c) for c in rows.columns])
