"""Comparison and pooling of reports, and result tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.operators.metrics import SIX, fwgs

# What a blocked page says instead of its article.
BLOCKED = (
    r"(?i)cloudflare|verify you are human|just a moment\.|enable javascript and cookies|attention required|checking your browser|challenge-platform|are you a robot"
    r"|captcha|perimeterx|datadome|incapsula|sucuri website firewall|ddos protection by|wayback machine (has not|doesn'?t have|does not have)"
)


def acceptable(text: Column, least: int = 250) -> Column:
    """A text long enough that no challenge page's words are in."""
    return (F.length(F.coalesce(text, F.lit(""))) >= least) & ~F.coalesce(text.rlike(BLOCKED), F.lit(False))


def event_table(df: DataFrame, by: str, tp: Column) -> DataFrame:
    """Per event: its forward signals before the onset, hits, false alarms, precision, score, and the earliest lead of any signal, hit or not."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(tp).alias("tp"), F.count_if(~tp).alias("fp"), F.round(F.avg(tp.cast("double")), SIX).alias("prec"), F.max("lead").alias("earliest_lead"), F.round(F.avg(fwgs("v3")), SIX).alias("fwgs"))


def side_by_side(first: DataFrame, second: DataFrame, by: str, names: tuple[str, str]) -> DataFrame:
    """Two tables of events in one, every column of each under its own ending; events of ``first`` that ``second`` lacks have nulls."""
    a = first.select(by, *[F.col(c).alias(f"{c}_{names[0]}") for c in first.columns if c != by])
    b = second.select(by, *[F.col(c).alias(f"{c}_{names[1]}") for c in second.columns if c != by])
    return a.join(b, by, "left")


def pooled(reports: DataFrame, by: str, n: str, means: list[str]) -> DataFrame:
    """Means of reports, each weighted by its number; reports that lack a mean don't weigh in it. ``n_<mean>`` says how many rows stand behind it."""
    out = []
    for m in means:
        weight = F.sum(F.when(F.col(m).isNotNull(), F.col(n)).otherwise(0))
        out += [F.round(F.sum(F.col(m) * F.col(n)) / F.nullif(weight, F.lit(0)), SIX).alias(m), weight.alias(f"n_{m}")]
    return reports.groupBy(by).agg(F.sum(n).alias(n), *out)


def ablations(df: DataFrame, by: str, variants: list[str]) -> DataFrame:
    """(event, variant, fwgs) of each variant of the score, from one aggregate."""
    s = df.groupBy(by).agg(*[F.round(F.avg(fwgs(v)), SIX).alias(v) for v in variants])
    return s.unpivot(by, variants, "variant", "fwgs")


def modes(df: DataFrame, by: str, value: str, top: int = 3) -> DataFrame:
    """How few values a score takes: rows, different values, the commonest with its share, and the ``top`` commonest as value:count. Ties go to the smaller value."""
    c = df.groupBy(by, value).agg(F.count("*").alias("n"))
    g = c.groupBy(by).agg(F.sum("n").alias("n"), F.count("*").alias("n_values"), F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("m"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))), 1, top).alias("t"))
    return g.select(by, "n", "n_values", (-F.col("m.v")).alias("mode"), F.round(F.col("m.n") / F.col("n"), SIX).alias("mode_share"), F.array_join(F.transform("t", lambda x: F.concat_ws(":", F.format_number(x["v"], 3), (-x["n"]).cast("string"))), " ").alias("top"))


def prompt(template: Column, fields: list[Column]) -> tuple[Column, Column]:
    """(system, user) prompts out of a template's two sections; the user's has ``{1}``, ``{2}`` and so on for the fields, null as empty. A template without the sections gives empty ones."""
    between = lambda a, b: F.trim(F.regexp_extract(template, rf"(?s){a}\s*(.*?)\s*{b}", 1))
    user = between("## User Prompt", "$")
    for i, f in enumerate(fields, 1):
        user = F.replace(user, F.lit(f"{{{i}}}"), F.coalesce(f.cast("string"), F.lit("")))
    return between("## System Prompt", "## User Prompt"), user


def table_lines(df: DataFrame, columns: dict[str, str], style: str = "markdown") -> DataFrame:
    """``df`` with ``line``: each row as a line of a Markdown or LaTeX table, numbers by their ``printf`` formats, null as a dash."""
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f, c)), F.lit("--")) for c, f in columns.items()]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")) if style == "markdown" else F.concat(F.regexp_replace(F.concat_ws(" & ", *cells), "_", r"\\_"), F.lit(r" \\"))
    return df.withColumn("line", line)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every float rounded, as reports hold them."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_report(df: DataFrame, path: str, digits: int = 4) -> None:
    """A report's rows as one file of JSON lines in UTF-8, nulls included; for result tables, which are small."""
    rounded(df, digits).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_worksheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """A sheet for annotators: fixed columns in order, missing ones empty, as one CSV file whose header begins with the mark that spreadsheets know UTF-8 by."""
    out = df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    out = out.withColumnRenamed(columns[0], "﻿" + columns[0])
    out.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
