"""Readers and writers of the record formats: JSON lines, signals with sentinel rows, ground truth, worksheets, tab-separated exports."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = "signal_id string, input_id string, signal_date string, temporality string, event_type string, severity int, confidence double, description string, trigger_phrases array<string>, commodities array<string>, companies array<string>, geographies array<string>, status string, error string"
ARTICLE = "id string, date string, source string, url string, title string, text string"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Blank and malformed lines are skipped, or with ``strict`` fail the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def company_names(raw: str = "companies"):
    """Names out of companies given as strings or as objects with a name (as raw JSON strings)."""
    return F.filter(F.transform(F.col(raw), lambda c: F.coalesce(F.when(F.startswith(c, F.lit("{")), F.get_json_object(c, "$.name")).otherwise(c), F.lit(""))), lambda n: n != "")


def signals(spark: SparkSession, path: str, drop: tuple[str, ...] = ("error", "empty")) -> DataFrame:
    """Signals without the sentinel rows named in ``drop``; with both dropped, rows without a label go too."""
    s = json_lines(spark, path, SIGNAL).withColumn("companies", company_names())
    s = s.where(~F.coalesce("status", F.lit("")).isin(*drop))
    return s.where(F.coalesce("temporality", F.lit("")) != "") if len(drop) > 1 else s


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Events of an object's ``events``, or of a bare list."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.inline("events")) if "events" in df.columns else df


def keyword_map(spark: SparkSession, path: str) -> DataFrame:
    """(event, keywords, rationale) out of one JSON object by event; names with a leading underscore are notes. Keywords are in lower case, empty ones left out; an event without any has an empty list."""
    each = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(~F.startswith("key", F.lit("_")))
    words = F.coalesce(F.try_variant_get("value", "$.url_keywords", "array<string>"), F.array().cast("array<string>"))
    return each.where(F.schema_of_variant("value").startswith("OBJECT")).select(F.col("key").alias("event"), F.filter(F.transform(words, F.lower), lambda w: w != "").alias("keywords"), F.try_variant_get("value", "$.rationale", "string").alias("rationale"))


def report_metrics(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A row per JSON report that ``path`` (a glob, perhaps) names: its file and the values at the ``fields``' paths as doubles; a report without one, or with something else there, has null."""
    v = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.try_parse_json("value").alias("v"))
    return v.select("file", F.col("v").isNotNull().alias("readable"), *[F.try_variant_get("v", p, "double").alias(n) for n, p in fields.items()])


def worksheet(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


# Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")


def worksheets(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(file, encoding, row, *columns) of worksheets in unknown encodings: each file is decoded whole and strictly by the first of ``ENCODINGS`` that fits; with none the read fails. Columns a sheet lacks are null.

    A sheet is what a person filled in, so a task may hold one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                content = bytes(content)
                for encoding in ENCODINGS:
                    try:
                        text = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"no encoding of {ENCODINGS} fits {path}")
                rows = list(csv.reader(io.StringIO(text, newline="")))
                header = rows[0] if rows else []
                named = [dict(zip(header, r, strict=False)) for r in rows[1:] if r]
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "encoding": encoding, "row": range(len(named))} | {c: pd.Series([r.get(c) for r in named], dtype=object) for c in columns}, columns=["file", "encoding", "row", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, encoding string, row int, " + ", ".join(f"`{c}` string" for c in columns))


def export_rows(spark: SparkSession, path: str) -> DataFrame:
    """(day, url) of tab-separated export rows of 61 columns or more."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(F.size(c) >= 61).select(F.try_to_date(c[1], "yyyyMMdd").alias("day"), c[60].alias("url"))


def write_signals(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
