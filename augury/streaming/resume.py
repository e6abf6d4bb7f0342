"""Streaming forms: resumable extraction and post-onset contamination by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augury.operators.corpus import todo


def resumable(articles: DataFrame, done_path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """For each micro-batch of articles, extract only what isn't done and append it; a replayed batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        done = df.sparkSession.read.schema("input_id string, status string").parquet(done_path)
        extract(todo(df, done, "input_id")).write.mode("append").parquet(done_path)

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def contamination_by_day(signals: DataFrame, late: str = "14 days") -> DataFrame:
    """Share of forward-looking labels by day of a stream (ts, forward), with late rows up to ``late``."""
    return signals.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("forward").cast("double")).alias("beta0")).select(F.col("w.start").alias("day"), "n", "beta0")
