"""Helpers the operators of this subpackage share: shared-folder tables, text batches, stable column names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.sources.shared import shared_dir, stored  # noqa: F401


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of ``column`` (one long row may exceed it): memory follows bytes, not rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def spans_text(spans: Column) -> Column:
    """``[(start, end), ...]`` as ``start:end,start:end``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
