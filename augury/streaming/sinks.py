"""Sinks for extracted records: exactly once by batch, errors purged in place, and a stop when too many rows failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class TooManyErrorsError(RuntimeError):
    """A job whose share of failed rows passed the limit; ``counts`` says by how much."""

    def __init__(self, counts: dict[str, int], most: float):
        super().__init__(f"{counts['failed']} of {counts['rows']} rows failed, over {most:.0%}")
        self.counts = counts


def written(df: DataFrame, path: str, failed: Column, most: float = 0.2) -> dict[str, int]:
    """Write ``df`` and count, in the same job, its rows and those where ``failed`` holds; over ``most`` of them the rows stay, for a look at them, and the job fails. No rows never fail."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows"), F.count_if(failed).alias("failed")).write.mode("overwrite").parquet(path)
    counts = dict(seen.get)
    if counts["failed"] > most * counts["rows"]:
        raise TooManyErrorsError(counts, most)
    return counts


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Rows of a batch into a partition of its own, whole or not at all: a batch that comes again, be it after a crash in the middle, replaces what it wrote before."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def exactly_once(stream: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each micro-batch through ``extract`` into ``path``, by ``append_batch``. ``extract`` must give the same rows for the same batch, or the later ones win."""
    return stream.writeStream.foreachBatch(lambda df, i: append_batch(extract(df), path, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def purge(spark: SparkSession, path: str, failed: Column) -> int:
    """Take the failed rows out of a sink, so that their inputs are extracted again. Only partitions that hold some are written, and each at once; one that held nothing else keeps no rows. Returns how many rows went."""
    rows = spark.read.parquet(path)
    hit = [r["batch"] for r in rows.where(failed).select("batch").distinct().collect()]  # batches, not rows
    gone = rows.where(failed).count()
    for batch in hit:
        kept = rows.where((F.col("batch") == batch) & ~F.coalesce(failed, F.lit(False)))
        target = f"{path}/batch={batch}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        staged = f"{path}/_purge-{batch}"
        kept.drop("batch").write.mode("overwrite").parquet(staged)
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
        fs.delete(jvm.org.apache.hadoop.fs.Path(target), True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target))
    return gone
