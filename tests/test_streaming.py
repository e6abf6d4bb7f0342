"""Streams: causal features in any order of arrival, batches replayed and errors purged, and the stop on too many errors."""

import json
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from augury.operators.history import history
from augury.streaming import history as H
from augury.streaming import resume, sinks

ROWS = "key string, day date, tie long, conf double, sev double"


def written(folder, batches):
    folder.mkdir()
    for i, b in enumerate(batches):
        file = folder / f"{i:03d}.json"
        file.write_text("\n".join(json.dumps({**r, "day": str(r["day"])}) for r in b))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times


@pytest.mark.parametrize("seed", [1, 2])
def test_features_dont_depend_on_arrival_within_the_watermark(spark, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(seed)
    rows = [{"key": rng.choice("ab"), "day": date(2024, 1, 1) + timedelta(days=rng.randrange(40)), "tie": i, "conf": rng.randrange(1000) / 1000, "sev": float(rng.randrange(1, 6))} for i in range(120)]
    late = sorted(rows, key=lambda r: r["day"].toordinal() + rng.randrange(10))  # nearly in order: none comes over ten days late
    batches = [late[i : i + 30] for i in range(0, 120, 30)] + [[{"key": "end", "day": date(2030, 1, 1), "tie": 0, "conf": 0.0, "sev": 0.0}]]
    written(tmp_path / "in", batches)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = H.history_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> 'end'").collect()}
    batch = spark.createDataFrame([(r["key"], r["day"], r["tie"], r["conf"], r["sev"]) for r in rows], ROWS)
    want = {tuple(r) for r in history(batch, "key", "day", "tie", {"conf": "prior_conf", "sev": "prior_sev"}).select("key", "day", "tie", "conf", "sev", "prior_count", "days_since", "prior_conf", "prior_sev").collect()}
    assert len(got) == 120 and got == want


def test_a_batch_killed_and_replayed_is_there_once(spark, tmp_path):
    written(tmp_path / "in", [[{"id": i, "day": "x"}] for i in range(4)])
    out, died = str(tmp_path / "out"), []

    def extract(df):
        return df.select("id", F.when(F.col("id") == 2, "error").otherwise("ok").alias("status"))

    def run():
        stream = spark.readStream.schema("id long, day string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

        def batch(df, i):
            sinks.append_batch(extract(df), out, i)
            if i == 2 and not died:
                died.append(i)
                raise RuntimeError("lost after the write, before the commit")

        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="lost after the write"):
        run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    assert sinks.purge(spark, out, F.col("status") == "error") == 1
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 3]
    assert sinks.purge(spark, out, F.col("status") == "error") == 0
    q = sinks.exactly_once(spark.readStream.schema("id long, day string").json(str(tmp_path / "in")), out, str(tmp_path / "cp"), extract)
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 3  # nothing new came


def test_resumed_extraction_adds_only_what_is_not_done(spark, tmp_path):
    written(tmp_path / "in", [[{"input_id": f"a{i}", "day": "x"} for i in range(3)], [{"input_id": f"a{i}", "day": "x"} for i in range(2, 5)]])
    done = str(tmp_path / "done")
    spark.createDataFrame([("a0", "ok"), ("a1", "error")], "input_id string, status string").write.parquet(done)
    stream = spark.readStream.schema("input_id string, day string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    resume.resumable(stream, done, str(tmp_path / "cp"), lambda df: df.select("input_id", F.lit("ok").alias("status"))).awaitTermination(60)
    assert sorted(r["input_id"] for r in spark.read.parquet(done).where("status = 'ok'").collect()) == ["a0", "a1", "a2", "a3", "a4"]


def test_contamination_by_day_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-0{d}T0{h}:00:00Z", "forward": h < 2}) for d in (1, 2, 3) for h in range(4)) + '\n{"ts": "2024-03-01T00:00:00Z", "forward": true}')
    (tmp_path / "in/b.json").write_text('{"ts": "2024-06-01T00:00:00Z", "forward": true}')
    os.utime(tmp_path / "in/a.json", (1_700_000_000, 1_700_000_000))
    stream = spark.readStream.schema("ts timestamp, forward boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    resume.contamination_by_day(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((str(r["day"])[:10], r["n"], r["beta0"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:3] == [("2024-01-01", 4, 0.5), ("2024-01-02", 4, 0.5), ("2024-01-03", 4, 0.5)]


def test_stop_on_too_many_errors(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 20, "error").otherwise("ok").alias("status"))
    failed = F.col("status") == "error"
    assert sinks.written(df, str(tmp_path / "a"), failed) == {"rows": 100, "failed": 20}
    with pytest.raises(sinks.TooManyErrorsError, match="20 of 99"):
        sinks.written(df.where("id < 99"), str(tmp_path / "b"), failed)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 99
    assert sinks.written(df.where("id < 0"), str(tmp_path / "c"), failed) == {"rows": 0, "failed": 0}
