"""The pipeline's stages on a small corpus of known cases."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P

RNG = np.random.default_rng(9)
WORDS = [f"{a}{b}{c}" for a in "bdkt" for b in "aeiou" for c in ("n", "rs", "lt", "m")]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def test_stages(spark, tmp_path):
    clean = [prose(90) for _ in range(300)]
    toxic = [prose(60) + " scumbag " + prose(5) for _ in range(60)]
    words = clean[0].split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    item = prose(30)
    texts = clean + toxic + [near, clean[1], prose(10) + " " + item + " " + prose(10), prose(20) + " password=abcdefghijkl1234"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 360)) for i in range(360)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(300)) | {360, 361, 362, 363}
    assert kept[1] == set(range(300)) | {362, 363}
    assert kept[2] == set(range(300)) | {363} == kept[3] == kept[4]
    assert "[secret]" in spark.read.parquet(f"{tmp_path}/out3").where("doc_id = 363").first().text
    assert docs.where(F.col("n_tokens") * 4 != F.octet_length("ids")).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, ids that come twice with different texts, and rows that come twice."""
    clean = [prose(60) for _ in range(8)]
    item = prose(30)
    dirty = prose(8) + " " + item + " " + prose(8)
    rows = [(0, clean[0]), (0, clean[1]), (1, clean[2]), (1, clean[2]), (None, clean[3]), (None, dirty), (5, dirty), (5, clean[4]), (6, None), (7, ""), (8, clean[2])]
    train = [(100 + i, prose(40)) for i in range(80)] + [(200 + i, prose(30) + " scumbag " + prose(4)) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash long"
    spark.createDataFrame([(i, t, None, "s", len(t or ""), 7) for i, t in rows + train], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in train], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            left.append(sorted(((r.doc_id, r.text) for r in docs.where("doc_id is null or doc_id < 100").collect()), key=repr))
    key = lambda x: sorted(x, key=repr)
    assert left[0] == key(rows)
    empty = [r for r in left[1] if not r[1]]
    assert key(r for r in left[1] if r[1]) == key([(0, clean[0]), (0, clean[1]), (1, clean[2]), (None, clean[3]), (None, dirty), (5, dirty), (5, clean[4])]) and len(empty) >= 1
    assert key(r for r in left[2] if r[1]) == key([(0, clean[0]), (0, clean[1]), (1, clean[2]), (None, clean[3]), (5, clean[4])])
    assert key(r for r in left[3] if r[1]) == key(r for r in left[2] if r[1]) and docs.where("doc_id is null").count() == 1


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, s in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
