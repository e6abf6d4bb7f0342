"""The contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import bpe, decontaminate, html, lines, negatives, oracles, phrases, pii, quality, secrets, simhash, suffix, topk, toxicity
from augury.llm.common import read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    v = e.where(topk.usable(F.col("embedding"))).select("vec_id", topk.integer_vector(F.col("embedding")).alias("v"))
    return topk.search(v, v.where("vec_id % 20 = 0"), k=20)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal(read(spark, sf_dir, "documents"), length=400, keep_text=False)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.Toxicity().fit(docs, read(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings out of ``labels``: 0 poor, 1 good but toxic, 2 good. Selected: P(grade > 0) of 0.5 or more; without any ratings nothing speaks against a document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    model = quality.Quality().fit(docs, ratings)
    scored = model.score(docs)
    good, best = model.over(0), model.over(1)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", good.alias("p_good"), best.alias("p_best"), F.coalesce(good >= 0.5, F.lit(True)).alias("selected"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.link(simhash.fingerprints(read(spark, sf_dir, "documents"), words=4), max_distance=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"), least=30, longest=4, top=2000, covered=80)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label first becomes (label + 1) % 10; anchors: vec_id divisible by 100."""
    rows = negatives.labelled(read(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("id") % 100 == 0, positives=5, negatives=5, low=80)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_topk, op3_suffix, op4_html, op5_toxicity, op6_secrets, op7_quality, op8_lines, op9_simhash, op10_decontaminate, op11_pii, op12_phrases, op13_negatives)}
SQL = {"op8_lines": oracles.LINES, "op12_phrases": oracles.PHRASES, "op13_negatives": oracles.NEGATIVES}
