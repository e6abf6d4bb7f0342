"""A corpus pipeline out of the operators of ``augury.llm``: toxicity, near-dedup, decontamination, secrets, encoding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Null texts count as empty (the secret stage writes them so); null ids are kept in near-dedup, which can't name a group's first by them, and judged by their text elsewhere; rows that repeat an id are judged each for
itself, but rows equal in id and text are one document; extra columns pass through up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import bpe, decontaminate, secrets, simhash, toxicity
from augury.llm.common import read, stored
from augury.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the factorization machine, fitted on the labelled ones, scores 0.5 or more."""
    model = toxicity.Toxicity().fit(docs, read(spark, sf_dir, "labels"))
    scored = model.score(docs, keep=tuple(docs.columns), names=("__score", "__toxic"))
    return scored.where("__toxic = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group whose five-word shingle sets link at Jaccard similarity 0.8 or more, computed on the sets themselves.

    Candidates share two least shingle hashes in one of eight tables, which at 0.8 misses 3 in 10,000 pairs, and are within 140 of 512 fingerprint bits: at 0.8 sets differ in 78 on average,
    in 96 if they have four and five shingles, with a deviation of 8. Rows without an id are kept.
    """
    rows = docs.where("doc_id is not null")
    first = simhash.similar(rows, words=5, least=0.8).where("first").select("doc_id", F.col("hash").alias("__hash"))
    kept = rows.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit("")))).join(first, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that cover 0.6 or more of a benchmark item by tiles of five tokens or more. What goes is told by its text, so rows with null or repeated ids are judged each for itself."""
    keyed = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit(""))))
    found = decontaminate.contaminated(keyed, read(spark, sf_dir, "benchmark"), key="__digest").select("__digest").distinct()
    return keyed.join(found, "__digest", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and takes the secrets out of its text."""
    found = secrets.find(docs, keep=tuple(c for c in docs.columns if c not in ("text", "n_chars")), redact=True)
    return found.select(*[F.col("redacted").alias(c) if c == "text" else F.length("redacted").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the length in characters of what they decode to."""
    return bpe.encode(docs, VOCABULARY, keep=("doc_id", "lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids", F.length("decoded").cast("long").alias("n_decoded"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("secret scan", redact_secrets), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, fitted models and token ids can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
