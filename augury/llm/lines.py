"""Line and passage dedup: normalise units, group their digests globally, keep the earliest ranked occurrence and remove the rest, with original offsets.

Units of a text are its lines, whatever their length, and, within lines of several sentences, passages: a sentence of ``passage_words`` words or more, else it and the
next one if they have as many together. So a passage pasted into the middle of a line is found by the sentences inside it, and short sentences that writers share don't go by
themselves. Units are compared by the 128-bit digest of their words, A-Z in lower case, one space between them.

Only digests are counted first (partial counts before the shuffle, so a line that a third of the rows hold costs one row per task); then the units of repeated digests, few of all,
are kept and ranked. Joins against them have one row per digest on their other side, and the adaptive planner splits their hot keys.

Defined results: null or empty text has no units; lines of white space are no units and stay; ranks go by key (null last), hash of the text and offset; of rows that repeat a key with its
text one keeps what it would keep alone, the others lose all their lines; an empty table gives an empty result; other columns pass through ``deduplicated`` only, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, stored

SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
UNIT = T.StructType([T.StructField(n, t) for n, t in (("d1", T.LongType()), ("d2", T.LongType()), ("s", T.IntegerType()), ("e", T.IntegerType()), ("words", T.IntegerType()), ("n_long", T.IntegerType()), ("whole", T.StringType()))])


def text_hash(text: Column) -> Column:
    """60 bits of the text's MD5; null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def units(text: str, passage_words: int) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each unit; a line's end includes its line break. Offsets are code points, ends exclusive."""
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if words:
            out.append((at, min(end + 1, len(text)), words))
            pieces = SENTENCE.findall(line)
            if len(words) >= passage_words and len(pieces) > 1:
                for i, piece in enumerate(pieces):
                    words = piece.encode("utf-8", "surrogatepass").lower().split()
                    if len(words) < passage_words and i + 1 < len(pieces):
                        piece = piece + pieces[i + 1]
                        words = piece.encode("utf-8", "surrogatepass").lower().split()
                    if len(words) >= passage_words:
                        out.append((at, at + len(piece), words))
                    at += len(pieces[i])
        at = end + 1
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Runs that sorted spans cover together; spans that touch are one run."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def joined(runs: list[list[int]]) -> str:
    return ",".join(f"{s}:{e}" for s, e in runs)


def digested(docs: DataFrame, *, text: str, key: str, passage_words: int) -> DataFrame:
    """A header per row (s = -1, e: code points, words: lines, n_long: units of ``passage_words`` words, whole: spans of all lines), then its units. ``__uid`` tells rows apart."""
    rows = docs.select(F.col(key).alias("__key"), text_hash(docs[text]).alias("__hash"), F.monotonically_increasing_id().alias("__uid"), docs[text].alias("__text"))
    schema = T.StructType([*rows.select("__key", "__hash", "__uid").schema.fields, *UNIT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for b in small_batches(batches, "__text", 1 << 20):
            at: list[int] = []
            out: list[tuple] = []
            for i, t in enumerate(b.column("__text").to_pylist()):
                found = units(t or "", passage_words)
                lines = [(s, e) for s, e, _ in found if s == 0 or t[s - 1] == "\n"]
                ends: dict[int, int] = {}
                for s, e in lines:  # a line is the longest unit that starts where it starts
                    ends[s] = max(e, ends.get(s, 0))
                at.append(i)
                out.append((None, None, -1, len(t or ""), len(ends), sum(len(w) >= passage_words for _, _, w in found), joined(merged(sorted(ends.items())))))
                for s, e, words in found:
                    d = digest(b" ".join(words))
                    at.append(i)
                    out.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), s, e, len(words), None, None))
            kept = pa.array(at, pa.int32())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(kept) for c in ("__key", "__hash", "__uid")), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def removed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", passage_words: int = 20) -> DataFrame:
    """A row per document: key, n_chars, n_lines, n_removed (units that an earlier one repeats), n_passages (runs covered by units of ``passage_words`` words or more that occur elsewhere too,
    kept or not), removed_chars, spans ("start:end" of the removed runs, comma-joined)."""
    return results(docs, text=text, key=key, passage_words=passage_words).select(F.col("__key").alias(key), *RESULT)


RESULT = ("n_chars", "n_lines", "n_removed", "n_passages", "removed_chars", "spans")


def results(docs: DataFrame, *, text: str, key: str, passage_words: int) -> DataFrame:
    """The columns of ``removed`` with __key, __hash and __again: whether the row repeats another one."""
    all_ = stored(digested(docs, text=text, key=key, passage_words=passage_words), "units")
    own = all_.where("s >= 0").select("__key", "__hash", "d1", "d2", "s", "e", "words")
    often = stored(own.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2"), "often")  # stored, so that the join's hot keys can be split
    held = stored(own.join(often, ["d1", "d2"], "left_semi"), "repeated")
    place = F.struct(F.col("__key").isNull().alias("z"), "__key", "__hash", "s")
    first = stored(held.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")), "first")
    marked = held.join(first, ["d1", "d2"]).select("__key", "__hash", "s", "e", "words", (place > F.col("first")).alias("gone"), (F.col("first") < F.col("last")).alias("elsewhere"))
    per = marked.groupBy("__key", "__hash").agg(F.collect_set(F.struct("s", "e", "words", "gone", "elsewhere")).alias("units"))
    heads = all_.where("s < 0").select("__key", "__hash", "__uid", F.col("e").cast("long").alias("n_chars"), F.col("words").cast("long").alias("n_lines"), "n_long", "whole")
    one = heads.groupBy("__key", "__hash").agg(F.min("__uid").alias("__first"), F.count("*").alias("__n"))
    same = lambda a, b: a["__key"].eqNullSafe(b["__key"]) & (a["__hash"] == b["__hash"])
    found = stored(one.alias("o").join(per.alias("p"), F.col("o.__key").eqNullSafe(F.col("p.__key")) & (F.col("o.__hash") == F.col("p.__hash")), "left").select("o.*", "units"), "found")
    rows = heads.join(found, same(heads, found)).select(heads["*"], "units", (heads["__uid"] != found["__first"]).alias("__again"), (found["__n"] > 1).alias("__many"))
    schema = T.StructType([*docs.select(F.col(key).alias("__key")).schema.fields, T.StructField("__hash", T.LongType()), T.StructField("__again", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in RESULT[:-1]], T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for again, many, n_long, whole, units_ in zip(*(b.column(c).to_pylist() for c in ("__again", "__many", "n_long", "whole", "units")), strict=True):
                us = sorted((u["s"], u["e"], u["words"], u["gone"], u["elsewhere"]) for u in units_ or ())
                long_ = merged([(s, e) for s, e, w, _, other in us if w >= passage_words and (other or many)])
                if again:
                    gone = [[int(x) for x in r.split(":")] for r in whole.split(",") if r]
                    n = len(us)
                else:
                    gone = merged([(s, e) for s, e, _, g, _ in us if g])
                    n = sum(g for *_, g, _ in us)
                out.append((n, len(long_), sum(e - s for s, e in gone), joined(gone)))
            if out:
                n, n_long, chars, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__key", "__hash", "__again", "n_chars", "n_lines")), *(pa.array(x, pa.int64()) for x in (n, n_long, chars)), pa.array(spans, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", passage_words: int = 20) -> DataFrame:
    """The input with its repeats taken out of ``text``; all other columns stay."""
    got = results(docs, text=text, key=key, passage_words=passage_words).select("__key", "__hash", "__again", "spans")
    one = got.groupBy("__key", "__hash").agg(F.min_by("spans", "__again").alias("__spans"), F.max_by("spans", "__again").alias("__more"))
    rows = docs.withColumns({"__hash": text_hash(docs[text]), "__uid": F.monotonically_increasing_id()})
    rows = stored(rows, "texts")
    first = rows.groupBy(F.col(key).alias("__key"), F.col("__hash").alias("__h")).agg(F.min("__uid").alias("__first"))
    both = one.join(first, F.col("__hash") == F.col("__h")).where(one["__key"].eqNullSafe(first["__key"])).select(one["__key"].alias("__k"), "__h", "__first", "__spans", "__more")
    rows = rows.join(both, rows[key].eqNullSafe(both["__k"]) & (rows["__hash"] == both["__h"]))
    rows = rows.withColumn("__spans", F.when(F.col("__uid") == F.col("__first"), F.col("__spans")).otherwise(F.col("__more")))
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text):
            out = []
            for t, spans in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist(), strict=True):
                parts, last = [], 0
                for r in (spans or "").split(",") if spans else ():
                    s, e = map(int, r.split(":"))
                    parts.append(t[last:s])
                    last = e
                out.append(t if t is None else "".join([*parts, t[last:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b.column(n) for n in schema.names], names=schema.names)

    return rows.select(*docs.columns, "__spans").mapInArrow(cut, schema)
