"""Phrase collocation mining: level-wise counting with bucket bitmaps (PCY/DHP) and Apriori pruning, then scores of the phrases that are frequent.

Texts are lower-cased in ASCII and cut into pieces and words. Pass k counts the k-word phrases of each language exactly, and adds every (k+1)-word phrase whose two halves of k words survive to one of
2^bits buckets, by hash. A position enters pass k only if both its (k-1)-word parts are frequent and its bucket holds ``least`` or more; what is left is counted exactly. Frequent parts are looked up by hash in a bitmap
too, made of the exact counts of the pass before, so that both things sent to the tasks are bitmaps of 2^bits bits (8 MB), whatever the corpus holds. Collisions only let more phrases
be counted. On corpora with far more pairs than buckets, raise ``bits``: results don't change, the second pass then counts fewer phrases.

Tasks count in their own dictionaries, emptied at ``held`` entries, before anything is shuffled, so a frequent word costs a task one row. Bucket counts stop at ``least`` and travel as the places and counts
of the buckets in use, 32,768 buckets to a row. Parts, containers and cuts of the frequent phrases meet by equality joins.

Defined results: null and empty texts hold no words; a null language is ``und``; repeated rows all count; other columns are not read; an empty table gives an empty result; phrases never cross pieces or
documents; ties go by the stated order, so the result is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from augury.llm.common import dropped, small_batches, stored

STEP, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Ends of pieces become line ends, tabs spaces.
CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
BLOCK = 1 << 15


def narrow(least: int) -> type:
    """Type of a bucket count that stops at ``least``."""
    return np.uint8 if least < 256 else np.int64


class Words(dict):
    """Numbers of the words of one language in a task, from 2 on; 0 ends a piece, 1 is nothing."""

    def __init__(self, lang: str, names: list[bytes], hashes: list[int]):
        super().__init__({b"\n": 0, b"": 1})
        self.lang, self.names, self.hashes = lang.encode() + b"\x00", names, hashes

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(self.lang + word))
        return at


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each rolling hash."""
    h = (h ^ (h >> np.uint64(32))) * LAST
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on."""
    h = words[: max(0, len(words) - k + 1)]
    for j in range(1, k):
        h = h * STEP + words[j : len(h) + j]
    return h


def phrase_hash(lang: str, phrase: bytes) -> np.ndarray:
    """The rolling hash of a whole phrase, words joined by spaces."""
    words = np.array([xxhash.xxh64_intdigest(lang.encode() + b"\x00" + w) for w in phrase.split(b" ")], np.uint64)
    return rolling(words, len(words))


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def alive(ids: np.ndarray, words: np.ndarray, k: int, bits: int, frequent: np.ndarray | None, bucket: np.ndarray | None) -> np.ndarray:
    """For each place: may a frequent phrase of k words begin here?"""
    n = max(0, len(ids) - k + 1)
    ok = np.ones(n, bool)
    for j in range(k):
        ok &= ids[j : n + j] > 0
    if frequent is not None and n:
        part = has(frequent, buckets(rolling(words, k - 1), bits))
        ok &= part[:n] & part[1 : n + 1] & has(bucket, buckets(rolling(words, k), bits))
    return ok


def blocks_of(sorted_places: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(block, slice) of each run of places that lie in one block."""
    block = sorted_places >> 15
    edge = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(block[a]), slice(a, b)


def counted(docs: DataFrame, k: int, bits: int, least: int, held: int, frequent: np.ndarray | None, bucket: np.ndarray | None, longest: int) -> DataFrame:
    """One pass: rows (lang, phrase, n) with the counts of k-word phrases a task has met, and (block, counts) with bucket counts of phrases one longer; in the first pass a null phrase holds all words."""
    sc = docs.sparkSession.sparkContext
    sent = None if frequent is None else sc.broadcast((frequent, bucket))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def rows(lang: list[str], phrase: list[str | None], n: list[int]) -> pa.RecordBatch:
        none = pa.nulls(len(n))
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)

    def flushed(counts: dict[tuple[str, bytes], int]) -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        counts.clear()
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield rows([x[0][0] for x in part], [x[0][1].decode() for x in part], [x[1] for x in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_bucket = sent.value if sent else (None, None)
        counts: dict[tuple[str, bytes], int] = {}
        total: dict[str, int] = {}
        tally = np.zeros(1 << bits, narrow(least)) if k < longest else None
        words: dict[str, tuple[Words, list[bytes], list[int]]] = {}
        for b in small_batches(batches, "text"):
            by_lang: dict[str, list[bytes]] = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t:
                    by_lang.setdefault(lang, []).append(t)
            for lang, texts in by_lang.items():
                if lang not in words or len(words[lang][1]) > held:
                    names, hashes = [b"\n", b""], [0, 0]
                    words[lang] = Words(lang, names, hashes), names, hashes
                known_words, names, hashes = words[lang]
                whole = b"\n".join(texts).lower().translate(CUT).replace(b"\n", b" \n ")
                ids = np.fromiter(map(known_words.__getitem__, whole.split(b" ")), np.int64)
                ids = ids[ids != 1]
                if k == 1:
                    total[lang] = total.get(lang, 0) + int(np.count_nonzero(ids))
                h = np.array(hashes, np.uint64)[ids]
                ok = alive(ids, h, k, bits, known, of_bucket)
                at = np.flatnonzero(ok)
                if len(at):
                    wide = len(names)
                    key = ids[at]
                    for j in range(1, k):  # numbers of the first j words stay dense, so that no key passes 64 bits
                        key = (np.unique(key, return_inverse=True)[1] if j > 1 else key) * wide + ids[at + j]
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    for i, c in zip(at[first].tolist(), n.tolist(), strict=True):
                        phrase = (lang, b" ".join([names[x] for x in ids[i : i + k].tolist()]))
                        counts[phrase] = counts.get(phrase, 0) + c
                if tally is not None and len(ok) > 1:
                    met, n = np.unique(buckets(rolling(h, k + 1)[ok[:-1] & ok[1:]], bits), return_counts=True)
                    tally[met] = np.minimum(tally[met] + n, least)
                if len(counts) > held:
                    yield from flushed(counts)
        yield from flushed(counts)
        if total:
            yield rows(list(total), [None] * len(total), list(total.values()))
        if tally is not None:
            full = np.flatnonzero(tally)
            parts = list(blocks_of(full))
            for at in range(0, len(parts), 128):
                some = parts[at : at + 128]
                packed = [(full[x] & (BLOCK - 1)).astype(np.uint16).tobytes() + tally[full[x]].tobytes() for _, x in some]
                none = pa.nulls(len(some))
                yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([x for x, _ in some], pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "lang string, phrase string, n long, block int, counts binary")


def assembled(pieces: DataFrame, bits: int, join: Callable[[np.ndarray, bytes], np.ndarray], packed: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A bitmap of 2^bits out of (block, part) rows. The parts of a block meet in one task, one at a time; 2^bits / 32,768 rows at most come to the driver."""
    size = min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, np.zeros(size, np.int64)
        done: list[tuple[int, bytes]] = []
        for b in batches:
            for at, part in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), strict=True):
                if at != block and block is not None:
                    done.append((block, packed(held).tobytes()))
                    held = np.zeros(size, np.int64)
                block, held = at, join(held, part)
        if block is not None:
            done.append((block, packed(held).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], names=["block", "bitmap"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bitmap binary").collect():
        out[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def full_buckets(raw: DataFrame, bits: int, least: int) -> np.ndarray:
    """Bitmap of the buckets whose counts over all tasks reach ``least``."""
    wide = 2 + np.dtype(narrow(least)).itemsize

    def add(held: np.ndarray, part: bytes) -> np.ndarray:
        n = len(part) // wide
        held[np.frombuffer(part, np.uint16, n)] += np.frombuffer(part, narrow(least), n, 2 * n)
        return held

    return assembled(raw.where("block is not null").select("block", F.col("counts").alias("part")), bits, add, lambda held: np.packbits(held >= least, bitorder="little"))


def of_phrases(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the hashes of the phrases themselves."""
    size = min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                held[int(buckets(phrase_hash(lang, phrase.encode()), bits)[0])] = True
        held = held.reshape(-1, size)
        blocks = np.flatnonzero(held.any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([np.packbits(held[x], bitorder="little").tobytes() for x in blocks], pa.binary())], names=["block", "part"])

    parts = frequent.select("lang", "phrase").mapInArrow(run, "block int, part binary")
    return assembled(parts, bits, lambda held, part: held | np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little"), lambda held: np.packbits(held > 0, bitorder="little"))


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, bits: int = 26, held: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, n) of all phrases of 1 to ``longest`` words with n >= ``least``, (lang, n) of all word occurrences), both stored."""
    rows = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("text"))
    known = bucket = total = None
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        raw = stored(counted(rows, k, bits, least, held, known, bucket, longest), f"phrases-{k}-counted")
        sums = raw.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            total = stored(sums.where("phrase is null").select("lang", "n"), "phrases-total")
        found.append(stored(sums.where((F.col("n") >= least) & F.col("phrase").isNotNull()).select("lang", F.lit(k).alias("words"), "phrase", "n"), f"phrases-{k}"))
        if k < longest:
            known, bucket = of_phrases(found[-1], bits), full_buckets(raw, bits, least)
        dropped(raw)
    return reduce(DataFrame.unionByName, found), total


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, bits: int = 26) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    The score is the least, over the cuts of a phrase in two, of floor(2000000 a / (l + r)), a its count, l and r those of the parts. A phrase of which
    ``covered`` percent or more lie inside one longer frequent phrase (100 f(longer) >= ``covered`` a) is left out.
    """
    counts, total = frequent(docs, text=text, lang=lang, least=least, longest=longest, bits=bits)
    phrase = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", F.col(start), F.col(size)), " ")
    cuts = phrase.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"one": F.lit(1), "next": F.col("cut") + 1, "rest": F.col("words") - F.col("cut")})
    cuts = cuts.select("lang", "phrase", "a", "cut", part("one", "cut").alias("left"), part("next", "rest").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    inner = phrase.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", part("start", "size").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(wide("longer") * 100 < wide("a") * covered, F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
