"""Exact substring dedup: remove every byte covered by a ``length``-byte string that also starts elsewhere.

The suffixes that can matter are found, range-partitioned by sampled splitters, sorted inside their buckets, and compared with their neighbours,
also across bucket boundaries. A full suffix array has one entry per byte; sending each with its leading bytes would move many times the input. So
three sorts share the work, each over the suffixes that the one before couldn't settle, and all are exact:

1. *Runs.* Each window has a least ``seed``-byte string (by hash, the leftmost of equals) among its first ``passage`` bytes, its anchor. Neighbouring windows with the same anchor form a run.
   Equal windows have equal anchors at equal distances. Runs are ranged and sorted by anchor, then by the hash of all their bytes. A run equal to a neighbour is
   repeated as a whole; one that shares only the anchor goes on; all others can't be repeated.
2. *Blocks.* The windows of such a run are cut, by their distance to the anchor, into blocks of 16. A block's entry has the leading bytes and the hash of the string that all of its
   windows hold, and the hash of all its bytes. Sorted by these, a block whose common string is alone holds no repeat, one whose bytes equal a neighbour's is repeated, and the rest goes on.
3. *Suffixes.* Every window start of the blocks left over is a suffix entry: its leading bytes, then the hash of all its bytes, the later keys of a multikey sort.
   The first and last entries of the buckets meet in a small further step.

All sorts end with the place, so a string with very many places is spread over several buckets. Strings count as equal if their anchors (or leading bytes and common strings) and a
polynomial hash modulo 2^64 of all their bytes agree, two hashes of 64 bits; no text is cut or sampled.

The same sorts also settle ``passage``-byte strings, of which ``n_passages`` reports the maximal runs with over ``passage_words`` words; they are reported, not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import dropped, small_batches, stored

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed yet."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """A text's prefix sums, from which the hash of any of its strings follows."""

    powers = Powers()

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = self.powers.to(n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sum[end] - self.sum[start]) * self.down[start])

    def all_of(self, length: int) -> np.ndarray:
        """Of every string of ``length`` bytes."""
        return mixed((self.sum[length:] - self.sum[: len(self.sum) - length]) * self.down[: len(self.sum) - length])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out


BLOCK = 16
C = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03)]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def counted(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Hashes with small numbers mixed in."""
    for c, x in zip(C, more, strict=False):
        h = h + c * x.astype(np.uint64)
    return signed(mixed(h))


def schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in text.split(", "))])


# Numbers of windows (n) come by length: a for ``passage``, b for ``length``. States: 0 settled as single, 1 repeated, 2 to be asked, 3 repeated and needed as a partner of others.
RUN = "k1 int, k2 long, p int, na int, nb int, d int, least long, ua long, ub long, done boolean, settled boolean"
FOUND = "k1 int, k2 long, p int, na int, nb int, d int, sa int, sb int"
BLOCKS = "lead int, common long, whole long, k1 int, k2 long, p int, n int, b boolean, own boolean"
HELD = "k1 int, k2 long, p int, n int, b boolean, state int, own boolean"
ENTRY = "lead int, whole long, k1 int, k2 long, p int, b boolean, own boolean"
MARKED = ENTRY + ", same boolean, edge boolean"


def rows_of(columns: str, *cols) -> pa.RecordBatch:
    s = schema(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, s, strict=True)], schema=s)


def pieces(batches: Iterator[pa.RecordBatch], least_bytes: int, overlap: int, most: int = 2 << 20) -> Iterator[list[tuple]]:
    """Groups of (bytes, k1, k2, offset) of about ``most`` bytes; a long text comes in several pieces that overlap."""
    group, size = [], 0
    for b in small_batches(batches, "data"):
        for d, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("data", "k1", "k2")), strict=True):
            for at in range(0, max(1, len(d) - least_bytes + 1), most) if len(d) >= least_bytes else ():
                group.append((d[at : at + most + overlap - 1], k1, k2, at))
                size += len(group[-1][0])
                if size >= most:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def runs_of(group: list[tuple], passage: int, length: int, seed: int, most: int = 2 << 20) -> pa.RecordBatch:
    """``RUN`` rows of a group of pieces. Runs that repeat another one of the group are settled at once; one of each kind stays to meet other groups'."""
    data = b"".join(g[0] for g in group)
    size = np.array([len(g[0]) for g in group])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    hashed = Hashed(data)
    grams = hashed.all_of(seed)
    mask = np.uint64((1 << 24) - 1)
    least = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), passage - seed + 1)
    windows = {n: np.minimum(np.maximum(size - n + 1, 0), most) for n in (passage, length)}
    p = np.concatenate([np.arange(s, s + n) for s, n in zip(start.tolist(), windows[passage].tolist(), strict=True)])
    anchor = (least[p] & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    na = np.diff(np.concatenate((first, [len(p)])))
    p, anchor = p[first], anchor[first]
    piece = np.searchsorted(start, p, "right") - 1
    nb = np.clip(start[piece] + windows[length][piece] - p, 0, na)
    ua = counted(hashed.of(p, p + na - 1 + passage), na)
    ub = np.where(nb > 0, counted(hashed.of(p, np.where(nb > 0, p + nb - 1 + length, p)), nb), 0)
    key = signed(grams[anchor])
    order = np.lexsort((ub, ua, key))
    again = np.zeros(len(p), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (ua[order][1:] == ua[order][:-1]) & (ub[order][1:] == ub[order][:-1])
    done = again.copy()
    done[:-1] |= again[1:]
    settled, is_done = np.empty(len(p), bool), np.empty(len(p), bool)
    settled[order], is_done[order] = again, done
    k1, k2, base = (np.array([g[i] for g in group]) for i in (1, 2, 3))
    zero = lambda x: np.where(settled, 0, x)
    return rows_of(RUN, k1[piece], k2[piece], p - start[piece] + base[piece], na, nb, anchor - p, zero(key), zero(ua), zero(ub), is_done, settled)


def numpy_of(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of sorted rows: each batch's columns by name, with the row before and the row after it, None at the partition's ends."""
    before = held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = dict(zip(b.schema.names, numpy_of(b), strict=True))
        if held is not None:
            yield held, before, {n: c[:1] for n, c in cols.items()}
            before = {n: c[-1:] for n, c in held.items()}
        held = cols
    if held is not None:
        yield held, before, None


def beside(name: str, rows: dict, before, after, unknown: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row's value equals the one before and the one after; ``unknown`` at the ends of the partition."""
    x = rows[name]
    prev, nxt = np.empty(len(x), bool), np.empty(len(x), bool)
    prev[1:] = nxt[:-1] = x[1:] == x[:-1]
    prev[0] = unknown if before is None else before[name][0] == x[0]
    nxt[-1] = unknown if after is None else after[name][0] == x[-1]
    return prev, nxt


def states(near: tuple, equal: tuple, known: np.ndarray) -> np.ndarray:
    """A state for each row from whether its neighbours may share a window with it (``near``) and whether they are ``equal`` to it; ``known``: repeated anyway."""
    same = equal[0] | equal[1] | known
    edge = (~equal[0] & near[0]) | (~equal[1] & near[1])
    return np.where(same, np.where(edge, 3, 1), np.where(near[0] | near[1], 2, 0)).astype(np.int32)


def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, before, after in with_neighbours(batches):
        near, a, b = beside("least", rows, before, after, True), beside("ua", rows, before, after, False), beside("ub", rows, before, after, False)
        a = (a[0] & near[0], a[1] & near[1])
        b = (b[0] & a[0], b[1] & a[1])
        sa, sb = states(near, a, rows["done"]), np.where(rows["nb"] > 0, states(near, b, rows["done"]), 0)
        at = (sa > 0) | (sb > 0)
        if at.any():
            yield rows_of(FOUND, *(rows[c][at] for c in ("k1", "k2", "p", "na", "nb", "d")), sa[at], sb[at])


def lists(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Offsets of a column of lists of structs, and the structs' fields."""
    flat = column.flatten()
    cut = np.concatenate(([0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))).tolist()
    return cut, [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def leading(octets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The four bytes from each place, as a number of their order."""
    return sum(octets[at + i].astype(np.int64) << (24 - 8 * i) for i in range(4)).astype(np.int64) - (1 << 31)


def blocks(batches: Iterator[pa.RecordBatch], passage: int, length: int) -> Iterator[pa.RecordBatch]:
    """``BLOCKS`` rows of texts (data, k1, k2, wanted: p, na, nb, d, sa, sb)."""
    for batch in small_batches(batches, "data"):
        cut, (p, na, nb, d, sa, sb) = lists(batch.column("wanted"))
        for i, (text, k1, k2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("data", "k1", "k2")), strict=True)):
            hashed, octets, own = Hashed(text), np.frombuffer(text, np.uint8), slice(cut[i], cut[i + 1])
            for size, n, state, is_b in ((passage, na, sa, False), (length, nb, sb, True)):
                at = np.flatnonzero(state[own] >= 2) + cut[i]
                for lo in range(0, len(at), 1 << 14):
                    x = at[lo : lo + (1 << 14)]
                    first, last = d[x] // BLOCK, (d[x] - n[x] + 1) // BLOCK  # distances to the anchor fall along the run
                    many = first - last + 1
                    x = np.repeat(x, many)
                    j = np.repeat(first, many) - (np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many))
                    far, close = np.minimum(j * BLOCK + BLOCK - 1, d[x]), np.maximum(j * BLOCK, d[x] - n[x] + 1)
                    anchor = p[x].astype(np.int64) + d[x]
                    start = anchor - j * BLOCK
                    common = counted(hashed.of(start, start - BLOCK + 1 + size), j, np.full(len(j), int(is_b)))
                    whole = counted(hashed.of(anchor - far, anchor - close + size), far - close, close - j * BLOCK)
                    yield rows_of(BLOCKS, leading(octets, start), common, whole, np.full(len(x), k1), np.full(len(x), k2), anchor - far, far - close + 1, np.full(len(x), is_b), state[x] == 2)


def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, before, after in with_neighbours(batches):
        lead, near, equal = beside("lead", rows, before, after, True), beside("common", rows, before, after, True), beside("whole", rows, before, after, False)
        near = (near[0] & lead[0], near[1] & lead[1])
        equal = (equal[0] & near[0], equal[1] & near[1])
        state = states(near, equal, ~rows["own"])
        at = np.where(rows["own"], state > 0, state > 1)
        if at.any():
            yield rows_of(HELD, *(rows[c][at] for c in ("k1", "k2", "p", "n", "b")), state[at], rows["own"][at])


def entries(batches: Iterator[pa.RecordBatch], passage: int, length: int) -> Iterator[pa.RecordBatch]:
    """``ENTRY`` rows of texts (data, k1, k2, wanted: p, n, b, own)."""
    for batch in small_batches(batches, "data"):
        cut, (p, n, b, own) = lists(batch.column("wanted"))
        for i, (text, k1, k2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("data", "k1", "k2")), strict=True)):
            hashed, octets = Hashed(text), np.frombuffer(text, np.uint8)
            for size, is_b in ((passage, False), (length, True)):
                x = np.flatnonzero(b[cut[i] : cut[i + 1]] == is_b) + cut[i]
                for lo in range(0, len(x), 1 << 13):
                    y = x[lo : lo + (1 << 13)]
                    z = np.repeat(y, n[y])
                    q = p[z].astype(np.int64) + np.arange(len(z)) - np.repeat(np.cumsum(n[y]) - n[y], n[y])
                    yield rows_of(ENTRY, leading(octets, q), counted(hashed.of(q, q + size), np.full(len(q), int(is_b))), np.full(len(q), k1), np.full(len(q), k2), q, np.full(len(q), is_b), own[z])


def sort_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, before, after in with_neighbours(batches):
        a, b = beside("lead", rows, before, after, False), beside("whole", rows, before, after, False)
        equal = (a[0] & b[0]) | (a[1] & b[1])
        edge = np.zeros(len(equal), bool)
        edge[0] |= before is None
        edge[-1] |= after is None
        at = (equal & rows["own"]) | edge
        if at.any():
            yield rows_of(MARKED, *(c[at] for c in rows.values()), equal[at], edge[at])


def covered(p: np.ndarray, n: np.ndarray, size: int, total: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that ``n`` strings of ``size`` bytes from each ``p`` on cover together."""
    if not len(p):
        return [], []
    order = np.argsort(p, kind="stable")
    s, e = p[order].astype(np.int64), np.maximum.accumulate(p[order].astype(np.int64) + n[order] - 1 + size)
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new].tolist(), np.minimum(e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))], total).tolist()


def removal(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = 400, passage: int = 240, passage_words: int = 50, seed: int = 80, keep_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passages[, kept]) of every row. ``spans``: "start:end" of removed runs, in bytes of the input, comma-joined.
    ``n_passages``: maximal runs of bytes covered by repeated strings of ``passage`` bytes that hold over ``passage_words`` words.

    Null text counts as empty. Texts under ``length`` bytes lose nothing. Rows that are the same in key and text are separate places, so they are repeats of
    each other. Rows with a null key take part and come back with it. Columns other than key and text are not read. An empty table gives an empty result.
    """
    if not BLOCK < seed <= passage <= length:
        raise ValueError(f"{BLOCK} < seed <= passage <= length is needed")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = docs.select(F.col(key), data.alias("data"), F.hash(key, text).alias("k1"), F.xxhash64(text, key).alias("k2"))
    long_ = rows.where(F.length("data") >= passage).select("data", "k1", "k2")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in pieces(batches, passage, length):
            yield runs_of(group, passage, length, seed)

    def sorted_by(df: DataFrame, *by: str) -> DataFrame:
        return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    runs = stored(long_.mapInArrow(find, RUN), "runs")
    settled = runs.where("settled").select("k1", "k2", "p", "na", "nb", "d", F.lit(1).alias("sa"), F.when(F.col("nb") > 0, 1).otherwise(0).alias("sb"))
    asked = runs.where("not settled").drop("settled")
    found = stored(sorted_by(asked, "least", "ua", "ub", "k1", "p").mapInArrow(sort_runs, FOUND).unionByName(settled), "found")
    dropped(runs)
    # What joins texts is stored first, so that the joins' hot keys (rows that repeat each other) can be split.
    wanted = stored(found.where("sa > 1 or sb > 1").groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "na", "nb", "d", "sa", "sb")).alias("wanted")), "wanted")
    cut_up = stored(long_.join(wanted, ["k1", "k2"]).mapInArrow(lambda b: blocks(b, passage, length), BLOCKS), "blocks")
    held = stored(sorted_by(cut_up, "lead", "common", "whole", "k1", "p").mapInArrow(sort_blocks, HELD), "held")
    dropped(cut_up)
    wanted = stored(held.where("state > 1").groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "n", "b", (F.col("state") == 2).alias("own"))).alias("wanted")), "wanted")
    suffixes = stored(long_.join(wanted, ["k1", "k2"]).mapInArrow(lambda b: entries(b, passage, length), ENTRY), "suffixes")
    marked = stored(sorted_by(suffixes, "lead", "whole", "k1", "p").mapInArrow(sort_entries, MARKED), "marked")
    dropped(suffixes)
    edges = marked.where("edge")  # two rows a bucket at most
    meets = edges.groupBy("lead", "whole").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hits = marked.where("own and same").select("k1", "k2", "p", "b").unionByName(edges.where("own and not same").join(meets, ["lead", "whole"]).select("k1", "k2", "p", "b"))
    spans = [found.where(F.col(s).isin(1, 3)).select("k1", "k2", "p", F.col(n).alias("n"), F.lit(b).alias("b")) for s, n, b in (("sa", "na", False), ("sb", "nb", True))]
    spans += [held.where("own and state in (1, 3)").select("k1", "k2", "p", "n", "b"), hits.select("k1", "k2", "p", F.lit(1).alias("n"), "b")]
    per_doc = stored(reduce(DataFrame.unionByName, spans).groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "n", "b")).alias("wanted")), "spans")
    out_schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_passages", T.LongType())] + [T.StructField("kept", T.BinaryType())] * keep_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data"):
            out: list[tuple] = []
            at, (p, n, b) = lists(batch.column("wanted"))
            for i, d in enumerate(batch.column("data").to_pylist()):
                own = slice(at[i], at[i + 1])
                is_b = b[own].astype(bool)
                start, end = covered(p[own][is_b], n[own][is_b], length, len(d))
                n_passages = sum(len(d[s:e].split()) > passage_words for s, e in zip(*covered(p[own][~is_b], n[own][~is_b], passage, len(d)), strict=True))
                kept, last = [], 0
                for s, e in zip(start, end, strict=True):
                    kept.append(d[last:s])
                    last = e
                kept = b"".join([*kept, d[last:]])
                out.append((len(d), len(d) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), ",".join(f"{s}:{e}" for s, e in zip(start, end, strict=True)), n_passages, *([kept] if keep_text else [])))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(x) for x in zip(*out, strict=True)]], names=out_schema.names)

    return rows.join(per_doc, ["k1", "k2"], "left").select(key, "data", "wanted").mapInArrow(cut, out_schema)
