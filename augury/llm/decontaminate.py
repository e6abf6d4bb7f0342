"""Benchmark decontamination by greedy string tiling.

Token n-grams that a document shares with a test item, found by Karp-Rabin hashes, seed the match. Seeds on one diagonal join to maximal matches; the longest
unmarked match is marked, again and again, until none of ``min_match`` tokens is left. The share of the item's tokens under marks is its coverage; as tiles may lie in any
order, reordered passages count in full. Pairs of ``coverage`` or more come out.

The test items are a stated query set: they go to the tasks in blocks of at most ``block_bytes`` of text, each block a pass over all documents. Blocks run one after the other and their results are
stored, so neither the driver nor a task holds more than one. Tokens are runs of word characters, in lower case.

Defined results: null or empty texts and items match nothing; items shorter than ``min_match`` tokens are matched whole; repeated rows give repeated pairs; items with equal
texts are each reported; null ids are reported as null; of equal matches the earlier one in the item is marked first; columns of other names are not read, and ``item_key`` and ``key`` may not be the
same name; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, stored, texts

#: Beyond so many seeds of a text and an item, their matches are found without listing them.
MOST_SEEDS = 1 << 16
TOKEN = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(t: str | None) -> list[str]:
    return TOKEN.findall((t or "").lower())


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``n`` ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * BASE + ids[i : len(ids) - n + 1 + i].astype(np.uint64)
    return h


def joined(seeds: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """(-length, place in item, diagonal) of the maximal matches out of all (doc, item) places that share ``n`` tokens."""
    runs: dict[int, list[int]] = {}
    for d, p in sorted(seeds):
        runs.setdefault(d - p, []).append(p)
    out = []
    for diagonal, ps in runs.items():
        start = last = ps[0]
        for p in [*ps[1:], None]:
            if p is None or p > last + 1:
                out.append((-(last - start + n), start, diagonal))
                start = p
            last = p
    return out


def scanned(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """The same matches, diagonal by diagonal: for texts that repeat themselves so much that their seeds are far more than their matches. Memory follows doc and item, not their product."""
    out = []
    for diagonal in range(n - len(item), len(doc) - n + 1):
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (doc[lo + diagonal : hi + diagonal] == item[lo:hi]).view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= n:
                out.append((a - b, lo + a, diagonal))
    return out


def tiles(doc: np.ndarray, item: np.ndarray, matches: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of greedy tiles out of maximal ``matches``; among equal lengths the earlier place in the item goes first, then the smaller diagonal."""
    heap = list(matches)
    heapq.heapify(heap)
    used_p, used_d, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        size, p, diagonal = heapq.heappop(heap)
        size = -size
        busy = used_p[p : p + size] | used_d[p + diagonal : p + diagonal + size]
        if not busy.any():
            used_p[p : p + size] = used_d[p + diagonal : p + diagonal + size] = True
            out.append((p, p + diagonal, size))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([1], busy, [1]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what an earlier tile left free
            if b - a >= n:
                heapq.heappush(heap, (-(b - a), p + a, diagonal))
    return sorted(out)


class Items:
    """One block of test items with their seed table."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], np.int64)
            if not len(ids):
                continue
            n = min(min_match, len(ids))
            for p, h in enumerate(rolled(ids, n).tolist()):
                places.setdefault(n, {}).setdefault(h, []).append((len(self.items), p))
            self.items.append((item_id, ids, n))
        self.places = {n: (np.array(sorted(t), np.uint64), t) for n, t in places.items()}

    def matches(self, text: str, coverage: float) -> list[tuple[int, float, str]]:
        """(item id, coverage, tiles) of every item that the text covers enough of."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens(text)], np.int64)
        at_doc: dict[int, list[tuple[np.ndarray, list[int]]]] = {}  # by item: (places in the text, places in the item) of each seed that both have
        for n, (hashes, places) in self.places.items():
            h = rolled(ids, n)
            if not len(h):
                continue
            at = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == h)
            order = hit[np.argsort(h[hit], kind="stable")]
            cut = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1], [True]))) if len(order) else []
            for x, y in zip(cut[:-1], cut[1:], strict=True) if len(order) else ():
                d, by_item = order[x:y], {}
                for i, p in places[int(h[d[0]])]:
                    by_item.setdefault(i, []).append(p)
                for i, ps in by_item.items():
                    at_doc.setdefault(i, []).append((d, ps))
        out = []
        for i, shared in at_doc.items():
            item_id, item, n = self.items[i]
            if sum(len(ps) for _, ps in shared) * n < coverage * len(item):
                continue  # its seeds can't cover enough
            if sum(len(d) * len(ps) for d, ps in shared) > MOST_SEEDS:
                found = scanned(ids, item, n)
            else:
                found = joined([(d, p) for ds, ps in shared for d in ds.tolist() for p in ps if (item[p : p + n] == ids[d : d + n]).all()], n)
            got = tiles(ids, item, found, n)
            share = sum(x[2] for x in got) / len(item)
            if share >= coverage:
                out.append((item_id, share, ",".join(f"{p}:{d}:{k}" for p, d, k in got)))
        return out


def contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", min_match: int = 5, coverage: float = 0.6, block_bytes: int = 8 << 20) -> DataFrame:
    """(key, item_key, coverage, tiles) of every document and test item with ``coverage`` or more; tiles: "place in item:place in document:tokens", comma-joined. An item that is repeated is matched once, and its pairs repeated.

    Items are taken in blocks of about ``block_bytes`` by a hash of id and text, one block at a time, each with a pass over the documents; a single longer item is a block of its own size."""
    if key == item_key:
        raise ValueError(f"documents and items both name their key {key}")
    items = items.groupBy(item_key, item_text).agg(F.count("*").alias("__times"))  # so that a block holds no more than its share, however often an item is repeated
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    schema = T.StructType([docs.schema[key], T.StructField(item_key, T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.StringType())])
    sent = T.StructType([*schema.fields, T.StructField("__times", T.LongType())])
    given = docs.select(key, docs[text].alias("__text"))

    def block(i: int) -> DataFrame:
        rows = [((r[0], r[2]), r[1]) for r in items.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(n_blocks)) == i).select(item_key, item_text, "__times").orderBy(item_key).collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = Items(rows, min_match)
            for b in small_batches(batches, "__text"):
                found = [(j, *m) for j, t in enumerate(texts(b, "__text")) for m in table.matches(t, coverage)]
                if found:
                    j, item, share, tile = zip(*found, strict=True)
                    ids, times = zip(*item, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(j)), pa.array(ids, pa.int64()), pa.array(share, pa.float64()), pa.array(tile, pa.string()), pa.array(times, pa.int64())], names=sent.names)

        repeated = F.explode(F.sequence(F.lit(1).cast("long"), "__times"))
        return given.mapInArrow(run, sent).select(*schema.names, repeated.alias("__i")).drop("__i")

    if n_blocks == 1:
        return block(0)
    return reduce(DataFrame.unionByName, [stored(block(i), "tiled") for i in range(n_blocks)])
