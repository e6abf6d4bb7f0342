"""SimHash near-duplicate linking with pivot distance tables.

``fingerprints`` gives every document a SimHash of its word shingles. ``link`` finds, among the distinct fingerprints, those that differ in at most
``max_distance`` bits, and returns every document's component.

Candidates meet under shared keys (below); within a key, each fingerprint's Hamming distances to a fixed set of reference fingerprints (the pivots)
are tabulated once. By the triangle inequality two fingerprints whose distances to any pivot differ by more than ``max_distance`` can't link: such
pairs are discarded by the maximum coordinate difference, and the survivors are verified by their true distance. The pivots alone leave a constant share of all
pairs in 64 dimensions (measured in the README), so they prune and the keys generate.

Keys: ``block_keys`` cuts 64 bits into ``max_distance + 3`` blocks and keys by every triple of blocks. Of these blocks at least three are equal within
``max_distance`` bits, so no link is lost. Stages that link by shingle similarity take ``shingle_keys`` instead, made with the fingerprint.

No pair list is emitted: a key's rows are searched by growing components (a found row leaves the rows still to be searched), and only one link
per joined row comes out. A key with more than ``dense_rows`` distinct fingerprints isn't gathered. With 64 bits its rows go by ``ball_links``:
each fingerprint meets all values within ``max_distance / 2`` bits of it, and two fingerprints link if they share such a value. That is exact and needs
only a minimum per value, which partial aggregates compute whatever the group's size. Wider fingerprints go by ``split_keys``: the key's rows are dealt
into parts, and every two parts of it meet under a key of their own, so all of the key's pairs are still searched and no task holds more than about ``dense_rows`` rows.

``similar`` links by the shingle sets themselves: fingerprints only find candidates, within a wider distance, and a pair links if the Jaccard similarity of its sets, computed
exactly, reaches ``least``. Of each candidate component first all members meet one of them (``leader``), a join that the adaptive planner splits; those too far from it meet each other
and the members that may link to them by the triangle inequality of Jaccard distance, in runs of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, stored, texts
from augury.llm.components import connected_components

SEED = 42
N_PIVOTS = 16
#: Odd multipliers that derive further hashes of a shingle from its first one.
MIX = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def pivots(bits: int, n: int = N_PIVOTS) -> np.ndarray:
    """(n, bits / 64) reference fingerprints, from a fixed seed."""
    return np.random.default_rng(11).integers(0, 2**64, (n, bits // 64), dtype=np.uint64, endpoint=False)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; A-Z in lower case, ASCII white space parts words. Fewer words: one run of all."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = (start + size)[words - 1 :]
    return np.array([h(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())], np.uint64)  # noqa: B905


def majority(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """The SimHash: bit i is set if it is set in over half the hashes; none: zero. Bits beyond 64 come from multiplied hashes."""
    n, per = len(hashes), bits // 64
    if not n:
        return np.zeros(per, np.uint64)
    count = np.zeros((bits // 8, 256), np.int64)
    at = (np.arange(bits // 8) * 256)[None, :]
    step = max(1, (1 << 21) // (bits // 8))
    for a in range(0, n, step):
        h = hashes[a : a + step]
        wide = h[:, None]
        if per > 1:
            wide = h[:, None] * MIX[None, : per - 1]
            wide = np.concatenate((h[:, None], wide ^ (wide >> np.uint64(32))), 1)
        octets = np.ascontiguousarray(wide).view(np.uint8).reshape(len(h), bits // 8)
        count += np.bincount((octets + at).ravel(), minlength=bits * 32).reshape(bits // 8, 256)
    set_ = count @ BIT_OF_BYTE
    return np.packbits((set_ * 2 > n).ravel(), bitorder="little").view(np.uint64)


def shingle_keys(hashes: np.ndarray, tables: int = 8) -> np.ndarray:
    """``tables`` keys, each of two smallest multiplied hashes: texts that share a share s of their shingles share a key with probability 1 - (1 - s^2)^tables."""
    if not len(hashes):
        return np.arange(tables, dtype=np.uint64)
    least = np.array([(hashes * m).min() for m in MIX[16 : 16 + 2 * tables]])
    return (least[:tables] * MIX[1] ^ least[tables:]) * MIX[2] + np.arange(tables, dtype=np.uint64)


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 4, bits: int = 64, tables: int = 0) -> DataFrame:
    """(key, fp: array of bits / 64 longs[, keys: array of ``tables`` longs]) of every row. Null or wordless text: fingerprint zero."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.ArrayType(T.LongType())), *([T.StructField("keys", T.ArrayType(T.LongType()))] if tables else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__text"):
            fps, keys = [], []
            for t in texts(b, "__text"):
                h = shingle_hashes(t, words)
                fps.append(majority(h, bits).view(np.int64))
                if tables:
                    keys.append(shingle_keys(h, tables).view(np.int64))
            out = [b.column(key), pa.array(fps, pa.list_(pa.int64()))] + ([pa.array(keys, pa.list_(pa.int64()))] if tables else [])
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(key, docs[text].alias("__text")).mapInArrow(run, schema)


def block_keys(fp: Column, max_distance: int, bits: int = 64) -> Column:
    """Keys of every triple out of ``max_distance + 3`` blocks: within ``max_distance`` differing bits one triple at least is equal."""
    n = max_distance + 3
    edges = [round(i * bits / n) for i in range(n + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(mask[a] | mask[b] | mask[c])))) for i, (a, b, c) in enumerate(combinations(range(n), 3))])


class KeySearch:
    """Links within runs of rows that share a key; rows come sorted by key."""

    def __init__(self, bits: int, max_distance: int, dense_rows: int):
        self.most, self.dense_rows, self.pivots = max_distance, dense_rows, pivots(bits)

    def table(self, fp: np.ndarray) -> np.ndarray:
        """(rows, pivots) Hamming distances."""
        return np.bitwise_count(fp[:, None, :] ^ self.pivots[None, :, :]).sum(2, dtype=np.int16)

    def near(self, fp: np.ndarray, table: np.ndarray, one: int, rest: np.ndarray) -> np.ndarray:
        """Of ``rest``, the rows within reach of row ``one``: pivot coordinates first, then the distance itself."""
        kept = rest[np.abs(table[rest] - table[one]).max(1, initial=0) <= self.most]
        return kept[np.bitwise_count(fp[kept] ^ fp[one]).sum(1, dtype=np.int64) <= self.most] if len(kept) else kept

    def pairs(self, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the row pairs (a, b) link."""
        ok = np.abs(self.table(fp[a]) - self.table(fp[b])).max(1, initial=0) <= self.most
        ok[ok] = np.bitwise_count(fp[a[ok]] ^ fp[b[ok]]).sum(1, dtype=np.int64) <= self.most
        return ok

    def grow(self, fp: np.ndarray) -> list[tuple[int, int]]:
        """One link per row that joins a component within the run."""
        table, rest, links = self.table(fp), np.arange(len(fp)), []
        while len(rest) > 1:
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                one = todo.pop()
                found = self.near(fp, table, one, rest)
                if len(found):
                    links += [(one, int(x)) for x in found]
                    todo += found.tolist()
                    rest = np.setdiff1d(rest, found, assume_unique=True)
        return links

    def links(self, key: np.ndarray, fp: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, dense) of whole runs; b is the key and dense is set for rows of runs that are too large to be searched here."""
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[self.pairs(fp, two, two + 1)] if len(two) else two
        a, b, dense = [id_[two]], [id_[two + 1]], [np.zeros(len(two), bool)]
        for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > self.dense_rows:
                a.append(id_[s : s + n])
                b.append(key[s : s + n])
                dense.append(np.ones(n, bool))
            elif got := self.grow(fp[s : s + n]):
                x = np.array(got) + s
                a.append(id_[x[:, 0]])
                b.append(id_[x[:, 1]])
                dense.append(np.zeros(len(x), bool))
        return np.concatenate(a), np.concatenate(b), np.concatenate(dense)


def set_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """One link per set that joins a component of sets (sorted, distinct, not empty) with Jaccard similarity ``least`` or more."""
    size = np.array([len(x) for x in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    rest, links, held = np.arange(1, len(sets)), [], np.zeros(len(values), np.int64)
    todo = [0]
    while len(rest):
        one = todo.pop()
        held[:] = 0
        held[place[start[one] : start[one] + size[one]]] = 1
        both = np.add.reduceat(held[place], start)[rest]
        near = both / (size[rest] + size[one] - both) >= least
        links += [(one, int(x)) for x in rest[near]]
        todo += rest[near].tolist()
        rest = rest[~near]
        if not todo and len(rest):
            todo, rest = [int(rest[0])], rest[1:]
    return links


def links_under_keys(rows: DataFrame, bits: int, max_distance: int, dense_rows: int, partitions: int | None = None) -> DataFrame:
    """``rows`` (id long >= 0, fp array<long>, keys array<long>) to (a, b, dense): one shuffle by key, a sort, and a search in each key's run."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_key = rows.select("id", "fp", F.explode("keys").alias("k")).repartition(n, "k").sortWithinPartitions("k", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = KeySearch(bits, max_distance, dense_rows)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held_rows, dense_key = 0, None
        none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)

        def out(a, b, dense):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dense, pa.bool_())], names=["a", "b", "dense"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, i = batch.column("k").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
            f = batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, bits // 64)
            if dense_key is not None:  # the rest of a run that was given up as too large
                n_same = int(np.searchsorted(k, dense_key, "right"))
                if n_same:
                    yield out(i[:n_same], k[:n_same], np.ones(n_same, bool))
                    k, f, i = k[n_same:], f[n_same:], i[n_same:]
                if not len(k):
                    continue
                dense_key = None
            held.append((k, f, i))
            held_rows += len(k)
            last = int(np.searchsorted(k, k[-1], "left"))
            if last or held[0][0][0] != k[-1]:  # all but the last run is whole
                k, f, i = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.searchsorted(k, k[-1], "left"))
                yield out(*search.links(k[:last], f[:last], i[:last]))
                held, held_rows = [(k[last:], f[last:], i[last:])], len(k) - last
            if held_rows > dense_rows:
                dense_key = held[0][0][0]
                for x, _, i in held:
                    yield out(i, x, np.ones(len(x), bool))
                held, held_rows = [], 0
        yield out(*(search.links(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else none))

    return by_key.mapInArrow(run, "a long, b long, dense boolean")


def split_keys(dense: DataFrame, distinct: DataFrame, dense_rows: int) -> DataFrame:
    """``dense`` (id, k) to (id, fp, keys): each key's rows dealt into parts of about ``dense_rows / 2`` by a hash of the id, a new key for every two parts."""
    parts = F.ceil(2 * F.col("n") / dense_rows).cast("int")
    sized = dense.join(dense.groupBy("k").agg(F.count("*").alias("n")), "k").withColumns({"parts": parts, "own": F.pmod(F.xxhash64("id", F.lit(3)), parts).cast("int")})
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("k", F.least("own", j), F.greatest("own", j)))
    return distinct.select("id", "fp").join(sized.select("id", other.alias("keys")), "id").select("id", "fp", "keys")


def ball_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """(id, fp with one long) to (a, b): ids that share a value within ``max_distance // 2`` bits, linked to that value's smallest id. For even ``max_distance`` exact:
    any two within it have such a value between them, and any two that share one are within it."""
    if max_distance % 2:
        raise ValueError("an even distance is needed here")
    flips = [0] + [sum(1 << b for b in c) for r in range(1, max_distance // 2 + 1) for c in combinations(range(64), r)]
    masks = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips])
    ball = fps.select("id", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")[0]))).alias("v"))
    least = ball.groupBy("v").agg(F.min("id").alias("b"), F.max("id").alias("m")).where("b <> m").drop("m")
    return ball.join(least, "v").select(F.col("id").alias("a"), "b").where("a <> b").distinct()


def candidate_edges(distinct: DataFrame, rows: DataFrame, bits: int, max_distance: int, dense_rows: int, balls: bool = False) -> DataFrame:
    """(a, b) links between the ids of ``distinct`` (id, fp) whose fingerprints are within ``max_distance`` under a key of ``rows`` (id, fp, keys)."""
    found = stored(links_under_keys(rows, bits, max_distance, dense_rows), "links")
    edges = found.where("not dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("id"), F.col("b").alias("k"))
    if dense.limit(1).count():
        if balls:
            more = ball_links(distinct.join(dense.select("id").distinct(), "id"), max_distance)
        else:
            more = links_under_keys(split_keys(dense, distinct, dense_rows), bits, max_distance, 1 << 40).select("a", "b")
        edges = edges.unionByName(more)
    return edges


def link(fps: DataFrame, *, key: str = "doc_id", bits: int = 64, max_distance: int = 4, dense_rows: int = 50_000) -> DataFrame:
    """(key, fp[, keys]) to (key, fp, component_id): the smallest key reachable over fingerprints within ``max_distance`` bits, itself included.

    Rows with equal fingerprints are one node from the start, and nodes are fingerprints, so rows that repeat a key link nothing by that. With no ``keys`` column the block keys of a 64-bit
    fingerprint are used (exact); with it, candidates are rows that share a key, and a fingerprint has the keys of all its rows. Rows with a null key take part: they link others, and their
    component is null only where no row of it has a key. An empty table gives an empty result.
    """
    fps = stored(fps, "fp")
    own = "keys" in fps.columns
    node = F.col("fp")[0] if bits == 64 else F.xxhash64("fp")
    distinct = stored(fps.groupBy("fp").agg(F.min(key).alias("least")).select("fp", node.alias("id"), "least"), "distinct")
    if own:
        rows = fps.select("fp", F.explode("keys").alias("k")).distinct().select(node.alias("id"), "fp", F.array("k").alias("keys"))
    else:
        rows = distinct.select("id", "fp", block_keys(F.col("fp")[0], max_distance, bits).alias("keys"))
    edges = candidate_edges(distinct, rows, bits, max_distance, dense_rows, bits == 64 and max_distance % 2 == 0 and not own)
    comp = connected_components(edges)
    of_fp = stored(distinct.join(comp.withColumnRenamed("node", "id"), "id", "left").select("fp", "least", F.coalesce("component", "id").alias("c")), "of_fp")
    least = of_fp.groupBy("c").agg(F.min("least").alias("component_id"))
    return fps.select(key, "fp").join(stored(of_fp.join(least, "c").select("fp", "component_id"), "least"), "fp").select(key, "fp", "component_id")


def shingle_sets(docs: DataFrame, *, text: str, keep: tuple[str, ...], words: int, bits: int = 0, tables: int = 0) -> DataFrame:
    """Columns ``keep`` with ``id``, a 64-bit digest of the set of distinct shingles, and with ``bits`` the set's fingerprint and keys, otherwise the sorted set as ``shingles``."""
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("id", long), *(T.StructField(c, longs) for c in (("fp", "keys") if bits else ("shingles",)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__text"):
            ids, out = [], []
            for t in texts(b, "__text"):
                h = np.unique(shingle_hashes(t, words))
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                out.append((majority(h, bits).view(np.int64), shingle_keys(h, tables).view(np.int64)) if bits else (h.view(np.int64),))
            columns = [pa.array(x, pa.list_(pa.int64())) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.array(ids, np.uint64).view(np.int64)), *columns], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def verified(members: DataFrame, least: float, run_shingles: int) -> DataFrame:
    """``members`` (component, id, shingles), a component's smallest id being its name, to links (a, b) that join just those whose sets reach ``least`` directly or by way of others."""
    leader = members.where("id = component").select("component", F.col("shingles").alias("__of"))
    both, size = F.size(F.array_intersect("shingles", "__of")), F.size("shingles")
    met = members.where("id <> component").join(leader, "component").select("component", "id", both.alias("both"), size.alias("n"), F.size("__of").alias("m"))
    met = stored(met.select("component", "id", "n", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("s")), "met")
    star = met.where(F.col("s") >= least).select(F.col("component").alias("a"), F.col("id").alias("b"))
    far = met.groupBy("component").agg(F.max(F.when(F.col("s") < least, F.col("s"))).alias("most")).where("most is not null")
    left = met.join(far, "component").where(F.col("s") <= F.col("most") + (1 - least) + 1e-9)  # nearer to the leader: too far from all that are not linked to it
    sizes = left.groupBy("component").agg(F.ceil(2 * F.sum("n") / run_shingles).cast("int").alias("parts"), F.count("*").alias("rows")).where("rows > 1")
    parts = F.when(F.col("parts") > 2, F.col("parts")).otherwise(1)
    left = left.join(sizes, "component").select("component", "id", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), "parts").cast("int"))
    left = left.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("component", F.least("own", j), F.greatest("own", j)))).alias("k"))
    left = members.select("id", "shingles").join(left, "id").select("k", "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def out():
            pairs = set_links(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for i, (k, id_) in enumerate(zip(batch.column("k").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                if k != key:
                    yield out()
                    key, ids, sets = k, [], []
                ids.append(id_)
                sets.append(batch.column("shingles")[i].values.to_numpy(zero_copy_only=False))
        yield out()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return star.unionByName(left.repartition(n, "k").sortWithinPartitions("k", "id").mapInArrow(run, "a long, b long"))


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, bits: int = 512, max_distance: int = 140, tables: int = 8, dense_rows: int = 50_000, run_shingles: int = 1 << 18) -> DataFrame:
    """(key, hash, first): each row's key and XXH64 of its text, and whether it is the first by both of its component, whose links are pairs of Jaccard similarity ``least`` or more.

    Rows with equal shingle sets, wordless ones among them, are one node. Null keys stay out. An empty table gives an empty result.
    """
    docs = docs.where(F.col(key).isNotNull()).select(key, F.coalesce(text, F.lit("")).alias(text)).withColumn("hash", F.xxhash64(text))
    rows = stored(shingle_sets(docs, text=text, keep=(key, "hash"), words=words, bits=bits, tables=tables), "sets")
    distinct = rows.groupBy("id").agg(F.min(F.struct("fp", "keys")).alias("x"), F.min(F.struct(key, "hash")).alias("y")).select("id", "x.fp", "x.keys", "y")
    candidates = connected_components(candidate_edges(distinct, distinct.select("id", "fp", "keys"), bits, max_distance, dense_rows))
    candidates = candidates.withColumnRenamed("node", "id").join(distinct.select("id", f"y.{key}", "y.hash"), "id").select(key, "hash", "component")
    members = docs.join(candidates, [key, "hash"]).select("component", text)
    members = stored(shingle_sets(members, text=text, keep=("component",), words=words).dropDuplicates(["id"]), "members")
    comp = connected_components(verified(members, least, run_shingles)).withColumnRenamed("node", "id")
    of = rows.select(key, "hash", "id").join(comp, "id", "left").select(key, "hash", F.coalesce("component", "id").alias("component"))
    first = of.groupBy("component").agg(F.min(F.struct(key, "hash")).alias("y"))
    return of.distinct().join(first, "component").select(key, "hash", (F.struct(key, "hash") == F.col("y")).alias("first"))
