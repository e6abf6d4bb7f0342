"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of identifiers that no pattern names.

Seeds (leftmost, non-overlapping, each kind for itself, failing matches dropped without a retry): ``email``; ``ip`` four dotted numbers of at most 255; ``card`` 12 to 19 digits that pass Luhn; ``phone`` a
plus sign and 9 to 15 digits.

Bootstrap: an item is a seed span or a candidate, which is a run of text of 5 to 64 characters that holds five digits or more, most of it digits, or an at sign, and touches no seed. Every item lies in three
lexical contexts: two words before, one before and one after, two after (ASCII letters lowered, digits blanked). Distinct (context, value) pairs form a graph. In each round a context's
confidence for a kind is the sum of its values' scores for that kind over its number of values plus ``prior``; values of other kinds count against it, so a context that takes any kind earns none. Contexts of ``least``
confidence and five values' worth of score are promoted, and a candidate scores 1 - product(1 - confidence) over its promoted contexts. After ``rounds`` rounds candidates of score ``accept``
or more are identifiers of the kind with the best score, wherever in the corpus they stand. They are listed as ``like_<kind>``.

One pass over the texts stores, per row, its seeds and items without the text; all else runs over that table. Contexts and values are 64-bit hashes, so that two that agree count as one.

Defined results: null or empty text: nothing found; repeated rows alike (values count once in the graph); null ids are kept; other columns are read only by ``keep``, whatever their names but for those of the result; an empty
table gives an empty result; a score that ties between kinds goes to the kind listed first. Offsets are code points, ends exclusive. Work on a text is linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import dropped, small_batches, stored, texts

# The patterns, and the kinds in the order that spans are listed in. Possessive forms and the look-behind spare retries that could not match either.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEEDS = ("email", "ip", "card", "phone")
KINDS = SEEDS + tuple(f"like_{k}" for k in SEEDS)
MARK = re.compile(r"[0-9@]+")
WORD = re.compile(r"\S+")
MORE = re.compile(r"\x20[0-9(]\S*")
TRIM = "\"'()[]{}<>,.;:!?*#|&$%="
LOWER = {c: c + 32 for c in range(65, 91)}
BLANK = LOWER | {c: 48 for c in range(48, 58)}


def luhn(digits: str) -> bool:
    """The check sum of card numbers: every second digit from the right doubled, its digits added."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def seeds(t: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the patterns' spans in order."""
    found: list[tuple[int, int, int]] = []
    at, free = t.find("@"), 0
    while at >= 0:
        a = at
        while a > free and t[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            found.append((a, 0, m.end()))
            free = m.end()
        at = t.find("@", max(at + 1, free))
    if MARK.search(t):
        if t.count(".") > 2:
            found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(t) if "+" in t else ():
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(t: str, taken: list[tuple[int, int, int]], longest: int = 64) -> list[tuple[int, int]]:
    """(start, end) of what may be an identifier and touches no span of ``taken``: a word, or words of digits and brackets with single spaces between them."""
    out: list[tuple[int, int]] = []
    cover: list[list[int]] = []
    for a, b in sorted((a, b) for a, _, b in taken):
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(b, cover[-1][1])
        else:
            cover.append([a, b])
    last, i = 0, 0
    for m in MARK.finditer(t):
        if m.start() < last:
            continue
        a = m.start()
        while a > last and m.start() - a <= longest and not t[a - 1].isspace():
            a -= 1
        b = WORD.match(t, m.start()).end()
        while b - a <= longest and (go := MORE.match(t, b)) and t[b - 1] in "0123456789)":
            b = go.end()
        last = b
        while a < b and t[a] in TRIM and not (t[a] == "(" and ")" in t[a:b]):
            a += 1
        while b > a and t[b - 1] in TRIM:
            b -= 1
        if not 5 <= b - a <= longest:
            continue
        digits = sum(c in "0123456789" for c in t[a:b])
        if not (digits >= 5 and 2 * digits > b - a or "@" in t[a + 1 : b - 1]):
            continue
        while i < len(cover) and cover[i][1] <= a:
            i += 1
        if i == len(cover) or cover[i][0] >= b:
            out.append((a, b))
    return out


def hashed(s: str) -> int:
    """64 bits of a string, signed, as Spark's long holds them."""
    return int.from_bytes(xxhash.xxh64_digest(s.encode("utf-8", "surrogatepass")), "big", signed=True)


def contexts(t: str, a: int, b: int) -> list[int]:
    """Hashes of the three contexts of a span; a side with too few words within 80 characters gives none."""
    before = [w.strip(TRIM).translate(BLANK) for w in t[max(0, a - 80) : a].split()][-2:]
    after = [w.strip(TRIM).translate(BLANK) for w in t[b : b + 80].split()][:2]
    out = []
    for place, words in (("two before", before), ("around", before[-1:] + after[:1]), ("two after", after)):
        if len(words) == 2 and all(words):
            out.append(hashed(" ".join((place, *words))))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


ITEM = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("seed", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("contexts", T.ArrayType(T.LongType()))])


def scanned(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep``, the seeds' counts, digest and spans of each row, and its items, stored with a row number."""
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"n_{k}", long) for k in SEEDS] + [T.StructField("base_sha256", string), T.StructField("base", string), T.StructField("items", T.ArrayType(ITEM))])
    item = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("seed", pa.int32()), ("value", pa.int64()), ("contexts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__text"):
            counts, digest, base, items = [[] for _ in SEEDS], [], [], []
            for t in texts(b, "__text"):
                found = seeds(t)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in found))
                spans = joined(found)
                base.append(spans)
                digest.append(hashlib.sha256(spans.encode()).hexdigest())
                spots = [(a, e, k) for a, k, e in found] + [(a, e, -1) for a, e in candidates(t, found)]
                items.append([{"s": a, "e": e, "seed": k, "value": hashed(t[a:e].translate(LOWER)), "contexts": contexts(t, a, e)} for a, e, k in spots])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(base), pa.array(items, pa.list_(item))], names=schema.names)

    return stored(docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "pii-scanned")


def bootstrap(items: DataFrame, *, rounds: int = 3, prior: float = 4.0, least: float = 0.6, support: float = 5.0, accept: float = 0.7) -> DataFrame:
    """(value, seed, score) of the candidates among ``items`` (value, seed: -1 a candidate, contexts) that promoted contexts call identifiers of the kind ``seed``."""
    known = stored(items.where("seed >= 0").groupBy("value").agg(F.min("seed").alias("seed"), F.lit(1.0).alias("score")), "pii-known")
    edges = stored(items.select("value", F.explode("contexts").alias("context")).distinct(), "pii-edges")
    sizes = stored(edges.groupBy("context").agg(F.count("*").alias("n")), "pii-sizes")
    open_edges = edges.join(known.select("value"), "value", "left_anti")
    scores, last = known, None
    for _ in range(rounds):
        mass = edges.join(scores, "value").groupBy("context", "seed").agg(F.sum("score").alias("mass")).where(F.col("mass") >= support)
        promoted = mass.join(sizes, "context").withColumn("confidence", F.col("mass") / (F.col("n") + prior)).where(F.col("confidence") >= least).select("context", "seed", "confidence")
        votes = open_edges.join(promoted, "context").groupBy("value", "seed").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = votes.groupBy("value").agg(F.max(F.struct("score", (-F.col("seed")).alias("first"))).alias("b")).select("value", (-F.col("b.first")).alias("seed"), F.col("b.score").alias("score"))
        found = stored(best, "pii-scores")
        if last is not None:
            dropped(last)
        scores, last = known.unionByName(found), found
        if found.isEmpty():
            break
    for t in (edges, sizes, known):
        dropped(t)
    return last.where(F.col("score") >= accept)


def find(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rounds: int = 3, prior: float = 4.0, least: float = 0.6, support: float = 5.0, accept: float = 0.7) -> DataFrame:
    """Columns ``keep`` with n_email, n_ip, n_card, n_phone, base_sha256, n_like (identifiers found by context) and spans (all of them, by start and then kind)."""
    rows = scanned(docs, text, keep)
    items = rows.select("__row", F.explode("items").alias("i")).select("__row", "i.*")
    found = bootstrap(items, rounds=rounds, prior=prior, least=least, support=support, accept=accept)
    names = F.array(*[F.lit(k) for k in KINDS])
    hits = items.where("seed < 0").select("__row", "s", "e", "value").join(found.select("value", (F.col("seed") + len(SEEDS)).alias("k")), "value").groupBy("__row").agg(F.collect_list(F.struct("s", "k", "e")).alias("hits"))
    own = F.transform(F.filter("items", lambda i: i["seed"] >= 0), lambda i: F.struct(i["s"].alias("s"), i["seed"].alias("k"), i["e"].alias("e")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(own, F.col("hits"))), lambda i: F.concat_ws(":", F.get(names, i["k"]), i["s"], i["e"])), ",")
    out = rows.join(hits, "__row", "left")
    return out.select(*keep, *(f"n_{k}" for k in SEEDS), "base_sha256", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_like"), F.when(F.col("hits").isNull(), F.col("base")).otherwise(spans).alias("spans"))
