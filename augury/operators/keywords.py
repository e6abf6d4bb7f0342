"""Keywords of events out of their entities, and the records that many keywords at once find."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.functions.text import plain_words, slug_title
from augury.sources.shared import stored

# Words that say too little to be keywords of their own.
GENERIC = (
    "port city state province region area county island the and of for de la el al north south east west central upper lower new old united states "
    "goods products shipping supply chain market company corporation group inc ltd international"
).split()


def aliases(value: Column) -> Column:
    """A name, or the two names of one with a second in brackets: what precedes the first bracket, and what lies between it and the last closing one."""
    at = F.instr(value, "(")
    inside = F.regexp_extract(value, r"(?s)\((.*)\)", 1)
    return F.when(at > 0, F.array(F.substring(value, F.lit(1), at - 1), inside)).otherwise(F.array(value))


def derived(entities: DataFrame, event: str = "event", value: str = "value", generic: list[str] = GENERIC, shortest: int = 4) -> DataFrame:
    """(event, keyword, place): the whole names of an event's entities, then their words of ``shortest`` letters or more that aren't generic, each in alphabetical order, without repeats."""
    names = entities.where(F.col(value).isNotNull()).select(F.col(event).alias("event"), F.explode(aliases(F.col(value))).alias("name")).select("event", plain_words(F.col("name")).alias("keyword")).where("keyword <> ''")
    words = names.select("event", F.explode(F.split("keyword", " ")).alias("keyword")).where((F.length("keyword") >= shortest) & ~F.col("keyword").isin(*generic))
    both = names.withColumn("part", F.lit(0)).unionByName(words.withColumn("part", F.lit(1))).groupBy("event", "keyword").agg(F.min("part").alias("part"), F.max("part").alias("also"))
    lists = both.groupBy("event").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("keyword")))).alias(n) for n, c in (("phrases", F.col("part") == 0), ("tokens", F.col("also") == 1))])
    return lists


def in_order(lists: DataFrame) -> DataFrame:
    """(event, place, keyword) of ``derived`` lists: phrases first. A word that is a whole name too keeps its first place."""
    return lists.select("event", F.posexplode(F.array_distinct(F.concat("phrases", "tokens"))).alias("place", "keyword"))


def alone(lists: DataFrame) -> DataFrame:
    """The lists with ``tokens`` less those inside a phrase of several words, so that one name isn't counted as evidence twice."""
    wide = F.filter("phrases", lambda p: F.contains(p, F.lit(" ")))
    return lists.withColumn("tokens", F.filter("tokens", lambda t: ~F.exists(wide, lambda p: F.array_contains(F.split(p, " "), t))))


#: Places of hashed words: what tasks know of the keywords beforehand.
PLACES = 1 << 20


def place(word: str) -> int:
    return zlib.crc32(word.encode()) % PLACES


#: Of a word that meets no keyword.
NOTHING = ((), (), (), ())


def pieces(word: str, widest: int) -> Iterator[tuple[int, int]]:
    """Start and end of the parts of ``widest`` characters at most that have no ASCII letter or digit right before or after them. Words are normalised, so their ASCII characters are letters and digits."""
    n, other = len(word), [i for i, c in enumerate(word) if c > "\x7f"]
    for at, i in enumerate([0, *(i + 1 for i in other if i + 1 < n)]):
        for k in range(max(0, at - 1), len(other) + 1):
            j = other[k] if k < len(other) else n
            if j > i + widest:
                break
            if j > i:
                yield i, j


class Known(dict):
    """A word's parts that may be a keyword, its first word (ends of the word), its last (fronts of it) and the second of more than two, by their places; remembered, as is which runs may be keywords."""

    def __init__(self, whole: frozenset[int], first: frozenset[int], last: frozenset[int], second: frozenset[int], widest: int):
        super().__init__()
        self.sets, self.any, self.widest, self.runs = (whole, first, last, second), whole | first | last | second, widest, {}

    def __missing__(self, word: str) -> tuple[tuple[str, ...], ...]:
        if len(self) >= 1 << 18:
            self.clear()
        if word.isascii():
            at = place(word)
            out = tuple((word,) if at in s else () for s in self.sets) if at in self.any else NOTHING
        else:
            out = ([], [], [], [])
            for i, j in pieces(word, self.widest):
                if (at := place(part := word[i:j])) in self.any:
                    for held, s, fits in zip(out, self.sets, (True, j == len(word), i == 0, j - i == len(word)), strict=True):
                        if fits and at in s:
                            held.append(part)
            out = tuple(tuple(set(x)) for x in out) if any(out) else NOTHING
        self[word] = out
        return out

    def run(self, words: str) -> bool:
        if (held := self.runs.get(words)) is None:
            if len(self.runs) >= 1 << 18:
                self.runs.clear()
            held = self.runs[words] = place(words) in self.sets[0]
        return held


def grams(texts: pa.Array, known: Known, sizes: list[int]) -> tuple[list[int], list[str]]:
    """The words and runs of ``sizes`` words that may be keywords, each once per text, as places of texts and strings. Every different word is looked up once for all texts."""
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = split.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    meets = [known[w] for w in words]
    some = [(i, m) for i, m in enumerate(meets) if m is not NOTHING]
    whole, first, last, second = np.zeros((4, len(words)), bool)
    for k, flag in enumerate((whole, first, last, second)):
        flag[[i for i, m in some if m[k]]] = True
    parts: dict[str, int] = {}
    held, many = [], np.zeros(len(words), np.int64)
    for i, m in some:
        held += [parts.setdefault(p, len(parts)) for p in m[0]]
        many[i] = len(m[0])
    starts, held = np.cumsum(many) - many, np.array(held, np.int64)
    whole, first, last, second = whole[code], first[code], last[code], second[code]
    hits = pc.unique(pa.array((text * len(words) + code)[whole])).to_numpy()
    of, w = hits // max(1, len(words)), hits % max(1, len(words))
    n = many[w]
    ids = held[np.repeat(starts[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    hits = pc.unique(pa.array(np.repeat(of, n) * len(parts) + ids)).to_numpy()  # words with letters beyond ASCII may share a part
    names = list(parts)
    row, out = (hits // max(1, len(parts))).tolist(), [names[i] for i in (hits % max(1, len(parts))).tolist()]
    runs = set()
    for n in sizes:
        if n > len(code):
            break
        fits = first[: len(code) - n + 1] & last[n - 1 :] & (text[: len(code) - n + 1] == text[n - 1 :])
        if n > 2:
            fits &= second[1 : len(code) - n + 2]
        at = np.flatnonzero(fits)
        for t, *run in set(zip(text[at].tolist(), *(code[at + k].tolist() for k in range(n)), strict=True)):
            between = [words[c] for c in run[1:-1]]
            runs.update((t, g) for h in meets[run[0]][1] for e in meets[run[-1]][2] if known.run(g := " ".join((h, *between, e))))
    return row + [t for t, _ in runs], out + [g for _, g in runs]  # a run has a space, a part has none


def candidates(rows: DataFrame, key: str, columns: dict[str, str], words: DataFrame) -> DataFrame:
    """(key, column, keyword) of what may be a keyword in every column: all that are, and a few strings of the same hashed places. ``words``: different keywords, stored.

    One pass over the rows, whose texts are never shuffled. Only hashed places of the keywords (and of first, second and last words, ``PLACES`` each at most) go to the tasks, to leave out what can't meet any.
    """
    w = F.split("keyword", " ")
    ends = words.select("keyword", F.size(w).alias("n"), F.element_at(w, 1).alias("first"), F.element_at(w, -1).alias("last"), F.when(F.size(w) > 2, F.get(w, F.lit(1))).alias("second"), F.array_max(F.transform(w, F.length)).alias("widest"))
    at = lambda c: F.collect_set((F.crc32(c) % PLACES).cast("int"))
    several = F.col("n") > 1
    held = ends.agg(at("keyword").alias("whole"), at(F.when(several, F.col("first"))).alias("first"), at(F.when(several, F.col("last"))).alias("last"), at(F.col("second")).alias("second"), F.collect_set(F.when(several, F.col("n"))).alias("sizes"), F.coalesce(F.max("widest"), F.lit(0)).alias("widest")).first()
    whole, first, last, second, sizes, widest = held["whole"], held["first"], held["last"], held["second"], sorted(held["sizes"]), held["widest"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(frozenset(whole), frozenset(first), frozenset(last), frozenset(second), widest)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                for i in range(1, part.num_columns):
                    row, keyword = grams(part.column(i), known, sizes)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array([i - 1] * len(row), pa.int32()), pa.array(keyword, pa.string())], names=["key", "column", "keyword"])

    cells = rows.select(F.col(key).alias("key"), *[plain_words(F.col(c)).alias(f"text{i}") for i, c in enumerate(columns)])  # no filter here: it would normalise texts twice
    schema = T.StructType([cells.schema["key"], T.StructField("column", T.IntegerType()), T.StructField("keyword", T.StringType())])
    return cells.mapInArrow(found, schema)


def met(rows: DataFrame, key: str, columns: dict[str, str], keywords: DataFrame) -> DataFrame:
    """(key, column, keyword) of every different keyword found in every column, with no ASCII letter or digit right before or after it. ``columns``: name to label, in order; ``key`` is unique. Words and runs of words, as long as keywords are, meet the keywords by equality."""
    words = stored(keywords.select("keyword").distinct(), "keywords")
    return candidates(rows, key, columns, words).join(words, "keyword").select("key", "column", "keyword")


def fired(rows: DataFrame, key: str, columns: dict[str, str], keywords: DataFrame) -> DataFrame:
    """(key, column, event, place, keyword): what ``met`` finds, for each event of a keyword. Finds are dealt by key before they meet their events, so that grouping by key moves them once, and once per keyword instead of per event."""
    keywords = stored(keywords, "keywords")
    found = candidates(rows, key, columns, stored(keywords.select("keyword").distinct(), "words")).repartition("key")
    return found.join(keywords, "keyword").select("key", "column", "event", "place", "keyword")


def times(rows: DataFrame, key: str, columns: dict[str, str], keywords: DataFrame) -> DataFrame:
    """(column, keyword, n): how many rows ``fired`` has of each, counted before keywords meet their events."""
    keywords = stored(keywords, "keywords")
    found = met(rows, key, columns, keywords).groupBy("column", "keyword").agg(F.count("*").alias("rows"))
    return found.join(keywords.groupBy("keyword").agg(F.count("*").alias("events")), "keyword").select("column", "keyword", (F.col("rows") * F.col("events")).alias("n"))


def specific(found: DataFrame, labels: list[str], least: int = 2) -> DataFrame:
    """(key, event, n, field, keyword) of the records an event's keywords are specific for: ``least`` different ones, or one of several words. ``field`` and ``keyword`` are the first, by column and then place."""
    name = F.get(F.array(*map(F.lit, labels)), F.col("first.column"))
    g = found.groupBy("key", "event").agg(F.count_distinct("keyword").alias("n"), F.bool_or(F.contains("keyword", F.lit(" "))).alias("strong"), F.min(F.struct("column", "place", "keyword")).alias("first"))
    return g.where((F.col("n") >= least) | F.col("strong")).select("key", "event", "n", name.alias("field"), F.col("first.keyword").alias("keyword"))


def haystack(url: Column) -> Column:
    """Lower-case URL and title, where the filters below look."""
    return F.lower(F.concat_ws(" ", url, slug_title(url)))


def any_of(hay: Column, words: list[str]) -> Column:
    """Whether any of the stated ``words`` occurs in ``hay``, within longer words too."""
    return F.exists(F.array(*map(F.lit, words)).cast(T.ArrayType(T.StringType())), lambda w: F.contains(hay, w))


def kept(hay: Column, words: list[str]) -> Column:
    """The haystack filter: any of ``words``; an empty list keeps all."""
    return any_of(hay, words) if words else F.lit(True)


def neutral(hay: Column, events: list[str]) -> Column:
    """No keyword of any event."""
    return ~any_of(hay, events)


def hard_negative(hay: Column, events: list[str], topic: list[str]) -> Column:
    """No keyword of any event, but one of the topic."""
    return neutral(hay, events) & any_of(hay, topic)
