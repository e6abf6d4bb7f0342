"""Entity-match rules between arrays of names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions.text import norm, spaced_words

# The rules in the order of the ladder.
RULES = ("R0_loose_substring", "R1_loose_word", "R2_two_dimension", "R3_company_only", "R4_identity")


def is_substring(a: Column, b: Column) -> Column:
    """Either value inside the other, normalised."""
    a, b = norm(a), norm(b)
    return F.contains(a, b) | F.contains(b, a)


def is_acronym(short: Column, long: Column) -> Column:
    """``short`` (2 to 6 letters) spells the first letters of all words of ``long``."""
    s, words = norm(short), F.split(F.trim(spaced_words(long)), " ")
    return s.rlike("^[a-z]{2,6}$") & (F.size(words) >= 2) & (F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "") == s)


def is_loose(a: Column, b: Column) -> Column:
    """Rule R0's test: a substring either way, or an acronym."""
    return is_substring(a, b) | is_acronym(a, b) | is_acronym(b, a)


def is_words(a: Column, b: Column) -> Column:
    """The words of one follow each other in the other, or one is the other's acronym. Values without ASCII words match nothing."""
    x, y = spaced_words(a), spaced_words(b)
    return (F.length(x) > 2) & (F.length(y) > 2) & (F.contains(x, y) | F.contains(y, x) | is_acronym(a, b) | is_acronym(b, a))


def hits(signal: Column, truth: Column, same) -> Column:
    """How many of the ``truth`` values some ``signal`` value matches; nulls and empty values are passed over."""
    given = lambda v: v.isNotNull() & (v != "")
    return F.size(F.filter(F.coalesce(truth, F.array().cast("array<string>")), lambda b: given(b) & F.exists(F.coalesce(signal, F.array().cast("array<string>")), lambda a: given(a) & same(a, b))))


#: Columns of ``verdicts``: the truth values that a signal value matches by each test.
TESTS = {"sub": "plain substring", "loose": "substring or acronym", "word": "words or acronym", "plain": "words"}


def _values(columns: list[str]) -> Column:
    """All values of array columns in one array of (kind, v), kind being the column's place."""

    def one(k: int, c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("v")))

    return F.flatten(F.array(*[one(k, c) for k, c in enumerate(columns)]))


def _parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, v, n, w, i): every distinct value of the array columns with its normal form, its words and their initials, computed once per value."""
    v = df.select(F.explode(_values(columns)).alias("x")).select("x.*")
    v = v.where(F.col("v").isNotNull() & (F.col("v") != "")).distinct()
    words = F.split(F.trim("w"), " ")
    v = v.select("kind", "v", norm(F.col("v")).alias("n"), spaced_words(F.col("v")).alias("w"))
    return v.withColumn("i", F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def verdicts(signals: DataFrame, truths: DataFrame, columns: list[str], truth_columns: list[str]) -> DataFrame:
    """(kind, v, sub, loose, word, plain): each distinct signal value that matches a truth value by any test, with arrays of the truth values. ``truths`` is the stated set of events;
    no pattern runs per pair, only comparisons of forms that were made once per value."""
    a, b = _parts(signals, columns), _parts(truths, truth_columns).toDF("t_kind", "t", "t_n", "t_w", "t_i")
    short = lambda n, i: F.coalesce(n.rlike("^[a-z]{2,6}$") & (n == i), F.lit(False))
    n, tn, w, tw = F.col("n"), F.col("t_n"), F.col("w"), F.col("t_w")
    sub = F.contains(n, tn) | F.contains(tn, n)
    acronym = short(n, F.col("t_i")) | short(tn, F.col("i"))
    some = (F.length(w) > 2) & (F.length(tw) > 2)
    plain, word = some & (F.contains(w, tw) | F.contains(tw, w)), some & (F.contains(w, tw) | F.contains(tw, w) | acronym)
    j = a.join(b, (a["kind"] == b["t_kind"]) & (sub | word | acronym))
    return j.groupBy("kind", "v").agg(*[F.collect_set(F.when(c, F.col("t"))).alias(name) for name, c in (("sub", sub), ("loose", sub | acronym), ("word", word), ("plain", plain))])


def with_verdicts(signals: DataFrame, truths: DataFrame, key: str, columns: list[str], truth_columns: list[str]) -> DataFrame:
    """``signals`` with m: for each column in order, the truth values matched by each test (null where the signal matches none). Joins are by value and by key; only signals with a match move."""
    values = _values(columns)
    found = signals.select(key, F.explode(values).alias("x")).select(key, "x.*").join(verdicts(signals, truths, columns, truth_columns), ["kind", "v"])
    of = lambda k, t: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col(t))))))
    per = found.groupBy(key).agg(F.array(*[F.struct(*[of(k, t).alias(t) for t in TESTS]) for k in range(len(columns))]).alias("m"))
    return signals.join(per, key, "left")


def matched_values(truth: Column, found: Column) -> Column:
    """How many of the ``truth`` values are among the ``found`` ones."""
    return F.coalesce(F.size(F.filter(truth, lambda b: F.array_contains(found, b))), F.lit(0))


def rule(name: str, company: Column, geo: Column, good: Column, axis: Column) -> Column:
    """A rule's verdict from the numbers of matched companies, places and goods. For R0 give substring numbers, for the rest word numbers."""
    if name in RULES[:2]:
        return (company > 0) | (geo > 0) | (good > 0)
    if name == RULES[2]:
        return (company > 0) | ((geo > 0) & (good > 0))
    if name == RULES[3]:
        return company > 0
    both = (geo > 0) & (good > 0)
    return (company > 0) | F.when(axis == "company", False).when(axis == "geo_one", both).otherwise((geo >= 2) | both)


def basis(company: Column, geo: Column, good: Column) -> Column:
    """The strongest evidence of a match."""
    return F.when(company > 0, "company").when((geo > 0) & (good > 0), "geo+commodity").when(good > 0, "commodity_only").when(geo > 0, "geo_only").otherwise("no_match")
