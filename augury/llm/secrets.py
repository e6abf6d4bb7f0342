"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

Patterns (leftmost, non-overlapping, each kind for itself): ``assign`` a credential word, an assignment sign and a value of 12 characters or more; ``access`` an access-key id of
18 or more; ``hex`` 16 or more lower-case hex digits. Matches that are too short are dropped after matching.

Battery: every run of 20 or more encoding characters that mixes letters and digits and touches no pattern span is a candidate, and so is every pattern's own value of 20 or more. Its encoding (hex,
base32, base36, base62, base64) is the smallest alphabet that holds it. Three tests ask whether it may be drawn evenly from that alphabet: chi-squared uniformity, a runs test of the upper and lower half, and
the serial correlation of neighbours; one that fails any (Bonferroni, level ``even_level``) is no secret. Its likelihood under even drawing, over that under text written in the
same alphabet (runs of one class of characters, letters by their shares in writing, few digits), gives a p-value against text: under text the ratio has mean one, so it reaches r with
probability 1 / r at most. All candidates of the corpus are one family: they pass by Benjamini-Hochberg at ``fdr``, weighted by length, as longer strings carry more evidence. One pass
counts the p-values by hundredths of their logarithm, from which the level follows (rounded so that it never passes more), and a second one applies it. Values of patterns stay whatever
the battery says; it says how many of them look random.

Defined results: null or empty text: nothing found; repeated rows alike, and each counts in the family; null ids are kept; other columns are read only by ``keep``, whatever their names; an empty table
gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, erfc, exp, log, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, texts

# The patterns, and the kinds in the order that spans are listed in.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
# Encodings with their alphabets, from small to large.
ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"),
]
PLACE = [(name, {c: i for i, c in enumerate(letters)}, frozenset(letters)) for name, letters in ENCODINGS]
#: Letter shares of written text in thousandths, four fifths of which count beside a fifth of even shares, as languages differ.
LETTER_SHARES = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
#: How written text goes on, from class (rows) to class: lower, upper, digit, sign.
NEXT_CLASS = np.array([[0.85, 0.05, 0.05, 0.05], [0.4, 0.42, 0.08, 0.1], [0.1, 0.1, 0.7, 0.1], [0.4, 0.3, 0.25, 0.05]])


def text_model(letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For an alphabet: each character's class, its log share of its class, and the log of ``NEXT_CLASS`` among the classes that the alphabet has."""
    kind = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in letters])
    share = np.array([0.8 * LETTER_SHARES[c.lower()] / 1000 + 0.2 / 26 if c.isalpha() else 1.0 for c in letters])
    of_class = np.bincount(kind, share, 4)
    step = NEXT_CLASS * (of_class > 0)
    with np.errstate(divide="ignore"):
        return kind, np.log(share / of_class[kind]), np.log(step / step.sum(1, keepdims=True))


TEXT = [text_model(letters) for _, letters in ENCODINGS]


def upper_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def battery(s: str) -> tuple[float, float]:
    """(least p-value of the three tests of evenness times three, p-value against written text) of a string."""
    s = s.rstrip("=")
    held = set(s)
    (place, size), (kind, share, step) = next(((p, len(letters) - 2 * (name == "base64")), m) for (name, p, letters), m in zip(PLACE, TEXT, strict=True) if held <= letters)
    x = np.array([place[c] for c in s])
    n = len(x)
    count = np.bincount(x, minlength=size)
    chi = float(((count - n / size) ** 2).sum() * size / n)
    spread = sqrt(2 * (size - 1) * (1 - 1 / n))
    uniform = upper_tail((chi - (size - 1)) / spread)
    high = x >= size // 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 2 * a * b / n + 1
        sd = sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        runs = 2 * upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / sd)
    else:
        runs = 2.0 ** (1 - n)
    y = x - x.mean()
    serial = 2 * upper_tail(abs(float((y[1:] * y[:-1]).sum()) / max(1e-9, float((y * y).sum()))) * sqrt(n)) if y.any() else 0.0
    k = kind[x]
    ratio = float(-n * log(size) - share[x].sum() - step[k[:-1], k[1:]].sum() - log(np.mean(kind == k[0])))
    return min(1.0, 3 * min(uniform, runs, serial)), exp(-max(0.0, ratio))


def place(p: float, length: int) -> int:
    """Hundredths of the decimal logarithm of a p-value over the length, rounded up."""
    return int(ceil(100 * (max(-300.0, log10(p) if p > 0 else -300.0) - log10(length))))


def level(counts: dict[int, tuple[int, int]], fdr: float) -> int | None:
    """The largest place that passes, out of (tests, summed lengths) by place; None if none does."""
    n, total = (sum(c[i] for c in counts.values()) for i in (0, 1))
    passed, seen = None, 0
    for at in sorted(counts):
        seen += counts[at][0]
        if 10 ** (at / 100) * total / n <= fdr * seen / n:  # p / weight, weights being lengths over their mean
            passed = at
    return passed


def patterns(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """((start, index of kind, end) of the patterns' spans, their values' (start, end), and the runs that may be secrets and touch no span)."""
    found: list[tuple[int, int, int]] = []
    values: list[tuple[int, int]] = []
    if ":" in t or "=" in t:
        for m in ASSIGN.finditer(t):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    at, runs = 0, []
    for c in t.split():
        if len(c) >= 16:
            at = t.index(c, at)
            own = [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(c)]
            if len(c) >= 18:
                own += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(c) if m.end() - m.start() >= 18]
                if len(c) >= 20 and not c.isalpha():
                    runs += [(at + m.start(), at + m.end()) for m in RUN.finditer(c)]
            found += own
            values += [(a, b) for a, _, b in own]
            at += len(c)
    if runs:
        runs = [(a, b) for a, b in runs if any(x.isdigit() for x in t[a:b]) and any(x.isalpha() for x in t[a:b]) and not any(x < b and a < y for x, _, y in found)]
    return found, [(a, b) for a, b in values if b - a >= 20], runs


def tested(s: str, even_level: float) -> int:
    """A string's ``place`` by the battery; what fails the tests of evenness, or isn't in any encoding, has a p-value of 1."""
    if not RUN.fullmatch(s):
        return place(1.0, len(s))
    even, p = battery(s)
    return place(p if even >= even_level else 1.0, len(s))


def counted(t: str, even_level: float, counts: dict[int, tuple[int, int]]) -> None:
    """Add a text's tests to ``counts``."""
    _, values, runs = patterns(t)
    for a, b in values + runs:
        x = tested(t[a:b], even_level)
        n, total = counts.get(x, (0, 0))
        counts[x] = (n + 1, total + b - a)


def scan(t: str, passed: int | None = None, even_level: float = 0.001, fdr: float = 0.01, alone: bool = True) -> tuple[list[tuple[int, int, int]], int]:
    """((start, index of kind, end) of every span in order, how many of the patterns' values are random) at the family's level ``passed``; ``alone``: the text is the family."""
    found, values, runs = patterns(t)
    if not values and not runs:
        return sorted(found), 0
    if alone:
        counts: dict[int, tuple[int, int]] = {}
        counted(t, even_level, counts)
        passed = level(counts, fdr)
    if passed is None:
        return sorted(found), 0
    found += [(a, 3, b) for a, b in runs if tested(t[a:b], even_level) <= passed]
    return sorted(found), sum(tested(t[a:b], even_level) <= passed for a, b in values)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(t: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each group of overlapping spans replaced by ``mark``."""
    out, last = [], 0
    for a, _, b in spans:
        if a >= last:
            out += [t[last:a], mark]
        last = max(last, b)
    return "".join([*out, t[last:]])


def family_level(docs: DataFrame, *, text: str = "text", fdr: float = 0.01, even_level: float = 0.001) -> int | None:
    """``level`` of all the candidates of all texts: at most some 30,000 counts come to the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[int, int]] = {}
        for b in small_batches(batches, "__text"):
            for t in texts(b, "__text"):
                counted(t, even_level, counts)
        rows = [(at, *c) for at, c in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["at", "n", "total"])

    c = docs.select(docs[text].alias("__text")).mapInArrow(run, "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return level({r["at"]: (r["n"], r["total"]) for r in c.collect()}, fdr)


def find(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = 0.01, even_level: float = 0.001, redact: bool = False) -> DataFrame:
    """Columns ``keep`` with n_assign, n_access, n_hex, base_sha256, spans and n_random_base (values of patterns that the battery calls random), and with ``redact`` the text without its secrets as ``redacted``."""
    passed = family_level(docs, text=text, fdr=fdr, even_level=even_level)
    fields = [docs.schema[c] for c in keep]
    long, string = T.LongType(), T.StringType()
    names = [("n_assign", long), ("n_access", long), ("n_hex", long), ("base_sha256", string), ("spans", string), ("n_random_base", long)] + [("redacted", string)] * redact
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__text"):
            rows = []
            for t in texts(b, "__text"):
                spans, random = scan(t, passed, even_level, alone=False)
                base = [s for s in spans if s[1] < 3]
                count = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), random, *([redacted(t, spans)] if redact else [])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x) for x in zip(*rows, strict=True))], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
