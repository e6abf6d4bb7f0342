"""Personal data, phrases and hard negatives against brute force, on fixtures with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import negatives, phrases, pii
from augury.llm.queries import op11_pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_seeds(t):
    """The contract's patterns, as they are written."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(t):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(int(x) for x in m[0].split(".")) > 255:
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_seed_patterns_equal_the_written_ones():
    rng = np.random.default_rng(3)
    pieces = ["a@b.c", "@", "x.y@z-1.com", ".", "..", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "+1 (303) 555-0101", "+", "4111 1111 1111 1111", "4111-1111", " ", "-", "é", "12", "9", "(", ")", "word", "%", "\n", "@b.c@d.e", "1" * 25]
    for _ in range(6000):
        t = "".join(rng.choice(pieces, rng.integers(1, 12)))
        assert pii.seeds(t) == plain_seeds(t), t


@pytest.mark.parametrize("t", ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "+" * 400_000, "a@" * 200_000, "+1" * 200_000, "1." * 200_000, "é1" * 200_000, "1-" * 200_000, "(" * 400_000])
def test_scan_of_long_texts_is_linear(t):
    began = time.time()
    pii.candidates(t, pii.seeds(t))
    assert time.time() - began < 8


def test_bootstrap_finds_what_stands_in_promoted_contexts(spark):
    rows = [(i, f"please call me on +1 (303) 555-01{i:02d} any time") for i in range(20)]
    rows += [(100, "please call me on 555-0199-22 any time"), (101, "please call me on 0170 5550199 any time"), (102, "see version 1234567 any way"), (103, None), (None, ""), (104, "nothing here")]
    rows += [(200 + i, f"item number {70000 + i} shipped") for i in range(30)] + [(300 + i, f"of the +1 (404) 555-02{i:02d} and") for i in range(12)] + [(400 + i, f"of the u{i}@mail.example and") for i in range(12)] + [(500, "of the 1234567 and")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit("other")).withColumn("seed", F.lit(1)).repartition(5)
    out = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert out[100]["spans"] == "like_phone:18:29" and out[101]["spans"] == "like_phone:18:30"
    assert out[5]["spans"] == "phone:18:35" and out[5]["n_phone"] == 1 and out[5]["n_like"] == 0
    for i in (102, 103, None, 104, 210, 500):
        assert out[i]["spans"] == "" and out[i]["n_like"] == 0
    assert len(out) == docs.count()


def plain_bootstrap(items, rounds=3, prior=4, least=0.6, support=5, accept=0.7):
    known = {v: min(k for x, k, _ in items if x == v and k >= 0) for v in {v for v, k, _ in items if k >= 0}}
    edges = {(v, c) for v, _, cs in items for c in cs}
    size = Counter(c for _, c in edges)
    score = {(v, k): 1.0 for v, k in known.items()}
    for _ in range(rounds):
        mass = Counter()
        for v, c in edges:
            for k in range(4):
                mass[c, k] += score.get((v, k), 0)
        conf = {x: m / (size[x[0]] + prior) for x, m in mass.items() if m >= support and m / (size[x[0]] + prior) >= least}
        vote = {}
        for v, c in edges:
            for k in range(4):
                if v not in known and (c, k) in conf:
                    vote[v, k] = vote.get((v, k), 1) * (1 - conf[c, k])
        best = {}
        for (v, k), miss in vote.items():
            best[v] = max(best.get(v, (0, 0)), (round(1 - miss, 9), -k))
        score = {(v, k): 1.0 for v, k in known.items()} | {(v, -k): s for v, (s, k) in best.items()}
    return {(v, k): s for (v, k), s in score.items() if v not in known and s >= accept}


def test_bootstrap_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    items = []
    for _ in range(1500):
        kind = int(rng.integers(-1, 4))
        items.append((int(rng.integers(0, 60)) + 100 * kind, kind, [int(x) for x in rng.integers(0, 6, 2) + 10 * (kind if kind >= 0 else int(rng.integers(0, 4)))]))
    got = {(r["value"], r["seed"]): r["score"] for r in pii.bootstrap(spark.createDataFrame(items, "value long, seed int, contexts array<long>")).collect()}
    want = plain_bootstrap(items)
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in got)


def test_pii_query_over_whole_documents_equals_the_written_patterns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op11_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        spans = plain_seeds(r["text"] or "")
        text = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in BASE] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(text.split(",")) <= set(got[r["doc_id"]]["spans"].split(","))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert pii.find(docs).count() == 0 and phrases.mine(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(negatives.labelled(vectors), F.lit(True)).count() == 0


def plain_phrases(docs, least, top, covered):
    f, n = Counter(), Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    rows = {}
    for (lang, p), a in cand.items():
        if any(x[0] == lang and len(x[1]) > len(p) and any(x[1][i : i + len(p)] == p for i in range(len(x[1]))) and 100 * b >= covered * a for x, b in cand.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in rows.items() for i, x in enumerate(sorted(v)[:top])}


@pytest.mark.parametrize(("bits", "least", "top"), [(20, 3, 2000), (4, 3, 40), (10, 300, 10)])
def test_phrases_equal_brute_force(spark, bits, least, top):
    rng = np.random.default_rng(7)
    words = ["the", "The", "cat", "sat", "Über", "ñ", "a.b", "x\x0by", " ", "on", "mat", "İ", "ß"]
    docs = [(str(rng.choice(["en", "de", "fr"])) if rng.random() < 0.9 else None, "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ". ", "\n"], p=[0.8, 0.05, 0.05, 0.05, 0.05])) for _ in range(rng.integers(0, 60)))) for _ in range(250)]
    docs += [("en", None), ("en", ""), (None, "the cat " * 3000), ("", "the cat sat")] + [("de", "über den Berg über den Berg")] * 400
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)).repartition(6)
    got = {tuple(r) for r in phrases.mine(df, least=least, top=top, bits=bits).collect()}
    assert got == plain_phrases(docs, least, top, 80) and got


def test_small_task_dictionaries_give_the_same_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (sorted(map(tuple, phrases.frequent(docs, least=5, held=held, bits=bits)[0].collect())) for held, bits in ((300_000, 26), (50, 16)))
    assert a == b and len({x[1] for x in a}) == 4


def plain_negatives(rows, anchor, k, low):
    out = []
    rows = [(i, x, label, np.array([int(c) for c in v], object)) for i, (x, label, v) in enumerate(rows)]
    for i, x, label, v in rows:
        if not anchor(x):
            continue
        scored = []
        for j, y, other, w in rows:
            m = min(len(v), len(w))
            scored.append((-int((v[:m] * w[:m]).sum()) if m else 0, y, j, other))
        scored.sort()
        for s, y, j, _ in [c for c in scored if c[3] == label and c[2] != i][:k]:
            found = [c for c in scored if c[3] != label and -80 * s <= -100 * c[0] <= -100 * s] if low == 80 else []
            out += [(x, y, r + 1, c[1], -s, -c[0]) for r, c in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "sphere", "ties", "one vector", "wide numbers", "lengths"])
def test_hard_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(11)
    n = 700
    if shape == "clusters":
        centres = rng.normal(0, 60, (12, 8))
        v = np.floor(centres[rng.integers(0, 12, n)] + rng.normal(0, 4, (n, 8))).astype(int).tolist()
    elif shape == "sphere":
        v = np.floor(rng.normal(0, 32, (n, 16))).astype(int).tolist()
    elif shape == "ties":
        v = rng.integers(-2, 3, (n, 3)).tolist()
    elif shape == "one vector":
        v = [[3, 4, 5]] * 500 + rng.integers(0, 6, (n - 500, 3)).tolist()
    elif shape == "wide numbers":
        v = [[int(x) for x in r] for r in rng.integers(-(1 << 29), 1 << 29, (n, 4))]
    else:
        v = [rng.integers(-9, 10, rng.integers(0, 6)).tolist() for _ in range(n)]
    rows = [(int(x), int(label), r) for x, label, r in zip(rng.permutation(n) if shape != "ties" else rng.integers(0, 300, n), rng.integers(0, 3, n), v, strict=True)]
    df = spark.createDataFrame(rows, "id long, label int, v array<long>").withColumn("block", F.lit("x"))
    for block_rows, tile in ((96, 20), (8192, 65536))[: 2 if shape == "ties" else 1]:
        got = sorted(map(tuple, negatives.mine(df, F.col("id") % 20 == 0, block_rows=block_rows, tile=tile).collect()))
        assert got == plain_negatives(rows, lambda x: x % 20 == 0, 5, 80)


def test_bounds_spare_rows_of_far_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (40, 8))
    v = centres[np.arange(4000) % 40] + rng.normal(0, 3, (4000, 8))
    v = np.floor(1000 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)  # of one norm, as embeddings mostly are
    most = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
    block = negatives.Block(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), v, most)
    low, high = block.tree.bounds(v[:200].astype(float), most)
    taken = [block.nearest(v[i], i, 0, True, negatives.LEAST, negatives.MOST, 5, low[i], high[i])[2] for i in range(200)]
    assert np.mean(taken) < 0.5 * len(low[0])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.9, 0.5]), (3, None, [1.0, 0.5]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (8, 2, [None, 1.0])]
    df = negatives.labelled(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert df.count() == 3
    assert [tuple(r) for r in negatives.mine(df, F.col("id") == 0).collect()] == []  # row 2 scores 75,264, over the positive's 73,728
    assert [tuple(r) for r in negatives.mine(df.withColumn("v", F.when(F.col("id") == 2, F.array(F.lit(200).cast("long"), F.lit(128).cast("long"))).otherwise(F.col("v"))), F.col("id") == 0).collect()] == [(0, 1, 1, 2, 73728, 67584)]


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a "' * 200_000 + ">", "<a '\"" * 100_000, "<!" * 300_000, "<svg>" * 50_000, "<select>" * 100_000, "<a \"'" * 100_000, "<!--" * 200_000, "</svg " * 100_000])
def test_broken_pages_are_read_in_linear_time(page):
    from augury.llm import html

    began = time.time()
    html.parse(page)
    assert time.time() - began < 8


def test_tags_without_an_end_are_text_and_quotes_hide_brackets():
    from augury.llm import html

    def text(x):
        return "".join(c if isinstance(c, str) else f"[{c.tag}:{text(c)}]" for c in x.children)

    assert text(html.parse("a <b c='>'>d</b> <e 'f")) == "a [b:d] <e 'f"
    assert text(html.parse("<p>x<math>y2</math><noscript>n</noscript><svg>s</svg><select>gone</select>")) == "[p:x[math:y2][noscript:n][svg:s]]"


@pytest.mark.parametrize(("grades", "over_0", "over_1"), [([0, 1, 2], 0.9, 0.3), ([1, 2], 1.0, 0.9), ([0, 2], 0.9, 0.9), ([0, 1], 0.9, 0.0), ([2], 1.0, 1.0), ([0], 0.0, 0.0), ([], None, None)])
def test_tails_go_by_the_grades_value(spark, grades, over_0, over_1):
    from augury.llm import quality

    model = quality.Quality()
    model.grades = grades
    df = spark.createDataFrame([([0.9, 0.3][: max(0, len(grades) - 1)],)], "tail array<double>")
    assert tuple(df.select(model.over(0), model.over(1)).first()) == (over_0, over_1)
