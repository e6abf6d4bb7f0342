"""Operators against brute force, exact round trips and held-out labels, with nulls, empty texts, repeats, ties and empty tables."""

import hashlib
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from augury.llm import bpe, decontaminate, html, lines, quality, secrets, simhash, suffix, topk, toxicity
from augury.llm.components import connected_components
from augury.llm.queries import VOCABULARY

RNG = np.random.default_rng(3)
WORDS = [f"{a}{b}{c}" for a in "bdkt" for b in "aeiou" for c in ("n", "rs", "lt", "m")]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keys string, fp string")  # the last two clash with inner names


def with_extras(texts):
    return [(i, t, "x", "y") for i, t in enumerate(texts)]


def test_bpe_is_the_librarys(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "Hello, World's end", "ΣΑΣ İstanbul é 漢字\x1cx", "<|endoftext|>a<|endoftext|>", "aaaa" * 50, prose(50), prose(50)]
    got = bpe.encode(docs(spark, with_extras(texts)), VOCABULARY).orderBy("doc_id").collect()
    for t0, r in zip(texts, got, strict=True):
        e = t.encode(t0 or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == e and r.decoded == t.decode(e, skip_special_tokens=False) and r.n_tokens == len(e)
    assert bpe.encode(docs(spark, []), VOCABULARY).count() == 0


def test_bpe_is_the_librarys_on_every_assigned_code_point():
    t, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.PairIndexBPE(VOCABULARY)
    points = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x34000), *range(0x3D000, 0x3D100), *range(0x3FC00, 0x3FD00), *range(0xE0000, 0xE0200), 0x10FFFF)]
    rows = [" ".join(f"a{c}'s1{c}b" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    for i, (text, mine) in enumerate(zip(rows, own.encode_batch(rows), strict=True)):
        assert np.frombuffer(mine, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, hex(ord(points[i * 200]))


def test_topk_with_ties_and_unusable_vectors(spark):
    v = RNG.integers(-2, 3, (120, 5))
    rows = [(i, [float(x) / 64 for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 5)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = e.where(topk.usable(F.col("embedding"))).select("vec_id", topk.integer_vector(F.col("embedding")).alias("v"))
    got = {}
    for r in topk.search(x, x.where("vec_id % 20 = 0"), k=7, block_rows=30).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    for q in range(0, 120, 20):
        best = sorted((-int(v[i] @ v[q]), i) for i in range(120) if i != q)[:7]
        assert [got[q][k] for k in range(1, 8)] == [(-s, i) for s, i in best]


def test_topk_walk_stops_early_and_is_exact():
    for dims, spread, first in ((1, 50, 2), (2, 1000, 2), (3, 9, 2), (6, 400, 16), (64, 64, 16)):
        v = RNG.integers(-spread, spread + 1, (1500, dims))
        ids = RNG.permutation(1500) // 2  # each id twice
        lists, walked = topk.SortedLists(ids, list(v)), []
        for q in (*RNG.integers(-spread, spread + 1, (20, dims)), np.zeros(dims, np.int64)):
            rows, scores, met = lists.search(7, q, 10, first)
            want = np.lexsort((ids, -(v @ q)))
            want = want[ids[want] != 7][:10]
            assert scores.tolist() == (v @ q)[want].tolist() and ids[rows].tolist() == ids[want].tolist()
            walked.append(met)
        assert dims > 3 or np.median(walked) < 750


def test_topk_with_repeats_lengths_huge_components_and_no_rows(spark):
    big = 2**62
    rows = [(1, [3, 1]), (1, [5]), (2, [-1, 2, 7]), (3, [big, big]), (4, [-(2**63), 1]), (5, [0, 0])] + [(6, [2, 2])] * 300
    x = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in topk.search(x, x.where("vec_id < 6"), k=4, block_rows=40).collect():
        got.setdefault((r.query_id, r.rank), []).append((r.score, r.vec_id))
    padded = [(i, v + [0] * (3 - len(v))) for i, v in rows]
    for q, v in [(i, v) for i, v in padded[:6] if i != 1]:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in padded if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [[(-s, i)] for s, i in best]
    assert topk.search(x.limit(0), x.limit(0)).count() == topk.search(x, x.limit(0)).count() == topk.search(x.limit(0), x).count() == 0


def test_suffix_removal_is_exact(spark):
    shared = prose(40)
    texts = [prose(30) + shared + prose(20), prose(10) + shared + prose(5), "ab" * 60, None, "", prose(60)]
    texts += [texts[-1], texts[0][:150] + "é" + texts[0][150:]]
    length, data = 50, [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    got = suffix.removal(docs(spark, with_extras(texts)), length=length, passage=30, seed=20).orderBy("doc_id").collect()
    for b, r in zip(data, got, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r.n_removed, r.kept_sha256, bytes(r.kept)) == (gone.sum(), hashlib.sha256(kept).hexdigest(), kept)
    assert suffix.removal(docs(spark, []), length=length, passage=30, seed=20).count() == 0


def test_extraction(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four</p><div class="comments"><p>me too</p></div></article><aside>side</aside><footer>&copy;</footer></body></html>'
    rows = [(i, "u", page.replace("four", f"four {i}")) for i in range(12)] + [(20, "u", None), (21, "u", ""), (22, "u", "plain &lt; text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, html.fit(pages)).collect()}
    assert got[3] == "A & B\n\none two three\n\nfour 3" and got[20] == got[21] == "" and got[22] == "plain < text"
    assert html.extract(pages.limit(0), None).count() == 0


def test_decoding_has_no_contradiction():
    order = html.measured(html.parse("<div><p>a</p><nav><p>b</p></nav></div>"))
    kept = dict(zip(map(id, order), html.decoded(order, RNG.normal(size=len(order))), strict=True))
    assert all(kept[id(x.parent)] or not kept[id(x)] for x in order[1:])


def test_toxicity_learns_on_held_out_rows(spark):
    texts = [prose(30) + (" scumbag" if i % 4 == 0 else "") for i in range(400)] + [None, ""]
    d = docs(spark, with_extras(texts))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.Toxicity(iterations=30).fit(d, labels)
    rows = model.score(d).withColumn("out", toxicity.held_out(F.col("doc_id"))).where("out and doc_id < 400").collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in rows]) > 0.95
    assert {r.score for r in toxicity.Toxicity().fit(d, labels.limit(0)).score(d.limit(3)).collect()} == {0.5}
    assert toxicity.Toxicity().fit(d.limit(0), labels).score(d.limit(0)).count() == 0


# The patterns as the contract writes them, with the least length of the group that counts.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", "([0-9a-f]+)", 1, 16),
)


def base_spans(t):
    found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(BASE) for m in re.finditer(p, t, re.ASCII) if len(m[group]) >= least]
    return [sum(k == j for _, k, _ in found) for j in range(3)], ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_are_those_of_the_written_patterns(spark):
    pieces = ["password", "PASSWD", "Secret", "to\u212aen", "\u017fecret", "token", "api_key", "apikey", "'", '"', " ", "  ", "\n", "\x1c", "\u00a0", "\t", ":", "=", "A" * 9, "AKIA", "0123456789abcdef", "ab12", "x_", "/+", "é", "AKIAAKIA9", "deadbeef", "-."]
    made = ["".join(RNG.choice(pieces, int(n))) for n in RNG.integers(1, 30, 3000)] + ["token = " + "ab1" * 100_000, "password" * 50_000, None, ""]
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = secrets.find(docs(spark, with_extras(made + given))).orderBy("doc_id").collect()
    for t, r in zip(made + given, got, strict=True):
        counts, spans = base_spans(t or "")
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, hashlib.sha256(spans.encode()).hexdigest()), t
        assert set(spans.split(",")) <= set(r.spans.split(","))


def test_quality_grades_in_order(spark):
    texts = [" ".join(w.upper() + "!!" if i % 3 == 0 else w + "###" if i % 3 == 1 else w for w in prose(40).split()) for i in range(240)]
    d, ratings = docs(spark, with_extras([*texts, None])), spark.createDataFrame([(i, i % 3) for i in range(240)], "doc_id long, grade int")
    model = quality.Quality(iterations=25).fit(d, ratings)
    rows = [r for r in model.score(d).collect() if r.doc_id < 240]
    assert np.mean([abs(r.expected_grade - r.doc_id % 3) < 0.5 for r in rows]) > 0.9 and all(r.tail[0] >= r.tail[1] for r in rows)


def test_secrets(spark):
    key = "q7Zp9Kx2Lm4Vt8Rb1Ny6Wc3D"
    texts = [None, "", "token: password: abcdefghijkl", 'API_KEY = "abcdefghij0123"', "AKIA" + "A1" * 8 + " " + "0123456789abcdef", f"see {key} here", "an ordinarywordthatisverylongindeed 2024"]
    got = [(r.n_assign, r.n_access, r.n_hex, r.spans, r.redacted) for r in secrets.find(docs(spark, with_extras(texts)), redact=True).orderBy("doc_id").collect()]
    assert [g[:3] for g in got] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0)]
    assert got[5][3] == f"random:4:{4 + len(key)}" and got[5][4] == "see [secret] here" and got[6][3] == ""


@pytest.mark.parametrize("name,letters", [(n, x[:64]) for n, x in secrets.ENCODINGS[1:]])
def test_battery_finds_random_strings(name, letters):
    """Lower-case hex goes by its pattern."""
    rng = np.random.default_rng(4)
    for n, least in ((20, 0.65), (24, 0.75), (32, 0.92), (40, 0.93), (64, 0.96), (128, 0.96)):
        found = [any(a == 4 and b == 4 + n for a, _, b in secrets.scan("see " + "".join(rng.choice(list(letters), n)) + " here")[0]) for _ in range(200)]
        assert np.mean(found) >= least, (name, n)


def test_battery_leaves_written_strings():
    written = ["MANUFACTURING2024REPORT", "HTTP2SERVERPUSHENABLED", "xmlHttpRequestFactoryImpl2Bean", "src/main/java/com/example/util2/StringHelper", "2024/11/28/how-to-build-a-garden-shed", "BADCAFE2024DEADBEEF00"]
    assert [secrets.scan(f"see {t} here")[0] for t in written] == [[]] * len(written)


def line_rows(texts, passage_words):
    """Brute force of ``lines.removed``: the places of every unit, the first kept; ``texts``: (key, text), repeats of a row one after the other."""
    places, out = {}, []
    for key, t in dict.fromkeys((k, t or "") for k, t in texts):
        for s, e, w in lines.units(t, passage_words):
            places.setdefault(tuple(w), []).append((key is None, key or 0, t, s))
    seen = Counter()
    for key, t in ((k, t or "") for k, t in texts):
        seen[key, t] += 1
        copies = sum(x == (key, t) for x in ((k, u or "") for k, u in texts))
        own = [(s, e, len(w), min(places[tuple(w)]) < (key is None, key or 0, t, s), len(set(places[tuple(w)])) > 1 or copies > 1) for s, e, w in lines.units(t, passage_words)]
        gone = [(s, e) for s, e, _, g, _ in own if g] if seen[key, t] == 1 else [(s, e) for s, e, *_ in own]
        mask = np.zeros(len(t) + 1, int)
        for s, e in gone:
            mask[s:e] = 1
        edge = np.diff(np.concatenate(([0], mask)))
        spans = ",".join(f"{a}:{b}" for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))
        out.append((key, len(t), len(set(gone)), len(lines.merged(sorted((s, e) for s, e, n, _, o in own if n >= passage_words and o))), int(mask.sum()), spans, "".join(c for c, m in zip(t, mask, strict=False) if not m)))
    return out


def test_line_dedup(spark):
    a, b, c = prose(12), prose(12), ". ".join(prose(6) for _ in range(6))
    texts = [f"{a}\nshort", f"{b}\n{a.upper()}  ", f"x\n{b}\n\n{b}\n \t\n", None, "", f"here {prose(3)}. {c} and {prose(4)}\nshort", f"{prose(9)}. {c}. {prose(2)}", f"é\n{'no end ' * 3000}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2 + [(None, texts[0])] * 2
    d = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, s string, __key string").repartition(3)
    expected = line_rows(rows, 10)
    got = [(r.doc_id, r.n_chars, r.n_removed, r.n_passages, r.removed_chars, r.spans) for r in lines.removed(d, passage_words=10).collect()]
    assert sorted(got, key=repr) == sorted((x[:6] for x in expected), key=repr) and expected[6][2] > 0
    kept = [(r.doc_id, r.text or "", r.s) for r in lines.deduplicated(d, passage_words=10).collect()]
    assert sorted(kept, key=repr) == sorted(((x[0], x[6], "x") for x in expected), key=repr)
    assert lines.removed(d.limit(0)).count() == lines.deduplicated(d.limit(0)).count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))] if words else []
    return "".join("1" if sum(x >> b & 1 for x in h) * 2 > len(h) else "0" for b in range(63, -1, -1))


def test_fingerprints_are_those_of_a_plain_version(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [None, "", " \x0b\n", "one", "ONE two\u00a0x three", "a b c d", "a\x1cb c d E", "É é a b c", "x y " * 300, prose(20_000), *given]
    got = simhash.fingerprints(docs(spark, with_extras(texts)), words=4).select("doc_id", "fp").collect()
    assert {r.doc_id: f"{r.fp[0] % (1 << 64):064b}" for r in got} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def hamming_components(fps, most):
    comp = list(range(len(fps)))
    for _ in fps:
        for i, j in combinations(range(len(fps)), 2):
            if int(fps[i] ^ fps[j]).bit_count() <= most:
                comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


@pytest.mark.parametrize("dense_rows", [50_000, 3])
def test_simhash_links_are_exact(spark, dense_rows):
    fps = [int(x) for x in RNG.integers(0, 2**63, 12, dtype=np.uint64)]
    for f in list(fps):
        for _ in range(4):
            f ^= sum(1 << int(b) for b in RNG.choice(64, int(RNG.integers(1, 6)), replace=False))
            fps.append(f)
    rows = [(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps + fps[:3])]
    got = {r.doc_id: r.component_id for r in simhash.link(spark.createDataFrame(rows, "doc_id long, fp array<long>"), dense_rows=dense_rows).collect()}
    expected = hamming_components(fps, 4)
    assert [got[i] for i in range(len(fps))] == expected and [got[len(fps) + i] for i in range(3)] == expected[:3]


@pytest.mark.parametrize("dense_rows", [50_000, 6])
def test_wide_fingerprints_under_a_crowded_key(spark, dense_rows):
    wide = [[int(x) for x in RNG.integers(-(2**63), 2**63, 8)] for _ in range(6)]
    for f in list(wide):
        for _ in range(5):
            f = [x ^ (1 << int(b)) for x, b in zip(f, RNG.integers(0, 62, 8), strict=True)]
            wide.append(f)
    rows = [(i, f, [1, 2 + i % 2]) for i, f in enumerate(wide)]  # the first key holds all of them
    got = {r.doc_id: r.component_id for r in simhash.link(spark.createDataFrame(rows, "doc_id long, fp array<long>, keys array<long>"), bits=512, max_distance=8, dense_rows=dense_rows).collect()}
    as_int = [sum((x & (2**64 - 1)) << (64 * j) for j, x in enumerate(f)) for f in wide]
    assert [got[i] for i in range(len(wide))] == hamming_components(as_int, 8)


def jaccard_firsts(texts, least=0.8):
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
            comp = [comp[i] if c == comp[j] else c for c in comp] if comp[i] < comp[j] else [comp[j] if c == comp[i] else c for c in comp]
    return {i for i, c in enumerate(comp) if i == c}


@pytest.mark.parametrize("run_shingles", [1 << 18, 300])
def test_similar_links_by_the_sets_themselves(spark, run_shingles):
    texts = [None, "", "one two", "One  two"]
    for n_changed in (1, 2, 3, 4, 5):  # Jaccard similarity from about 0.9 down to 0.6
        for _ in range(8):
            w = prose(90).split()
            texts.append(" ".join(w))
            for at in RNG.choice(np.arange(5, 85, 8), n_changed, replace=False):
                w[at] = "other"
            texts.append(" ".join(w))
    w = prose(90).split()
    for i in range(12):  # a chain whose ends are far apart
        w[6 * i + 5] = f"link{i}"
        texts.append(" ".join(w))
    texts += texts[4:8]
    got = simhash.similar(docs(spark, with_extras(texts)), run_shingles=run_shingles).where("first").collect()
    assert {r.doc_id for r in got} == jaccard_firsts(texts) and len(got) == len({r.doc_id for r in got})
    assert simhash.similar(docs(spark, [])).count() == 0


def test_similar_tells_rows_of_one_id_apart(spark):
    a, b = prose(40), prose(40)
    got = simhash.similar(docs(spark, [(1, a, "", ""), (1, b, "", ""), (2, b, "", ""), (None, b, "", "")])).collect()
    assert sorted((r.doc_id, r.first) for r in got) == [(1, True), (1, True), (2, False)]


def test_fingerprints_of_short_and_null_texts(spark):
    got = [r.fp[0] for r in simhash.fingerprints(docs(spark, with_extras([None, "", " \t", "One two", "one TWO"]))).orderBy("doc_id").collect()]
    assert got[:3] == [0, 0, 0] and got[3] == got[4] != 0


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (100, 100), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100
    assert connected_components(e.limit(0)).count() == 0


def test_reordered_passages_count(spark):
    item = prose(40)
    w = item.split()
    texts = [prose(20) + " " + item + " " + prose(10), " ".join([*w[20:], prose(8), *w[:20]]), prose(80), None, "", " ".join(w[:12])]
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc_id: r.coverage for r in decontaminate.contaminated(docs(spark, with_extras(texts)), items).collect()}
    assert got == {0: 1.0, 1: 1.0}


def brute_tiles(doc, item, n):
    """Repeatedly the longest common unmarked run; ties by place in the item, then by diagonal."""
    used_d, used_p, out = set(), set(), []
    while True:
        best = None
        for p in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while p + k < len(item) and d + k < len(doc) and item[p + k] == doc[d + k] and p + k not in used_p and d + k not in used_d:
                    k += 1
                if k >= n and (best is None or (-k, p, d - p) < best):
                    best = (-k, p, d - p)
        if best is None:
            return sorted(out)
        k, p, g = best
        out.append((p, p + g, -k))
        used_p |= set(range(p, p - k))
        used_d |= set(range(p + g, p + g - k))


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_tiles_are_those_of_brute_force(monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_SEEDS", most)
    rng = np.random.default_rng(8)
    for _ in range(60):
        item, doc = (" ".join(rng.choice(list("abc"), k)) for k in (int(rng.integers(1, 14)), int(rng.integers(0, 40))))
        n = min(3, len(item.split()))
        expected = brute_tiles(doc.split(), item.split(), n)
        got = decontaminate.Items([(1, item)], 3).matches(doc, 0.01)
        assert [t for _, _, t in got] == ([",".join(f"{p}:{d}:{k}" for p, d, k in expected)] if expected else [])


def test_contamination_in_blocks_of_repetitive_items(spark):
    item = "the " * 30
    rows = [(1, "the " * 20_000), (None, item), (3, None), (3, "")]
    items = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, [(k, t, "x", "y") for k, t in rows]), items, block_bytes=200).select("doc_id", "item_id", "coverage").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(k, i, 1.0) for k in (1, None) for i in (7, 7, None)], key=repr)
    with pytest.raises(ValueError, match="doc_id"):
        decontaminate.contaminated(docs(spark, []), items, item_key="doc_id")
    assert decontaminate.contaminated(docs(spark, []), items).count() == decontaminate.contaminated(docs(spark, [(1, item, "", "")]), items.limit(0)).count() == 0


def test_extraction_without_names_and_in_linear_time():
    began = time.process_time()
    html.measured(html.parse("<div>" + "<p>x y z</p>" * 8000 + "</div>"))
    html.measured(html.parse("<div>" * 8000 + "x" + "</b></p>" * 8000))
    assert time.process_time() - began < 4


def test_extraction_learns_the_shape_of_pages(spark):
    menu = "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(WORDS[:6]))
    page = f"<html><body><nav><ul>{menu}</ul></nav><div class='ad'>{prose(6)}</div><article><h1>{{}}</h1><p>{{}}</p><p>{{}}</p></article><footer>{prose(5)}</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page.format(prose(5), prose(40), prose(30))) for i in range(60)], "page_id long, url string, html string")
    got = html.accuracy(pages)
    assert got[False] == 1.0 and got[True] > 0.9
    plain = f"<html><body><div><ul>{menu}</ul></div><div><h1>head</h1><p>{prose(40)}</p><p>{prose(30)}</p></div></body></html>"
    text = html.extract(spark.createDataFrame([(1, "u", plain)], "page_id long, url string, html string"), html.fit(pages)).first().text
    assert text.startswith("head\n\n") and text.count("\n\n") == 2


def test_quality_of_wordless_texts_and_one_grade(spark):
    d = docs(spark, with_extras([prose(20) if i % 2 else "### " + prose(20).replace(" ", "# ") for i in range(80)] + [None, "", " "]))
    ratings = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3000, None)], "doc_id long, grade int")
    rows = quality.Quality(iterations=15).fit(d, ratings).score(d).where("doc_id >= 80").collect()
    assert [(r.expected_grade, r.tail) for r in rows] == [(0.0, [0.0])] * 3
    one = quality.Quality().fit(d, ratings.where("grade = 1")).score(d).collect()
    assert {r.expected_grade for r in one} == {1.0}
    assert {r.expected_grade for r in quality.Quality().fit(d, ratings.limit(0)).score(d.limit(3)).collect()} == {None}
    assert quality.Quality().fit(d, ratings.limit(0)).score(d.limit(0)).count() == 0


def test_quality_gradient_is_that_of_its_likelihood():
    rng = np.random.default_rng(5)
    x, c, w, free = rng.normal(size=(30, 4)), rng.integers(0, 4, 30), rng.normal(size=4), np.array([-1.0, 0.2, -0.3])
    (_, slope, by_free), v = quality.likelihood(x @ w, c, free), np.concatenate((w, free))
    f = lambda v: quality.likelihood(x @ v[:4], c, v[4:])[0]
    near = [(f(v + e) - f(v - e)) / 2e-6 for e in np.eye(7) * 1e-6]
    assert np.allclose(np.concatenate((slope @ x, by_free)), near, atol=1e-4) and (np.diff(quality.ordered(free)) > 0).all()


def test_secrets_of_a_corpus_are_one_family(spark):
    rng = np.random.default_rng(6)
    key = lambda n: "".join(rng.choice(list(secrets.ENCODINGS[5][1]), n))
    keys = [key(32) for _ in range(30)]
    texts = [f"see {k} there" for k in keys] + [f"password={key(40)}", "token: aaaaaaaaaaaaaaaaaaaaaaaa", None, ""] + ["xmlHttpRequestFactoryImpl2Bean and HTTP2SERVERPUSHENABLED"] * 20
    got = {r.doc_id: r for r in secrets.find(docs(spark, with_extras(texts))).collect()}
    assert sum(got[i].spans == f"random:4:{4 + len(keys[i])}" for i in range(30)) >= 27
    assert (got[30].n_random_base, got[31].n_random_base) == (1, 0) and all(got[i].spans == "" for i in range(32, 54))
    assert secrets.find(docs(spark, [])).count() == 0


def test_null_and_repeated_ids_in_components(spark):
    f = [0, 1, 1 << 40 | 1 << 41 | 1 << 42 | 1 << 43 | 1 << 44 | 1 << 45]
    rows = [(5, [f[0]]), (None, [f[1]]), (5, [f[2]]), (9, [f[2]]), (None, [-1]), (None, [f[0]])]
    got = [(r.doc_id, r.fp[0], r.component_id) for r in simhash.link(spark.createDataFrame(rows, "doc_id long, fp array<long>")).collect()]
    assert sorted(got, key=repr) == sorted([(5, 0, 5), (None, 1, 5), (None, 0, 5), (5, f[2], 5), (9, f[2], 5), (None, -1, None)], key=repr)
    assert simhash.link(spark.createDataFrame([], "doc_id long, fp array<long>")).count() == 0
