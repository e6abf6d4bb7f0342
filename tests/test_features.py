"""Keyword matching, bootstraps by counts, worksheets, first rows, audits and plans, against plain versions on small fixtures."""

import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import counts as N
from augury.operators import keywords as K
from augury.operators import records as P
from augury.operators import resampling as B
from augury.plans import resampling
from augury.plans.adapters import leads
from augury.plans.registry import QUERIES

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["match_ladder", "validate_strict", "validate_loose", "validate_summary", "tier_comparison", "best_and_first_event", "in_any_window", "specific_rows", "keyword_fields"])
def test_no_nested_loops(spark, name):
    df = QUERIES[name](spark, D)
    df.collect()
    assert not re.search("CartesianProduct", plan(df))
    loops = re.findall("BroadcastNestedLoopJoin", plan(df))
    assert not loops


def test_keywords_of_entities(spark):
    rows = [("e", "Ever Given (Evergreen)"), ("e", "Port of Los Angeles"), ("e", "Taïwan-Semi"), ("e", None), ("e", "()"), ("e", "steel"), ("f", "(Open bracket")]
    got = {r["event"]: r for r in K.derived(spark.createDataFrame(rows, "event string, value string")).collect()}
    assert got["e"]["phrases"] == ["ever given", "evergreen", "port of los angeles", "steel", "taïwan semi"]
    assert got["e"]["tokens"] == ["angeles", "ever", "evergreen", "given", "semi", "steel", "taïwan"]
    lone = {r["event"]: r["tokens"] for r in K.alone(K.derived(spark.createDataFrame(rows, "event string, value string"))).collect()}
    assert lone["e"] == ["evergreen", "steel"]


def test_specific_rows_equal_a_plain_search(spark):
    rng = np.random.default_rng(1)
    words = ["ever", "given", "evergreen", "never", "everything", "oil", "Öl", "elait", "élait", "lait", "红海", "红海危机", "port-said", "a.b", "suez", "canal", "suezcanal", "x2", "2x"]
    kws = [("e", i, k) for i, k in enumerate(["ever given", "suez canal", "ever", "oil", "lait", "红海", "öl", "海危", "élait", "x2"])] + [("f", i, k) for i, k in enumerate(["port said", "suez", "a b", "危"])]
    rows = [(i, *(" ".join(rng.choice(words, rng.integers(0, 7))) if rng.random() < 0.9 else None for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, url string, name string, geo string").withColumn("key", F.lit("x")).withColumn("mark", F.lit("y"))
    columns = {"url": "url", "name": "actor", "geo": "place"}
    got = {(r["key"], r["event"], r["n"], r["field"], r["keyword"]) for r in K.specific(K.fired(df, "id", columns, spark.createDataFrame(kws, "event string, place int, keyword string")), list(columns.values())).collect()}
    want = set()
    for i, *cells in rows:
        for event in "ef":
            hits = []
            for label, cell in zip(columns.values(), cells, strict=True):
                hay = " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in (cell or "").lower()).split())
                hits += [(label, k) for e, _, k in kws if e == event and re.search(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])", hay)]
            different = {k for _, k in hits}
            if len(different) >= 2 or any(" " in k for k in different):
                want.add((i, event, len(different), *hits[0]))
    assert got == want and len(want) > 50


def test_texts_are_searched_once_and_not_shuffled(spark):
    words = ["ñezll", "mañezll", "ezll", "del", "delé", "éa", "a", "del红", "红del", "海", "öl", "x"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(300)]
    kws = ["ñezll del", "ezll", "a del 红", "ezll del", "del é", "a x del", "红", "红del", "l", "éa a", "x", "öl x", "x öl"]
    f = K.fired(spark.createDataFrame(rows, "id long, t string"), "id", {"t": "t"}, spark.createDataFrame([("e", i, k) for i, k in enumerate(kws)], "event string, place int, keyword string"))
    got = {(r["key"], r["keyword"]) for r in f.collect()}
    assert got == {(i, k) for i, t in rows for k in kws if re.search(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])", t)} and len({k for _, k in got}) > 8
    p = plan(QUERIES["specific_rows"](spark, D))
    assert "regexp_like" not in p.lower() and "rlike" not in p.lower() and "SortMergeJoin" not in p


def test_finds_are_moved_once_by_key(spark):
    rows = [(1, "x oil", "gas"), (1, "gas", None), (2, "oil oil", "oil"), (3, "", "a b"), (4, "lait, élait", "aéb")]
    kws = [("e", 0, "oil"), ("e", 1, "gas"), ("f", 0, "a b"), ("f", 1, "lait"), ("f", 2, "b c d e f")]
    found = K.fired(spark.createDataFrame(rows, "id long, t string, u string"), "id", {"t": "t", "u": "u"}, spark.createDataFrame(kws, "event string, place int, keyword string"))
    assert sorted((r["key"], r["column"], r["keyword"]) for r in found.collect()) == [(1, 0, "gas"), (1, 0, "oil"), (1, 1, "gas"), (2, 0, "oil"), (2, 1, "oil"), (3, 1, "a b"), (4, 0, "lait")]
    out = K.specific(found, ["t", "u"])
    assert {(r["key"], r["event"], r["n"], r["field"], r["keyword"]) for r in out.collect()} == {(1, "e", 2, "t", "oil"), (3, "f", 1, "u", "a b")}
    p = plan(out).split("Initial Plan")[-1]
    assert p.count("MapInArrow") == 1 and p.count("Exchange hashpartitioning") == 1
    assert plan(QUERIES["specific_rows"](spark, D)).split("Initial Plan")[-1].count("documents.parquet") == 1


def test_filters_of_samples(spark):
    df = spark.createDataFrame([("https://x/Red-Sea_ships.html?q",), ("https://x/oil",), (None,)], "url string")
    hay = K.haystack(F.col("url"))
    got = [tuple(r) for r in df.select(K.kept(hay, []), K.kept(hay, ["red sea"]), K.neutral(hay, ["red sea"]), K.hard_negative(hay, ["red sea"], ["oil"])).collect()]
    assert got == [(True, True, False, False), (True, False, True, True), (True, False, True, False)]


def test_means_by_counts_are_distributed_as_those_of_items(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = {g: np.round(rng.normal(i, 1 + i, 40 * (i + 1)), 3) for i, g in enumerate("abc")}
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [("a", None)], "g string, x double")
    monkeypatch.setattr(N, "BLOCK", 8)  # many blocks a group
    got = N.group_means(df, ["g"], F.col("x"), 1000).toPandas()
    again = N.group_means(df.repartition(7), ["g"], F.col("x"), 1000).toPandas()
    assert got.sort_values(["g", "rep"])["mean"].tolist() == again.sort_values(["g", "rep"])["mean"].tolist()  # a job that runs again draws the same
    for g, v in values.items():
        m = got[got["g"] == g]["mean"]
        assert len(m) == 1000 and abs(m.mean() - v.mean()) < 5 * v.std() / np.sqrt(len(v) * 1000) and abs(m.std() * np.sqrt(len(v)) / v.std() - 1) < 0.12
    pooled = N.pooled_means(df, "g", F.col("x"), n=1000).toPandas()["mean"]
    plain = []
    for _ in range(2000):
        s = np.concatenate([rng.choice(values[g], len(values[g])) for g in rng.choice(list("abc"), 3)])
        plain.append(s.mean())
    assert len(pooled) == 1000 and abs(pooled.mean() - np.mean(plain)) < 0.1 and abs(pooled.std() / np.std(plain) - 1) < 0.12


@pytest.mark.parametrize("block", [1 << 12, 1 << 20])
def test_shares_of_counted_events_are_those_of_single_draws(spark, block):
    e = [("a", 300, 2000), ("b", 0, 1), ("c", 9000, 20000), ("d", 9000, 20000)]
    got = {r.rep: r.share for r in B.counted_shares(spark.createDataFrame(e, "event string, k long, n long"), "event", 6, block).collect()}
    for rep in range(6):
        hit = n = 0
        for slot in range(4):
            x = np.array([rep * B.STEP[0] + slot * B.STEP[1] + B.SEED]) % B.PRIME
            _, k, size = e[int(B.permuted(x)[0]) % 4]
            x = (rep * B.STEP[0] + slot * B.STEP[1] + B.SEED + np.arange(size) * B.STEP[2]) % B.PRIME
            hit, n = hit + int((B.permuted(x) % size < k).sum()), n + size
        assert got[rep] == round(hit / n, 6)


def test_intervals_read_stored_tallies(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(resampling, "leads", lambda s, d: calls.append(d) or leads(s, d))
    for name in ("two_stage_intervals", "event_intervals", "model_intervals", "cell_intervals"):
        df = QUERIES[name](spark, D)
        assert len(calls) == 1 and not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]
        calls.clear()


def test_weighted_rows_draw_as_repeated_ones(spark):
    rows = [("a", 0.5, 3), ("a", 0.25, 2), ("b", 1.0, 4), ("b", None, 2)]
    t = spark.createDataFrame(rows, "g string, v double, weight long")
    flat = spark.createDataFrame([(g, v) for g, v, w in rows for _ in range(w)], "g string, v double")
    for f in (lambda df, w: N.group_means(df, ["g"], F.col("v"), 30, weight=w), lambda df, w: N.pooled_means(df, "g", F.col("v"), n=30, weight=w)):
        assert sorted(map(tuple, f(t, F.col("weight")).collect())) == sorted(map(tuple, f(flat, None).collect()))
    assert {(r.g, r.point, r.n) for r in resampling.points(t, ["g"]).collect()} == {("a", 0.4, 5), ("b", 1.0, 6)}


def test_means_of_one_value_have_no_spread(spark):
    df = spark.createDataFrame([("a", "m", 0.25)] * 9 + [("b", "m", 0.25)] * 4 + [("a", "n", -1.5)], "e string, arm string, x double")
    assert {r["mean"] for r in N.pooled_means(df, "e", F.col("x"), ["arm"], 50).where("arm = 'm'").collect()} == {0.25}
    b = N.bounds(N.group_means(df, ["arm", "e"], F.col("x"), 40), ["arm", "e"]).collect()
    assert {(r["arm"], r["e"], r["replicates"], r["lo"], r["hi"]) for r in b} == {("m", "a", 40, 0.25, 0.25), ("m", "b", 40, 0.25, 0.25), ("n", "a", 40, -1.5, -1.5)}


def test_only_changed_events_of_a_sheet_are_written(spark, tmp_path):
    cols = "event string, id long, status string, body string, body_len long, note string, label string"
    old = [("a", 1, "ok_jina", "x", 1, "challenge page", "1"), ("a", 2, "ok", "y", 1, None, None), ("b", 3, "ok", "z", 1, "", "0"), ("c", 4, "ok_jina", "w", 1, "challenge page; no archive copy", "0"), ("c", 5, "title_fallback", "", 0, "", "")]
    path = str(tmp_path / "sheet")
    spark.createDataFrame(old, cols).write.partitionBy("event").parquet(path)
    before = {f.name for f in (tmp_path / "sheet/event=b").iterdir()}
    corpus = spark.createDataFrame([("a", 1, "ok", "new"), ("a", 2, "ok", "y"), ("b", 3, "title_fallback", None), ("c", 4, "title_fallback", ""), ("c", 5, "title_fallback", ""), ("d", 9, "ok", "q")], "event string, id long, status string, body string")
    rows = P.refreshed(spark.read.schema(cols).parquet(path), corpus, ["event", "id"])
    flags = {(r["event"], r["id"]): [t for t in P.TRANSITIONS if r[t]] for r in rows.collect()}
    assert flags == {("a", 1): ["updated", "reopened"], ("a", 2): [], ("b", 3): ["downgraded"], ("c", 4): ["still_closed"], ("c", 5): [], ("d", 9): ["unlisted"]}
    P.write_back(rows, path, "event")
    got = {(r["event"], r["id"]): (r["status"], r["body"], r["body_len"], r["note"], r["label"]) for r in spark.read.schema(cols).parquet(path).collect()}
    assert got == {("a", 1): ("ok", "new", 3, "", ""), ("a", 2): ("ok", "y", 1, None, None), ("b", 3): ("ok", "z", 1, "", "0"), ("c", 4): ("title_fallback", "", 0, "challenge page; no archive copy", "0"), ("c", 5): ("title_fallback", "", 0, "", "")}
    assert {f.name for f in (tmp_path / "sheet/event=b").iterdir()} == before


@pytest.mark.parametrize("n", [0, 1, 7, 50, 500])
def test_first_rows_in_order_with_ties_and_a_hot_part(spark, n):
    rng = np.random.default_rng(4)
    rows = [(int(p), int(o), int(u)) for p, o, u in zip(rng.choice([0, 1, 1, 1, 1, 5], 300), rng.integers(0, 20, 300), rng.integers(0, 120, 300), strict=True)]
    df = P.first_of(spark.createDataFrame(rows + [(0, 0, None)], "part int, o int, url long"), "url", ["part", "o"])
    best = {}
    for p, o, u in rows:
        best[u] = min(best.get(u, (9, 99)), (p, o))
    want = sorted((p, o, u) for u, (p, o) in best.items())[:n]
    got = sorted((r["part"], r["o"], r["url"], r["number"]) for r in P.first_rows(df, "part", ["o", "url"], n).collect())
    assert got == [(*x, i) for i, x in enumerate(want)]


def test_wikitext_with_nested_and_broken_templates(spark):
    texts = ["a {{x|{{y}}|z}} b", "a {{x b", "a }} b {{c}} d", "[[P|q]] '''r'''<ref>{{s}}</ref> t<ref name='u'/>", "{{{{a}}}}", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(P.plain_wikitext(F.col("t"))).collect()]
    assert got == ["a b", "a ", "a b d", "q r t ", " ", None, ""]


def test_audit_of_numbers(spark):
    p = spark.createDataFrame([("a", "n", 1.0), ("a", "p", 0.5), ("a", "q", None), ("b", "n", 2.0), ("c", "n", None)], "key string, metric string, value double")
    f = spark.createDataFrame([("a", "n", 1.0), ("a", "p", 0.52), ("a", "q", None), ("c", "n", 0.0), ("d", "n", 3.0)], "key string, metric string, value double")
    got = {(r["key"], r["metric"]): r["verdict"] for r in P.audited(p, f, {"p": 0.05}).collect()}
    assert got == {("a", "n"): "match", ("a", "p"): "match", ("a", "q"): "match", ("b", "n"): "not_recomputed", ("c", "n"): "differs", ("d", "n"): "not_published"}


def test_slots_are_seeded(spark):
    plan_ = lambda wanted, seed=42: [tuple(r) for r in P.sampled_slots(spark, "2024-01-01", 30, ["00", "12"], wanted, seed=seed).orderBy("place").collect()]
    assert plan_(100) == plan_(100) != plan_(100, 7) and len(plan_(1)) == 5 and len(plan_(700)) == 9 and len(plan_(10**6)) == 80
    assert {d for _, d, _ in plan_(10**6)} <= {date(2024, 1, d) for d in range(1, 31)} and {s for *_, s in plan_(10**6)} == {"00", "12"}


def test_reports_and_sheets_are_written_as_read(spark, tmp_path):
    from augury.operators import reports as T

    df = spark.createDataFrame([("a", 0.123456, None), ("é", None, "x, \"y\"\nz")], "id string, v double, note string")
    T.write_report(df, str(tmp_path / "r"), 3)
    lines = [f.read_text(encoding="utf-8").splitlines() for f in (tmp_path / "r").glob("part-*")]
    assert [sorted(x) for x in lines] == [['{"id":"a","v":0.123,"note":null}', '{"id":"é","v":null,"note":"x, \\"y\\"\\nz"}']]
    T.write_worksheet(df, str(tmp_path / "w"), ["id", "note", "label"])
    (file,) = (tmp_path / "w").glob("part-*")
    text = file.read_bytes().decode("utf-8")
    assert text.startswith("﻿id,note,label\n") and "é," in text and '"x, ""y""\nz"' in text
    from augury.sources import io

    rows = [tuple(r) for r in io.worksheets(spark, str(tmp_path / "w") + "/part-*", ["id", "note", "label"]).orderBy("row").select("id", "note", "label").collect()]
    assert rows == [("a", "", ""), ("é", 'x, "y"\nz', "")]


def test_prompts_of_broken_templates(spark):
    from augury.operators import reports as T

    rows = [("## System Prompt\ns\n## User Prompt\n{1}|{2}", "x", None), ("no sections", "x", "y"), (None, "x", "y")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a string, b string").orderBy("i")
    got = [tuple(r) for r in df.select(*T.prompt(F.col("t"), [F.col("a"), F.col("b")])).collect()]
    assert got == [("s", "x|"), ("", ""), (None, None)]
