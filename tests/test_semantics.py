"""Known cases of the matching rules, calibration and text functions."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.operators import attribution as T
from augury.operators import corpus as C
from augury.operators import decision as D
from augury.operators import history as H
from augury.operators import match as M
from augury.operators import metrics as A
from augury.operators import resampling as B
from augury.operators import worksheets as W
from augury.plans import learning
from augury.sources import io


@pytest.mark.parametrize(("a", "b", "substring", "words"), [("christopher steele", "steel", True, False), ("ever", "everything", True, False), ("UAW", "United Auto Workers", False, True), ("GM", "General Motors", False, True), ("Suez", "Suez Canal", True, True), ("  ", "anything", True, False)])
def test_match_traps(spark, a, b, substring, words):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert tuple(df.select(M.is_substring(F.col("a"), F.col("b")), M.is_words(F.col("a"), F.col("b"))).first()) == (substring, words)


def test_match_counts_pass_over_nulls(spark):
    df = spark.createDataFrame([(["x", None, ""], ["X", "y", None]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(M.hits(F.col("a"), F.col("b"), M.is_substring)).collect()] == [1, 0]


@pytest.mark.parametrize(("rows", "expected"), [([(0.05, False)] * 10 + [(0.15, True)] * 2 + [(0.15, False)] * 8 + [(0.95, True)] * 9 + [(0.95, False)], 0.05), ([(0.9, False)] * 9 + [(0.9, True)], 0.8)])
def test_ece(spark, rows, expected):
    df = spark.createDataFrame(rows, "conf double, is_tp boolean")
    assert A.ece(df).first().ece == pytest.approx(expected, abs=1e-6)


def test_bin_edges_are_literals(spark):
    df = spark.createDataFrame([(i / 10, True) for i in range(11)], "conf double, is_tp boolean")
    assert {r.bin: r.n for r in A.bins(df).collect()} == {i: 1 + (i == 9) for i in range(10)}


def test_auc_and_average_precision_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), bool(y)) for s, y in zip(rng.integers(0, 40, 300) / 7, rng.integers(0, 2, 300), strict=True)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    expected = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert A.auc(df, "s", F.col("y")).first().auc == pytest.approx(expected, abs=1e-6) and A.auc(df, "s", ~F.col("y")).first().auc == pytest.approx(1 - expected, abs=1e-6)
    ap = sum(sum(y for s, y in rows if s == x) / len(pos) * np.mean([y for s, y in rows if s >= x]) for x in {s for s, _ in rows})
    assert A.average_precision(df, "s", "y").first().ap == pytest.approx(ap, abs=1e-6)


def test_strict_and_loose_hits_of_one_event(spark):
    """Made-up signals of one event, with the outcome that the rules publish for them."""
    rows = [
        ("S1", "2023-11-05", "forward_looking", ["oil"], ["Red Sea"], ["Maersk"]), ("S2", "2023-10-20", "latent", ["containerized goods"], ["Suez Canal"], []),
        ("S2b", "2023-10-15", "forward_looking", ["coffee"], ["Brazil"], ["Maersk"]), ("S3", "2023-11-10", "confirmation", ["oil"], ["Red Sea"], []),
        ("S4", "2023-11-25", "forward_looking", ["oil"], ["Red Sea"], []), ("S5", "2023-11-01", "forward_looking", ["coffee"], ["Brazil"], []), ("S6", "2023-04-01", "forward_looking", ["oil"], ["Red Sea"], []),
    ]
    signals = spark.createDataFrame(rows, "id string, day string, label string, good array<string>, geo array<string>, co array<string>").withColumn("day", F.to_date("day"))
    truth = spark.createDataFrame([("red_sea", "2023-11-19", ["oil", "LNG"], ["Red Sea", "Suez", "Yemen"], ["Maersk", "MSC"])], "event string, onset string, t_good array<string>, t_geo array<string>, t_co array<string>").withColumn("onset", F.to_date("onset"))
    s = M.with_verdicts(signals.where(F.col("label").isin(*X.FORWARD)), truth, "id", ["co", "geo", "good"], ["t_co", "t_geo", "t_good"])
    lead = X.lead_days(F.col("onset"), F.col("day"))
    j = s.join(truth, lead.between(1, 180)).withColumn("lead", lead)
    n = {c: M.matched_values(F.col(f"t_{c}"), F.col("m")[i]["sub"]) > 0 for i, c in enumerate(("co", "geo", "good"))}
    strict = {r.id: r.lead for r in j.where(n["co"] | (n["geo"] & n["good"])).collect()}
    loose = {r.id for r in j.where(n["co"] | n["geo"] | n["good"]).collect()}
    assert strict == {"S1": 14, "S2b": 35} and loose == {"S1", "S2", "S2b"}


def test_verdicts_are_those_of_the_pairs(spark):
    a = [["UAW", "steel  mill", " ", None, ""], ["christopher steele"], ["Gm"], None, []]
    b = [["United Auto Workers", "steel", "steel"], ["General Motors", "every thing", "é"]]
    s = spark.createDataFrame(list(enumerate(a)), "id int, v array<string>")
    t = spark.createDataFrame(list(enumerate(b)), "t int, w array<string>")
    pairs = (("x_sub", M.is_substring), ("x_loose", M.is_loose), ("x_word", M.is_words))
    rows = M.with_verdicts(s, t, "id", ["v"], ["w"]).crossJoin(t).select("id", "t", *[M.matched_values(F.col("w"), F.col("m")[0][k]).alias(k) for k in M.TESTS], *[M.hits(F.col("v"), F.col("w"), f).alias(n) for n, f in pairs]).collect()
    assert all((r["sub"], r["loose"], r["word"]) == (r.x_sub, r.x_loose, r.x_word) for r in rows) and any(r.loose > r["sub"] for r in rows)


def test_costs_by_hand(spark):
    rows = [("a", 0.9, True, 60), ("a", 0.4, False, 10), ("b", 0.8, False, 5), ("c", 0.3, True, 30), ("d", 0.1, False, 1)]
    df = spark.createDataFrame(rows, "event string, conf double, is_tp boolean, lead int")
    grid = [0.35, 0.85, 0.95]
    events = df.select("event").distinct()
    t = {r.theta: r.cost for r in D.costs(D.pooled(D.fired(df, grid), events, grid)).collect()}
    left = 1 - 0.8 * (1 - math.exp(-1))
    assert t[0.35] == pytest.approx(0.5 * (2 / 3 * 0.05 + 1 / 3 * left) + 0.5) and t[0.85] == pytest.approx(0.25 * left + 0.75) and t[0.95] == 1.0
    # Without b, only a fires: at 0.35 a hit and a false alarm, at 0.85 the hit alone.
    best = {r.event: (r.theta, r.fired) for r in D.held_out_choice(D.fired(df, grid), events, grid).collect()}
    assert best["b"] == ((0.35, 1) if 0.5 * 0.05 + 0.5 * left < left else (0.85, 0)) and best["a"][0] == 0.35
    assert [r[0] for r in spark.createDataFrame([(5, 0), (-1, 0), (1, -3), (-3, -2)], "t int, f int").select(D.break_even(F.col("t"), F.col("f"))).collect()] == [math.inf, math.inf, 0.0, 1.5]


def test_two_stage_bootstrap_covers_the_share(spark):
    df = spark.createDataFrame([(i % 12, i % 3 == 0) for i in range(600)], "event int, is_tp boolean")
    r = B.interval(B.two_stage_shares(df, "event", "is_tp", 400), "share").first()
    assert r.n == 400 and r.lo < 1 / 3 < r.hi and 0.02 < r.hi - r.lo < 0.6


def test_logistic_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) * [1, 5] + [0, 3]
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y int, g int")
    got = {r.feature: r.coef for r in H.coefficients(df, ["a", "b"], "y").collect()}
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(60)]
    w, penalty = np.zeros(3), np.diag([1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    assert got["a"] == pytest.approx(w[0], abs=1e-7) and got["b"] == pytest.approx(w[1], abs=1e-7)
    assert H.held_out_scores(df, ["a", "b"], "y", "g").count() == 60
    assert {r.score for r in H.held_out_scores(df.where("g < 2").limit(5), ["a"], "y", "g").collect()} == {0.5}


SMALL = "/root/testdata/sf0.001"


def plain_scores(x, y, groups, least=10):
    """Held-out scores group by group, by plain Newton steps."""
    out = np.full(len(y), 0.5)
    for g in set(groups):
        own = np.array([v == g for v in groups])
        a, b = x[~own], y[~own]
        if len(b) < least or len(set(b)) < 2:
            continue
        sd = a.std(0)
        sd[sd == 0] = 1
        z = np.c_[(a - a.mean(0)) / sd, np.ones(len(a))]
        w, penalty = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - b) + penalty @ w)
        out[own] = 1 / (1 + np.exp(-np.c_[(x[own] - a.mean(0)) / sd, np.ones(own.sum())] @ w))
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_held_out_scores_are_those_of_single_fits(spark, block):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(90, 2)) * [1, 500] + [0, 90000], np.full(90, 3.0)]
    y = (x[:, 0] + rng.normal(size=90) > 0.5).astype(int)
    g = [None if i % 7 == 0 else f"g{i % 7}" for i in range(90)]
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), g[i]) for i in range(90)], "i int, a double, b double, c double, y int, g string")
    got = {r.i: r.score for r in H.held_out_scores(df, ["a", "b", "c"], "y", "g", block=block).collect()}
    assert [got[i] for i in range(90)] == pytest.approx(plain_scores(x, y, g).tolist(), abs=1e-6)


def test_held_out_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (2.0, None, "a"), (3.0, 1, "b"), (1.0, 0, "b"), (0.0, 0, None)], "v double, y int, g string")
    got = H.held_out_scores(df, ["v"], "y", "g", least=1).collect()
    assert len(got) == 5 and all(0 < r.score < 1 for r in got)
    assert H.held_out_scores(df.limit(0), ["v"], "y", "g").count() == 0
    assert {r.coef for r in H.coefficients(df.limit(0), ["v"], "y").collect()} == {0.0}


def test_ranking_is_fitted_on_stored_features(spark, monkeypatch):
    read, fit = [], H.coefficients
    monkeypatch.setattr(H, "coefficients", lambda df, *a: read.append(df.inputFiles()) or fit(df, *a))
    assert learning.coefficient_ranking(spark, SMALL).count() == 8
    assert read[0] and not [f for f in read[0] if "lineitem" in f or "orders" in f]


def test_coefficients_of_one_size_are_ranked_by_name(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), -float(i), i % 3 == 0) for i in range(9)], "a double, b double, y boolean").withColumn("y", F.col("y").cast("int"))
    for w in ([0.25, -0.25 - 1e-15, 0.0], [0.25 + 1e-15, -0.25, 0.0]):
        monkeypatch.setattr(H, "penalised_fits", lambda *a, w=w: np.array([w]))
        assert [r.feature for r in H.coefficients(df, ["a", "b"], "y").collect()] == ["a", "b"]
        assert [r.feature for r in H.coefficients(df, ["a", "b"], "y", top=1).collect()] == ["a"]


def test_scored_rows_are_not_moved(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(rng.normal()), i % 2, None if i % 17 == 0 else i % 17) for i in range(200)], "i int, v double, y int, g int").where("i >= 0")
    got = H.held_out_scores(df, ["v"], "y", "g")
    assert sorted(r.i for r in got.collect()) == list(range(200))
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p


def test_registered_scores_are_those_of_single_fits(spark):
    h, names = learning.featured(spark, SMALL)
    rows = h.where("pool = 0").collect()
    x = np.array([[float(r[c]) for c in names] for r in rows])
    want = plain_scores(x, np.array([r.y for r in rows]), [r.event for r in rows])
    got = sorted((r.event, r.sid, r.y, r.score) for r in learning.loeo_scores(spark, SMALL).collect())
    for a, b in zip(got, sorted((r.event, r.sid, r.y, s) for r, s in zip(rows, want, strict=True)), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-6)


def test_recoverability_is_that_of_single_fits(spark):
    s = A.pre_onset(learning.leads(spark, SMALL)).where("forward").toPandas()
    e = s.groupby("event").apply(lambda x: pd.Series({"conf": x.conf.mean(), "sev": x.sev.mean(), "g": x.g.mean(), "part": x.forward.mean(), "n": len(x), "y": int(((x.arm == "O") & x.is_tp).sum() > ((x.arm == "F") & x.is_tp).sum())}), include_groups=False)
    e = e[e.n >= 3].astype(float)
    want = plain_scores(e[["conf", "sev", "g", "part", "n"]].to_numpy(), e.y.to_numpy(), list(e.index), least=1)
    got = {r.event: (r.y, r.score) for r in learning.schema_recoverability(spark, SMALL).collect()}
    assert sorted(got) == sorted(e.index)
    assert [got[k][0] for k in e.index] == e.y.tolist() and [got[k][1] for k in e.index] == pytest.approx(want.tolist(), abs=2e-6)


def test_history_over_months(spark):
    rows = [("e", i, f"2024-{1 + i // 3:02d}-{1 + i % 3:02d}", float(i)) for i in range(9)] + [("f", 1, "2024-01-01", 2.0)]
    df = spark.createDataFrame(rows, "k string, i int, d string, v double").withColumn("d", F.to_date("d"))
    got = {(r.k, r.i): (r.prior_count, r.days_since, r.mv) for r in H.history(df, "k", "d", "i", {"v": "mv"}).collect()}
    assert got["e", 0] == (0, 0, 0.0) == got["f", 1] and got["e", 3] == (3, 29, 1.0) and got["e", 8] == (8, 1, 3.5)


def test_fits_and_scores_read_stored_features(spark):
    h, _ = learning.featured(spark, SMALL)
    assert h.count() > 0 and not [f for f in h.inputFiles() if "lineitem" in f or "orders" in f]
    assert not [f for f in learning.frame_separability(spark, SMALL).inputFiles() if "lineitem" in f or "orders" in f]


def test_features_of_tied_rows_do_not_go_by_the_order_of_the_table(spark, tmp_path):
    orders = spark.createDataFrame([(1, 5, "1996-03-01")], "o_orderkey long, o_custkey long, d string").select("o_orderkey", "o_custkey", F.to_timestamp("d").alias("o_orderdate"))
    lines = [(1, 1, 8.0 + i, 0.01 * (i + 1), "RAN"[i % 3], "OF"[i % 2], "1996-02-20") for i in range(6)] + [(1, 3, 7.0, 0.05, "R", "F", "1996-02-20")]
    got = []
    for name, rows in (("a", lines), ("b", lines[::-1])):
        orders.write.parquet(str(tmp_path / name / "orders.parquet"))
        i = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, d string").coalesce(1)
        i.withColumn("l_shipdate", F.to_timestamp("d")).drop("d").write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got.append(sorted(map(tuple, learning.causal_features(spark, str(tmp_path / name)).collect())))
    assert len(got[0]) == 7 and got[0] == got[1]


def test_first_window_wins(spark):
    e = spark.createDataFrame([("x", 2, "2024-01-01"), ("y", 1, "2024-01-03"), ("z", 3, None)], "event string, o int, s string").withColumn("s", F.to_date("s"))
    r = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in (1, 2, 3, 5, 9)] + [(None,)], "day string").withColumn("day", F.to_date("day"))
    got = [(str(x.day)[-2:], x.event) for x in T.attributed(r, "day", T.first_windows(e, "event", "o", "s", 2), "event", "UNMATCHED").orderBy("day").collect()]
    assert got == [("ne", "UNMATCHED"), ("01", "x"), ("02", "x"), ("03", "y"), ("05", "y"), ("09", "UNMATCHED")]


@pytest.mark.parametrize(("raw", "signals"), [('{"signals": []}', True), ('```json\n{"signals": [1]}\n```', True), ('<think>{x}</think>{"signals": []}', True), ('text {"signals": []} more', True), ("no braces", None), ("{}", False)])
def test_answers(spark, raw, signals):
    j = X.answer_json(F.col("raw"))
    r = spark.createDataFrame([(raw,)], "raw string").select(j.alias("j"), X.missing_keys(j, ["signals"]).alias("m")).first()
    assert (None if r.j is None else "signals" not in r.m) == signals


# What each cell of a judged sheet, date of a record and text of a page or record stands for.
LABELS = [("Yes", 1), (" TRUE ", 1), ("1.0", 1), ("relevant", 1), ("n", 0), ("Not Relevant", 0), ("0", 0), ("maybe", None), ("", None), (None, None)]
DATES = [("2024-02-29T10:00:00Z", "2024-02-29"), ("2023-02-29", "None"), ("20240101", "None"), ("2024-1-1", "None"), ("", "None"), (None, "None")]
MARKUP = [
    ("<p>A &amp; B&nbsp;&lt;c&gt;</p>", "A & B <c>"), ("x &#8212; &#x263A;&notaname; &copy", "x \u2014 \u263a¬aname; ©"), ("<SCRIPT>a&amp;b</SCRIPT>left<style>\nx</style> right", "left right"),
    ("no markup", "no markup"), ("&amp;lt;", "&lt;"), ("", ""), (None, None),
]
PHRASES = [("AT&T", "at&t said", True), ("AT&T", "at t said", True), ("red-sea", "the Red Sea.", True), ("oil", "boil oils", False), ("oil", "(OIL)", True), ("!?", "what!?", False), ("oil", None, None)]


def test_cells_dates_markup_and_words(spark):
    for f, pairs in ((X.label, LABELS), (lambda c: X.parse_date(c).cast("string"), DATES), (X.html_text, MARKUP), (X.plain_words, [("  Red-Sea_Crisis, 红海 2!", "red sea crisis 红海 2"), ("...", ""), (None, None)])):
        got = [r[0] for r in spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string").orderBy("i").select(f(F.col("a"))).collect()]
        assert got == [None if b == "None" else b for _, b in pairs]


@pytest.mark.parametrize(("phrase", "text", "found"), PHRASES)
def test_phrases_with_punctuation(spark, phrase, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(X.has_phrase(F.col("t"), phrase)).first()[0] is found


def test_first_wins(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, None), ("k", 1, "z"), (None, 5, "n")], "k string, o int, v string")
    assert {r.k: r.v for r in C.first_wins(df, "k", ["o", "v"]).collect()} == {"k": None, None: "n"}


def test_slug(spark):
    df = spark.createDataFrame([("http://a.b/c/red-sea_crisis.html?x=1#t",), ("http://a.b/c/d/",)], "u string")
    assert [r[0] for r in df.select(X.slug_title(F.col("u"))).collect()] == ["red sea crisis", "d"]


def test_faithfulness_without_phrases_or_text(spark):
    df = spark.createDataFrame([(["Oil"], "crude oil"), ([], "x"), (["a"], None), (None, "x")], "p array<string>, t string")
    assert [r[0] for r in df.select(X.faithfulness(F.col("p"), F.col("t"), 1.0)).collect()] == [1.0, 1.0, 0.0, 1.0]


def test_wilson_holds_the_share(spark):
    r = A.with_wilson(spark.createDataFrame([(3, 10), (0, 0)], "tp long, n long")).orderBy("n").collect()
    assert r[0].lo is None and r[1].lo < 0.3 < r[1].hi


def test_signal_reader_drops_sentinels(spark, tmp_path):
    rows = [{"signal_id": "1", "temporality": "latent", "companies": [{"name": "A", "role": "buyer"}]}, {"input_id": "x", "status": "empty"}, {"input_id": "y", "status": "error", "error": "e"}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    assert [(r.signal_id, r.companies) for r in io.signals(spark, str(tmp_path / "s.jsonl")).collect()] == [("1", ["A"])]


def test_last_wins_and_best_body(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, None)], "k string, o int, v string")
    assert {r.k: r.v for r in C.last_wins(df, "k", ["o"]).collect()} == {"k": "b", "m": None}
    b = spark.createDataFrame([("k", 900, True, 1), ("k", 300, False, 2), ("k", 300, False, 3)], "k string, n int, junk boolean, o int")
    assert C.best_body(b, "k", F.col("junk"), F.col("n"), "o").first().o == 2


def test_backfill_needs_every_key(spark):
    source = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    rows = spark.createDataFrame([(1, " "), (2, "z"), (1, None)], "k int, v string")
    assert sorted(r.v for r in W.backfilled(rows, source, "k", "v").collect()) == ["x", "x", "z"]
    with pytest.raises(Exception, match="no source row"):
        W.backfilled(spark.createDataFrame([(3, "kept")], "k int, v string"), source, "k", "v").collect()


def test_day_slots_of_empty_ranges(spark):
    r = spark.sql("select * from values ('a', date'2024-01-01', date'2024-01-03'), ('b', date'2024-01-05', date'2024-01-05'), ('c', date'2024-01-05', date'2024-01-01'), ('d', null, date'2024-01-01') as t(k, s, e)")
    assert [x.stamp for x in W.day_slots(r, "s", "e", ("00", "12")).orderBy("stamp").collect()] == ["2024010100", "2024010112", "2024010200", "2024010212"]
    assert W.day_plan(r, "k", "s", "e").count() == 2


def test_extended_sample_keeps_judged_rows(spark):
    rows = spark.createDataFrame([("e", i, i < 5) for i in range(20)] + [("f", 100 + i, True) for i in range(3)], "event string, sid int, hit boolean")
    out = W.extended_sample(rows, rows.where("sid in (0, 19)"), "event", "sid", F.col("hit"), 3, 6).collect()
    e = [r for r in out if r.event == "e"]
    assert len(e) == 6 and {r.sid for r in e if r.adjudicated} == {0, 19} and sum(r.sid < 5 for r in e if not r.adjudicated) == 3
    assert len(out) == 9


def test_best_fetch(spark):
    rows = [("a", "fail", 900, 1), ("a", "ok", 10, 2), ("a", "ok_archive", 20, 3), ("b", "fail", 1, 5), ("b", "fail", 9, 6)]
    out = {r.k: r.n for r in W.best_fetch(spark.createDataFrame(rows, "k string, status string, size int, n int"), "k", "status", "size", "n").collect()}
    assert out == {"a": 3, "b": 5}


def test_paired_gain_counts_ids_once(spark):
    a = spark.createDataFrame([("e", 1), ("e", 1), ("e", 2)], "event string, id int")
    b = spark.createDataFrame([("e", 2), ("e", 3), ("f", 4)], "event string, id int")
    assert sorted(map(tuple, W.paired_gain(a, b, "event", "id").collect())) == [("e", 2, 2, 1, 1, 0), ("f", 0, 1, 0, 1, 1)]


def test_numbers_per_day(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("day"), "id")
    got = {r.id: r.seq for r in W.numbered_per_day(rows, "day", ["id"], "id", 7).collect()}
    assert got == {i: i // 2 + 1 for i in range(1000)}
