"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.operators import corpus as C
from augury.operators import match as M
from augury.operators import metrics as A
from augury.plans.adapters import LEADS, SIGNALS, TRUTH, leads, signals, table, truth
from augury.plans.catalog import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

COLUMNS, TRUTH_COLUMNS = ["companies", "geographies", "commodities"], ["t_companies", "t_geographies", "t_commodities"]


def pairs(s: DataFrame, t: DataFrame, days: int) -> DataFrame:
    """Records (day, m) with each event they precede by up to ``days``, and every rule's verdict. The events' windows are spread to days, so the join is an equality; what no value matches needs no rule."""
    w = t.withColumn("window_day", F.explode(F.sequence(F.date_sub("onset", days), F.date_sub("onset", 1))))
    j = s.join(w, F.col("day") == F.col("window_day")).drop("window_day").withColumn("lead", X.lead_days(F.col("onset"), F.col("day")))
    j = j.withColumns({f"{k}_{v[0]}": F.when(F.col("m").isNull(), 0).otherwise(M.matched_values(F.col(n), F.col("m")[i][v])) for i, (k, n) in enumerate(zip(("co", "geo", "good"), TRUTH_COLUMNS, strict=True)) for v in M.TESTS})
    rules = {r: M.rule(r, *(F.col(f"{k}_{'l' if r.startswith('R0') else 'w'}") for k in ("co", "geo", "good")), F.col("axis")) for r in M.RULES}
    exact = {"loose": (F.col("co_s") > 0) | (F.col("geo_s") > 0) | (F.col("good_s") > 0), "strict": (F.col("co_s") > 0) | ((F.col("geo_s") > 0) & (F.col("good_s") > 0))}
    return j.withColumns(rules | exact)


def matched(spark: SparkSession, d: str, days: int = 180) -> DataFrame:
    """``pairs`` of the forward signals one by one."""
    t = truth(spark, d)
    return pairs(M.with_verdicts(signals(spark, d).where(F.col("temporality").isin(*X.FORWARD)), t, "event_id", COLUMNS, TRUTH_COLUMNS), t, days)


def matched_classes(spark: SparkSession, d: str, days: int = 180) -> DataFrame:
    """``pairs`` of the forward signals' classes: signals of one day and the same names match alike, so they meet the events once, with their number as ``weight``."""
    s, t = signals(spark, d).where(F.col("temporality").isin(*X.FORWARD)), truth(spark, d)
    c = s.groupBy("day", *COLUMNS).agg(F.count("*").alias("size"))
    found = M.with_verdicts(c.withColumn("class", F.md5(F.to_json(F.struct("day", *COLUMNS)))), t, "class", COLUMNS, TRUTH_COLUMNS)
    return pairs(found.groupBy("day", "m").agg(F.sum("size").alias("weight")).withColumn("class", F.md5(F.to_json(F.struct("day", "m")))), t, days)


def weight_if(c: Column) -> Column:
    """Signals of the classes where ``c`` holds."""
    return F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))


def padded(c: str) -> str:
    return f"(' ' || trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def sub(a: str, b: str) -> str:
    return f"coalesce(contains(lower(trim({a})), lower(trim({b}))) or contains(lower(trim({b})), lower(trim({a}))), false)"


def acronym(a: str, b: str) -> str:
    words = f"string_split(trim({padded(b)}), ' ')"
    return f"(regexp_full_match(lower(trim({a})), '[a-z]{{2,6}}') and len({words}) >= 2 and array_to_string([x[1] for x in {words}], '') = lower(trim({a})))"


def loose(a: str, b: str) -> str:
    return f"coalesce({sub(a, b)} or {acronym(a, b)} or {acronym(b, a)}, false)"


def word(a: str, b: str) -> str:
    return f"coalesce(contains({padded(a)}, {padded(b)}) or contains({padded(b)}, {padded(a)}) or {acronym(a, b)} or {acronym(b, a)}, false)"


MATCHED = f"""{SIGNALS}, {TRUTH}, pairs as (select *, date_diff('day', day, onset) as lead, {sub("co", "t_co")} as co_s, {sub("geo", "t_geo")} as geo_s, {sub("good", "t_good")} as good_s, {loose("co", "t_co")} as co_l, {loose("geo", "t_geo")} as geo_l, {loose("good", "t_good")} as good_l, {word("co", "t_co")} as co_w, {word("geo", "t_geo")} as geo_w, {word("good", "t_good")} as good_w
 from signals join truth on date_diff('day', day, onset) between 1 and 180 where temporality in ('forward_looking', 'latent')),
 matched as (select *, co_s or geo_s or good_s as loose, co_s or (geo_s and good_s) as strict, co_l or geo_l or good_l as r0, co_w or geo_w or good_w as r1, co_w or (geo_w and good_w) as r2, co_w as r3, co_w or (axis <> 'company' and geo_w and good_w) as r4 from pairs)"""


@query(f"with {MATCHED} select 'R' || r as rule, count(*) as n, sum(cast(ok as int)) as tp, count(distinct case when ok then truth_id end) as events_hit from (select truth_id, unnest([0,1,2,3,4]) as r, unnest([r0, r1, r2, r3, r4]) as ok from matched) group by r")
def match_ladder(spark, d):
    """Matches and events hit under each rule, from one pass over the pairs."""
    m = matched_classes(spark, d).select("truth_id", "weight", F.explode(F.array(*[F.struct(F.lit(r[:2]).alias("rule"), F.col(r).alias("ok")) for r in M.RULES])).alias("x")).select("truth_id", "weight", "x.*")
    return m.groupBy("rule").agg(F.sum("weight").alias("n"), weight_if(F.col("ok")).alias("tp"), F.count_distinct(F.when(F.col("ok"), F.col("truth_id"))).alias("events_hit"))


def validated(spark, d, mode):
    t = truth(spark, d).select("truth_id", "onset")
    m = matched_classes(spark, d).where(F.col(mode)).groupBy("truth_id").agg(F.sum("weight").alias("n"), F.min("day").alias("earliest"))
    j = t.join(m, "truth_id", "left")
    return j.select("truth_id", F.col("n").isNotNull().alias("hit"), F.coalesce("n", F.lit(0)).alias("n"), F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), X.lead_days(F.col("onset"), F.col("earliest")).cast("long").alias("lead"))


VALIDATED = "with {m} select truth_id, n is not null as hit, coalesce(n, 0) as n, strftime(earliest, '%Y-%m-%d') as earliest, date_diff('day', earliest, onset) as lead from truth left join (select truth_id, count(*) as n, min(day) as earliest from matched where {w} group by truth_id) using (truth_id)"


@query(VALIDATED.format(m=MATCHED, w="strict"))
def validate_strict(spark, d):
    return validated(spark, d, "strict")


@query(VALIDATED.format(m=MATCHED, w="loose"))
def validate_loose(spark, d):
    return validated(spark, d, "loose")


@query(f"with {MATCHED}, v as ({VALIDATED.format(m='x as (select 1)', w='strict')[len('with x as (select 1) '):]}), s as (select list_sort(list(lead) filter (hit)) as l, count(*) as n_events, sum(cast(hit as int)) as n_hit from v) select n_events, n_hit, round(n_hit / n_events, 3) as hit_rate, l[len(l) // 2 + 1] as median_lead, (select count(distinct event_id) from matched where strict) as n_matched, (select count(distinct event_id) from matched) as n_in_window, round((select count(distinct event_id) from matched where strict) / (select count(distinct event_id) from matched), 6) as prec from s")
def validate_summary(spark, d):
    """Hit rate, upper median lead and precision."""
    v = validate_strict(spark, d).agg(F.count("*").alias("n_events"), F.sum(F.col("hit").cast("int")).alias("n_hit"), F.array_sort(F.collect_list("lead")).alias("l"))  # one lead per event
    c = matched_classes(spark, d).groupBy("class").agg(F.bool_or("strict").alias("ok"), F.first("weight").alias("weight"))
    p = c.agg(weight_if(F.col("ok")).alias("n_matched"), F.sum("weight").alias("n_in_window"))
    both = v.unionByName(p, allowMissingColumns=True)  # two rows
    return both.agg(*[F.first(c, True).alias(c) for c in both.columns]).select("n_events", "n_hit", F.round(F.col("n_hit") / F.col("n_events"), 3).alias("hit_rate"), F.expr("l[size(l) div 2]").alias("median_lead"), "n_matched", "n_in_window", F.round(F.col("n_matched") / F.col("n_in_window"), 6).alias("prec"))


@query(f"with {MATCHED} select truth_id, case when co_w then 'company' when geo_w and good_w then 'geo+commodity' when good_w then 'commodity_only' when geo_w then 'geo_only' else 'no_match' end as basis, count(*) as n from matched group by all")
def evidence_breakdown(spark, d):
    return matched_classes(spark, d).groupBy("truth_id", M.basis(F.col("co_w"), F.col("geo_w"), F.col("good_w")).alias("basis")).agg(F.sum("weight").alias("n"))


@query(f"with {MATCHED} select truth_id, sum(cast(r0 as int)) as r0, sum(cast(r4 as int)) as r4, sum(cast(r0 as int)) - sum(cast(r4 as int)) as dropped from matched group by truth_id")
def r0_minus_r4(spark, d):
    r = {k: weight_if(F.col(n)) for k, n in (("r0", M.RULES[0]), ("r4", M.RULES[4]))}
    return matched_classes(spark, d).groupBy("truth_id").agg(r["r0"].alias("r0"), r["r4"].alias("r4"), (r["r0"] - r["r4"]).alias("dropped"))


@query(f"with {MATCHED}, b as (select event_id, max(lead) as lead, bool_or(loose) as any_match, arg_min(truth_id, ev_ord) filter (loose) as first_truth from matched group by event_id) select cast(first_truth is not null as boolean) as has, first_truth, count(*) as n, sum(lead) as lead_sum from b group by all")
def best_and_first_event(spark, d):
    """Signals by their first matching event in truth order, with the largest lead of any event."""
    b = matched_classes(spark, d).groupBy("class").agg(F.first("weight").alias("weight"), F.max("lead").alias("lead"), F.min_by("truth_id", F.when(F.col("loose"), F.col("ev_ord"))).alias("f"), F.bool_or("loose").alias("has"))
    return b.groupBy("has", F.when(F.col("has"), F.col("f")).alias("first_truth")).agg(F.sum("weight").alias("n"), F.sum(F.col("lead") * F.col("weight")).alias("lead_sum"))


@query(f"with {SIGNALS}, {TRUTH} select count(*) as n, sum(cast(exists (select 1 from truth where date_diff('day', day, onset) between 1 and 3) as int)) as n_in from signals where temporality in ('forward_looking', 'latent')")
def in_any_window(spark, d):
    """Signals inside any event's window: signals are counted by day, and days meet the windows' days."""
    s, t = signals(spark, d).where(F.col("temporality").isin(*X.FORWARD)), truth(spark, d)
    inside = t.select(F.explode(F.sequence(F.date_sub("onset", 3), F.date_sub("onset", 1))).alias("day")).distinct().withColumn("inside", F.lit(True))
    return s.groupBy("day").agg(F.count("*").alias("n")).join(inside, "day", "left").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in"))


# ---- scored signals at scale


@query(f"with {LEADS} select case when lead > 0 and lead <= 7 then '1-7' when lead > 7 and lead <= 30 then '8-30' when lead > 30 and lead <= 90 then '31-90' when lead > 90 and lead <= 180 then '91-180' end as stratum, count(*) as n, sum(cast(is_tp as int)) as tp from leads group by all")
def lead_strata(spark, d):
    return leads(spark, d).groupBy(X.stratum(F.col("lead")).alias("stratum")).agg(F.count("*").alias("n"), F.sum(F.col("is_tp").cast("int")).alias("tp"))


@query(f"with {LEADS} select event, sum(cast(lead between 1 and 180 as int)) as pre, sum(cast(lead between -14 and -1 as int)) as post, sum(cast(lead = 0 as int)) as onset_day from leads group by event")
def lead_window_counts(spark, d):
    n = lambda c: F.sum(c.cast("int"))
    lead = F.col("lead")
    return leads(spark, d).groupBy("event").agg(n(lead.between(1, 180)).alias("pre"), n((-lead).between(1, 14)).alias("post"), n(lead == 0).alias("onset_day"))


BIN = "cast(" + " + ".join(f"cast(conf >= {i / 10}::double as int)" for i in range(1, 10)) + " as int)"


@query(f"with {LEADS} select {BIN} as bin, count(*) as n, round(avg(conf), 6) as mean_conf, round(avg(cast(is_tp as double)), 6) as acc from leads where lead between 1 and 180 group by 1")
def ece_bins(spark, d):
    return A.bins(A.pre_onset(leads(spark, d))).select("bin", "n", F.round("mean_conf", 6).alias("mean_conf"), F.round("acc", 6).alias("acc"))


ECE = f"select {{by}} {BIN} as bin, count(*) as n, avg(conf) as c, avg(cast(is_tp as double)) as a from leads where lead between 1 and 180 group by all"


@query(f"with {LEADS}, b as ({ECE.format(by='')}) select cast(sum(n) as bigint) as n, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b")
def ece(spark, d):
    return A.ece(A.pre_onset(leads(spark, d)))


STRATUM = "case when lead <= 7 then '1-7' when lead <= 30 then '8-30' when lead <= 90 then '31-90' else '91-180' end as stratum,"


@query(f"with {LEADS}, b as ({ECE.format(by=STRATUM)}) select stratum, cast(sum(n) as bigint) as n, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b group by stratum")
def ts_ece(spark, d):
    return A.ece(A.pre_onset(leads(spark, d)).withColumn("stratum", X.stratum(F.col("lead"))), ["stratum"])


@query(f"with {LEADS} select round(avg(cast(is_tp as double)) filter (conf >= 0.8), 6) as high, round(avg(cast(is_tp as double)) filter (conf < 0.5), 6) as low from leads")
def conf_discrimination(spark, d):
    at = lambda c: F.round(F.avg(F.when(c, F.col("is_tp").cast("double"))), 6)
    return leads(spark, d).agg(at(F.col("conf") >= 0.8).alias("high"), at(F.col("conf") < 0.5).alias("low"))


BETA = "select {by} p as post_days, count(*) as n, sum(cast(forward as int)) as n_forward, round(avg(cast(forward as double)), 6) as beta0 from leads, (select unnest([7, 14, 30, 60]) as p) where -lead between 1 and p group by all"


@query(f"with {LEADS} {BETA.format(by='')}")
def beta0_windows(spark, d):
    return A.beta0(leads(spark, d), [7, 14, 30, 60])


@query(f"with {LEADS} {BETA.format(by='event,')}")
def beta0_by_event(spark, d):
    return A.beta0(leads(spark, d), [7, 14, 30, 60], ["event"])


@query(f"with {LEADS}, p as (select -lead as lag, forward from leads where -lead between 1 and 14) select cast(delta as int) as delta, count(lag) as n, round(case when count(lag) > 0 then sum(cast(coalesce(forward, false) as int)) / count(lag) end, 6) as s from range(1, 15) r(delta) left join p on lag >= delta group by delta")
def survival_curve(spark, d):
    return A.survival(leads(spark, d))


AUC = "select {by} sum(cast({pos} as int)) as n_pos, sum(cast(not {pos} as int)) as n_neg, round((sum(rk) filter ({pos}) - sum(cast({pos} as int)) * (sum(cast({pos} as int)) + 1) / 2.0) / (sum(cast({pos} as int))::double * sum(cast(not {pos} as int))), 6) as auc from (select *, rank() over ({w} order by conf) + (count(*) over ({w2} conf) - 1) / 2.0 as rk from leads where {where}) {g}"


@query(f"with {LEADS} {AUC.format(by='', pos='is_tp', w='', w2='partition by', where='lead between 1 and 180', g='')}")
def auc_ties(spark, d):
    return A.auc(A.pre_onset(leads(spark, d)), "conf", F.col("is_tp"))


@query(f"with {LEADS} {AUC.format(by='event,', pos='forward', w='partition by event', w2='partition by event,', where='-lead between 1 and 60', g='group by event')}")
def postevent_auc(spark, d):
    return A.auc(A.post_onset(leads(spark, d), 60), "conf", F.col("forward"), ["event"])


FWGS = {
    "v1": "(1 - exp(-greatest(lead, 0) / 30.0)) * g * cast(is_tp as int) - 0.5 * (1 - g) * conf",
    "v3": "case when is_tp then (1 - exp(-greatest(lead, 0) / 30.0)) * g else -0.5 * (1 - g) end",
    "no_w": "g * cast(is_tp as int) - 0.5 * (1 - g) * conf",
    "no_g": "(1 - exp(-greatest(lead, 0) / 30.0)) * cast(is_tp as int)",
    "no_lam": "(1 - exp(-greatest(lead, 0) / 30.0)) * g * cast(is_tp as int)",
}
CELL = "select {by} count(*) as n, sum(cast(is_tp as int)) as tp, sum(cast(not is_tp as int)) as fp, round(avg(cast(is_tp as double)), 6) as prec, round(avg({v}), 6) as fwgs from leads where {w} group by all"


@query(f"with {LEADS} {CELL.format(by='event,', v=FWGS['v3'], w='lead between 1 and 180')}")
def cell(spark, d):
    return A.cell(A.pre_onset(leads(spark, d)), ["event"])


@query(f"with {LEADS} {CELL.format(by='event,', v=FWGS['v1'], w='forward')}")
def fwgs_v1(spark, d):
    return A.cell(leads(spark, d).where("forward"), ["event"], "v1")


@query(f"with {LEADS} {CELL.format(by='arm,', v=FWGS['v3'], w='lead between 1 and 180')}")
def cell_compare(spark, d):
    return A.cell(A.pre_onset(leads(spark, d)), ["arm"])


@query(f"with {LEADS} " + " union all ".join(f"select '{k}' as variant, round(avg({v}), 6) as fwgs from leads where lead between 1 and 180" for k, v in FWGS.items() if k != "v3"))
def fwgs_ablation(spark, d):
    s = A.pre_onset(leads(spark, d)).agg(*[F.round(F.avg(A.fwgs(k)), 6).alias(k) for k in FWGS if k != "v3"])
    return s.unpivot([], [k for k in FWGS if k != "v3"], "variant", "fwgs")


@query(f"with {LEADS} " + " union all ".join(f"select {tau}.0::double as tau, {lam}::double as lam, round(avg(case when is_tp then (1 - exp(-greatest(lead, 0) / {tau}.0)) * g else -{lam} * (1 - g) end), 6) as fwgs from leads where lead between 1 and 180" for tau in (15, 30, 60) for lam in (0.25, 0.5, 1.0)))
def fwgs_grid(spark, d):
    """A grid of parameters in one pass: one aggregate per point."""
    s = A.pre_onset(leads(spark, d)).agg(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(lam).alias("lam"), F.round(F.avg(A.fwgs("v3", t, lam)), 6).alias("fwgs")) for t in (15, 30, 60) for lam in (0.25, 0.5, 1.0)]).alias("x"))
    return s.select(F.inline("x"))


@query(f"with {LEADS}, c as ({CELL.format(by='event,', v=FWGS['v1'], w='forward')}) select cast(sum(n) as bigint) as n, round(sum(n * round(fwgs, 4)) / sum(n), 6) as pooled from c")
def fwgs_pooled(spark, d):
    return fwgs_v1(spark, d).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.round("fwgs", 4)) / F.sum("n"), 6).alias("pooled"))


@query(f"with {LEADS} select conf, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as part from leads group by conf")
def quantisation(spark, d):
    c = leads(spark, d).groupBy("conf").agg(F.count("*").alias("n"))
    return c.join(c.agg(F.sum("n").alias("all"))).select("conf", "n", F.round(F.col("n") / F.col("all"), 6).alias("part"))


@query(f"with {LEADS} select is_tp, round(median(conf), 6) as med, round(stddev_pop(conf), 6) as sd from leads where lead between 1 and 180 group by is_tp")
def separation_median(spark, d):
    return A.pre_onset(leads(spark, d)).groupBy("is_tp").agg(F.round(F.median("conf"), 6).alias("med"), F.round(F.stddev_pop("conf"), 6).alias("sd"))


WILSON = "round((tp / n + 1.9208 / n {s} 1.96 * sqrt((tp / n) * (1 - tp / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6)"


@query(f"with {LEADS}, c as (select event, count(*)::double as n, sum(cast(is_tp as int))::double as tp from leads where lead between 1 and 180 group by event) select event, n::bigint as n, tp::bigint as tp, {WILSON.format(s='-')} as lo, {WILSON.format(s='+')} as hi from c")
def wilson_precision(spark, d):
    return A.with_wilson(A.cell(A.pre_onset(leads(spark, d)), ["event"]).select("event", "n", "tp"))


@query(f"with {LEADS} select case when grouping(event) = 1 then 'POOLED' else cast(event as varchar) end as event, count(*) as n, sum(cast(is_tp as int)) as tp, round(avg(cast(is_tp as double)), 6) as prec from leads where lead between 1 and 180 group by rollup (event)")
def precision_rollup(spark, d):
    return A.rollup(A.pre_onset(leads(spark, d)), "event")


@query("select count(*) as n, round(po, 6) as po, round(case when pe = 1 then 1 else (po - pe) / (1 - pe) end, 6) as kappa from labels, (select po, pa * pb + (1 - pa) * (1 - pb) as pe from (select avg(cast(quality = toxic as double)) as po, avg(quality) as pa, avg(toxic) as pb from labels)) group by all")
def kappa(spark, d):
    return A.kappa(table(spark, d, "labels"), "quality", "toxic")


@query("select case when quality is null or toxic is null then 'unlabelled' when quality = toxic then 'same' when quality = 1 then '1to0' else '0to1' end as flip, count(*) as n from labels group by all")
def flip_matrix(spark, d):
    return C.flips(table(spark, d, "labels"), F.col("quality"), F.col("toxic"))


@query("select doc_id, case when quality is not distinct from toxic then quality else 1 end as final from labels")
def adjudication(spark, d):
    return table(spark, d, "labels").select("doc_id", C.adjudicated(F.col("quality"), F.col("toxic"), F.lit(1)).alias("final"))


@query(f"with {LEADS}, c as (select sum(cast(is_tp as int))::double as tp, sum(cast(not is_tp as int))::double as fp from leads where lead between 1 and 180) select r, round(tp / (tp / r + fp), 6) as prec from c, (select unnest([1.0, 0.9, 0.7, 0.5]::double[]) as r)")
def recall_sensitivity(spark, d):
    s = A.pre_onset(leads(spark, d)).agg(F.sum(F.col("is_tp").cast("int")).alias("tp"), F.sum((~F.col("is_tp")).cast("int")).alias("fp"))
    return s.select("tp", "fp", F.explode(F.array(*map(F.lit, (1.0, 0.9, 0.7, 0.5)))).alias("r")).select("r", F.round(F.col("tp") / (F.col("tp") / F.col("r") + F.col("fp")), 6).alias("prec"))


ARMS = "arms as (select sum(cast(is_tp as int)) filter (arm = 'F') as tp_a, sum(cast(is_tp as int)) filter (arm = 'O') as tp_b, sum(cast(not is_tp as int)) filter (arm = 'F') as fp_a, sum(cast(not is_tp as int)) filter (arm = 'O') as fp_b from leads where lead between 1 and 180)"


def arms(spark, d) -> DataFrame:
    n = lambda a, tp: F.sum(((F.col("arm") == a) & (F.col("is_tp") == tp)).cast("int"))
    return A.pre_onset(leads(spark, d)).agg(n("F", True).alias("tp_a"), n("O", True).alias("tp_b"), n("F", False).alias("fp_a"), n("O", False).alias("fp_b"))


@query(f"with {LEADS}, {ARMS} select c, round(tp_a - c * fp_a, 6) as value_a, round(tp_b - c * fp_b, 6) as value_b from arms, (select unnest([0.25, 0.5, 1.0, 2.0]::double[]) as c)")
def value_by_cost(spark, d):
    c = arms(spark, d).select("*", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0)))).alias("c"))
    return c.select("c", F.round(F.col("tp_a") - F.col("c") * F.col("fp_a"), 6).alias("value_a"), F.round(F.col("tp_b") - F.col("c") * F.col("fp_b"), 6).alias("value_b"))


GRID = [i / 100 for i in range(30, 96)]
THETA = f"(select unnest({GRID}::double[]) as theta)"
CURVE = "select {by} theta, count(*) as fired, sum(cast(is_tp as int)) as tp, sum(cast(not is_tp as int)) as fp, round(avg(cast(is_tp as double)), 6) as prec, round(avg(lead) filter (is_tp), 6) as mean_lead from leads, " + THETA + " where lead between 1 and 180 and conf >= theta group by all"


@query(f"with {LEADS} {CURVE.format(by='')}")
def threshold_curve(spark, d):
    return A.thresholds(A.pre_onset(leads(spark, d)), GRID)


@query(f"with {LEADS}, v as (select lead from leads where lead between 1 and 180 and is_tp), s as (select count(*) as n, greatest(1.06 * stddev_samp(lead) * pow(count(*), -0.2), 5.0) as h from v) select cast(x as int) as x, round(sum(exp(-0.5 * pow((x - lead) / h, 2))) / any_value(n * h) / sqrt(2 * pi()), 8) as density from v, s, range(0, 181, 15) r(x) group by x")
def lead_kde(spark, d):
    return A.kde(A.pre_onset(leads(spark, d)).where("is_tp"), "lead", list(range(0, 181, 15)))


@query(f"with {LEADS}, r as (select is_tp, row_number() over (order by conf desc, sid) as rk from leads where lead between 1 and 180) select k, count(*) filter (is_tp and rk <= k) as tp, round(count(*) filter (is_tp and rk <= k) / k, 6) as prec, round(count(*) filter (is_tp and rk <= k) / count(*) filter (is_tp), 6) as recall from r, (select unnest([10, 50, 100]) as k) group by k")
def precision_at_k(spark, d):
    return A.at_k(A.pre_onset(leads(spark, d)), "conf", "sid", [10, 50, 100])


@query(f"with {LEADS}, c as (select conf, count(*) as n, count(*) filter (is_tp) as p from leads where lead between 1 and 180 group by conf), w as (select p, sum(p) over (order by conf desc) / sum(n) over (order by conf desc) as prec from c) select cast(sum(p) as bigint) as n_pos, round(sum(p * prec) / sum(p), 6) as ap from w")
def average_precision(spark, d):
    return A.average_precision(A.pre_onset(leads(spark, d)), "conf", "is_tp")


@query(f"with {LEADS}, p as (select * from leads where lead between 1 and 180), x as (" + " union all ".join(f"select '{c}' as feature, abs(avg({c}) filter (is_tp) - avg({c}) filter (not is_tp)) / stddev_pop({c}) as gap from p" for c in ("conf", "g", "lead")) + ") select feature, round(gap, 6) as gap, gap > 0.5 as flagged from x")
def feature_drift(spark, d):
    return A.drift(A.pre_onset(leads(spark, d)), "is_tp", ["conf", "g", "lead"])


@query(f"with {LEADS} select {STRATUM} case when conf >= 0.8 then 'high' when conf >= 0.5 then 'mid' else 'low' end as band, count(*) as n, round(avg(conf), 6) as mean_conf, round(avg(cast(is_tp as double)), 6) as mean_tp from leads where lead between 1 and 180 group by all")
def prob_warning(spark, d):
    """Chance of a true positive by confidence band and lead stratum, beside the mean confidence."""
    band = F.when(F.col("conf") >= 0.8, "high").when(F.col("conf") >= 0.5, "mid").otherwise("low")
    return A.pre_onset(leads(spark, d)).groupBy(X.stratum(F.col("lead")).alias("stratum"), band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(A.share(F.col("is_tp")), 6).alias("mean_tp"))


@query(f"with {LEADS} select case when lead > 0 then case when is_tp then 'pre_tp' else 'pre_fp' end else 'post_onset' end as pool, cast(lead > 0 and is_tp as int) as y, count(*) as n from leads where forward and lead between -60 and 180 and lead <> 0 group by all")
def label_table(spark, d):
    """Forward signals as training pools: true and false ones before the onset, and those after it."""
    s = leads(spark, d).where("forward")
    pre = A.pre_onset(s).select(F.when(F.col("is_tp"), "pre_tp").otherwise("pre_fp").alias("pool"), F.col("is_tp").cast("int").alias("y"))
    return pre.unionByName(A.post_onset(s, 60).select(F.lit("post_onset").alias("pool"), F.lit(0).alias("y"))).groupBy("pool", "y").agg(F.count("*").alias("n"))


@query(f"with {LEADS}, p as (select * from leads where -lead between 1 and 60) select 'before' as state, count(*) as n, round(avg(cast(forward as double)), 6) as beta0 from p union all select 'after', count(*), round(avg(cast(forward as double)), 6) from p where event <> 3")
def retraction(spark, d):
    """Share of forward labels after the onset with and without a retracted event, from one pass."""
    p, kept = A.post_onset(leads(spark, d), 60), F.col("event") != 3
    x = p.agg(F.array(*[F.struct(F.lit(s).alias("state"), F.count_if(c).alias("n"), F.round(F.avg(F.when(c, F.col("forward").cast("double"))), 6).alias("beta0")) for s, c in (("before", F.lit(True)), ("after", kept))]).alias("x"))
    return x.select(F.inline("x"))


@query(f"with {LEADS}, c as ({CELL.format(by='arm, event,', v=FWGS['v3'], w='lead between 1 and 180')}), r as (select arm, event, row_number() over (partition by arm order by fwgs desc, event) as rk from c) select a.rk, a.event as event_a, b.event as event_b, a.event = b.event as agree from r a join r b on a.rk = b.rk and a.arm = 'F' and b.arm = 'O'")
def rank_agreement(spark, d):
    c = A.cell(A.pre_onset(leads(spark, d)), ["arm", "event"])
    r = c.withColumn("rk", F.row_number().over(Window.partitionBy("arm").orderBy(F.col("fwgs").desc(), "event")))
    a, b = (r.where(F.col("arm") == x).select("rk", F.col("event").alias(n)) for x, n in (("F", "event_a"), ("O", "event_b")))
    return a.join(b, "rk").select("rk", "event_a", "event_b", (F.col("event_a") == F.col("event_b")).alias("agree"))


@query(f"with {LEADS}, e as (select event, cast(lead / 30 as int) as x from (select event, lead from leads where lead between 1 and 180)) select event, m, count(*) filter (lead <= m) as detected from (select event, lead from leads where lead between 1 and 180 and is_tp), (select unnest([7, 30, 60, 90, 120, 180]) as m) group by event, m")
def cdf_curve(spark, d):
    """Detections by each horizon, per event: one aggregate per grid point in one pass."""
    grid = (7, 30, 60, 90, 120, 180)
    c = A.pre_onset(leads(spark, d)).where("is_tp").groupBy("event").agg(F.array(*[F.struct(F.lit(m).alias("m"), F.count_if(F.col("lead") <= m).alias("detected")) for m in grid]).alias("x"))
    return c.select("event", F.inline("x"))


@query(f"with {LEADS}, s as (select event, sid, l from (select event, sid, row_number() over (partition by event, is_tp order by (sid * 1103515245 + 42 * 12345) % 2147483647, sid) as l from leads)) select event, sid from s where l <= 5")
def stratified_sample(spark, d):
    return C.stratified(leads(spark, d), ["event", "is_tp"], "sid", 5).select("event", "sid")


@query("select conv_id, arg_max(role, turn) as role, max(turn) as turn from conversations group by conv_id")
def last_wins(spark, d):
    return C.last_wins(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"]).select("conv_id", "role", "turn")


# ---- text and corpus


@query(r"select page_id, substr(replace(replace(translate(regexp_replace(split_part(rtrim(url, '/'), '/', -1), '[?#].*$', ''), '_-', '  '), '.html', ''), '.htm', ''), 1, 200) as title, substr(sha1(url), 1, 16) as h from pages")
def slug_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.slug_title(F.col("url")).alias("title"), X.url_hash(F.col("url")).alias("h"))


@query(r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as h from pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_html(F.col("html"))).alias("h"))


DECODED = "regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"
STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"


@query(rf"select page_id, md5(h) as h, length(h) as n_chars from (select page_id, trim(regexp_replace({DECODED.format(STRIPPED)}, '\s+', ' ', 'g')) as h from pages)")
def html_text(spark, d):
    """Pages as text with character references decoded (the SQL knows those that the given pages hold)."""
    return table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("h")).select("page_id", F.md5("h").alias("h"), F.length("h").cast("long").alias("n_chars"))


@query(r"select lang, count(*) as n, count(*) filter (length(text) >= 250) as acceptable from documents group by lang")
def junk_filter(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") >= 250).alias("acceptable"))


@query("select doc_id from documents where contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' the ') and not contains(lower(text), 'stupid')")
def keyword_filter(spark, d):
    return table(spark, d, "documents").where(X.has_phrase(F.col("text"), "the") & ~F.contains(F.lower("text"), F.lit("stupid"))).select("doc_id")


@query("select b.conv_id, b.turn, round(len(list_filter(string_split(lower(a.text), ' '), lambda x: contains(lower(b.text), x))) / len(string_split(a.text, ' ')), 6) as g, len(list_filter(string_split(lower(a.text), ' '), lambda x: not contains(lower(b.text), x))) as n_missing from conversations b join conversations a on a.conv_id = b.conv_id and a.turn + 1 = b.turn")
def faithfulness_audit(spark, d):
    """How much of a turn's words its next turn holds verbatim, and how many are missing."""
    c = table(spark, d, "conversations")
    a = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.split("text", " ").alias("phrases"))
    j = c.select("conv_id", "turn", "text").join(a, ["conv_id", "turn"])
    missing = F.filter("phrases", lambda p: ~F.contains(F.lower("text"), F.lower(p)))
    return j.select("conv_id", "turn", F.round(X.faithfulness(F.col("phrases"), F.col("text")), 6).alias("g"), F.size(missing).cast("long").alias("n_missing"))


@query("select md5(text) as h, arg_min(doc_id, (case when length(text) < 250 then 1 else 0 end, -length(text), doc_id)) as keep, count(*) as n from documents group by 1 having count(*) > 1")
def url_dedup(spark, d):
    t = table(spark, d, "documents").select(F.md5("text").alias("h"), "doc_id", F.length("text").alias("n"))
    b = C.best_body(t, "h", F.col("n") < 250, F.col("n"), "doc_id").select("h", F.col("doc_id").alias("keep"))
    return b.join(t.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")


@query("select source, arg_min(doc_id, (case when length(text) < 400 then 1 else 0 end, -length(text), doc_id)) as doc_id from documents group by source")
def best_body(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return C.best_body(t, "source", F.col("n") < 400, F.col("n"), "doc_id").select("source", "doc_id")


@query("select d.doc_id, case when l.doc_id is null then 'title_fallback' else 'ok' end as body_status from documents d left join (select doc_id from labels where quality = 1) l on d.doc_id = l.doc_id")
def body_merge(spark, d):
    docs, ok = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("body").alias("body"))
    return C.merged(docs, ok, "doc_id", F.col("lang"), F.col("body")).select("doc_id", "body_status")


@query("select source, round(avg(cast(ok as double)), 6) as by_row, bool_or(ok) as any_ok from (select source, length(text) >= 1000 as ok from documents) group by source")
def coverage(spark, d):
    t = table(spark, d, "documents").select("source", (F.length("text") >= 1000).alias("ok"))
    return t.groupBy("source").agg(F.round(A.share(F.col("ok")), 6).alias("by_row"), F.bool_or("ok").alias("any_ok"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic <> 1)")
def resume_antijoin(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))
    return C.todo(table(spark, d, "documents").select("doc_id"), done, "doc_id")


@query("select doc_id from labels where doc_id not in (select doc_id from documents where length(text) < 500)")
def invalidate(spark, d):
    return C.invalidated(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where(F.length("text") < 500), "doc_id")


@query("select case when a.lang is null then 'admitted' when b.quality is null then 'dropped' when (a.lang = 'en') = (b.quality = 1) then 'kept' else 'relabelled' end as fate, count(*) as n from documents a full join labels b using (doc_id) group by all")
def schema_fate(spark, d):
    a = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").cast("int").alias("y"))
    b = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return C.schema_fate(a, b, "doc_id", "y")


@query("(select o_custkey as k, 'a' as side from orders where o_orderstatus = 'F' group by 1 except select o_custkey, 'a' from orders where o_orderstatus = 'O') union all (select o_custkey, 'b' from orders where o_orderstatus = 'O' group by 1 except select o_custkey, 'b' from orders where o_orderstatus = 'F')")
def sym_diff(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FO")
    return C.symmetric_difference(a, b)


def answers(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("<think>{</think>```json\n"), "props", F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("so: "), "props", F.lit(" ok"))).otherwise(F.lit("none")).alias("raw"))


@query("select event_id, case when cast(json_extract_string(props, '$.k') as int) % 3 < 2 then cast(json_extract_string(props, '$.k') as int) end as k, case when cast(json_extract_string(props, '$.k') as int) % 3 < 2 then 1 else 2 end as n_missing from events")
def parse_llm_json(spark, d):
    j = X.answer_json(F.col("raw"))
    return answers(spark, d).select("event_id", F.get_json_object(j, "$.k").cast("int").alias("k"), F.size(X.missing_keys(j, ["k", "confidence"])).alias("n_missing"))


# The modules below register their queries in the same catalog.
from augury.plans import attribution, decision, keywords, learning, records, reports, resampling, worksheets  # noqa: E402, F401
