"""Bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import counts as N
from augury.operators import metrics as A
from augury.operators import resampling as B
from augury.plans.adapters import LEADS, leads
from augury.plans.catalog import query

REPLICATES = 2000
PRICES = [0.5, 1.0, 2.0]
GRID = [7, 30, 60, 90, 120, 180]


def hashed(lin: str, n: str, name: str) -> str:
    """Columns that repeat ``drawn``: each names the one before."""
    cols, x = [f"({lin} + {B.SEED}) % {B.PRIME} as {name}_x0"], f"{name}_x0"
    for i in (1, 2):
        cols += [f"({x} * {x}) % {B.PRIME} as {name}_s{i}", f"(({name}_s{i} * {name}_s{i}) % {B.PRIME} * {x} + 12345) % {B.PRIME} as {name}_x{i}"]
        x = f"{name}_x{i}"
    return ", ".join([*cols, f"{x} % {n} as {name}"])


DRAWS = f"""numbered as (select *, row_number() over (order by event) - 1 as i, count(*) over () as n_events from e),
slots as (select rep, slot, n_events from range({REPLICATES}) a(rep), (select i as slot, n_events from numbered)),
picked as (select rep, slot, i from (select rep, slot, {hashed(f"rep * {B.STEP[0]} + slot * {B.STEP[1]}", "n_events", "i")} from slots)),
draws as (select * from picked join numbered using (i))"""


def counts(flag: str, where: str) -> str:
    return f"e as (select event, count(*) filter ({flag}) as k, count(*) as n from leads where {where} group by event)"


TWO_STAGE = f"""items as (select rep, slot, k, n, unnest(range(n)) as item from draws),
reps as (select rep, round(avg(cast(hit < k as int)), 6) as share from (select rep, k, {hashed(f"rep * {B.STEP[0]} + slot * {B.STEP[1]} + item * {B.STEP[2]}", "n", "hit")} from items) group by rep)"""


def interval_sql(table: str, value: str) -> str:
    return f"select cast(len(v) as bigint) as n, v[cast(floor(len(v) * ((1 - 0.95::double) / 2)) as int) + 1] as lo, v[least(cast(floor(len(v) * ((1 + 0.95::double) / 2)) as int), len(v) - 1) + 1] as hi from (select list_sort(list({value})) as v from {table})"


PRE, POST = "lead between 1 and 180", "-lead between 1 and 60"


@query(f"with {LEADS}, {counts('is_tp', PRE)}, {DRAWS}, {TWO_STAGE} {interval_sql('reps', 'share')}")
def bootstrap_precision(spark, d):
    """Interval of precision, resampling events and then signals."""
    return B.interval(B.two_stage_shares(A.pre_onset(leads(spark, d)), "event", "is_tp", REPLICATES), "share")


@query(f"with {LEADS}, {counts('forward', POST)}, {DRAWS}, {TWO_STAGE} {interval_sql('reps', 'share')}")
def bootstrap_beta0(spark, d):
    return B.interval(B.two_stage_shares(A.post_onset(leads(spark, d), 60), "event", "forward", REPLICATES), "share")


@query(f"with {LEADS}, {counts('is_tp', PRE)}, {DRAWS} select rep, round(sum(k) / sum(n), 6) as share from draws group by rep")
def bootstrap_events(spark, d):
    """Precision of each replicate, resampling events only."""
    return B.shares(A.pre_onset(leads(spark, d)), "event", "is_tp", REPLICATES)


PAIRED = "e as (select event, " + ", ".join(f"count(*) filter (arm = '{a}' and {'' if t == 'tp' else 'not '}is_tp) as {t}_{m}" for a, m in (("F", "a"), ("O", "b")) for t in ("tp", "fp")) + f" from leads where {PRE} group by event)"
REPS = """reps as (select rep, tp_a, fp_a, tp_b, fp_b, round(tp_b / nullif(tp_b + fp_b, 0) - tp_a / nullif(tp_a + fp_a, 0), 6) as d_prec, tp_b - tp_a as d_tp, fp_b - fp_a as d_fp,
  round(case when fp_b = fp_a then case when tp_b < tp_a then 'infinity'::double else 0.0 end when tp_b >= tp_a then 0.0 else (tp_a - tp_b) / (fp_a - fp_b) end, 6) as c_star
  from (select rep, cast(sum(tp_a) as bigint) as tp_a, cast(sum(fp_a) as bigint) as fp_a, cast(sum(tp_b) as bigint) as tp_b, cast(sum(fp_b) as bigint) as fp_b from draws group by rep))"""


def paired(spark, d):
    return B.paired(A.pre_onset(leads(spark, d)), "event", "arm", "F", "O", REPLICATES)


@query(f"with {LEADS}, {PAIRED}, {DRAWS}, {REPS} select rep, tp_a, fp_a, tp_b, fp_b, d_prec, d_tp, d_fp, c_star from reps")
def bootstrap_paired(spark, d):
    return paired(spark, d)


@query(f"with {LEADS}, {PAIRED}, {DRAWS}, {REPS} " + " union all ".join(f"select '{v}' as measure, * from ({interval_sql('reps' + (' where c_star < 1e300' if v == 'c_star' else ''), f'{v}::double')})" for v in ("d_prec", "d_tp", "d_fp", "c_star")))
def bootstrap_paired_intervals(spark, d):
    p = paired(spark, d)
    out = None
    for v in ("d_prec", "d_tp", "d_fp", "c_star"):
        rows = p.where(F.col("c_star") < float("inf")) if v == "c_star" else p
        one = B.interval(rows.select(F.col(v).cast("double").alias("v")), "v").select(F.lit(v).alias("measure"), "n", "lo", "hi")
        out = one if out is None else out.unionByName(one)
    return out


MEASURES = [("P(precision rises)", "coalesce(d_prec > 0, false)"), ("P(FP falls)", "d_fp < 0"), ("finite c*", "c_star < 1e300"), *((f"P(b better | {c:g})", f"tp_b - {c}::double * fp_b > tp_a - {c}::double * fp_a") for c in PRICES)]


@query(f"with {LEADS}, {PAIRED}, {DRAWS}, {REPS} " + " union all ".join(f"select '{n}' as measure, round(avg(cast({c} as int)), 6) as value from reps" for n, c in MEASURES))
def bootstrap_paired_summary(spark, d):
    return B.paired_summary(paired(spark, d), PRICES)


@query(f"with {LEADS}, e as (select event, cast(sum(cast(round((case when is_tp then (1 - exp(-greatest(lead, 0) / 30.0)) * g else -0.5 * (1 - g) end) * 1000000) as bigint)) as bigint) as s, count(*) as n from leads where {PRE} group by event), {DRAWS}, reps as (select rep, round(sum(s) / sum(n) / 1000000, 6) as mean from draws group by rep) {interval_sql('reps', 'mean')}")
def bootstrap_fwgs(spark, d):
    """Interval of the pooled score, events resampled and weighted by their signals."""
    return B.interval(B.weighted_means(A.pre_onset(leads(spark, d)), "event", A.fwgs("v3"), REPLICATES), "mean")


@query(f"with {LEADS}, e as (select event, x, avg(cast(lead <= x as int)) as y from leads, (select unnest({GRID}) as x) where {PRE} and is_tp group by event, x), names as (select distinct event from e), numbered as (select event, row_number() over (order by event) - 1 as i, count(*) over () as n_events from names), slots as (select rep, slot, n_events from range({REPLICATES}) a(rep), (select i as slot, n_events from numbered)), picked as (select rep, slot, i from (select rep, slot, {hashed(f'rep * {B.STEP[0]} + slot * {B.STEP[1]}', 'n_events', 'i')} from slots)), reps as (select rep, x, round(avg(y), 6) as m from picked join numbered using (i) join e using (event) group by rep, x), v as (select x, list_sort(list(m)) as v from reps group by x), point as (select x, round(avg(y), 6) as mean from e group by x) select x, mean, v[cast(floor(len(v) * ((1 - 0.95::double) / 2)) as int) + 1] as lo, v[cast(floor(len(v) * ((1 + 0.95::double) / 2)) as int) + 1] as hi from v join point using (x)")
def bootstrap_curve(spark, d):
    """Cumulative detection by lead, averaged over events, with its pointwise interval."""
    return B.curve(A.pre_onset(leads(spark, d)).where("is_tp"), "event", "lead", GRID, REPLICATES)


def points(t, by):
    """The observed mean and number of each group of a tally."""
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("weight")))
    return t.groupBy(*by).agg(F.round(F.sum(F.col("v") * F.col("weight")) / known, 6).alias("point"), F.coalesce(F.sum("weight"), F.lit(0)).alias("n"))


def scores(spark, d):
    """Tally of the score before the onset by event (as text) and arm."""
    return N.tallied(A.pre_onset(leads(spark, d)).withColumn("event", F.col("event").cast("string")), ["event", "arm"], A.fwgs("v3"))


@query()
def event_intervals(spark, d):
    """Each event's mean score with its interval, signals resampled within the event; then all events pooled, events and their signals resampled."""
    t = scores(spark, d)
    one = points(t, ["event"]).join(N.bounds(N.group_means(t, ["event"], F.col("v"), REPLICATES, weight=F.col("weight")), ["event"]), "event")
    pool = points(t.withColumn("event", F.lit("POOLED")), ["event"]).join(N.bounds(N.pooled_means(t, "event", F.col("v"), n=REPLICATES, weight=F.col("weight")).withColumn("event", F.lit("POOLED")), ["event"]), "event")
    return one.unionByName(pool)


@query()
def model_intervals(spark, d):
    """Event intervals of each model (here: arm), and each model's pooled interval."""
    t = scores(spark, d)
    one = points(t, ["arm", "event"]).join(N.bounds(N.group_means(t, ["arm", "event"], F.col("v"), REPLICATES, weight=F.col("weight")), ["arm", "event"]), ["arm", "event"])
    pool = N.bounds(N.pooled_means(t, "event", F.col("v"), ["arm"], REPLICATES, weight=F.col("weight")), ["arm"]).withColumn("event", F.lit("POOLED"))
    return one.unionByName(points(t, ["arm"]).join(pool, "arm"))


@query()
def cell_intervals(spark, d):
    """Half-widths of the cells of an event by model chart, and whether an interval leaves out 0."""
    t = scores(spark, d).withColumn("event", F.col("event").cast("int"))
    c = N.bounds(N.group_means(t, ["event", "arm"], F.col("v"), REPLICATES, weight=F.col("weight")), ["event", "arm"], ends="outer")
    return points(t, ["event", "arm"]).join(c, ["event", "arm"]).select("event", "arm", "point", "n", F.round((F.col("hi") - F.col("lo")) / 2, 6).alias("half"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("off_zero"))


@query()
def two_stage_intervals(spark, d):
    """Intervals of precision, of the score before the onset and of the forward share after it, events resampled and then their signals. One pass over the signals tallies all three."""
    pre, post = F.col("lead").between(1, 180), (-F.col("lead")).between(1, 60)
    values = {"precision": (pre, F.col("is_tp").cast("double")), "fwgs": (pre, A.fwgs("v3")), "beta0": (post, F.col("forward").cast("double"))}
    each = F.array(*[F.when(c, F.struct(F.lit(name).alias("measure"), v.alias("x"))) for name, (c, v) in values.items()])
    s = leads(spark, d).where(pre | post).select("event", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m")).select("event", "m.*")
    t = N.tallied(s, ["measure", "event"], F.col("x"))
    out = None
    for name in values:
        own = t.where(F.col("measure") == name)
        one = points(own, []).withColumn("measure", F.lit(name)).join(N.bounds(N.pooled_means(own, "event", F.col("v"), n=REPLICATES, weight=F.col("weight")).withColumn("measure", F.lit(name)), ["measure"], ends="outer"), "measure")
        out = one if out is None else out.unionByName(one)
    return out
