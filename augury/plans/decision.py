"""Queries on thresholds, costs and decision value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.operators import decision as D
from augury.operators import metrics as A
from augury.plans.adapters import LEADS, leads
from augury.plans.catalog import query

# Thresholds, prices of an action as shares of the loss, and score limits that the published curves stand on.
GRID = [i / 100 for i in range(30, 96)]
PRICES = [0.01, 0.02, 0.05, 0.1, 0.2]
SCORE_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


def unnested(values: list[float], name: str) -> str:
    return f"(select unnest({values}::double[]) as {name})"


def cost_sql(n_events: str, n_fire: str, n: str, tp: str, lead: str, c: str) -> str:
    left = f"(1 - 0.8::double * (1 - exp(-coalesce({lead}::double / nullif({tp}, 0), 0) / 60.0::double)))"
    p_hit, p_fire = f"({tp}::double / {n})", f"({n_fire}::double / {n_events})"
    return f"case when coalesce({n}, 0) <= 0 then 1.0::double else {p_fire} * ((1 - {p_hit}) * {c}::double + {p_hit} * {left}) + (1 - {p_fire}) end"


PER = f"""pre as (select * from leads where lead between 1 and 180),
per as (select event, theta, count(*) as fired, sum(cast(is_tp as int)) as tp, coalesce(sum(lead) filter (is_tp), 0) as lead_tp
  from pre, {unnested(GRID, "theta")} where conf >= theta group by event, theta),
pooled as (select theta, (select count(distinct event) from pre) as n_events, count(fired) as n_fire, coalesce(sum(fired), 0) as fired, coalesce(sum(tp), 0) as tp, coalesce(sum(lead_tp), 0) as lead_tp
  from {unnested(GRID, "theta")} left join per using (theta) group by theta),
costs as (select *, {cost_sql("n_events", "n_fire", "fired", "tp", "lead_tp", "0.05")} as cost from pooled)"""


def parts(spark, d) -> tuple[DataFrame, DataFrame]:
    pre = A.pre_onset(leads(spark, d))
    return D.fired(pre, GRID), pre.select("event").distinct()


@query(f"""with {LEADS}, {PER} select theta, cast(fired as bigint) as fired, cast(tp as bigint) as tp, cast(n_fire as bigint) as events_firing,
  round(lead_tp / nullif(tp, 0), 6) as mean_lead, round(cost, 6) as cost from costs""")
def expected_cost(spark, d):
    c = D.costs(D.pooled(*parts(spark, d), GRID))
    return c.select("theta", "fired", "tp", F.col("n_fire").alias("events_firing"), F.round(F.col("lead_tp") / F.nullif("tp", F.lit(0)), 6).alias("mean_lead"), F.round("cost", 6).alias("cost"))


@query(f"with {LEADS}, {PER} select theta, round(cost, 9) as cost from costs order by round(cost, 9), theta limit 1")
def best_theta(spark, d):
    return D.cheapest(D.costs(D.pooled(*parts(spark, d), GRID)))


LOEO = f"""{PER}, own as (select e.event, p.theta, p.n_events, p.n_fire - cast(q.fired is not null as int) as n_fire, p.fired - coalesce(q.fired, 0) as fired, p.tp - coalesce(q.tp, 0) as tp,
    p.lead_tp - coalesce(q.lead_tp, 0) as lead_tp, coalesce(q.fired, 0) as own_fired, coalesce(q.tp, 0) as own_tp, coalesce(q.lead_tp, 0) as own_lead
  from (select distinct event from pre) e cross join pooled p left join per q on q.event = e.event and q.theta = p.theta),
chosen as (select * from (select *, round({cost_sql("(n_events - 1)", "n_fire", "fired", "tp", "lead_tp", "0.05")}, 9) as cost from own where n_events > 3)
  qualify row_number() over (partition by event order by cost, theta) = 1)"""


@query(f"with {LEADS}, {LOEO} select event, theta, cast(own_fired as bigint) as fired, cast(own_tp as bigint) as tp from chosen")
def loeo_theta(spark, d):
    """The threshold chosen without each event, applied to it."""
    return D.held_out_choice(*parts(spark, d), GRID).select("event", "theta", "fired", "tp")


@query(f"""with {LEADS}, {LOEO} select cast(sum(own_fired) as bigint) as fired, cast(sum(own_tp) as bigint) as tp, cast(sum(own_fired - own_tp) as bigint) as fp,
  round(sum(own_tp) / nullif(sum(own_fired), 0), 6) as prec, round(sum(own_lead) / nullif(sum(own_tp), 0), 6) as mean_lead, min(theta) as lo, max(theta) as hi, round(median(theta), 6) as mid from chosen""")
def loeo_pooled(spark, d):
    """Out-of-fold results of all events together."""
    c = D.held_out_choice(*parts(spark, d), GRID)
    s = {n: F.sum(n) for n in ("fired", "tp", "lead_tp")}
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return c.agg(s["fired"].alias("fired"), s["tp"].alias("tp"), (s["fired"] - s["tp"]).alias("fp"), ratio(s["tp"], s["fired"]).alias("prec"), ratio(s["lead_tp"], s["tp"]).alias("mean_lead"), F.min("theta").alias("lo"), F.max("theta").alias("hi"), F.round(F.median("theta"), 6).alias("mid"))


@query(f"""with {LEADS}, {PER}, priced as (select price, theta, fired, tp, round({cost_sql("n_events", "n_fire", "fired", "tp", "lead_tp", "price")}, 9) as cost from pooled, {unnested(PRICES, "price")})
select price, theta, cost, cast(fired as bigint) as fired, cast(tp as bigint) as tp from priced qualify row_number() over (partition by price order by cost, theta) = 1""")
def cost_sensitivity(spark, d):
    """Cheapest threshold at each price of a false alarm."""
    return D.by_price(D.pooled(*parts(spark, d), GRID), PRICES).select("price", "theta", "cost", "fired", "tp")


ARMS = "arms as (" + ", ".join(["select " + ", ".join(f"count(*) filter (arm = '{a}' and {'' if t == 'tp' else 'not '}is_tp) as {t}_{n}" for a, n in (("F", "a"), ("O", "b")) for t in ("tp", "fp"))]) + " from leads where lead between 1 and 180)"


@query(f"""with {LEADS}, {ARMS} select tp_b - tp_a as d_tp, fp_b - fp_a as d_fp,
  case when fp_b = fp_a then 'infinity'::double when tp_b >= tp_a then 0.0::double else round((tp_a - tp_b) / (fp_a - fp_b), 6) end as c_star from arms""")
def break_even_cost(spark, d):
    n = lambda a, tp: F.count_if((F.col("arm") == a) & (F.col("is_tp") == tp))
    s = A.pre_onset(leads(spark, d)).agg((n("O", True) - n("F", True)).alias("d_tp"), (n("O", False) - n("F", False)).alias("d_fp"))
    return s.select("d_tp", "d_fp", F.round(D.break_even(F.col("d_tp"), F.col("d_fp")), 6).alias("c_star"))


#: Forward signals with their score: a hit's lead counts, all others have none.
SCORED = """scored as (select event, conf, is_tp and lead between 1 and 180 as is_tp, case when is_tp and lead between 1 and 180 then lead else 0 end as lead,
  round((1 - exp(-(case when is_tp and lead between 1 and 180 then lead else 0 end) / 30.0)) * g * cast(is_tp and lead between 1 and 180 as int) - 0.5 * (1 - g) * conf, 9) as score from leads where forward)"""


def scored(spark, d) -> DataFrame:
    hit = F.col("is_tp") & F.col("lead").between(1, 180)
    s = leads(spark, d).where("forward").select("event", "conf", "g", hit.alias("is_tp"), F.when(hit, F.col("lead")).otherwise(0).alias("lead"))
    return s.withColumn("score", F.round(A.fwgs("v1"), D.DIGITS))


def elr_sql(grid: list[float], more: str = "", keys: str = "theta", m_max="0.8", scale="60.0", c="0.05", over="score > theta", deployable: bool = False) -> str:
    lead = "coalesce(lead_tp::double / nullif(tp, 0), 0)" if deployable else "lead_all::double / fired"
    return f"""t as (select e.event, e.theta, e.n, coalesce(fired, 0) as fired, coalesce(tp, 0) as tp, lead_tp, lead_all
  from (select event, theta, count(*) as n from scored, {unnested(grid, "theta")} group by all) e left join
    (select event, theta, count(*) as fired, count(*) filter (is_tp) as tp, sum(lead) filter (is_tp) as lead_tp, sum(lead) as lead_all from scored, {unnested(grid, "theta")} where {over} group by all) f using (event, theta))
select {keys}, count(*) as n_events, cast(sum(fired) as bigint) as fired, round(1 - avg(case when fired = 0 then 1.0::double else
  (fired::double / n) * ((1 - tp::double / fired) * {c}::double + (tp::double / fired) * (1 - {m_max}::double * (1 - exp(-({lead}) / {scale}::double)))) + (1 - fired::double / n) end), 6) as elr
from t {more} group by {keys}"""


@query(f"with {LEADS}, {SCORED}, {elr_sql(SCORE_GRID)}")
def decision_value(spark, d):
    """Expected loss reduction of firing over a score."""
    return D.loss_reduction(scored(spark, d), SCORE_GRID)


M_MAX, SCALE, C_FP = [0.6, 0.8, 1.0], [30.0, 60.0, 90.0], [0.01, 0.05, 0.1]


@query(f"with {LEADS}, {SCORED}, {elr_sql([0.3], f', {unnested(M_MAX, "m_max")}, {unnested(SCALE, "scale")}, {unnested(C_FP, "c_fp")}', 'theta, m_max, scale, c_fp', 'm_max', 'scale', 'c_fp')}")
def decision_value_grid(spark, d):
    """Its sensitivity to the three parameters: 27 points from one aggregate per event."""
    grid = spark.createDataFrame([(m, s, c) for m in M_MAX for s in SCALE for c in C_FP], "m_max double, scale double, c_fp double")
    return D.loss_reduction(scored(spark, d), [0.3], F.col("m_max"), F.col("scale"), F.col("c_fp"), extra=grid)


@query(f"with {LEADS}, {SCORED}, {elr_sql([0.5, 0.7, 0.9], over='conf >= theta', deployable=True)}")
def decision_value_deployable(spark, d):
    """The rule that can be deployed: fire at a confidence or over it."""
    return D.loss_reduction(scored(spark, d), [0.5, 0.7, 0.9], score="conf", deployable=True)
