"""Queries on causal features and logistic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.operators import history as H
from augury.operators import metrics as A
from augury.plans.adapters import LEADS, leads
from augury.plans.catalog import query
from augury.sources.shared import stored

MEANS = {"conf": "prior_conf", "sev": "prior_sev"}
#: What orders different rows of one signal and day, which (day, sid) leaves open.
TIES = ["conf", "sev", "g", "kind", "pool", "y"]
MEAN = "case when count(*) over w > 0 then floor((coalesce(sum(cast(round({v} * 1000) as bigint)) over w, 0) * 2000 + count(*) over w) / (count(*) over w * 2)) / 1000000.0::double else 0 end"


@query(f"""with {LEADS}, u as (select event, sid, day, min(conf) as conf, min(sev) as sev from leads group by all)
select event, sid, day, conf, sev, count(*) over w as prior_count, coalesce(date_diff('day', lag(day) over (partition by event order by day, sid), day), 0) as days_since,
  {MEAN.format(v="conf")} as prior_conf, {MEAN.format(v="sev")} as prior_sev
from u window w as (partition by event order by day, sid rows between unbounded preceding and 1 preceding)""")
def prior_history_features(spark, d):
    u = leads(spark, d).groupBy("event", "sid", "day").agg(F.min("conf").alias("conf"), F.min("sev").alias("sev"))
    h = H.history(u, "event", "day", "sid", MEANS)
    return h.withColumn("days_since", F.col("days_since").cast("long"))


def featured(spark, d) -> tuple[DataFrame, list[str]]:
    """Forward signals of the training pools with their features and one place per kind. Signals and features are stored, as fits and scores read them many times: lineitem meets orders once."""
    s = leads(spark, d).where("forward and lead between -60 and 180 and lead <> 0")
    s = s.select("event", "sid", "day", "conf", "sev", "g", F.col("arm").alias("kind"), F.when(F.col("lead") > 0, 0).otherwise(1).alias("pool"), ((F.col("lead") > 0) & F.col("is_tp")).cast("int").alias("y"))
    h = stored(H.history(stored(s, "signals"), "event", "day", ["sid", *TIES], MEANS), "features")
    names, hot = H.one_hot(h, "kind")
    h = h.withColumn("__hot", hot)
    return h.select("*", *[F.get("__hot", F.lit(i)).alias(f"kind={n}") for i, n in enumerate(names)]).drop("__hot"), [*H.FEATURES, "g", *(f"kind={n}" for n in names)]


@query(f"""with {LEADS}, s as (select event, sid, day, conf, sev, g, arm as kind, case when lead > 0 then 0 else 1 end as pool, cast(lead > 0 and is_tp as int) as y from leads where forward and lead between -60 and 180 and lead <> 0)
select event, sid, day, conf, sev, g, kind, pool, y, count(*) over w as prior_count, coalesce(date_diff('day', lag(day) over (partition by event order by day, sid), day), 0) as days_since,
  {MEAN.format(v="conf")} as prior_conf, {MEAN.format(v="sev")} as prior_sev, cast(kind = 'F' as int)::double as "kind=F", cast(kind = 'O' as int)::double as "kind=O"
from s window w as (partition by event order by day, sid rows between unbounded preceding and 1 preceding)""")
def causal_features(spark, d):
    h, _ = featured(spark, d)
    return h.withColumn("days_since", F.col("days_since").cast("long"))


@query()
def loeo_scores(spark, d):
    """Each event's scores by a model of the other events."""
    h, names = featured(spark, d)
    return H.held_out_scores(h.where("pool = 0"), names, "y", "event").select("event", "sid", "y", F.round("score", 6).alias("score"))


@query()
def frame_separability(spark, d):
    """How well features alone tell the pools apart, out of fold."""
    h, names = featured(spark, d)
    s = stored(H.held_out_scores(h, names, "pool", "event").select(F.round("score", 6).alias("score"), (F.col("pool") == 1).alias("is_tp")), "scores")
    return A.auc(s, "score", F.col("is_tp")).join(A.average_precision(s, "score", "is_tp").select("ap"))


@query()
def coefficient_ranking(spark, d):
    h, names = featured(spark, d)
    return H.coefficients(h.where("pool = 0"), names, "y").select("feature", F.round("coef", 6).alias("coef"))


@query()
def schema_recoverability(spark, d):
    """Whether an event's own means tell which arm finds more of it: one row per event with three signals or more, each scored by a model of the others."""
    s = A.pre_onset(leads(spark, d)).where("forward")
    hit = lambda a: F.count_if((F.col("arm") == a) & F.col("is_tp"))
    e = s.groupBy("event").agg(F.avg("conf").alias("conf"), F.avg("sev").alias("sev"), F.avg("g").alias("g"), F.avg(F.col("forward").cast("int")).alias("part"), F.count("*").alias("n"), (hit("O") > hit("F")).cast("int").alias("y")).where("n >= 3")
    return H.held_out_scores(stored(e, "means"), ["conf", "sev", "g", "part", "n"], "y", "event", least=1).select("event", "y", F.round("score", 6).alias("score"))
