"""Queries on attribution, article texts, warnings, tiers and annotators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.operators import attribution as T
from augury.operators import match as M
from augury.operators import metrics as A
from augury.plans import registry as R
from augury.plans.adapters import SIGNALS, TRUTH, signals, table, truth
from augury.plans.catalog import query

WINDOWS = f"{SIGNALS}, {TRUTH}, placed as (select s.*, (select arg_min(truth_id, ev_ord) from truth where s.day between onset and onset + 5) as truth_id from signals s)"


def placed(spark, d, unmatched=None):
    return T.attributed(signals(spark, d), "day", T.first_windows(truth(spark, d), "truth_id", "ev_ord", "onset", 5), "truth_id", unmatched)


@query(f"with {WINDOWS} select event_id, truth_id from placed where truth_id is not null")
def article_event(spark, d):
    """The first event whose window holds a record's day."""
    return placed(spark, d).select("event_id", "truth_id")


@query(f"with {WINDOWS} select coalesce(truth_id, 'UNMATCHED') as truth_id, count(*) as n from placed group by all")
def article_event_counts(spark, d):
    return placed(spark, d, "UNMATCHED").groupBy("truth_id").agg(F.count("*").alias("n"))


FWD = "coalesce(temporality in ('forward_looking', 'latent'), false)"


@query(f"""with {WINDOWS}, p as (select a.*, t.onset from placed a join truth t using (truth_id) where day >= onset) select case when grouping(truth_id) = 1 then 'POOLED' else truth_id end as truth_id,
 count(*) filter (day > onset) as n_post, count(*) filter (day = onset) as n_onset_day, count(*) filter (day > onset and {FWD}) as n_forward,
 round(count(*) filter (day > onset and {FWD}) / nullif(count(*) filter (day > onset), 0), 6) as beta0, round(avg(conf::double) filter (day > onset and {FWD}), 6) as conf_forward, round(avg(conf::double) filter (day > onset and not {FWD}), 6) as conf_other
 from p group by rollup (truth_id)""")
def beta0_attributed(spark, d):
    p = placed(spark, d).join(truth(spark, d).select("truth_id", "onset"), "truth_id")
    return T.contamination(p, "truth_id", "day", "onset", F.coalesce(F.col("temporality").isin(*X.FORWARD), F.lit(False)), "conf")


@query(f"with {WINDOWS} select truth_id, temporality, count(*) as n from placed where truth_id is not null group by all")
def label_mix(spark, d):
    """Labels of each event's attributed signals."""
    return placed(spark, d).groupBy("truth_id", "temporality").agg(F.count("*").alias("n"))


#: Every forward signal with the largest lead to any event that it matches loosely, if any.
WARNINGS = f"""{R.MATCHED}, warnings as (select s.event_id, s.day, s.user_id, s.conf::double as conf, coalesce(m.lead, 0) as lead, m.lead is not null as is_tp, case s.user_id % 3 when 1 then [] when 0 then ['the'] else ['DE', 'zebra'] end as phrases, lower(coalesce(a.text, '')) as article, len(list_filter(phrases, lambda p: contains(article, lower(p)))) as n_found,
  case when len(phrases) = 0 then 0.0 else n_found / len(phrases) end::double as g
  from signals s left join documents a on a.doc_id = s.event_id left join (select event_id, max(lead) as lead from matched where loose group by event_id) m using (event_id) where {FWD})"""


def warnings(spark, d):
    """Grounding: the share of a signal's phrases that its article holds; signals without an article have none of theirs."""
    s = signals(spark, d).where(F.col("temporality").isin(*X.FORWARD))
    m = R.matched(spark, d).where("loose").groupBy("event_id").agg(F.max("lead").alias("best"))
    k = F.col("user_id") % 3
    phrases = F.when(k == 0, F.array(F.lit("the"))).when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("DE"), F.lit("zebra")))
    text = table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.lower("text").alias("article"))
    s = s.join(m, "event_id", "left").withColumn("phrases", phrases).join(text, "event_id", "left")
    s = s.withColumn("missing", F.filter("phrases", lambda p: ~F.coalesce(F.contains(F.col("article"), F.lower(p)), F.lit(False))))
    share = F.when(F.size("phrases") > 0, 1 - F.size("missing") / F.size("phrases")).otherwise(0.0)
    return s.select("event_id", "day", "conf", F.coalesce("best", F.lit(0)).alias("lead"), F.col("best").isNotNull().alias("is_tp"), share.alias("g"), (F.size("phrases") > 0).alias("given"), "missing")


@query(f"with {WARNINGS} select event_id, case when is_tp then cast(lead as bigint) end as lead, is_tp, conf from warnings")
def warning_rows(spark, d):
    return warnings(spark, d).select("event_id", F.when(F.col("is_tp"), F.col("lead").cast("long")).alias("lead"), "is_tp", "conf")


@query(f"with {WARNINGS} select round(avg((1 - exp(-lead / 30.0)) * g * cast(is_tp as int) - 0.5 * (1 - g) * conf), 4) as fwgs, count(*) as n_signals, count(*) filter (is_tp) as n_tp, count(*) filter (not is_tp) as n_fp from warnings")
def fwgs_all_events(spark, d):
    """The score over all forward signals, with hits from any event."""
    return warnings(spark, d).agg(F.round(F.avg(A.fwgs("v1")), 4).alias("fwgs"), F.count("*").alias("n_signals"), F.count_if("is_tp").alias("n_tp"), F.count_if(~F.col("is_tp")).alias("n_fp"))


@query(f"with {WARNINGS} select count(*) as n, count(*) filter (g = 1) as n_faithful, round(count(*) filter (g = 1) / count(*), 6) as part from warnings where len(phrases) > 0")
def all_phrases_found(spark, d):
    """Share of signals with phrases whose phrases are all in the text."""
    w = warnings(spark, d).where("given")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("g") == 1).alias("n_faithful"), F.round(F.count_if(F.col("g") == 1) / F.count("*"), 6).alias("part"))


@query(f"with {WARNINGS} select event_id, array_to_string(list_filter(phrases, lambda p: not contains(article, lower(p))), '|') as missing, g from warnings where len(phrases) > 0 and g < 1")
def phrase_violations(spark, d):
    """Signals with phrases that their article doesn't hold, and which."""
    return warnings(spark, d).where(F.col("given") & (F.col("g") < 1)).select("event_id", F.array_join("missing", "|").alias("missing"), "g")


PLAIN = {k: f"coalesce(contains({R.padded(k)}, {R.padded('t_' + k)}) or contains({R.padded('t_' + k)}, {R.padded(k)}), false)" for k in ("co", "geo", "good")}


@query(f"""with {R.MATCHED}, p as (select *, {", ".join(f"{v} as {k}_p" for k, v in PLAIN.items())} from matched),
 q as (select truth_id, unnest([0, 1, 2, 3]) as tier, unnest([loose, co_p or geo_p or good_p, co_p or (geo_p and good_p), co_p]) as ok from p),
 r as (select 'T' || tier as tier, count(*) as fwd, count(*) filter (ok) as tp, count(distinct truth_id) filter (ok) as hits from q group by tier)
 select *, round(tp / fwd, 6) as prec, tp - (select tp from r where tier = 'T0') as vs_t0 from r""")
def tier_comparison(spark, d):
    """Matches under the four tiers (substring; words; company or two dimensions; company), without acronyms."""
    m = R.matched_classes(spark, d)
    co, geo, good = (F.col(f"{k}_p") > 0 for k in ("co", "geo", "good"))
    tiers = {"T0": F.col("loose"), "T1": co | geo | good, "T2": co | (geo & good), "T3": co}
    q = m.select("truth_id", "weight", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), c.alias("ok")) for t, c in tiers.items()])).alias("x")).select("truth_id", "weight", "x.*")
    r = q.groupBy("tier").agg(F.sum("weight").alias("fwd"), R.weight_if(F.col("ok")).alias("tp"), F.count_distinct(F.when(F.col("ok"), F.col("truth_id"))).alias("hits"))
    return r.withColumn("base", F.max(F.when(F.col("tier") == "T0", F.col("tp"))).over(Window.partitionBy(F.lit(1)))).select(  # four rows
        "tier", "fwd", "tp", "hits", F.round(F.col("tp") / F.col("fwd"), 6).alias("prec"), (F.col("tp") - F.col("base")).alias("vs_t0"))


@query(f"""with {R.MATCHED}, b as (select truth_id, case when co_w then 'company' when geo_w and good_w then 'geo+commodity' when good_w then 'commodity_only' when geo_w then 'geo_only' else 'no_match' end as basis from matched),
 c as (select truth_id, count(*) filter (basis <> 'no_match') as n, count(*) filter (basis in ('commodity_only', 'geo_only')) as weak from b group by truth_id)
 select truth_id, n, weak, round(weak / n, 6) as part from c where n > 0 order by round(weak / n, 6) desc, truth_id limit 6""")
def weakest_evidence(spark, d):
    """The six events with the largest share of matches by one dimension only."""
    b = R.matched_classes(spark, d).select("truth_id", "weight", M.basis(F.col("co_w"), F.col("geo_w"), F.col("good_w")).alias("basis")).where("basis <> 'no_match'")
    c = b.groupBy("truth_id").agg(F.sum("weight").alias("n"), R.weight_if(F.col("basis").isin("commodity_only", "geo_only")).alias("weak"))
    return c.withColumn("part", F.round(F.col("weak") / F.col("n"), 6)).orderBy(F.col("part").desc(), "truth_id").limit(6)


@query("select doc_id, md5(coalesce(nullif(case when doc_id % 5 = 0 then '' else text end, ''), source, '')) as h from documents")
def article_texts(spark, d):
    body = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.article_text(body, F.col("source"))).alias("h"))


FIRST = "case when doc_id % 7 = 0 then '?' else cast(quality as varchar) end"
SECOND = "case when doc_id % 11 = 0 then '?' else cast(1 - toxic as varchar) end"


def annotator(spark, d, expression: str):
    return table(spark, d, "labels").select("doc_id", F.expr(expression.replace("varchar", "string")).alias("label"))


@query(f"""with l as (select {FIRST} as a, {SECOND} as b from labels where doc_id % 3 <> 0), s as (select count(*) as n, avg((a = b)::int) as po,
 {" + ".join(f"avg((a = '{c}')::int) * avg((b = '{c}')::int)" for c in "10?")} as pe from l) select n, round(po, 6) as po, round(case when pe = 1 then 1 else (po - pe) / (1 - pe) end, 6) as kappa from s""")
def kappa_three_labels(spark, d):
    """Two annotators, who share part of the rows, with the label for unsure as a category of its own."""
    return T.nominal_kappa(annotator(spark, d, FIRST), annotator(spark, d, SECOND).where("doc_id % 3 <> 0"), "doc_id", "label")


@query(f"""with l as (select source, {FIRST} as label from labels join documents using (doc_id)) select case when grouping(source) = 1 then 'POOLED' else source end as source, count(*) filter (label = '1') as tp,
 count(*) filter (label in ('1', '0')) as n, count(*) filter (label not in ('1', '0')) as unsure, round(count(*) filter (label = '1') / nullif(count(*) filter (label in ('1', '0')), 0), 6) as prec from l group by rollup (source)""")
def human_precision(spark, d):
    return T.human_precision(annotator(spark, d, FIRST).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source", "label")


@query(f"""with l as (select lang = 'en' as hit, {FIRST} as label from labels join documents using (doc_id)), c as (select hit, count(*) filter (label = '1')::double as tp, count(*)::double as n from l where label <> '?' group by hit)
 select hit, tp::bigint as tp, n::bigint as n, round(tp / n, 6) as ppv, {R.WILSON.format(s='-')} as lo, {R.WILSON.format(s='+')} as hi from c""")
def stratum_ppv(spark, d):
    """Share of human hits among protocol hits and misses, with Wilson intervals."""
    l = annotator(spark, d, FIRST).join(table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("hit")), "doc_id").where("label <> '?'")
    return A.with_wilson(l.groupBy("hit").agg(F.count_if(F.col("label") == "1").alias("tp"), F.count("*").alias("n"))).withColumn("ppv", F.round(F.col("tp") / F.col("n"), 6))
