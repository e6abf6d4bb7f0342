"""Report tables: per event, side by side, pooled, swept over rules, and as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import corpus as C
from augury.operators import metrics as A
from augury.operators import reports as T
from augury.operators import worksheets as W
from augury.plans import registry as R
from augury.plans.adapters import LEADS, leads, table
from augury.plans.attribution import FIRST, WARNINGS, annotator, warnings
from augury.plans.catalog import query
from augury.plans.worksheets import GAIN, gains

V3 = R.FWGS["v3"]
PRE = "forward and lead between 1 and 180"


@query(f"with {R.MATCHED} select truth_id, event_id, row_number() over (partition by truth_id order by day, event_id) as place from matched where strict")
def matched_ids(spark, d):
    """Each event's matched signals in order of their days, numbered without a task that holds an event."""
    m = R.matched(spark, d).where("strict").select("truth_id", F.unix_date("day").alias("at"), "event_id")
    return W.numbered_per_day(m, "truth_id", ["at", "event_id"], "at").select("truth_id", "event_id", F.col("seq").alias("place"))


@query(f"with {R.MATCHED}, e as (select truth_id, min(day) as day from matched where strict group by truth_id) select count(e.truth_id) as n_hit, round(avg(date_diff('day', day, onset)), 6) as mean_lead, min(date_diff('day', day, onset)) as least, max(date_diff('day', day, onset)) as most from truth left join e using (truth_id)")
def lead_summary(spark, d):
    """Mean, least and greatest lead of the events that any signal matches."""
    v = R.validate_strict(spark, d)
    return v.agg(F.count_if("hit").alias("n_hit"), F.round(F.avg("lead"), 6).alias("mean_lead"), F.min("lead").alias("least"), F.max("lead").alias("most"))


@query(f"with {R.MATCHED}, f as (select event_id, arg_min(lead, ev_ord) as lead from matched where loose group by event_id) select s.event_id, s.conf::double as conf, f.lead is not null as correct, f.lead::bigint as lead from signals s left join f using (event_id) where temporality in ('forward_looking', 'latent')")
def label_correctness(spark, d):
    """Confidence, correctness and lead of every forward signal, by the first event it matches."""
    first = R.matched(spark, d).where("loose").groupBy("event_id").agg(F.min_by("lead", "ev_ord").cast("long").alias("lead"))
    s = R.signals(spark, d).where(F.col("temporality").isin(*R.X.FORWARD))
    return s.join(first, "event_id", "left").select("event_id", "conf", F.col("lead").isNotNull().alias("correct"), "lead")


SIDES = {k: f"coalesce(contains({R.padded(k)}, {R.padded('t_' + k)}) or contains({R.padded('t_' + k)}, {R.padded(k)}), false)" for k in ("co", "geo", "good")}


@query(f"with {R.MATCHED}, p as (select truth_id, event_id, {', '.join(f'{v} as {k}_p' for k, v in SIDES.items())} from matched) select truth_id, event_id, case when geo_p then 'geo' else 'good' end as alone from p where (co_p or geo_p or good_p) and not (co_p or (geo_p and good_p))")
def tier_drops(spark, d):
    """Matches of the second tier that the third drops, with the one thing that matched."""
    co, geo, good = (F.col(f"{k}_p") > 0 for k in ("co", "geo", "good"))
    return R.matched(spark, d).where((co | geo | good) & ~(co | (geo & good))).select("truth_id", "event_id", F.when(geo, "geo").otherwise("good").alias("alone"))


@query(f"with {R.MATCHED}, x as (select truth_id, event_id, unnest(['R0', 'R1', 'R2', 'R3', 'R4', 'loose', 'strict']) as mode, unnest([r0, r1, r2, r3, r4, loose, strict]) as ok from matched), y as (select mode, event_id % 2 as arm, event_id, bool_or(ok) as ok, count(distinct truth_id) filter (ok) as events from x group by all) select mode, cast(arm as bigint) as arm, count(*) as n, count(*) filter (ok) as tp, round(count(*) filter (ok) / count(*), 6) as prec from y group by mode, arm")
def rule_sweep(spark, d):
    """Signals in a window, matches and precision under every rule, for two arms (titles and bodies; here: even and odd)."""
    modes = {r[:2]: r for r in R.M.RULES} | {"loose": "loose", "strict": "strict"}
    m = R.matched(spark, d).groupBy("event_id").agg(*[F.bool_or(c).alias(k) for k, c in modes.items()])
    return m.unpivot("event_id", list(modes), "mode", "ok").groupBy("mode", (F.col("event_id") % 2).alias("arm")).agg(F.count("*").alias("n"), F.count_if("ok").alias("tp"), F.round(F.count_if("ok") / F.count("*"), 6).alias("prec"))


@query(f"with {R.MATCHED}, c as (select truth_id, day, event_id, co_s, not (geo_s or good_s) and co_s as only_co from matched) select truth_id, count(*) filter (co_s) as company_hit, count(*) filter (only_co) as company_only from c group by truth_id")
def company_hits(spark, d):
    """Signals that match an event's company, and those that match nothing else of it."""
    co, other = F.col("co_s") > 0, (F.col("geo_s") > 0) | (F.col("good_s") > 0)
    return R.matched_classes(spark, d).groupBy("truth_id").agg(R.weight_if(co).alias("company_hit"), R.weight_if(co & ~other).alias("company_only"))


@query(f"with {LEADS}, c as (select arm, conf, count(*) as n from leads group by arm, conf), r as (select *, row_number() over (partition by arm order by n desc, conf) as k from c) select arm, sum(n)::bigint as n, count(*) as n_values, max(conf) filter (k = 1) as mode, round(max(n) / sum(n), 6) as mode_share, string_agg(printf('%.3f:%d', conf, n), ' ' order by k) filter (k <= 3) as top from r group by arm")
def confidence_modes(spark, d):
    """Different confidences, the commonest and its share, and the three commonest, of each arm."""
    return T.modes(leads(spark, d), "arm", "conf")


@query(f"with {LEADS}, p as (select -lead as lag, forward from leads where -lead between 1 and 14), s as (select delta, round(case when count(lag) > 0 then sum(cast(coalesce(forward, false) as int)) / count(lag) end, 6) as s from range(1, 15) r(delta) left join p on lag >= delta group by delta) select round(sum(s), 6) as mean_lag, count(s) as n_points from s")
def censored_lag(spark, d):
    """Mean lag of forward labels after the onset, cut at 14 days: the sum of the survival curve."""
    return A.survival(leads(spark, d)).agg(F.round(F.sum("s"), 6).alias("mean_lag"), F.count("s").alias("n_points"))


ABLATED = ["v1", "no_w", "no_g", "no_lam"]


@query(f"with {LEADS}, a as (select event, unnest({ABLATED}) as variant, unnest([{', '.join(f'round(avg({R.FWGS[v]}), 6)' for v in ABLATED)}]) as fwgs from leads where lead between 1 and 180 group by event) select a.event, variant, a.fwgs, round(a.fwgs - b.fwgs, 6) as over_first from a join (select variant, fwgs from a where event = 0) b using (variant)")
def ablation_by_event(spark, d):
    """The score's variants for each event, and how far each is from the first event's."""
    a = T.ablations(A.pre_onset(leads(spark, d)), "event", ABLATED)
    first = a.where("event = 0").select("variant", F.col("fwgs").alias("base"))
    return a.join(first, "variant").select("event", "variant", "fwgs", F.round(F.col("fwgs") - F.col("base"), 6).alias("over_first"))


TABLE = f"select {{by}} count(*) as n, count(*) filter (is_tp) as tp, count(*) filter (not is_tp) as fp, round(avg(cast(is_tp as int)), 6) as prec, max(lead) as earliest_lead, round(avg({V3}), 6) as fwgs from leads where {PRE} {{w}} group by all"


@query(f"with {LEADS} {TABLE.format(by='event,', w='')}")
def event_table(spark, d):
    """The table of events, with the earliest lead of any forward signal."""
    return T.event_table(leads(spark, d).where(PRE), "event", F.col("is_tp"))


COLUMNS = ["n", "tp", "fp", "prec", "earliest_lead", "fwgs"]


@query(f"with {LEADS}, a as ({TABLE.format(by='event,', w="and arm = 'F'")}), b as ({TABLE.format(by='event,', w="and arm = 'O' and event <> 5")}) select a.event, " + ", ".join(f"a.{c} as {c}_title, b.{c} as {c}_body" for c in COLUMNS) + " from a left join b on a.event = b.event")
def title_body(spark, d):
    """Titles against bodies (here: two arms), event by event; an event may lack its bodies."""
    s = leads(spark, d).where(PRE)
    return T.side_by_side(*(T.event_table(x, "event", F.col("is_tp")) for x in (s.where("arm = 'F'"), s.where("arm = 'O' and event <> 5"))), "event", ("title", "body"))


@query(f"with {LEADS}, pairs as (select l.* from leads l where {PRE} and exists (select 1 from orders where o_orderkey = sid // 10 and o_orderstatus <> 'P' and o_totalprice > 100000)) select arm, (select count(*) from leads x where x.arm = p.arm and {PRE}) as n_all, count(*) as n, count(*) filter (is_tp) as tp, round(avg(cast(is_tp as int)), 6) as prec, round(avg({V3}), 6) as fwgs from pairs p group by arm")
def body_subset(spark, d):
    """Both arms over only those signals whose body is there (its status isn't the fallback, and it isn't empty), and how many there were."""
    s = leads(spark, d).where(PRE).withColumn("article", F.floor(F.col("sid") / 10))
    there = table(spark, d, "orders").where("o_orderstatus <> 'P' and o_totalprice > 100000").select(F.col("o_orderkey").alias("article"))
    sub = A.cell(s.join(there, "article", "left_semi"), ["arm"]).drop("fp")
    return sub.join(s.groupBy("arm").agg(F.count("*").alias("n_all")), "arm").select("arm", "n_all", "n", "tp", "prec", "fwgs")


@query(f"with {LEADS}, c as (select arm, event, count(*) as n, round(avg({V3}), 6) as fwgs from leads where {PRE} group by arm, event), p as (select coalesce(a.event, b.event) as event, a.n as n_v1, b.n as n_v2, a.fwgs as fwgs_v1, b.fwgs as fwgs_v2 from (select * from c where arm = 'F') a full join (select * from c where arm = 'O') b using (event)) select cast(event as varchar) as event, n_v1, n_v2, fwgs_v1, fwgs_v2, round(fwgs_v2 - fwgs_v1, 6) as gain from p union all select 'POOLED', sum(n_v1)::bigint, sum(n_v2)::bigint, round(sum(n_v1 * fwgs_v1) / sum(n_v1), 6), round(sum(n_v2 * fwgs_v2) / sum(n_v2), 6), round(sum(n_v2 * fwgs_v2) / sum(n_v2) - sum(n_v1 * fwgs_v1) / sum(n_v1), 6) from p")
def version_comparison(spark, d):
    """Scores of two versions by event, and pooled by the number of signals."""
    c = A.cell(leads(spark, d).where(PRE), ["arm", "event"])
    a, b = (c.where(F.col("arm") == arm).select(F.col("event").cast("string").alias("event"), F.col("n").alias(f"n_{v}"), F.col("fwgs").alias(f"fwgs_{v}")) for arm, v in (("F", "v1"), ("O", "v2")))
    p = a.join(b, "event", "full")
    mean = lambda v: F.sum(F.col(f"n_{v}") * F.col(f"fwgs_{v}")) / F.sum(f"n_{v}")
    pool = p.agg(F.sum("n_v1").alias("n_v1"), F.sum("n_v2").alias("n_v2"), F.round(mean("v1"), 6).alias("fwgs_v1"), F.round(mean("v2"), 6).alias("fwgs_v2"), F.round(mean("v2") - mean("v1"), 6).alias("gain")).select(F.lit("POOLED").alias("event"), "*")
    return p.withColumn("gain", F.round(F.col("fwgs_v2") - F.col("fwgs_v1"), 6)).select("event", "n_v1", "n_v2", "fwgs_v1", "fwgs_v2", "gain").unionByName(pool)


STRATUM = "case when lead <= 7 then '1-7' when lead <= 30 then '8-30' when lead <= 90 then '31-90' else '91-180' end"


@query(f"with {LEADS}, r as (select event, {STRATUM} as stratum, count(*) as n, round(avg(conf::double), 6) as conf, case when count(*) >= 20 then round(avg(cast(is_tp as int)), 6) end as acc from leads where {PRE} group by all), q as (select *, round(abs(conf - acc), 6) as ece from r) select stratum, sum(n)::bigint as n, " + ", ".join(f"round(sum({m} * n) / sum(n) filter ({m} is not null), 6) as {m}, coalesce(sum(n) filter ({m} is not null), 0)::bigint as n_{m}" for m in ("conf", "acc", "ece")) + " from q group by stratum")
def report_pooling(spark, d):
    """Calibration reports of the events pooled by stratum, each with the weight of its signals; small strata have no accuracy."""
    r = leads(spark, d).where(PRE).groupBy("event", R.X.stratum(F.col("lead")).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"), F.when(F.count("*") >= 20, F.round(F.avg(F.col("is_tp").cast("double")), 6)).alias("acc"))
    return T.pooled(r.withColumn("ece", F.round(F.abs(F.col("conf") - F.col("acc")), 6)), "stratum", "n", ["conf", "acc", "ece"])


@query("with r as (select n_name as id, n_nationkey % 3 <> 0 as verified, case when n_nationkey % 4 = 0 then null when n_nationkey % 4 = 1 then '' else 's' end as source from nation) select id, verified, coalesce(source, '') = '' as unsourced, (select count(*) from r where not verified) as n_open from r where not verified or coalesce(source, '') = ''")
def registry_check(spark, d):
    """Events whose onset isn't verified or has no source, with the number of the former."""
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(F.col("n_name").alias("id"), (k % 3 != 0).alias("verified"), F.when(k % 4 == 1, "").when(k % 4 > 1, "s").alias("source"))
    unsourced = F.coalesce("source", F.lit("")) == ""
    n = F.sum((~F.col("verified")).cast("long")).over(R.Window.partitionBy(F.lit(1)))  # a row per event
    return r.withColumn("n_open", n).where(~F.col("verified") | unsourced).select("id", "verified", unsourced.alias("unsourced"), "n_open")


@query(f"with l as (select doc_id, {FIRST} as a, case when doc_id % 5 = 0 then null else cast(1 - toxic as varchar) end as b from labels) select doc_id, a is distinct from b as differs, row_number() over (order by a is not distinct from b, doc_id) as place from l")
def disagreements_first(spark, d):
    """An adjudication sheet's order: rows the annotators differ on first, then by id."""
    a = annotator(spark, d, FIRST).withColumnRenamed("label", "a")
    b = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, (1 - F.col("toxic")).cast("string")).alias("b"))
    j = a.join(b, "doc_id").select("doc_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))
    n = W.numbered_per_day(j, "differs", ["doc_id"], "doc_id")
    first = j.agg(F.count_if("differs").alias("first"))
    return n.join(F.broadcast(first)).select("doc_id", "differs", (F.col("seq") + F.when(F.col("differs"), 0).otherwise(F.col("first"))).alias("place"))


SLUG = "lower(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1])"


@query(f"with p as (select {SLUG} as slug, url from pages) select count(*) as n, count(*) filter (contains(slug, '2')) as named, count(*) filter (contains(slug, '2') and contains(slug, '5')) as named_and_kind, count(*) filter (contains(slug, '5') and not contains(slug, '2')) as kind_only, count(distinct slug) as n_slugs from p")
def slug_evidence(spark, d):
    """How many addresses name a contested event, its kind, or both (here: two digits)."""
    slug = F.lower(F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", ""), "/"), -1))
    p = table(spark, d, "pages").select(slug.alias("slug"))
    a, b = F.contains("slug", F.lit("2")), F.contains("slug", F.lit("5"))
    return p.agg(F.count("*").alias("n"), F.count_if(a).alias("named"), F.count_if(a & b).alias("named_and_kind"), F.count_if(b & ~a).alias("kind_only"), F.count_distinct("slug").alias("n_slugs"))


@query("with f as (select event_type as eid, cast(ts as date) as day, user_id as url, min(event_id) as first from events group by all) select printf('%s-%s-%04d', eid, strftime(day, '%Y-%m-%d'), row_number() over (partition by eid, day order by first) - 1) as id, url, first from f")
def article_ids(spark, d):
    """Articles of each event and day, each address once at its first place, with ids by that order."""
    e = table(spark, d, "events").select(F.concat_ws("-", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.col("user_id").alias("url"), "event_id")
    first = e.groupBy("day", "url").agg(F.min("event_id").alias("first"))
    n = W.numbered_per_day(first, "day", ["first"], "first")
    return n.select(F.format_string("%s-%04d", "day", (F.col("seq") - 1)).alias("id"), "url", "first")


@query("with f as (select user_id as url, arg_min(event_type, event_id) as kind, min(event_id) as first from events where event_type <> 'error' group by 1) select e.event_id, coalesce(case when e.event_type = 'error' then f.kind end, e.event_type) as kind, case when e.event_type = 'error' then f.first else e.event_id end as id from events e left join f on f.url = e.user_id")
def first_event_of_url(spark, d):
    """Rows without an event take that of the first row with the same address; those with one keep it."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("url"))
    first = C.first_wins(e.where("event_type <> 'error'"), "url", ["event_id"]).select("url", F.col("event_type").alias("kind"), F.col("event_id").alias("first"))
    lost = F.col("event_type") == "error"
    return e.join(first, "url", "left").select("event_id", F.coalesce(F.when(lost, F.col("kind")), F.col("event_type")).alias("kind"), F.when(lost, F.col("first")).otherwise(F.col("event_id")).alias("id"))


HASH = "(sid % 2147483647 * 1103515245 + 42 * 12345) % 2147483647"


@query(f"with {LEADS}, r as (select event, is_tp, sid, row_number() over (partition by event, is_tp order by {HASH}, sid) as rn, {HASH} as h from (select distinct event, is_tp, sid from leads)), c as (select * from r where rn <= 6) select event, is_tp, sid, rn from (select *, row_number() over (order by rn, h, event, sid) as place from c) where place <= 100")
def capped_sample(spark, d):
    """Up to six hits and six others of each event, and a hundred rows in all, taken from every stratum in turn."""
    s = C.stratified(leads(spark, d).select("event", "is_tp", "sid").distinct(), ["event", "is_tp"], "sid", 6)
    order = (F.col("sid") % 2147483647 * 1103515245 + F.lit(42) * 12345) % 2147483647
    return s.orderBy("rn", order, "event", "sid").limit(100).select("event", "is_tp", "sid", "rn")


@query("with t as (select doc_id, case doc_id % 6 when 0 then 'Just a moment. ' || text when 1 then text || ' The Wayback Machine doesn''t have it' when 2 then 'CAPTCHA: ' || text else text end as text from documents) select doc_id, length(coalesce(text, '')) >= 250 and not regexp_matches(coalesce(text, ''), '(?i)just a moment\\.|captcha|wayback machine (has not|doesn''?t have|does not have)') as ok, length(coalesce(text, '')) >= 400 and not regexp_matches(coalesce(text, ''), '(?i)just a moment\\.|captcha|wayback machine (has not|doesn''?t have|does not have)') as ok_late from t".replace("\\\\", "\\"))
def challenge_pages(spark, d):
    """Texts that are acceptable bodies in the early and the late pass: long enough, and no challenge page."""
    i = F.col("doc_id") % 6
    text = F.when(i == 0, F.concat(F.lit("Just a moment. "), "text")).when(i == 1, F.concat("text", F.lit(" The Wayback Machine doesn't have it"))).when(i == 2, F.concat(F.lit("CAPTCHA: "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text")).select("doc_id", T.acceptable(F.col("text")).alias("ok"), T.acceptable(F.col("text"), 400).alias("ok_late"))


@query("select doc_id, md5('You read news.') as system, md5('Date: ' || n_chars || chr(10) || 'Source: ' || source || chr(10) || 'Title: ' || lang || chr(10) || 'Text: ' || text) as prompt from documents")
def prompts(spark, d):
    """The two prompts for every document."""
    template = F.lit("# v2\n## System Prompt\nYou read news.\n\n## User Prompt\nDate: {1}\nSource: {2}\nTitle: {3}\nText: {4}\n")
    system, user = T.prompt(template, [F.col("n_chars"), F.col("source"), F.col("lang"), F.col("text")])
    return table(spark, d, "documents").select("doc_id", F.md5(system).alias("system"), F.md5(user).alias("prompt"))


@query("select n_name as id, case when n_nationkey in (3, 8, 11) then 'excluded' else 'kept' end as side, case n_nationkey when 3 then 'no source' when 8 then 'duplicate' when 11 then 'no source' end as reason from nation")
def retraction_split(spark, d):
    """The ground truth in two, kept and excluded, with the log's reason."""
    log = spark.createDataFrame([(3, "no source"), (8, "duplicate"), (11, "no source")], "n_nationkey long, reason string")
    return table(spark, d, "nation").join(F.broadcast(log), "n_nationkey", "left").select(F.col("n_name").alias("id"), F.when(F.col("reason").isNotNull(), "excluded").otherwise("kept").alias("side"), "reason")


@query(f"with {LEADS} select event, sid, case when is_tp then lead::bigint end as lead, is_tp, conf, sev::bigint as sev, arm as kind from leads where {PRE}")
def warning_details(spark, d):
    """Forward signals with lead, confidence, severity and type."""
    return leads(spark, d).where(PRE).select("event", "sid", F.when(F.col("is_tp"), F.col("lead").cast("long")).alias("lead"), "is_tp", "conf", F.col("sev").cast("long").alias("sev"), F.col("arm").alias("kind"))


@query(f"with l as (select source, {FIRST} as label, n_chars % 180 + 1 as lead, doc_id % 5 / 4.0 as g from labels join documents using (doc_id)), s as (select source, case when label = '1' then (1 - exp(-lead / 30.0)) * g else -0.5 * (1 - g) end as v from l) select case when grouping(source) = 1 then 'POOLED' else source end as source, count(*) as n, round(avg(v), 6) as fwgs from s group by rollup (source)")
def human_fwgs(spark, d):
    """The score with people's verdicts as hits; an unsure one counts as a false alarm here. By source, and pooled."""
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") % 180 + 1).alias("lead"), (F.col("doc_id") % 5 / 4.0).alias("g"))
    s = annotator(spark, d, FIRST).join(docs, "doc_id").withColumn("is_tp", F.col("label") == "1")
    r = s.rollup("source").agg(F.grouping("source").alias("all"), F.count("*").alias("n"), F.round(F.avg(A.fwgs("v3")), 6).alias("fwgs"))
    return r.select(F.when(F.col("all") == 1, "POOLED").otherwise(F.col("source")).alias("source"), "n", "fwgs")


@query(f"{GAIN}, k as (select event % 3 as kind, avg(net) as m, sum(greatest(h1, h2)) as best, sum(h1) as h1, sum(h2) as h2 from g group by 1) select round(max(m) - min(m), 6) as spread, sum(best)::bigint as bound, sum(h1)::bigint as h1, sum(h2)::bigint as h2, sum(greatest(h1, h2))::bigint as by_type from k")
def gain_bounds(spark, d):
    """How far the types' mean gains are apart, and what choosing the better schema by event, or by type, would hit."""
    g = gains(spark, d).withColumn("kind", F.col("event") % 3)
    k = g.groupBy("kind").agg(F.avg("net").alias("m"), F.sum(F.greatest("h1", "h2")).alias("best"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    return k.agg(F.round(F.max("m") - F.min("m"), 6).alias("spread"), F.sum("best").alias("bound"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.sum(F.greatest("h1", "h2")).alias("by_type"))


@query(f"with {LEADS}, t as ({TABLE.format(by='event,', w='')}) select event, printf('| event_%d | %d | %.3f | %.4f |', event, n, prec, fwgs) as markdown, printf('event\\_%d & %d & %.3f & %.4f \\\\', event, n, prec, fwgs) as latex from t")
def table_lines(spark, d):
    """The table of events as lines of Markdown and LaTeX."""
    t = event_table(spark, d).withColumn("name", F.format_string("event_%d", "event"))
    columns = {"name": "%s", "n": "%d", "prec": "%.3f", "fwgs": "%.4f"}
    return T.table_lines(T.table_lines(t, columns).withColumnRenamed("line", "markdown"), columns, "latex").select("event", "markdown", F.col("line").alias("latex"))


@query(f"with {WARNINGS}, e as (select user_id % 4 as firm, * from warnings) select cast(firm as bigint) as firm, count(*) as n, count(*) filter (is_tp) as tp, round(avg(cast(is_tp as int)), 6) as prec, round(avg((1 - exp(-lead / 30.0)) * g * cast(is_tp as int) - 0.5 * (1 - g) * conf), 6) as fwgs, max(lead) filter (is_tp) as earliest from e group by firm")
def filing_cells(spark, d):
    """A second corpus, filings by firm (here: users), against the same ground truth and by the same measures."""
    users = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("firm"))
    w = warnings(spark, d).join(users, "event_id")
    return w.groupBy("firm").agg(F.count("*").alias("n"), F.count_if("is_tp").alias("tp"), F.round(F.avg(F.col("is_tp").cast("double")), 6).alias("prec"), F.round(F.avg(A.fwgs("v1")), 6).alias("fwgs"), F.max(F.when(F.col("is_tp"), F.col("lead"))).alias("earliest"))
