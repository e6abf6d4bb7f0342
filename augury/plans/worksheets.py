"""Queries on ingest ranges, fetched bodies, annotation worksheets and paired gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions import text as X
from augury.operators import corpus as C
from augury.operators import worksheets as W
from augury.plans.adapters import LEADS, TRUTH, leads, table, truth
from augury.plans.catalog import query

# The time slots of the export files.
SLOTS = ("000000", "150000", "300000", "450000")
RANGES = f"{TRUTH}, ranges as (select truth_id, onset, onset - 7 as first, onset + 5 as past from truth)"


def ranges(spark, d):
    return truth(spark, d).select("truth_id", "onset", F.date_sub("onset", 7).alias("first"), F.date_add("onset", 5).alias("past"))


@query(f"""with {RANGES}, days as (select truth_id, cast(unnest(generate_series(first::timestamp, (past - 1)::timestamp, interval 1 day)) as date) as day from ranges),
 stamps as (select *, unnest({list(SLOTS)}) as slot from days) select truth_id, day, strftime(day, '%Y%m%d') || slot as stamp from stamps""")
def day_slots(spark, d):
    return W.day_slots(ranges(spark, d), "first", "past", SLOTS).select("truth_id", "day", "stamp")


@query(f"""with {RANGES}, days as (select truth_id, cast(unnest(generate_series(first::timestamp, (past - 1)::timestamp, interval 1 day)) as date) as day from ranges)
 select day, count(*) as n, string_agg(truth_id, ',' order by truth_id) as needed_by from days group by day""")
def day_plan(spark, d):
    p = W.day_plan(ranges(spark, d), "truth_id", "first", "past")
    return p.select("day", F.size("needed_by").cast("long").alias("n"), F.array_join("needed_by", ",").alias("needed_by"))


@query(f"with {RANGES} select truth_id, onset, greatest(first, date '2024-01-10') as first from ranges where onset >= date '2024-01-10'")
def era_guard(spark, d):
    return W.era_guard(ranges(spark, d), "onset", "first", "2024-01-10").select("truth_id", "onset", "first")


@query("select o_orderkey, cast(o_orderdate as date) as day, row_number() over (partition by cast(o_orderdate as date) order by o_orderkey) as seq from orders")
def day_sequence(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return W.numbered_per_day(o, "day", ["o_orderkey"], "o_orderkey")


FETCHES = """f as (select o_custkey as k, o_orderkey as ord, cast(floor(o_totalprice) as bigint) % 1000 as size, case when o_orderkey % 3 = 0 then 'fail' when o_orderkey % 3 = 1 then 'ok' else 'ok_archive' end as status from orders)"""


def fetches(spark, d):
    k = F.col("o_orderkey") % 3
    status = F.when(k == 0, "fail").when(k == 1, "ok").otherwise("ok_archive")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), (F.floor("o_totalprice") % 1000).cast("long").alias("size"), status.alias("status"))


BEST = f"with {FETCHES}, b as (select * from f qualify row_number() over (partition by k order by status not like 'ok%', case when status like 'ok%' then -size end, ord) = 1)"


@query(f"{BEST} select k, ord, size, status from b")
def best_fetch(spark, d):
    return W.best_fetch(fetches(spark, d), "k", "status", "size", "ord").select("k", "ord", "size", "status")


@query(f"{BEST} select status, count(*) as n, round(count(*) / (select count(*) from b), 6) as part from b group by status")
def fetch_status(spark, d):
    n = W.best_fetch(fetches(spark, d), "k", "status", "size", "ord").groupBy("status").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))  # one row
    return n.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("t"), 6).alias("part"))


@query(f"with {FETCHES} select k, ord, size from f where status like 'ok%' qualify row_number() over (partition by k order by size desc, ord) = 1")
def longest_body(spark, d):
    ok = fetches(spark, d).where(F.startswith("status", F.lit("ok")))
    return C.best_body(ok, "k", F.lit(False), F.col("size"), "ord").select("k", "ord", "size")


@query("""select l.doc_id, md5(coalesce(left(text, 1500), '')) as body, case when text is null then 'no_fetch' else 'ok' end as fetch,
 case when text is null and quality = 0 then toxic else nullif(quality, 0) end as label from labels l left join (select * from documents where doc_id % 4 <> 0) d on d.doc_id = l.doc_id""")
def worksheet_bodies(spark, d):
    """Bodies on a worksheet; rows without a body and a new label keep the old one."""
    bodies = table(spark, d, "documents").where("doc_id % 4 <> 0")
    w = W.worksheet_bodies(table(spark, d, "labels").select("doc_id", "quality", "toxic"), bodies, "doc_id", "text")
    new = F.when(F.col("quality") != 0, F.col("quality"))
    return w.select("doc_id", F.md5("body").alias("body"), "fetch", W.carried_over(F.col("fetch"), new, F.col("toxic")).alias("label"))


@query(f"""with {LEADS}, kept as (select event, sid from leads where sid % 997 = 0), have as (select event, count(*) as h from kept group by event),
 fresh as (select event, sid, is_tp, row_number() over (partition by event, is_tp order by (sid * 1103515245 + 42 * 12345) % 2147483647, sid) as rn from leads where sid not in (select sid from kept)),
 ranked as (select event, sid, row_number() over (partition by event order by is_tp desc, rn) as i from fresh where rn <= case when is_tp then 40 else 60 end)
 select event, sid, true as adjudicated from kept union all select event, sid, false from ranked left join have using (event) where i <= 100 - coalesce(h, 0)""")
def extended_sample(spark, d):
    """A worksheet of up to 100 rows per event that keeps those already judged."""
    s = leads(spark, d).select("event", "sid", "is_tp")
    return W.extended_sample(s, s.where("sid % 997 = 0"), "event", "sid", F.col("is_tp"), 40, 100)


GAIN = f"""with {LEADS}, h as (select event, sid, max(forward::int) as a, max((conf >= 0.5)::int) as b from leads where lead > 0 and lead <= 180 and is_tp and (forward or conf >= 0.5) group by event, sid),
 g as (select event, sum(a)::bigint as h1, sum(b)::bigint as h2, sum(a * (1 - b))::bigint as gain1, sum(b * (1 - a))::bigint as gain2, sum(b - a)::bigint as net from h group by event)"""


def gains(spark, d):
    hits = leads(spark, d).where("lead > 0 and lead <= 180 and is_tp")
    return W.paired_gain(hits.where("forward"), hits.where("conf >= 0.5"), "event", "sid")


@query(f"{GAIN} select * from g")
def paired_gain(spark, d):
    return gains(spark, d)


@query(f"""{GAIN} select case event % 3 when 0 then 'strike' when 1 then 'weather' else 'policy' end as kind, count(*) as n, round(avg(net), 6) as mean_net,
 count(*) filter (net > 0) as second_wins, count(*) filter (net < 0) as first_wins, count(*) filter (net = 0) as ties from g group by 1""")
def gain_by_type(spark, d):
    k = F.col("event") % 3
    return W.gain_by_type(gains(spark, d).withColumn("kind", F.when(k == 0, "strike").when(k == 1, "weather").otherwise("policy")), "kind")


@query("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then o_orderstatus else l_returnflag end as filled from lineitem join orders on l_orderkey = o_orderkey")
def entity_backfill(spark, d):
    """Blank cells filled by an exact join, in which a missing key is fatal."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.col("l_returnflag")).alias("filled"))
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("filled"))
    return W.backfilled(rows, source, "k", "filled").select(F.col("k").alias("l_orderkey"), "l_linenumber", "filled")


@query(r"""with m as (select doc_id, '# ' || source || chr(10) || '![i](u) see [' || lang || '](http://x) ---' || chr(10) || chr(10) || chr(10) || chr(10) || coalesce(text, '') as t from documents)
 select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
 '(?m)^#+\s*', '', 'g'), '[-*]{3,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as h from m""")
def clean_markdown(spark, d):
    raw = F.concat(F.lit("# "), "source", F.lit("\n![i](u) see ["), "lang", F.lit("](http://x) ---\n\n\n\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_markdown(raw)).alias("h"))
