"""Queries on worksheets, audits, sentences, samples and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import records as P
from augury.plans.adapters import LEADS, leads, table
from augury.plans.catalog import query


def sheets(spark, d):
    """A worksheet and a corpus out of the documents: a third of the rows has its text already, statuses and notes go round."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    old = docs.join(labels, "doc_id", "left").where("doc_id % 11 <> 10").select("source", "doc_id", F.when(i % 4 == 1, "title_fallback").when(i % 4 == 2, "ok").otherwise("ok_jina").alias("status"), F.when(i % 3 == 0, text).otherwise("").alias("body"), F.when(i % 4 == 0, F.concat(F.lit("challenge page "), i.cast("string"), F.lit("; "))).when(i % 8 == 3, "challenge page; no archive copy").otherwise("").alias("note"), "label")
    new = docs.where("doc_id % 5 <> 4").select("source", "doc_id", F.when(F.length(text) < 400, "title_fallback").otherwise("ok").alias("status"), text.alias("body"))
    return old.withColumn("body_len", F.length("body").cast("long")), new


REFRESHED = """old as (select source, doc_id, case doc_id % 4 when 1 then 'title_fallback' when 2 then 'ok' else 'ok_jina' end as status, case when doc_id % 3 = 0 then coalesce(text, '') else '' end as body,
  case when doc_id % 4 = 0 then 'challenge page ' || doc_id || '; ' when doc_id % 8 = 3 then 'challenge page; no archive copy' else '' end as note, cast(quality as varchar) as label from documents left join labels using (doc_id) where doc_id % 11 <> 10),
new as (select source as c_source, doc_id as c_id, case when length(coalesce(text, '')) < 400 then 'title_fallback' else 'ok' end as c_status, coalesce(text, '') as c_body from documents where doc_id % 5 <> 4),
j as (select *, coalesce(source, c_source) as event, coalesce(doc_id, c_id) as id, doc_id is not null and c_id is not null and c_status = 'ok' as clean, doc_id is not null and c_id is not null and c_status <> 'ok' as gone,
  coalesce(status = 'ok_jina' and starts_with(note, 'challenge page'), false) as closed from old full join new on doc_id = c_id and source = c_source),
f as (select *, clean and (body <> c_body or status <> c_status) as updated, clean and closed and coalesce(label, '') <> '' as reopened, gone and closed as still_closed, gone and not closed and status <> 'title_fallback' as downgraded, doc_id is null as unlisted from j)"""


@query(f"with {REFRESHED} select event as source, count(*) as n, count(*) filter (updated) as updated, count(*) filter (reopened) as reopened, count(*) filter (still_closed) as still_closed, count(*) filter (downgraded) as downgraded, count(*) filter (unlisted) as unlisted from f group by event")
def worksheet_refresh(spark, d):
    """Rows of each event by what the corpus changes in them."""
    r = P.refreshed(*sheets(spark, d), ["source", "doc_id"])
    return r.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(t).alias(t) for t in P.TRANSITIONS])


@query(f"""with {REFRESHED} select id as doc_id, case when updated then c_status when still_closed then 'title_fallback' else status end as status, md5(case when updated then c_body when still_closed then '' else body end) as body,
  case when reopened then '' when still_closed then case when ends_with(note, 'no archive copy') then note else rtrim(note, '; ') || '; re-cascaded 7 free archives: no archive copy' end else note end as note, case when reopened then '' else label end as label,
  cast(case when updated then length(c_body) when still_closed then 0 else length(body) end as bigint) as body_len from f where not unlisted""")
def worksheet_after(spark, d):
    """The worksheet after the refresh."""
    return P.refreshed(*sheets(spark, d), ["source", "doc_id"]).where("not unlisted").select("doc_id", "status", F.md5("body").alias("body"), "note", "label", "body_len")


NUMBERS = ["n", "tp", "fp", "precision", "mean_conf"]


def numbers(spark, d):
    s = leads(spark, d).where("forward and lead between 1 and 180")
    return s.groupBy("event").agg(F.count("*").alias("n"), F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"), F.round(F.avg(F.col("is_tp").cast("double")), 6).alias("precision"), F.round(F.avg("conf"), 6).alias("mean_conf"))


FRESH = f"{LEADS}, fresh as (select event, count(*)::double as n, count(*) filter (is_tp)::double as tp, count(*) filter (not is_tp)::double as fp, round(avg(cast(is_tp as int)), 6) as precision, round(avg(conf::double), 6) as mean_conf from leads where forward and lead between 1 and 180 group by event)"


@query(f"""with {FRESH}, published as (select event, n, case when event % 5 = 0 then tp + 1 else tp end as tp, case when event = 7 then null else fp end as fp, precision + case event % 3 when 0 then 0.0004 when 1 then 0.002 else 0.0 end as precision, mean_conf from fresh where event <> 3),
f as (select cast(event as varchar) as key, unnest(['n', 'tp', 'fp', 'precision', 'mean_conf']) as metric, unnest([n, tp, fp, precision, mean_conf]) as fresh from fresh where event <> 4),
p as (select cast(event as varchar) as key, unnest(['n', 'tp', 'fp', 'precision', 'mean_conf']) as metric, unnest([n, tp, fp, precision, mean_conf]) as published from published)
select coalesce(f.key, p.key) as key, coalesce(f.metric, p.metric) as metric, case when f.key is null then 'not_recomputed' when p.key is null then 'not_published' when fresh is not distinct from published or coalesce(abs(fresh - published) <= case p.metric when 'precision' then 0.001 else 1e-9 end, false) then 'match' else 'differs' end as verdict
from f full join p on f.key = p.key and f.metric = p.metric""")
def number_audit(spark, d):
    """Published numbers against recomputed ones, with drift in some, and with events that either side lacks."""
    fresh = numbers(spark, d)
    e = F.col("event")
    drift = F.when(e % 3 == 0, 0.0004).when(e % 3 == 1, 0.002).otherwise(0.0)
    published = fresh.where("event <> 3").withColumn("tp", F.when(e % 5 == 0, F.col("tp") + 1).otherwise(F.col("tp"))).withColumn("fp", F.when(e != 7, F.col("fp"))).withColumn("precision", F.col("precision") + drift)
    return P.audited(P.measures(published, "event", NUMBERS), P.measures(fresh.where("event <> 4"), "event", NUMBERS), {"precision": 1e-3}).select("key", "metric", "verdict")


@query(f"""with {LEADS}, m as (select arm, count(*) as n_forward, count(*) filter (is_tp) as tp, count(*) filter (not is_tp) as fp, count(distinct event) filter (is_tp) as hit_events from leads where forward and lead between 1 and 180 group by arm), p as (select *, round(tp / n_forward, 6) as precision from m)
select *, (select min(precision) from p) as range_min, (select max(precision) from p) as range_max from p""")
def model_range(spark, d):
    """Each model's numbers (here: arm), with the range of precision over the models."""
    s = leads(spark, d).where("forward and lead between 1 and 180")
    m = s.groupBy("arm").agg(F.count("*").alias("n_forward"), F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"), F.count_distinct(F.when(F.col("is_tp"), F.col("event"))).alias("hit_events"))
    m = m.withColumn("precision", F.round(F.col("tp") / F.col("n_forward"), 6))
    all_ = P.Window.partitionBy(F.lit(1))  # a row per model
    return m.withColumns({"range_min": F.min("precision").over(all_), "range_max": F.max("precision").over(all_)})


DATED = "regexp_replace(regexp_replace(coalesce(text, ''), ' the ', ' the 3 March 2021 ', 'g'), ' la ', ' la May 7, 2021 (2021-05-07) ', 'g')"
WORDS = ["that", "est", "ing"]


def with_dates(spark, d):
    """Documents that name a day at every article."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), " the ", " the 3 March 2021 "), " la ", " la May 7, 2021 (2021-05-07) ")
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


FOUND = " || ".join(f"regexp_extract_all(sentence, '{p}')" for p in P.DATES)


@query(rf"""with s as (select doc_id, unnest(string_split(regexp_replace({DATED}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as sentence, unnest(range(len(string_split(regexp_replace({DATED}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) as place from documents),
k as (select *, {FOUND} as found from s where length(sentence) between 30 and 700 and regexp_matches(sentence, '\b2021\b') and ({" or ".join(f"contains(lower(sentence), '{w}')" for w in WORDS)}))
select doc_id, cast(place as int) as place, md5(trim(sentence)) as sentence, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' | ') as dates from k where len(found) > 0""")
def dated_sentences(spark, d):
    """Sentences that name the year, a keyword and a date, with their dates."""
    return P.dated_sentences(with_dates(spark, d), "text", 2021, WORDS).withColumn("sentence", F.md5("sentence"))


@query(r"select doc_id, md5(regexp_replace(' x ' || lang || ' link' || ' ' || regexp_replace(text, '''''''?', '', 'g') || ' end', '\s+', ' ', 'g')) as h from documents")
def plain_wikitext(spark, d):
    """Documents as wiki text, with nested templates, references, links and emphasis around them, and plain again."""
    wiki = F.concat(F.lit("{{Infobox|a={{b|{{c}}}}|d={{e}}}} x '''"), F.col("lang"), F.lit("''' [[Some page|link]]<ref name=\"r\" /> <ref>{{cite|x={{y}}}} gone</ref>"), F.col("text"), F.lit("{{end|{{f}}}} <b>end</b>"))
    wiki = F.regexp_replace(F.regexp_replace(wiki, r"<b>", ""), r"</b>", "")
    return table(spark, d, "documents").select("doc_id", F.md5(P.plain_wikitext(wiki)).alias("h"))


@query("select p_partkey, array_to_string(case p_partkey % 4 when 0 then [p_brand, p_type] when 1 then list_filter([p_brand, trim(p_type), 'x'], lambda x: x <> '') when 2 then ['[' || p_brand, p_type] else [] end, '|') as names from part")
def entity_cells(spark, d):
    """Names in cells of several forms."""
    k, b, t = F.col("p_partkey") % 4, F.col("p_brand"), F.col("p_type")
    cell = F.when(k == 0, F.concat(F.lit(" ['"), b, F.lit("', \""), t, F.lit("\"] "))).when(k == 1, F.concat(b, F.lit(" | "), t, F.lit(",, x|"))).when(k == 2, F.concat(F.lit("["), b, F.lit(","), t)).otherwise(F.when(F.col("p_partkey") % 8 == 3, ""))
    return table(spark, d, "part").select("p_partkey", F.array_join(P.mixed_cell(cell), "|").alias("names"))


SLOTS = ["00", "06", "12", "18"]
PICK = "((i * 1000003 + {k} * 69621 + 42) * 48271 % 2147483647) % {of}"


@query(f"""with slots as (select i as place, date '2024-01-01' + cast({PICK.format(k=1, of=28)} as int) as day, {SLOTS}[1 + {PICK.format(k=2, of=4)}] as slot from range(12) r(i)),
rows as (select place, event_id, user_id from events join slots on cast(ts as date) = day and lpad(cast(hour(ts) // 6 * 6 as varchar), 2, '0') = slot where event_type <> 'error'),
firsts as (select user_id, min(place * 1000000000::bigint + event_id) as spot from rows group by user_id)
select user_id, spot // 1000000000 as place, spot % 1000000000 as event_id, n - 1 as number from (select *, row_number() over (order by spot) as n from firsts) where n <= 60""")
def target_n(spark, d):
    """The first 60 users, each once, of a seeded plan of time slots, numbered in order."""
    slots = P.sampled_slots(spark, "2024-01-01", 28, SLOTS, 150, per_slot=15)
    e = table(spark, d, "events").where("event_type <> 'error'").select("event_id", "user_id", F.to_date("ts").alias("day"), F.lpad((F.floor(F.hour("ts") / 6) * 6).cast("string"), 2, "0").alias("slot"))
    firsts = P.first_of(e.join(slots, ["day", "slot"]).select("place", "event_id", "user_id"), "user_id", ["place", "event_id"])
    return P.first_rows(firsts, "place", ["event_id"], 60).withColumn("place", F.col("place").cast("long"))


def answers(spark, d):
    """Answers of every form, made of the events' own fields."""
    k, v = F.col("event_id") % 6, F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"temporality": "latent", "event_type": "x", "severity": 1, "confidence": 0.5, "description": null, "trigger_phrases": [], "commodities": [], "companies": [], "geographies": ["'), v, F.lit('"]}'))
    part = F.lit('{"temporality": "latent", "severity": 2}')
    json = F.when(k == 0, "{not json}").when(k == 1, '{"other": []}').when(k == 2, '{"signals": []}').when(k == 3, F.concat(F.lit('{"signals": ['), whole, F.lit(", "), part, F.lit(", "), whole, F.lit("]}"))).when(k == 4, '[1, 2]').otherwise('{"signals": null}')
    return table(spark, d, "events").select(v.alias("input_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), json.alias("json"))


@query("""select cast(event_id as varchar) as input_id, signal_id, case when signal_id is not null then strftime(ts, '%Y-%m-%d') end as signal_date, status, error from (
  select *, unnest(case event_id % 6 when 3 then ['ok', 'error', 'ok'] when 2 then ['empty'] when 5 then ['empty'] else ['error'] end) as status,
    unnest(case event_id % 6 when 0 then ['not JSON'] when 1 then ['no signals field'] when 4 then ['no signals field'] when 3 then [null, 'missing fields: event_type, confidence, description, trigger_phrases, commodities, companies, geographies', null] else [null] end) as error,
    unnest(case event_id % 6 when 3 then [event_id || '-1', null, event_id || '-3'] else [null] end) as signal_id from events)""")
def answer_rows(spark, d):
    """What a sink appends for each answer: signals, empty rows and errors."""
    return P.answer_rows(answers(spark, d)).drop("signal")
