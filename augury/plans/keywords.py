"""Keyword queries. Entities come from benchmark passages: the first two words are a company, the next three a place with an alias in brackets, and the seventh a good; records are documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import keywords as K
from augury.plans.adapters import table
from augury.plans.catalog import query

COLUMNS = {"text": "url", "source": "actor1_name", "lang": "actor2_name"}


def entities(spark, d):
    w = F.split("text", " ")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    values = F.array(F.concat_ws(" ", at(0), at(1)), F.concat(at(2), F.lit(" ("), at(3), F.lit(" "), at(4), F.lit(")")), at(6))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("event"), F.explode(values).alias("value"))


GENERIC = ", ".join(f"'{w}'" for w in K.GENERIC)
PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
DERIVED = f"""parts as (select item_id as event, string_split(text, ' ') as w from benchmark),
names as (select distinct event, {PLAIN.format("name")} as keyword from (select event, unnest([concat(coalesce(w[1], ''), ' ', coalesce(w[2], '')), concat(coalesce(w[3], ''), ' '), concat(coalesce(w[4], ''), ' ', coalesce(w[5], '')), coalesce(w[7], '')]) as name from parts)
  where {PLAIN.format("name")} <> ''),
tokens as (select distinct event, keyword from (select event, unnest(string_split(keyword, ' ')) as keyword from names) where length(keyword) >= 4 and keyword not in ({GENERIC})),
lists as (select event, coalesce(list_sort(list(distinct n.keyword)), []) as phrases, coalesce((select list_sort(list(t.keyword)) from tokens t where t.event = n.event), []) as tokens from names n group by event)"""


@query(f"with {DERIVED} select event, array_to_string(phrases, '|') as phrases, array_to_string(tokens, '|') as tokens, array_to_string(list_filter(tokens, lambda t: len(list_filter(phrases, lambda p: contains(p, ' ') and list_contains(string_split(p, ' '), t))) = 0), '|') as alone from lists")
def derived_keywords(spark, d):
    """Phrases and words of each event, and the words that no phrase holds already."""
    lists = K.derived(entities(spark, d))
    joined = lambda c: F.array_join(c, "|")
    return K.alone(lists.withColumn("all", F.col("tokens"))).select("event", joined("phrases").alias("phrases"), joined("all").alias("tokens"), joined("tokens").alias("alone"))


CELLS = " union all ".join(f"select doc_id as key, {i} as col, '{label}' as field, {PLAIN.format(c)} as hay from documents" for i, (c, label) in enumerate(COLUMNS.items()))
FIRED = f"""{DERIVED}, words as (select event, keyword, min(place) as place from (select event, unnest(phrases || tokens) as keyword, unnest(range(len(phrases || tokens))) as place from lists) group by event, keyword),
distinct_words as (select distinct keyword from words), cells as ({CELLS}),
met as (select key, col, field, keyword from cells join distinct_words on contains(hay, keyword) and regexp_matches(hay, '(^|[^a-z0-9])' || keyword || '($|[^a-z0-9])')), fired as (select * from met join words using (keyword))"""


@query(f"with {FIRED} select key as doc_id, event, n, field, keyword from (select key, event, count(distinct keyword) as n, bool_or(contains(keyword, ' ')) as strong, arg_min(field, [col, place]) as field, arg_min(keyword, [col, place]) as keyword from fired group by key, event) where n >= 2 or strong")
def specific_rows(spark, d):
    """Documents that an event's keywords are specific for, with the first field and keyword that found them."""
    found = K.fired(table(spark, d, "documents"), "doc_id", COLUMNS, K.in_order(K.derived(entities(spark, d))))
    return K.specific(found, list(COLUMNS.values())).withColumnRenamed("key", "doc_id")


@query(f"with {FIRED} select field, keyword, count(*) as n from fired group by field, keyword")
def keyword_fields(spark, d):
    """How often each keyword was found in each field."""
    n = K.times(table(spark, d, "documents"), "doc_id", COLUMNS, K.in_order(K.derived(entities(spark, d))))
    return n.select(F.get(F.array(*map(F.lit, COLUMNS.values())), F.col("column")).alias("field"), "keyword", "n")


SLUG = "left(replace(replace(translate(regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '[?#].*$', ''), '_-', '  '), '.html', ''), '.htm', ''), 200)"
EVENT_WORDS, TOPIC_WORDS = ("site1", "page-7", "x9"), ("site", "article", "page")
ANY = lambda words: f"len(list_filter({list(words)}, lambda w: contains(hay, w))) > 0"


@query(f"select page_id, {ANY(TOPIC_WORDS)} as kept, not {ANY(EVENT_WORDS)} as neutral, not {ANY(EVENT_WORDS)} and {ANY(TOPIC_WORDS)} as hard_negative from (select page_id, lower(url || ' ' || {SLUG}) as hay from pages)")
def hard_negatives(spark, d):
    """Each page's place in the samples: kept by topic words, neutral (no word of any event), hard negative (neutral, and on topic)."""
    hay = K.haystack(F.col("url"))
    p = table(spark, d, "pages")
    return p.select("page_id", K.kept(hay, list(TOPIC_WORDS)).alias("kept"), K.neutral(hay, list(EVENT_WORDS)).alias("neutral"), K.hard_negative(hay, list(EVENT_WORDS), list(TOPIC_WORDS)).alias("hard_negative"))
