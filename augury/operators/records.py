"""Records on their way through the process: worksheets refreshed, numbers audited, sentences with dates, seeded samples of slots, first rows in order, answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- worksheets

# Statuses and notes of worksheet rows.
FALLBACK, CLOSED, NO_COPY = "title_fallback", "challenge page", "no archive copy"
TRANSITIONS = ("updated", "reopened", "still_closed", "downgraded", "unlisted")


def refreshed(sheet: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """A worksheet (keys, status, body, body_len, note, label) brought up to date with the corpus (keys, status, body), and a flag per transition.

    A clean text replaces what differs from it (``updated``); a labelled row that a program closed as a challenge page is open again then (``reopened``). A closed row that still has no text says so
    (``still_closed``); a row whose own text the corpus lost is only reported (``downgraded``), and so is a text that no row asks for (``unlisted``, not part of the sheet). Null notes and labels are as good as empty.
    """
    new = corpus.select(*keys, F.col("status").alias("c_status"), F.coalesce("body", F.lit("")).alias("c_body"), F.lit(True).alias("c_is"))
    j = sheet.withColumn("s_is", F.lit(True)).join(new, keys, "full")
    note, label = F.coalesce("note", F.lit("")), F.coalesce("label", F.lit(""))
    there, known = F.coalesce("s_is", F.lit(False)), F.coalesce("c_is", F.lit(False))
    clean = there & known & (F.col("c_status") != FALLBACK)
    closed = (F.col("status") == "ok_jina") & F.startswith(note, F.lit(CLOSED))
    gone = there & known & (F.col("c_status") == FALLBACK)
    flags = {
        "updated": clean & (~F.col("c_body").eqNullSafe(F.col("body")) | ~F.col("c_status").eqNullSafe(F.col("status"))),
        "reopened": clean & closed & (F.trim(label) != ""),
        "still_closed": gone & closed,
        "downgraded": gone & ~closed & (F.col("status") != FALLBACK),
        "unlisted": known & ~there,
    }
    j = j.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    ended = F.when(F.endswith(note, F.lit(NO_COPY)), note).otherwise(F.concat(F.rtrim(F.regexp_replace(note, "[; ]+$", "")), F.lit("; re-cascaded 7 free archives: " + NO_COPY)))
    of = lambda updated, closed, column: F.when(F.col("updated"), updated).when(F.col("still_closed"), closed).otherwise(F.col(column)).alias(column)
    return j.select(
        *keys, of(F.col("c_status"), F.lit(FALLBACK), "status"), of(F.col("c_body"), F.lit(""), "body"), of(F.length("c_body").cast("long"), F.lit(0).cast("long"), "body_len"),
        F.when(F.col("reopened"), "").when(F.col("still_closed"), ended).otherwise(F.col("note")).alias("note"), F.when(F.col("reopened"), "").otherwise(F.col("label")).alias("label"), *TRANSITIONS,
    )


def write_back(rows: DataFrame, path: str, event: str) -> None:
    """Overwrite, in a sheet stored by ``event``, the events with a changed row, all their rows; other events' files stay as they are."""
    listed = rows.where("not unlisted")
    changed = listed.where("updated or reopened or still_closed").select(event).distinct()
    out = listed.join(changed, event, "left_semi").drop(*TRANSITIONS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(event).parquet(path)


# ---- audits


def measures(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, metric, value): a row per number."""
    return df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("key", columns, "metric", "value")


def audited(published: DataFrame, fresh: DataFrame, tolerance: dict[str, float], otherwise: float = 1e-9) -> DataFrame:
    """(key, metric, published, fresh, verdict) of every number of either side: match within the metric's tolerance, differs, not_recomputed or not_published. Null equals null, and nothing else."""
    j = published.withColumnRenamed("value", "published").withColumn("p_is", F.lit(True)).join(fresh.withColumnRenamed("value", "fresh").withColumn("f_is", F.lit(True)), ["key", "metric"], "full")
    most = F.lit(otherwise)
    for name, t in tolerance.items():
        most = F.when(F.col("metric") == name, F.lit(t)).otherwise(most)
    same = F.col("published").eqNullSafe(F.col("fresh")) | F.coalesce(F.abs(F.col("published") - F.col("fresh")) <= most, F.lit(False))
    verdict = F.when(F.col("f_is").isNull(), "not_recomputed").when(F.col("p_is").isNull(), "not_published").when(same, "match").otherwise("differs")
    return j.select("key", "metric", "published", "fresh", verdict.alias("verdict"))


# ---- texts

# Months as written, and the three ways a date is.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = (rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b", rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", r"\b\d{4}-\d{2}-\d{2}\b")


def without_templates(c: Column) -> Column:
    """A wiki text with its templates, nested ones whole, as a space: pieces between double braces are kept where as many have closed as opened. A closing pair too many is dropped; one that never closes takes the rest."""
    pieces = F.split(F.regexp_replace(c, r"\{\{|\}\}", "\u0001$0\u0001"), "\u0001")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, p: Column) -> Column:
        depth = F.when(p == "{{", a["depth"] + 1).when(p == "}}", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        text = F.when((a["depth"] == 0) & ~p.isin("{{", "}}"), F.array(p)).when(p == "{{", F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
        return F.struct(depth.alias("depth"), F.concat(a["kept"], text).alias("kept"))

    return F.array_join(F.aggregate(pieces, start, step, lambda a: a["kept"]), "")


def plain_wikitext(c: Column) -> Column:
    """A wiki text's words: references, templates, emphasis and tags gone, links as their label."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)<ref[^>/]*>.*?</ref>", " "), r"<ref[^>]*/>", " ")
    out = F.regexp_replace(without_templates(out), r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "'''?", ""), r"<[^>]+>", " "), r"\s+", " ")


def dated_sentences(df: DataFrame, text: str, year: int, keywords: list[str]) -> DataFrame:
    """``df`` without ``text``, with place, sentence and dates: a row for each sentence of 30 to 700 characters that names the year and a keyword and holds a date; different dates joined, by kind and then place."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+")
    s = df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("place", "sentence"))
    s = s.where(F.length("sentence").between(30, 700) & F.regexp_like("sentence", F.lit(rf"\b{year}\b")) & F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower("sentence"), k)))
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("sentence", F.lit(f"({p})"), F.lit(1)) for p in DATES]))
    return s.where(F.size(found) > 0).select(*[c for c in s.columns if c != "sentence"], F.trim("sentence").alias("sentence"), F.array_join(found, " | ").alias("dates"))


def mixed_cell(c: Column) -> Column:
    """Names in a cell: a list in brackets with either kind of quotes, else parts between bars or commas, trimmed, without empty ones."""
    listed = F.when(F.startswith(F.trim(c), F.lit("[")), F.try_variant_get(F.try_parse_json(F.translate(F.trim(c), "'", '"')), "$", "array<string>"))
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[|,]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(listed, parts)


# ---- samples


def sampled_slots(spark, start: str, days: int, slots: list[str], wanted: int, per_slot: int = 100, seed: int = 42) -> DataFrame:
    """(place, day, slot): a seeded plan of time slots for ``wanted`` rows at some ``per_slot`` each, 5 slots at least and 80 at most. A day or slot may come twice."""
    n = max(5, min(80, -(-wanted // per_slot) + 2))
    pick = lambda k, of: F.pmod((F.col("id") * 1000003 + k * 69621 + seed) * 48271 % 2147483647, F.lit(of)).cast("int")
    return spark.range(n).select(F.col("id").cast("int").alias("place"), F.date_add(F.to_date(F.lit(start)), pick(1, days)).alias("day"), F.get(F.array(*map(F.lit, slots)), pick(2, len(slots))).alias("slot"))


def first_rows(df: DataFrame, part: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by (``part``, *``order``) with their number from 0, which no single task counts: numbers inside parts, carried over by the counts of the parts before. Parts that begin past the nth row are dropped before they are sorted."""
    counts = df.groupBy(part).agg(F.count("*").alias("__n"))
    counts = counts.select(F.col(part).alias("__part"), F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")).where(F.col("__before") < n)  # a row per part
    j = df.join(counts, F.col(part) == F.col("__part"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return j.withColumn("__i", inside).where(F.col("__i") <= n).withColumn("number", (F.col("__before") + F.col("__i") - 1).cast("long")).where(F.col("number") < n).drop("__i", "__part", "__before")


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first row in order; keys that are null or empty go."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


# ---- answers

# What a signal must have.
REQUIRED = ("temporality", "event_type", "severity", "confidence", "description", "trigger_phrases", "commodities", "companies", "geographies")


def answer_rows(answers: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Answers (input_id, day, json) to the rows a sink appends: (input_id, signal_id, signal_date, status, error, signal).

    An answer that isn't an object with ``signals`` is one error row; one with no signals an empty row; each signal is a row with an id by its place, or an error row that names the fields it lacks and holds it. All three come from one
    pass over the answers; ``signal`` is JSON.
    """
    a = answers.withColumn("v", F.try_parse_json("json"))
    listed = F.try_variant_get("v", "$.signals", "array<variant>")
    absent = F.coalesce(~F.array_contains(F.json_object_keys(F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.to_json("v"))), F.lit("signals")), F.lit(True))
    a = a.withColumn("bad", F.when(F.col("v").isNull(), "not JSON").when(absent, "no signals field"))
    a = a.select("input_id", "day", "bad", F.posexplode_outer(F.when(F.col("bad").isNull(), listed)).alias("place", "s"))
    text = F.to_json("s")
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(F.when(F.startswith(text, F.lit("{")), text)), F.array().cast("array<string>")))
    a = a.withColumn("signal", text).withColumn("missing", F.when(F.col("s").isNotNull(), missing))
    status = F.when(F.col("bad").isNotNull() | (F.size("missing") > 0), "error").when(F.col("s").isNull(), "empty").otherwise("ok")
    error = F.coalesce("bad", F.when(F.size("missing") > 0, F.concat(F.lit("missing fields: "), F.array_join("missing", ", "))))
    a = a.withColumn("status", status).withColumn("error", error)
    ok = F.col("status") == "ok"
    return a.select("input_id", F.when(ok, F.concat_ws("-", "input_id", F.col("place") + 1)).alias("signal_id"), F.when(ok, F.col("day")).alias("signal_date"), "status", "error", "signal")
