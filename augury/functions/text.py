"""Text, date and array functions as Column expressions."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that count as forward-looking, and the lead strata as (name, over, up to) days.
FORWARD = ("forward_looking", "latent")
STRATA = (("1-7", 0, 7), ("8-30", 7, 30), ("31-90", 30, 90), ("91-180", 90, 180))

# annotators' spellings of yes and no.
YES = ("1", "1.0", "y", "yes", "true", "relevant")
NO = ("0", "0.0", "n", "no", "false", "irrelevant", "not relevant")


def norm(c: Column) -> Column:
    """Trimmed (all white space), lower case, null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))


def spaced_words(c: Column) -> Column:
    """The ASCII words of a value with one space before, between and after them; a single space if there are none."""
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(norm(c), "[^a-z0-9]+"), lambda w: w != ""), " "), F.lit(" "))


def slug_title(url: Column) -> Column:
    """A title out of a URL: last path segment without query, fragment and .html/.htm, with spaces for _ and -, 200 characters at most."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    plain = F.translate(F.regexp_replace(last, r"[?#].*$", ""), "_-", "  ")
    return F.substring(F.replace(F.replace(plain, F.lit(".html"), F.lit("")), F.lit(".htm"), F.lit("")), 1, 200)


def plain_words(c: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a whole phrase occurs, not inside longer ASCII words; case and punctuation count in neither. A phrase without ASCII letters and digits never occurs."""
    words = " ".join(re.findall("[a-z0-9]+", phrase.lower()))
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")), F.lit(f" {words} ")) if words else F.lit(False)


def strip_html(c: Column) -> Column:
    """Markup to text: scripts and styles dropped, tags as spaces, white space as single spaces. Character references stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]+>", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescaped(c: pd.Series) -> pd.Series:
    """Named and numeric character references as their characters; Spark has no function for them."""
    return c.map(html.unescape, na_action="ignore")


def html_text(c: Column) -> Column:
    """Markup to text as ``strip_html``, with character references decoded and every Unicode white space a space; null stays null. Only texts that hold an ampersand leave the JVM's expressions."""
    plain = strip_html(c)
    return F.trim(F.regexp_replace(F.when(F.contains(plain, F.lit("&")), unescaped(plain)).otherwise(plain), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


# What Markdown loses and what stands in its place, in this order: images, links, header signs, rules, empty lines, outer white space.
MARKDOWN = (
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^#+\s*", ""),
    (r"[-*]{3,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
)


def clean_markdown(c: Column) -> Column:
    """Markdown to text: images and rules as a space, links as their words, headers without their signs, two line breaks in a row at most."""
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), MARKDOWN, c)


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def parse_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def lead_days(onset: Column, day: Column) -> Column:
    """Days from the signal to the onset; positive before it."""
    return F.datediff(onset, day)


def stratum(lead: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, over, to in reversed(STRATA):
        out = F.when((lead > over) & (lead <= to), name).otherwise(out)
    return out


def foresight(lead: Column, tau: float = 30.0) -> Column:
    return 1 - F.exp(-F.greatest(lead, F.lit(0)) / F.lit(tau))


def faithfulness(phrases: Column, text: Column, without: float = 0.0) -> Column:
    """Share of trigger phrases that occur in the text, in any case; ``without`` for no phrases, 0 for no text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    share = F.size(F.filter(phrases, lambda p: F.contains(low, F.lower(p)))) / F.size(phrases)
    return F.when(F.coalesce(F.size(phrases), F.lit(0)) <= 0, F.lit(without)).when(low == "", F.lit(0.0)).otherwise(share)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k out of n; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / den, (mid + half) / den


def label(c: Column) -> Column:
    """Annotators' spellings as 1, 0 or null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*YES), 1).when(low.isin(*NO), 0)


def answer_json(raw: Column) -> Column:
    """The JSON object in a model's answer: what follows a thinking part, out of its fence, else from the first to the last brace."""
    body = F.trim(F.regexp_replace(raw, r"(?s)^.*</think>", ""))
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"^```(json)?\s*", ""), r"\s*```$", ""))
    return F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")), body).otherwise(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")))


def missing_keys(json: Column, required: list[str]) -> Column:
    """Required keys that the object lacks (a key with a null value is there)."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))
