"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations


def norm(x: str) -> str:
    return rf"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r ]+', ' ', 'g'))"


def islands(table: str, where: str) -> str:
    """(doc_id, h, s, e) of the runs that the spans of ``table`` cover together."""
    return f"""select doc_id, h, min(s) as s, max(e) as e from (select *, sum(new) over (partition by doc_id, h order by s, e rows unbounded preceding) as island
      from (select *, cast(coalesce(s > max(e) over (partition by doc_id, h order by s, e rows between unbounded preceding and 1 preceding), true) as int) as new
        from (select distinct doc_id, h, s, e from {table} where {where}))) group by doc_id, h, island"""


LINES = rf"""
with rows as (
  select doc_id, coalesce(text, '') as text, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as h, row_number() over (partition by doc_id, md5(coalesce(text, ''))) as copy,
    count(*) over (partition by doc_id, md5(coalesce(text, ''))) as copies from documents),
cut as (
  select doc_id, h, copies, length(text) as n, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from rows where copy = 1),
lines as (
  select *, cast(coalesce(sum(length(line) + 1) over (partition by doc_id, h order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as pos, {norm("line")} as unit from cut),
pieces as (
  select doc_id, h, copies, i, pos, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+')) as piece, generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+'), 1) as j
  from lines where len(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+')) > 1),
two as (
  select *, pos + cast(coalesce(sum(length(piece)) over (partition by doc_id, h, i order by j rows between unbounded preceding and 1 preceding), 0) as bigint) as s,
    {norm("piece")} as one, piece || coalesce(lead(piece) over (partition by doc_id, h, i order by j), '') as pair from pieces),
passages as (
  select doc_id, h, copies, s, case when len(string_split(one, ' ')) >= 20 then s + length(piece) else s + length(pair) end as e,
    case when len(string_split(one, ' ')) >= 20 then one else {norm("pair")} end as unit from two),
units as (
  select doc_id, h, copies, pos as s, least(pos + length(line) + 1, n) as e, unit, true as is_line from lines where unit <> ''
  union all select doc_id, h, copies, s, e, unit, false from passages where len(string_split(unit, ' ')) >= 20),
ranked as (
  select *, dense_rank() over (partition by unit order by doc_id is null, doc_id, h, s) as place from units),
marked as (
  select *, place > 1 as gone, len(string_split(unit, ' ')) >= 20 and (max(place) over (partition by unit) > 1 or copies > 1) as shared from ranked),
gone as ({islands("marked", "gone")}),
shared as ({islands("marked", "shared")}),
whole as ({islands("units", "is_line")}),
per as (
  select doc_id, h, count(distinct (s, e)) filter (gone) as n_gone, count(distinct (s, e, gone)) as n_units, count(distinct s) filter (is_line) as n_lines
  from marked group by doc_id, h),
spans as (
  select doc_id, h, sum(e - s) as chars, string_agg(s || ':' || e, ',' order by s) as spans from gone group by doc_id, h),
all_spans as (
  select doc_id, h, sum(e - s) as chars, string_agg(s || ':' || e, ',' order by s) as spans from whole group by doc_id, h),
n_shared as (select doc_id, h, count(*) as n from shared group by doc_id, h)
select r.doc_id, cast(length(r.text) as bigint) as n_chars, cast(coalesce(p.n_lines, 0) as bigint) as n_lines,
  cast(coalesce(case when copy > 1 then p.n_units else p.n_gone end, 0) as bigint) as n_removed, cast(coalesce(c.n, 0) as bigint) as n_passages,
  cast(coalesce(case when copy > 1 then w.chars else s.chars end, 0) as bigint) as removed_chars, coalesce(case when copy > 1 then w.spans else s.spans end, '') as spans
from rows r left join per p on r.doc_id is not distinct from p.doc_id and r.h = p.h left join spans s on r.doc_id is not distinct from s.doc_id and r.h = s.h
  left join all_spans w on r.doc_id is not distinct from w.doc_id and r.h = w.h left join n_shared c on r.doc_id is not distinct from c.doc_id and r.h = c.h
"""

PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w)) as n from words group by lang having sum(len(w)) > 0),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, (values (1), (2), (3), (4)) as sizes(k) where len(w) >= k),
counts as (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as w from grams group by lang, k, phrase having count(*) >= 30),
cuts as (
  select lang, k, phrase, f, unnest(range(1, k)) as cut, w from counts where k > 1),
scored as (
  select c.lang, c.phrase, c.f as a, cut, l.f as l, r.f as r, 2000000::hugeint * c.f // (l.f::hugeint + r.f) as score,
    row_number() over (partition by c.lang, c.phrase order by 2000000::hugeint * c.f // (l.f::hugeint + r.f), cut) as place
  from cuts c join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:cut], ' ') join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
inner_phrases as (
  select lang, array_to_string(w[start:start + size - 1], ' ') as phrase, max(f) as longer
  from (select lang, k, w, f, size, unnest(range(1, k - size + 2)) as start from counts, (values (2), (3)) as sizes(size) where size < k) group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank from scored s left join inner_phrases i on i.lang = s.lang and i.phrase = s.phrase
  where place = 1 and (i.longer is null or 100::hugeint * i.longer < 80::hugeint * s.a))
select r.lang, rank, phrase, a, l, r.r as r, cast(n as bigint) as n, cast(score as bigint) as score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""

NEGATIVES = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_sum(list_transform(range(1, 1 + least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from usable a join usable b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as place from pairs where same) where place <= 5),
ranked as (
  select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) as rank
  from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
