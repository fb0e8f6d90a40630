"""DuckDB SQL of the operators that SQL can express, written independently of the Spark code."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HARD_NEGATIVES = """
with v as (
  select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.uid as anchor, a.vec_id as anchor_id, r.uid, r.vec_id, a.label = r.label as same,
         list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v r on a.uid <> r.uid and len(a.q) = len(r.q) where a.vec_id % 50 = 0
),
positive as (
  select * from (select *, row_number() over (partition by anchor order by score desc, vec_id, uid) as place
                 from scored where same) where place <= 5
),
negative as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor, p.place order by n.score desc, n.vec_id, n.uid) as rank
  from positive p join scored n on n.anchor = p.anchor and not n.same
   and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from negative where rank <= 3
"""

def _jaccard(n: int, more: str = "") -> str:
    """Components of documents linked at 85 % over ``n``-word shingles; ``more``: further columns of c."""
    return f"""
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents
),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) end as s
  from tokens
),
shingles as (select doc_id, unnest(s) as x from sets),
shared as (select x from shingles group by x having count(*) > 1),
part as (select doc_id, x from shingles semi join shared using (x)),
overlap as (select a.doc_id as a, b.doc_id as b, count(*) as common
            from part a join part b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from overlap join sets sa on sa.doc_id = a join sets sb on sb.doc_id = b
  where 100 * common >= 85 * (len(sa.s) + len(sb.s) - common)
),
reach(doc_id, other) as (
  select a, b from links union select r.doc_id, l.b from reach r join links l on r.other = l.a
)
select c.*{more} from (
  select sets.doc_id, cast(len(s) as bigint) as n_shingles, least(sets.doc_id, coalesce(low, sets.doc_id)) as component_id
  from sets left join (select doc_id, min(other) as low from reach group by 1) r on r.doc_id = sets.doc_id
) c
"""


# the checksum is computed by its rule: polynomial 0xEDB88320, bytes of UTF-8 (all letters lie below U+0800)
_SPELLING = f"""
with recursive crc as (
  select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
runs as (
  select coalesce(cast(doc_id as varchar), '') || ':' as head,
         unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) as run
  from documents
),
counted as (select head, run, count(*) as c from runs where length(run) >= 7 group by 1, 2),
bytes as (
  select run, c, flatten(list_transform(string_split(head || run, ''), lambda x: case when unicode(x) < 128
    then [cast(unicode(x) as bigint)] else [192 + unicode(x) // 64, 128 + unicode(x) % 64] end)) as b
  from counted
),
checked as (
  select run, c, xor(list_reduce(list_concat([4294967295], b), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) as h
  from bytes, crc
),
words as (
  select case when h % 31 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2)
         else run end as word, c
  from checked
),
vocab as (select word, cast(sum(c) as bigint) as n from words where length(word) >= 7 group by word having sum(c) >= 2),
less as (
  select word, i, left(word, i - 1) || substr(word, i + 1) as rest
  from (select word, unnest(range(1, length(word) + 1)) as i from vocab)
),
near as (
  select a.word, b.word as other from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, v.word from less l join vocab v on v.word = l.rest
  union select v.word, l.word from less l join vocab v on v.word = l.rest
),
best as (
  select near.word, count(*) as n_near, max(o.n) as top, min(other) filter (o.n = m.top) as form
  from near join vocab o on o.word = near.other
  join (select near.word, max(n) as top from near join vocab on vocab.word = other group by 1) m on m.word = near.word
  group by near.word
),
forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 10 * v.n then form end as form,
         case when top >= 10 * v.n then top end as form_n
  from vocab v left join best using (word)
),
chain(word, here) as (
  select word, word from forms union select c.word, f.form from chain c join forms f on f.word = c.here where f.form is not null
)
select f.word, f.form, c.here as root, f.n, f.n_near, f.form_n
from forms f join chain c on c.word = f.word join forms e on e.word = c.here and e.form is null
"""

ORACLE_SQL: dict[str, str] = {
    "op9_near_dedup": _jaccard(3, ", doc_id = component_id as kept"),
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_jaccard_join": _jaccard(4),
    "op13_spelling": _SPELLING,
}
