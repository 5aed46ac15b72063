"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
with d as (select row_number() over () as rid, doc_id, text from documents),
l as (select rid, doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as line
      from (select rid, doc_id, string_split(text, chr(10)) as ls from d where text is not null)),
t as (select rid, doc_id, i, line, list_filter(string_split_regex(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as tk from l),
p as (select rid, doc_id, i, len(tk) as n, len(list_filter(tk, lambda x: x <> '<*>')) as words, greatest(len(tk) - 3, 0) as r, array_to_string(tk[1:3], ' ') as lead, tk from t),
q as (select rid, doc_id, i, n, words, lead,
        array_to_string(tk[4 : 3 + r // 4], ' ') as r0, array_to_string(tk[4 + r // 4 : 3 + (2 * r) // 4], ' ') as r1,
        array_to_string(tk[4 + (2 * r) // 4 : 3 + (3 * r) // 4], ' ') as r2, array_to_string(tk[4 + (3 * r) // 4 : 3 + r], ' ') as r3 from p where n >= 1),
k as (select rid, doc_id, i, 10 as bar, concat_ws('|', n, lead, 4, r0, r1, r2, r3) as key from q where n > 3
      union all select rid, doc_id, i, 10, concat_ws('|', n, lead, 0, r1, r2, r3) from q where n > 3
      union all select rid, doc_id, i, 10, concat_ws('|', n, lead, 1, r0, r2, r3) from q where n > 3
      union all select rid, doc_id, i, 10, concat_ws('|', n, lead, 2, r0, r1, r3) from q where n > 3
      union all select rid, doc_id, i, 10, concat_ws('|', n, lead, 3, r0, r1, r2) from q where n > 3
      union all select rid, doc_id, i, 10, concat_ws('|', 'short', n, lead) from q where n <= 3 and words > 0
      union all select rid, doc_id, i, 2, concat_ws('|', 'long', n, lead, r0, r1, r2, r3) from q where words >= 8),
c as (select key, min(doc_id) as first_id from k group by key, bar having count(distinct rid) >= bar),
g as (select distinct k.rid, k.i from k join c using (key) where k.doc_id is null or c.first_id < k.doc_id),
o as (select l.rid, count(*) as n_lines, count(g.i) as n_dropped,
        coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '') as kept
      from l left join g on g.rid = l.rid and g.i = l.i group by l.rid)
select d.doc_id, coalesce(o.n_lines, 0) as n_lines, coalesce(o.n_dropped, 0) as n_dropped, sha256(o.kept) as kept_sha256
from d left join o using (rid)
"""

OP6 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as c from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.c, v.c) as bigint) as score
      from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

OP7 = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as pos from s0),
s2 as (select *, cast(1 + (pos - 1) % 3 as bigint) as weight from s1),
s3 as (select *, 3 * source_size / weight as ratio, sum(source_size) over () as total, sum(weight) over () as w from s2),
s4 as (select *, (total - coalesce(sum(3 * source_size) over b, 0)) / (w - coalesce(sum(weight) over b, 0)) as level from s3
       window b as (order by ratio, pos rows between unbounded preceding and 1 preceding)),
s5 as (select *, least(cast(3 * source_size as double), weight * (select level from s4 where level <= ratio order by ratio, pos limit 1)) as target from s4),
a0 as (select source, pos, source_size, target, target as v, cast(round(sum(target) over () / 16) as bigint) as n, sum(target) over () as al, count(*) over () as m from s5),
a1 as (select *, cast(greatest(0, coalesce(floor(v * n / nullif(al, 0) - (v / nullif(al, 0) * m / 2 + 1)), 0)) as bigint) as base,
         cast(coalesce(ceil(v * n / nullif(al, 0) + (v / nullif(al, 0) * m / 2 + 1)), 0) as bigint) as top from a0),
a2 as (select *, n - sum(base) over () as lft from a1),
a3 as (select source, pos, lft, row_number() over (order by v / (2 * s - 1) desc, pos, s) as r
       from (select *, unnest(generate_series(base + 1, top)) as s from a2 where top > base)),
a4 as (select pos, count(*) as won from a3 where r <= lft group by pos),
qs as (select source, source_size, target, base + coalesce(won, 0) as blocks from a2 left join a4 using (pos)),
e as (select d.doc_id, d.source, d.size, q.source_size, q.target, q.blocks, md5('mix:' || coalesce(cast(d.doc_id as varchar), 'null')) as key
      from d join qs q on d.source is not distinct from q.source),
f as (select *, cast('0x' || substr(key, 1, 8) as bigint) % cast(greatest(1, ceil(source_size / 500000)) as bigint) as shard from e),
h0 as (select source, shard, sum(size) as shard_size, any_value(blocks) as n from f group by source, shard),
h1 as (select *, cast(shard_size as double) as v, sum(cast(shard_size as double)) over g as al, count(*) over g as m from h0 window g as (partition by source)),
h2 as (select *, cast(greatest(0, coalesce(floor(v * n / nullif(al, 0) - (v / nullif(al, 0) * m / 2 + 1)), 0)) as bigint) as base,
         cast(coalesce(ceil(v * n / nullif(al, 0) + (v / nullif(al, 0) * m / 2 + 1)), 0) as bigint) as top from h1),
h3 as (select *, n - sum(base) over (partition by source) as lft from h2),
h4 as (select source, shard, lft, row_number() over (partition by source order by v / (2 * s - 1) desc, shard, s) as r
       from (select *, unnest(generate_series(base + 1, top)) as s from h3 where top > base)),
h5 as (select source, shard, count(*) as won from h4 where r <= lft group by source, shard),
h6 as (select h3.source, h3.shard, h3.shard_size, least((base + coalesce(won, 0)) * 16, 3 * h3.shard_size) as words
       from h3 left join h5 on h3.source is not distinct from h5.source and h3.shard = h5.shard),
i as (select f.*, h6.shard_size, h6.words, coalesce(sum(f.size) over (partition by f.source, f.shard order by key, size, f.doc_id rows between unbounded preceding and 1 preceding), 0) as before,
        coalesce(h6.words // nullif(h6.shard_size, 0), 0) as passes
      from f join h6 on f.source is not distinct from h6.source and f.shard = h6.shard)
select doc_id, size, source_size, target, cast(passes * size + greatest(0, least(size, words - passes * shard_size - before)) as bigint) as taken from i
"""

OP10 = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, generate_subscripts(ws, 1) as i, unnest(ws) as word from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)),
x as (select rid, i, word, lead(word) over o as nxt, case when lead(word, 7) over o is not null then concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o,
        lead(word, 4) over o, lead(word, 5) over o, lead(word, 6) over o, lead(word, 7) over o) end as win from w window o as (partition by rid order by i)),
y as (select *, case when win is not null and count(*) over (partition by rid, win) > 1 then 1 else 0 end as twice from x),
z as (select *, max(twice) over (partition by rid order by i rows between 7 preceding and current row) as covered from y),
c as (select rid, count(*) as n_words, sum(length(word)) as word_chars, sum(covered) as n_repeat_words, count(distinct word) as n_distinct,
        count(*) filter (where length(word) > 1 and upper(word) = word and lower(word) <> word) as n_upper, count(*) filter (where word = nxt) as n_same from z group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from d),
m as (select rid, count(*) as n_lines, count(*) filter (where regexp_matches(line, '[^\x20\x09-\x0D]'))
        - count(distinct line) filter (where regexp_matches(line, '[^\x20\x09-\x0D]')) as n_dup_lines from l group by rid),
b as (select d.rid, doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, n_distinct, n_upper, n_same, n_lines
      from d left join c using (rid) left join m using (rid)),
e as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 14 * n_words or 10 * n_dup_lines > 3 * n_lines
    or 10 * n_upper > 3 * n_words or 10 * n_same > 3 * n_words or 4 * n_distinct * n_distinct < 25 * n_words) as kept
from e
"""
