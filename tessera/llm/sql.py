"""DuckDB SQL for the queries that SQL can state: what op3, op5 and op10 return, by plain windows, sets and recursion."""

from __future__ import annotations

#: Least id reachable over ``links`` (a, b, both ways) for every row of ``nodes`` (id).
_REACH = "reach as (select id, id as far from nodes union select r.id, l.b from reach r join links l on l.a = r.far), least as (select id, min(far) as component_id from reach group by id)"

OP3 = f"""with recursive vectors as (
    select vec_id as id, label, list_transform(cast(embedding as double[]), lambda x: coalesce(x, cast('nan' as double))) as v from embeddings),
finite as (select *, list_max(list_transform(v, lambda x: abs(x))) as m from vectors where label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: isnan(x) or isinf(x))) = 0),
usable as (select id, label, case when m > 1e-100 and m < 1e100 then v else list_transform(list_transform(v, lambda x: x / pow(2, floor(log2(m) / 2))), lambda x: x / pow(2, floor(log2(m)) - floor(log2(m) / 2))) end as v from finite where m > 0),
links as (select x.id as a, y.id as b from usable x join usable y on x.label = y.label and x.id <> y.id and len(x.v) = len(y.v)
    where list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.93),
nodes as (select id from vectors), {_REACH}
select n.id as vec_id, cast(count(l.b) as bigint) as n_links, any_value(c.component_id) as component_id, n.id = any_value(c.component_id) as kept
from nodes n join least c on c.id = n.id left join links l on l.a = n.id group by n.id"""

# Windows are cut from blocks of 1,000 bytes (and the 99 after), as hexadecimal digits; they are told apart by MD5.
OP5 = """with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select doc_id, b, substr(h, 2000 * b + 1, 2198) as part from (select doc_id, h, unnest(range(0, cast(len(h) // 2000 as bigint) + 1)) as b from texts) t),
windows as (select doc_id, 1000 * b + i as pos, md5_number(substr(part, cast(2 * i + 1 as bigint), 200)) as w
    from (select doc_id, b, part, unnest(range(0, least(1000, cast(len(part) // 2 as bigint) - 99))) as i from blocks where len(part) >= 200) t),
again as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as rn from windows) t where rn > 1),
marked as (select doc_id, pos, case when pos <= lag(pos) over (partition by doc_id order by pos) + 100 then 0 else 1 end as fresh from again),
numbered as (select doc_id, pos, sum(fresh) over (partition by doc_id order by pos rows unbounded preceding) as run from marked),
spans as (select doc_id, run, min(pos) as lo, max(pos) + 100 as hi from numbered group by doc_id, run),
sides as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from spans),
cuts as (select s.doc_id, string_agg(substr(t.h, cast(2 * s.since + 1 as bigint), cast(2 * (s.lo - s.since) as bigint)), '' order by s.lo) as front, max(s.hi) as upto, sum(s.hi - s.lo) as gone, count(*) as n
    from sides s join texts t on t.doc_id = s.doc_id group by s.doc_id)
select t.doc_id, cast(len(t.h) // 2 as bigint) as n_bytes, cast(coalesce(c.gone, 0) as bigint) as n_removed, cast(coalesce(c.n, 0) as bigint) as n_spans,
    sha256(unhex(coalesce(c.front, '') || substr(t.h, cast(2 * coalesce(c.upto, 0) + 1 as bigint)))) as kept_sha256
from texts t left join cuts c on c.doc_id = t.doc_id"""

OP10 = rf"""with recursive worded as (select doc_id as id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
tokens as (select id, len(w) as m, w[1:3] as few, unnest(w) as t, generate_subscripts(w, 1) as i from worded),
grams as (select id, m, i, few, concat_ws(' ', t, lead(t, 1) over o, lead(t, 2) over o, lead(t, 3) over o) as g from tokens window o as (partition by id order by i)),
shingles as (select distinct id, case when m < 4 then array_to_string(few, ' ') else g end as g from grams where i = 1 or i <= m - 3),
items as (select id, g, count(*) over (partition by id) as n from shingles),
links as (select x.id as a, y.id as b from items x join items y on x.g = y.g and x.id <> y.id group by x.id, y.id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
nodes as (select id from worded), sizes as (select id, count(*) as n from shingles group by id), {_REACH}
select c.id as doc_id, coalesce(s.n, 0) as n_shingles, c.component_id, c.id = c.component_id as kept from least c left join sizes s on s.id = c.id"""

OP11 = r"""select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
    row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents) d"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""with listed as (select doc_id, row_number() over () as row, {_TERMS} as terms from documents), sized as (select *, cast(len(terms) as bigint) as n from listed),
totals as (select cast(count(*) filter (n > 0) as bigint) as docs, cast(sum(n) as bigint) as all_terms from sized),
held as (select row, doc_id, n, t, cast(count(*) as bigint) as tf from (select row, doc_id, n, unnest(terms) as t from sized) x group by row, doc_id, n, t),
weights as (select t, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from held, totals group by t),
asked as (select distinct item_id, t from (select item_id, unnest({_TERMS}) as t from benchmark) b),
scored as (select a.item_id, h.row, h.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) as bigint) as score
    from asked a join held h on h.t = a.t join weights g on g.t = a.t cross join totals group by a.item_id, h.row, h.doc_id),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""

# CRC-32 of the decimal digits: each code is followed by eight steps of the shift register.
OP13 = """with hashed as (select *, xor(list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(sale_id as varchar), ''),
        lambda c: [cast(unicode(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 5 = 0 as one from sale_lines),
grouped as (select case when one then -1 else vendor_id end as vendor_id, cast(case when one then -1 else coalesce(item_id % 5, -1) end as bigint) as part,
    cast(case when one then -1 else coalesce(100 * year(shipped_at) + month(shipped_at), -1) end as bigint) as month, sale_id, cast(line_no as bigint) as line_no, cast(quantity as bigint) as quantity,
    cast(floor(100 * discount + 0.5) as bigint) as percent, cast(floor(100 * amount + 0.5) as bigint) as amount_cents, cast(floor(quantity / 10) as bigint) as tens from (select * replace (sale_id is not null and one as one) from hashed) h),
placed as (select *, row_number() over (partition by vendor_id, part, month order by tens desc nulls last, percent nulls last, sale_id nulls last, line_no nulls last, quantity nulls last, amount_cents nulls last) as pos,
    count(*) over (partition by vendor_id, part, month, tens, percent) as tied from grouped)
select vendor_id, part, month, pos, pos as place, sale_id, line_no, quantity, percent, amount_cents, tied from placed where pos <= 2"""

SQL = {"op12_wand": OP12, "op13_bit_slices": OP13, "op11_content_sort": OP11, "op3_cover_tree": OP3, "op5_suffix_array": OP5, "op10_minhash": OP10}
