"""Truncation and collision analytics over word types."""

from __future__ import annotations

L = 8


def _types(e) -> str:
    return f"select lane, w, cast(count(*) as bigint) as n from (select lang as lane, {e.each(e.words('text'))} as w from {{documents}}) t group by lane, w"


def edge_punctuation(e) -> str:
    x = e.replace("w", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    return f"select lane, cast(count(*) as bigint) as types, cast(count(case when {x} <> w then 1 end) as bigint) as stripped, cast(count(case when {x} = '' then 1 end) as bigint) as emptied, cast(count(distinct {x}) as bigint) as distinct_left from ({_types(e)}) y group by lane"


def _collide(e, key: str, name: str) -> str:
    return f"select lane, '{name}' as scheme, cast(count(*) as bigint) as colliding_groups, cast(sum(types) as bigint) as colliding_types, cast(sum(n) as bigint) as occurrences from (select lane, {key} as k, count(*) as types, sum(n) as n from ({_types(e)}) y group by lane, {key}) g where types > 1 group by lane"


def truncation_collisions(e) -> str:
    return " union all ".join(_collide(e, f"substr(w, 1, {n})", f"first_{n}") for n in (8, 12, 16))


def scheme_comparison(e) -> str:
    ends = f"case when length(w) <= {L} then w else concat(substr(w, 1, {L // 2}), substr(w, length(w) - {L // 2 - 1}, {L // 2})) end"
    hashed = f"case when length(w) <= {L} then w else concat(substr(w, 1, 3), substr(w, length(w) - 2, 3), substr({e.sha('w')}, 1, 2)) end"
    return " union all ".join((_collide(e, f"substr(w, 1, {L})", "prefix"), _collide(e, ends, "both_ends"), _collide(e, hashed, "both_ends_hash")))


def collision_examples(e) -> str:
    return f"select lane, k, rn, types from (select lane, k, types, cast(row_number() over (partition by lane order by types desc, k) as bigint) as rn from (select lane, substr(w, 1, {L}) as k, cast(count(*) as bigint) as types from ({_types(e)}) y group by lane, substr(w, 1, {L})) g where types > 1) t where rn <= 12"


def occupancy(e) -> str:
    b = e.bytes("w")
    return f"select lane, round(cast(sum(least({b}, 32) * n) as double) / (sum(n) * 32), 6) as occupancy, cast(max({b}) as bigint) as longest, round(cast(sum({b} * n) as double) / sum(n), 6) as mean_bytes, round(cast(sum({b} * n) as double) / sum(length(w) * n), 6) as bytes_per_char from ({_types(e)}) y group by lane"


def weighted_median_bytes(e) -> str:
    return f"select lane, cast(min(b) as bigint) as median_bytes from (select lane, b, sum(n) over (partition by lane order by b rows unbounded preceding) as run, sum(n) over (partition by lane) as total from (select lane, {e.bytes('w')} as b, sum(n) as n from ({_types(e)}) y group by lane, {e.bytes('w')}) h) t where 2 * run >= total group by lane"


def reported_lanes(e) -> str:
    return f"select lane, cast(count(*) as bigint) as types, count(*) >= 200 as reported from ({_types(e)}) y group by lane"


def _chars(e) -> str:
    return f"select lane, c, cast(sum(n) as bigint) as n from (select lane, n, {e.each(e.chars('w'))} as c from ({_types(e)}) y) z group by lane, c"


def digit_entropy(e) -> str:
    part = lambda d: f"select lane, {d} as d, cast(sum(n) as bigint) as n from ({_chars(e)}) c group by lane, {d}"
    ent = lambda d, name: f"select lane, '{name}' as digit, abs(round(sum(p * log2(p)), 6)) as entropy from (select lane, cast(n as double) / sum(n) over (partition by lane) as p from ({part(d)}) q) r group by lane"
    return ent(f"cast(floor({e.code('c')} / 256) as bigint)", "high") + " union all " + ent(f"{e.code('c')} % 256", "low")


def astral_chars(e) -> str:
    return f"select lane, cast(sum(n) as bigint) as chars, cast(sum(case when {e.code('c')} > 65535 then n else 0 end) as bigint) as astral, cast(count(*) as bigint) as distinct_chars from ({_chars(e)}) c group by lane"


def alias_groups(e) -> str:
    return f"select low, cast(count(distinct high) as bigint) as blocks, cast(sum(n) as bigint) as n from (select {e.code('c')} % 256 as low, cast(floor({e.code('c')} / 256) as bigint) as high, n from ({_chars(e)}) c) t group by low having count(distinct high) > 1"


def truncation_exposure(e) -> str:
    b = e.bytes("w")
    return f"select lane, {', '.join(f'cast(sum(case when {b} > {k} then n else 0 end) as bigint) as over_{k}' for k in (8, 16, 32))}, cast(sum(n) as bigint) as n from ({_types(e)}) y group by lane"


def frequency_bands(e) -> str:
    return f"select lane, case when rn <= 250 then 'top' when rn <= 750 then 'middle' when rn <= 1000 then 'low' when rn <= 1500 then 'near' else 'out' end as band, cast(count(*) as bigint) as types, cast(sum(n) as bigint) as n from (select lane, n, row_number() over (partition by lane order by n desc, w) as rn from ({_types(e)}) y) t group by 1, 2"


def length_regression(e) -> str:
    return "select lang, round(regr_slope(cast(octet as double), cast(n_chars as double)), 6) as slope, round(corr(cast(octet as double), cast(n_chars as double)), 6) as r from (select lang, n_chars, " + e.bytes("text") + " as octet from {documents}) t group by lang"


QUERIES = {f.__name__: f for f in (edge_punctuation, truncation_collisions, scheme_comparison, collision_examples, occupancy, weighted_median_bytes, reported_lanes, digit_entropy, astral_chars, alias_groups, truncation_exposure, frequency_bands, length_regression)}
