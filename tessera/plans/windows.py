"""Windows of bytes over word types, as hexadecimal digits of UTF-8: cuts, collisions, capacity; inventories and searches."""

from __future__ import annotations

from .collisions import _types

CAPACITIES = (16, 32)


def _byte(h: str, i: str) -> str:
    """Digits of byte ``i`` (from 0) of ``h``."""
    return f"substr({h}, cast(2 * ({i}) + 1 as int), 2)"


def _inside(byte: str) -> str:
    """Whether a byte continues a character."""
    return f"({byte} between '80' and 'BF')"


def _leads(e, h: str, size: int) -> str:
    """Characters that begin in the first ``size`` bytes."""
    byte = _byte(h, "i")
    return e.size(e.where(e.range("0", str(size - 1)), "i", f"{byte} <> '' and not {_inside(byte)}"))


def _hexed(e) -> str:
    return f"select lane, w, n, hex(w) as h, {e.bytes('w')} as b, cast(length(w) as bigint) as c from ({_types(e)}) y"


def byte_cut_quality(e) -> str:
    """Types longer than a window of bytes: how many cuts fall inside a character, and the characters lost to the cut."""
    rows = []
    for k in CAPACITIES:
        split = _inside(_byte("h", str(k)))
        whole = f"({_leads(e, 'h', k)} - case when {split} then 1 else 0 end)"
        rows.append(f"select lane, {k} as bytes, cast(count(*) as bigint) as types, cast(count(case when b > {k} then 1 end) as bigint) as cropped, cast(count(case when b > {k} and {split} then 1 end) as bigint) as invalid_prefix, cast(sum(case when b > {k} then c - {whole} else 0 end) as bigint) as chars_lost from ({_hexed(e)}) x group by lane")
    return " union all ".join(rows)


def _ends(size: int) -> str:
    half = size // 2
    return f"case when b <= {size} then h else concat(substr(h, 1, {2 * half}), substr(h, cast(2 * (b - {half}) + 1 as int), {2 * half})) end"


def _aligned(size: int) -> str:
    """Both ends with each cut moved to a character's edge: the front back, the rear forward. A character has four bytes at most."""
    front = " ".join(f"when not {_inside(_byte('h', str(size - size // 2 - k)))} then {size - size // 2 - k}" for k in range(4))
    rear = " ".join(f"when not {_inside(_byte('h', f'b - {size // 2 - k}'))} then b - {size // 2 - k}" for k in range(4))
    return f"case when b <= {size} then h else concat(substr(h, 1, 2 * (case {front} end)), substr(h, cast(2 * (case {rear} end) + 1 as int))) end"


def _colliding(e, key: str, scheme: str, size: int) -> str:
    return f"select lane, '{scheme}' as scheme, {size} as bytes, cast(count(*) as bigint) as colliding_groups, cast(sum(types) as bigint) as colliding_types, cast(sum(n) as bigint) as occurrences from (select lane, {key} as k, count(*) as types, sum(n) as n from ({_hexed(e)}) x group by lane, {key}) g where types > 1 group by lane"


def byte_collisions(e) -> str:
    """Types that become one under the first bytes, under both ends, and under both ends cut at characters."""
    return " union all ".join(_colliding(e, f(k), name, k) for k in (8, *CAPACITIES) for name, f in (("prefix", lambda k: f"substr(h, 1, {2 * k})"), ("both_ends", _ends), ("both_ends_aligned", _aligned)))


def window_choice(e) -> str:
    """Colliding groups of all lanes by scheme and size, least first."""
    return f"select scheme, bytes, groups, cast(row_number() over (order by groups, bytes, scheme) as bigint) as place from (select scheme, bytes, cast(sum(colliding_groups) as bigint) as groups from ({byte_collisions(e)}) c group by scheme, bytes) t"


def headline_collisions(e) -> str:
    """Colliding groups and types of English and of the other languages by window, and what both ends leave of the prefix's."""
    kind = "case when lane = 'en' then 'en' else 'other' end"
    base = f"select {kind} as kind, scheme, bytes, cast(sum(colliding_groups) as bigint) as groups, cast(sum(colliding_types) as bigint) as types from ({byte_collisions(e)}) c group by {kind}, scheme, bytes"
    return f"select a.kind, a.bytes, a.groups as prefix_groups, a.types as prefix_types, coalesce(b.groups, 0) as ends_groups, coalesce(b.types, 0) as ends_types from ({base}) a left join ({base}) b on b.kind = a.kind and b.bytes = a.bytes and b.scheme = 'both_ends' where a.scheme = 'prefix'"


def window_capacity(e) -> str:
    """Bytes a character, code points a letter with its marks, and characters in 32 bytes against English."""
    marks = e.count("w", r"\p{M}")
    base = f"select lane, cast(sum(b * n) as double) / sum(c * n) as bytes_char, cast(sum(c * n) as double) / sum(greatest(c - {marks}, 1) * n) as points_letter from ({_hexed(e)}) x group by lane"
    return f"select t.lane, round(t.bytes_char, 6) as bytes_char, round(t.points_letter, 6) as points_letter, round(32 / t.bytes_char, 4) as capacity, round(l.bytes_char / t.bytes_char, 6) as of_english from ({base}) t cross join (select bytes_char from ({base}) s where lane = 'en') l"


def overflow_split(e) -> str:
    """Types and occurrences that fit a window of 32 bytes, and those that overflow it."""
    return f"select lane, b > 32 as overflows, cast(count(*) as bigint) as types, cast(sum(n) as bigint) as occurrences from ({_hexed(e)}) x group by lane, b > 32"


def inventory_membership(e) -> str:
    """The 1,000 commonest types of all lanes as inventory: occurrences in and out of it by lane."""
    totals = f"select w, sum(n) as n from ({_types(e)}) y group by w"
    kept = f"select w from (select w, row_number() over (order by n desc, w) as rn from ({totals}) t) r where rn <= 1000"
    return f"select y.lane, cast(sum(case when k.w is not null then n else 0 end) as bigint) as inside, cast(sum(case when k.w is null then n else 0 end) as bigint) as outside, round(cast(sum(case when k.w is not null then n else 0 end) as double) / sum(n), 6) as hit_rate from ({_types(e)}) y left join ({kept}) k on k.w = y.w group by y.lane"


def vocabulary_search(e) -> str:
    """Types that hold a string, commonest first: a list of 400 at most."""
    return f"select w, n, rn from (select w, n, cast(row_number() over (order by n desc, w) as bigint) as rn from (select w, cast(sum(n) as bigint) as n from ({_types(e)}) y where w like '%an%' group by w) t) r where rn <= 400"


def top_words(e) -> str:
    """The ten commonest words of each lane."""
    return f"select lane, w, n, rn from (select lane, w, n, cast(row_number() over (partition by lane order by n desc, w) as bigint) as rn from ({_types(e)}) y) t where rn <= 10"


def pooled_types(e) -> str:
    """Word counts of all lanes but one united: types, occurrences, and types found in more than one lane."""
    return f"select cast(count(*) as bigint) as types, cast(sum(n) as bigint) as occurrences, cast(count(case when lanes > 1 then 1 end) as bigint) as shared from (select w, sum(n) as n, count(*) as lanes from ({_types(e)}) y where lane <> 'es' group by w) t"


def token_stats(e) -> str:
    """Words, word types, and characters and bytes a word, by lane."""
    return f"select lane, cast(sum(n) as bigint) as tokens, cast(count(*) as bigint) as types, round(cast(sum(c * n) as double) / sum(n), 6) as chars_token, round(cast(sum(b * n) as double) / sum(n), 6) as bytes_token from ({_hexed(e)}) x group by lane"


def fertility_spread(e) -> str:
    """Bytes a character as fertility: the spread over lanes, 1000 over the spread, and the penalty of the highest above 1.2."""
    return f"select round(max(f) - min(f), 6) as spread, round(1000 / (max(f) - min(f)), 4) as score, round(exp(greatest(0.0, max(f) / 1.2 - 1)), 6) as penalty from (select lane, cast(sum(b * n) as double) / sum(c * n) as f from ({_hexed(e)}) x group by lane) t having max(f) > min(f)"


def nearest_separation(e) -> str:
    """Squared distance to the nearest other vector for those of an id divisible by 100, and how many others equal them."""
    gap = f"({e.dot('a.embedding', 'a.embedding')} + {e.dot('b.embedding', 'b.embedding')} - 2 * {e.dot('a.embedding', 'b.embedding')})"
    return f"select vec_id, round(sqrt(greatest(min(gap), 0.0)), 4) as nearest, cast(count(case when gap <= 1e-9 then 1 end) as bigint) as equal_vectors from (select a.vec_id, {gap} as gap from {{embeddings}} a join {{embeddings}} b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) t group by vec_id"


QUERIES = {f.__name__: f for f in (byte_cut_quality, byte_collisions, window_choice, headline_collisions, window_capacity, overflow_split, inventory_membership, vocabulary_search, top_words, pooled_types, token_stats, fertility_spread, nearest_separation)}
