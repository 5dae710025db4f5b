"""Splits, shards, packing by offsets, masks and sampling. A document's tokens here are its white-space words."""

from __future__ import annotations

SEQ = 512


def _docs(e) -> str:
    return f"select doc_id, source as lane, text, {e.size(e.words('text'))} as n, {_split(e)} as split from {{documents}}"


def _split(e) -> str:
    bucket = e.hex(f"substr({e.sha(chr(39) + 'split:' + chr(39) + ' || cast(doc_id as varchar(20))')}, 1, 8)") + " % 100"
    return f"case when {bucket} < 5 then 'eval' when {bucket} < 8 then 'holdout' else 'train' end"


def content_split(e) -> str:
    return f"select split, cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as tokens from ({_docs(e)}) d group by split"


def split_overlap(e) -> str:
    """Texts found in more than one split: what splitting by id alone leaks."""
    return f"select {e.sha('text')} as content_hash, cast(count(distinct split) as bigint) as splits from ({_docs(e)}) d group by {e.sha('text')} having count(distinct split) > 1"


def _thresholds(e) -> str:
    qs = ", ".join(f"{e.quantile('n', q)} as t{i}" for i, q in enumerate((0.15, 0.35, 0.6, 0.82, 0.95)))
    return f"select lane, {qs} from ({_docs(e)}) d group by lane"


def band_thresholds(e) -> str:
    return f"select lane, {', '.join(f'round(t{i}, 4) as t{i}' for i in range(5))} from ({_thresholds(e)}) t"


def _banded(e) -> str:
    ladder = " ".join(f"when d.n <= t{i} then 'B{i}'" for i in range(5))
    return f"select d.doc_id, d.lane, d.n, d.split, case {ladder} else 'B5' end as band from ({_docs(e)}) d join ({_thresholds(e)}) t on d.lane is not distinct from t.lane"


def band_assign(e) -> str:
    return f"select lane, band, cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as tokens from ({_banded(e)}) b group by lane, band"


def reserved_docs(e) -> str:
    return f"select doc_id, band, band = 'B5' or (lane in ('src0', 'src1') and band in ('B3', 'B4')) as reserved from ({_banded(e)}) b"


BLOCK = 1000


def running(rows: str, keys: list[str], value: str, block: str = f"coalesce(cast(floor(doc_id / {BLOCK}) as bigint), cast(-1 as bigint))", order: str = "doc_id", hint: str = "") -> str:
    """``rows`` with off, the sum of ``value`` over the rows before in their group of ``keys``, and total, the group's.

    Sums are taken by block first and placed over the blocks; rows are only put in order within theirs, so no task sees a
    whole group. ``block`` rises with ``order``; keys may be null.
    """
    by = ", ".join(keys)
    sums = f"select {by}, {block} as block, sum({value}) as part from ({rows}) r group by {by}, {block}"
    placed = f"select {by}, block, part, sum(part) over (partition by {by} order by block) - part as before, sum(part) over (partition by {by}) as total from ({sums}) s"
    same = " and ".join(f"r.{k} is not distinct from p.{k}" for k in keys)
    inside = f"sum({value}) over (partition by {', '.join(f'r.{k}' for k in keys)}, p.block order by r.{order} rows unbounded preceding)"
    return f"select {hint}r.*, cast(p.before + {inside} - {value} as bigint) as off, cast(p.total as bigint) as total from (select *, {block} as block_of from ({rows}) x) r join ({placed}) p on r.block_of = p.block and {same}"


def _offsets(e) -> str:
    return f"select doc_id, lane, split, n, off from ({running(_docs(e), ['lane', 'split'], 'n')}) o"


def shard_offsets(e) -> str:
    return _offsets(e)


def budget_prefix(e) -> str:
    """Rows of a source until its budget of words is met, the crossing row included."""
    return f"select doc_id, lane, n from ({running(_docs(e), ['lane'], 'n')}) t where off < 4000"


def lane_rollup(e) -> str:
    return f"select coalesce(lane, '*') as lane, coalesce(split, '*') as split, cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as tokens from ({_docs(e)}) d group by rollup(lane, split)"


def firewall(e) -> str:
    return f"select c.conv_id, s.split, s.split is not null and s.split = 'train' as admitted from (select distinct conv_id from {{conversations}}) c left join (select doc_id, {_split(e)} as split from {{documents}}) s on s.doc_id = c.conv_id"


def pack_concat(e) -> str:
    """Free concatenation: the windows that a document's offset range meets, with the slice in each."""
    base = f"select lane, doc_id, n, off from ({_offsets(e)}) o where n > 0 and split = 'train'"
    each = f"select lane, doc_id, n, off, {e.each(e.range(f'cast(floor(off / {SEQ}) as bigint)', f'cast(floor((off + n - 1) / {SEQ}) as bigint)'))} as seq from ({base}) b"
    return f"select lane, seq, doc_id, cast(greatest(off, seq * {SEQ}) - off as bigint) as tok_start, cast(least(off + n, (seq + 1) * {SEQ}) - off as bigint) as tok_end, cast(greatest(off - seq * {SEQ}, 0) as bigint) as seq_start from ({each}) w"


def packing_report(e) -> str:
    return f"select lane, cast(count(distinct seq) as bigint) as sequences, cast(sum(tok_end - tok_start) as bigint) as tokens, round(cast(sum(tok_end - tok_start) as double) / (count(distinct seq) * {SEQ}), 6) as utilisation from ({pack_concat(e)}) p group by lane"


def pack_long_doc(e) -> str:
    each = f"select doc_id, n, {e.each(e.range('0', f'cast(floor((n - 1) / {SEQ}) as bigint)'))} as win from ({_docs(e)}) d where n > 0"
    return f"select doc_id, win, least(n - win * {SEQ}, {SEQ}) as used from ({each}) w"


def span_clip(e) -> str:
    """Loss spans (assistant turns) clipped to windows: interval overlap of turns and windows of 128 words."""
    spans = f"select conv_id, turn, role, cast(coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as s, n from (select *, {e.size(e.words('text'))} as n from {{conversations}}) c"
    wins = f"select conv_id, {e.each(e.range('0', 'cast(floor((total - 1) / 128) as bigint)'))} as win from (select conv_id, sum({e.size(e.words('text'))}) as total from {{conversations}} group by conv_id) t where total > 0"
    return f"select w.conv_id, w.win, p.turn, cast(greatest(p.s, w.win * 128) as bigint) as lo, cast(least(p.s + p.n, w.win * 128 + 128) as bigint) as hi from ({wins}) w join ({spans}) p on p.conv_id = w.conv_id and p.role = 'assistant' and p.s < w.win * 128 + 128 and p.s + p.n > w.win * 128"


def segment_targets(e) -> str:
    """Positions with a next token in the same segment, by turn of a conversation."""
    toks = f"select conv_id, turn, {e.each(e.range('1', e.size(e.words('text'))))} as i from {{conversations}}"
    return f"select conv_id, cast(count(*) as bigint) as tokens, cast(count(case when nxt = turn then 1 end) as bigint) as targets from (select conv_id, turn, lead(turn) over (partition by conv_id order by turn, i) as nxt from ({toks}) t) x group by conv_id"


def attention_pairs(e) -> str:
    """Pairs that a block-diagonal causal mask lets through, in closed form by segment."""
    return f"select conv_id, cast(sum(n * (n + 1) / 2) as bigint) as pairs from (select conv_id, {e.size(e.words('text'))} as n from {{conversations}}) c group by conv_id"


def deterministic_draws(e) -> str:
    draw = e.hex(f"substr({e.sha(chr(39) + '7:' + chr(39) + ' || cast(i as varchar(20))')}, 1, 12)")
    return f"select i, {draw} % 1000 as draw from (select {e.each(e.range('0', '199'))} as i) t"


def strided_sample(e) -> str:
    """Ten strides over all documents of each source, in order of doc_id, null first: as many as it has where it has fewer.

    Documents are counted in blocks of a thousand ids; only the blocks that a stride falls in are numbered row by row.
    """
    docs = "select doc_id, source, coalesce(cast(floor(doc_id / 1000) as bigint), cast(-9223372036854775 as bigint) - 1000) as block from {documents}"
    counted = f"select source, block, cast(count(*) as bigint) as m from ({docs}) d group by source, block"
    placed = f"select source, block, m, cast(coalesce(sum(m) over (partition by source order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as off, cast(sum(m) over (partition by source) as bigint) as n from ({counted}) c"
    wanted = f"select p.source, p.block, p.off, s.i, (s.i * 7919) % p.n as rn from ({placed}) p join (select {e.each(e.range('0', '9'))} as i) s on s.i < p.n and (s.i * 7919) % p.n >= p.off and (s.i * 7919) % p.n < p.off + p.m"
    blocks = f"select distinct source, block, off from ({wanted}) w"
    numbered = f"select d.doc_id, d.source, b.off + row_number() over (partition by d.source, d.block order by d.doc_id nulls first) - 1 as rn from ({docs}) d join ({blocks}) b on d.block = b.block and d.source is not distinct from b.source"
    return f"select w.source, w.i, cast(w.rn as bigint) as rn, x.doc_id from ({wanted}) w join ({numbered}) x on x.rn = w.rn and x.source is not distinct from w.source"


def tail_split(e) -> str:
    """The last fifth of a source's documents in order of id is validation."""
    rows = "select doc_id, source, cast(1 as bigint) as one from {documents}"
    return f"select source, cast(count(case when off + 1 > 0.8 * total then 1 end) as bigint) as validation, cast(count(*) as bigint) as docs from ({running(rows, ['source'], 'one')}) t group by source"


QUERIES = {f.__name__: f for f in (content_split, split_overlap, band_thresholds, band_assign, reserved_docs, shard_offsets, budget_prefix, lane_rollup, firewall, pack_concat, packing_report, pack_long_doc, span_clip, segment_targets, attention_pairs, deterministic_draws, strided_sample, tail_split)}
