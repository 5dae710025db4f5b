"""Roll-ups over documents, runs and ledgers: markers, invisibles, windows in bytes, metadata, seeds, verdicts."""

from __future__ import annotations

from tessera.functions.text import GHOST

from .shards import running
from .study import _study, noise_floor


def ghost_markers(e) -> str:
    """Documents with chat markers: how many, and the hash of the text without them."""
    return f"select doc_id, {e.count('text', GHOST)} as markers, {e.sha(e.replace('text', GHOST, ''))} as stripped_hash from {{documents}} where {e.like('text', GHOST)}"


def joiner_counts(e) -> str:
    """Zero-width joiners and non-joiners by language, which cleaning has to keep."""
    return "select lang, cast(sum(length(text) - length(replace(text, '\u200c', ''))) as bigint) as zwnj, cast(sum(length(text) - length(replace(text, '\u200d', ''))) as bigint) as zwj, cast(count(*) as bigint) as docs from {documents} group by lang"


def empty_drop(e) -> str:
    return "select source, cast(count(*) as bigint) as docs, cast(count(case when text is null or trim(text) = '' then 1 end) as bigint) as empty from {documents} group by source"


def newline_forms(e) -> str:
    """Texts with every line end as one newline: the hash, and whether that changes the text."""
    x = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"select doc_id, {e.sha(x)} as content_hash, {x} <> text as changed from {{documents}}"


def wide_to_long(e) -> str:
    """One row for each filled column of a document."""
    return "select doc_id, 'source' as field, source as value from {documents} where source is not null union all select doc_id, 'lang' as field, lang as value from {documents} where lang is not null"


def shard_meta(e) -> str:
    """What a shard of 16 holds: documents, words, characters, bytes and distinct sources and languages."""
    return f"select cast(doc_id % 16 as bigint) as shard, cast(count(*) as bigint) as docs, cast(sum({e.size(e.words('text'))}) as bigint) as words, cast(sum(length(text)) as bigint) as chars, cast(sum({e.bytes('text')}) as bigint) as bytes, cast(count(distinct source) as bigint) as sources, cast(count(distinct lang) as bigint) as langs from {{documents}} group by doc_id % 16"


def seed_statistics(e) -> str:
    """Mean, spread and standard deviation of a mixture's loss over its seeds, and whether the spread is within twice the deviation of all."""
    by = f"select lane, name, cast(count(*) as bigint) as seeds, avg(loss) as mean, max(loss) - min(loss) as spread from ({_study(e)}) s group by lane, name"
    return f"select b.lane, b.name, b.seeds, round(b.mean, 6) as mean_loss, round(b.spread, 6) as spread, round(b.spread, 6) <= round(2 * d.sd, 6) as within_noise from ({by}) b join (select lane, stddev_samp(loss) as sd from ({_study(e)}) s group by lane) d on d.lane = b.lane"


def named_verdicts(e) -> str:
    """Claims that mixture a + 1 beats mixture a in a lane: held when the mean loss falls by more than the lane's floor."""
    means = f"select lane, name, avg(loss) as loss from ({_study(e)}) s group by lane, name"
    return f"select a.lane, a.name, round(a.loss - b.loss, 6) as delta, round(a.loss - b.loss, 6) > f.floor as holds from ({means}) a join ({means}) b on b.lane = a.lane and b.name = a.name + 1 join ({noise_floor(e)}) f on f.lane = a.lane"


def integrated_share(e) -> str:
    """A lane's share over stages that weigh 10, 70 and 20."""
    stages = "select * from (values (0, 10), (1, 70), (2, 20)) s(stage, weight)"
    shares = "select stage, lane, cast(100 as double) * n / sum(n) over (partition by stage) as share from (select cast(user_id % 3 as int) as stage, event_type as lane, count(*) as n from {events} group by user_id % 3, event_type) t"
    return f"select lane, round(sum(share * weight) / 100, 6) as share from ({shares}) x join ({stages}) s on s.stage = x.stage group by lane"


def shared_steps(e) -> str:
    """Two runs of one mixture at the steps that both have: how many, and the worst rise of the second."""
    steps = "select cast(user_id % 25 as bigint) as name, user_id % 50 as run, event_type as lane, cast(round(avg(value), 6) as double) as loss from {events} group by user_id % 25, user_id % 50, event_type"
    return f"select a.name, cast(count(*) as bigint) as steps, cast(count(case when round(a.loss, 4) = round(b.loss, 4) then 1 end) as bigint) as identical, round(max(b.loss - a.loss), 4) as worst from ({steps}) a join ({steps}) b on b.name = a.name and b.lane = a.lane and a.run < b.run group by a.name"


def head_split(e) -> str:
    """Validation is the first 5 % of a source's words in order of id: documents wholly or in part below that offset."""
    words = f"select doc_id, source, {e.size(e.words('text'))} as n from {{documents}}"
    placed = f"select source, n, off as start, total from ({running(words, ['source'], 'n')}) t"
    return f"select source, cast(count(*) as bigint) as docs, cast(count(case when start * 20 < total then 1 end) as bigint) as validation, cast(count(case when start * 20 < total and (start + n) * 20 > total then 1 end) as bigint) as leaking from ({placed}) p group by source"


def quality_evidence(e) -> str:
    """Requirements on the corpus as passed or failed, and whether all are."""
    facts = "select count(*) as docs, count(distinct doc_id) as ids, count(distinct lang) as langs, count(case when text is null or text = '' then 1 end) as empty from {documents}"
    rules = {"documents": "docs > 0", "unique_ids": "ids = docs", "four_languages": "langs >= 4", "no_empty_text": "empty = 0"}
    rows = " union all ".join(f"select '{k}' as requirement, {v} as passed from ({facts}) f" for k, v in rules.items())
    return f"select requirement, passed, min(case when passed then 1 else 0 end) over () = 1 as all_passed from ({rows}) r"


QUERIES = {f.__name__: f for f in (ghost_markers, joiner_counts, empty_drop, newline_forms, wide_to_long, shard_meta, seed_statistics, named_verdicts, integrated_share, shared_steps, head_split, quality_evidence)}
