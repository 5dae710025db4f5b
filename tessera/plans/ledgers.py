"""Ledgers over ``events``: contiguity, replay, resume, fork, selection and vectors."""

from __future__ import annotations


def _steps(e) -> str:
    return "select cast(event_id as bigint) as step, event_type as lane, cast(user_id as bigint) as branch, cast(round(value * 100) as bigint) as tokens from {events}"


def ledger_contiguity(e) -> str:
    """Of each branch's records in order of arrival: steps that come again, that come late, and steps missing between its ends."""
    ordered = "select branch, step, step - lag(step) over (partition by branch order by ts, step) as d from (select cast(event_id as bigint) as step, cast(user_id as bigint) as branch, ts from {events}) s"
    return f"select branch, cast(count(*) - count(distinct step) as bigint) as repeats, cast(max(step) - min(step) + 1 - count(distinct step) as bigint) as gaps, cast(count(case when d < 0 then 1 end) as bigint) as disorder from ({ordered}) t group by branch"


def replay_state(e) -> str:
    return f"select lane, cast(coalesce(branch % 4, -1) as bigint) as stage, cast(sum(tokens) as bigint) as tokens, cast(max(step) + 1 as bigint) as next_step from ({_steps(e)}) s group by grouping sets ((lane), (lane, branch % 4))"


def cumulative_floor(e) -> str:
    """The least cumulative share of a lane over its branch's steps."""
    return f"select branch, round(min(share), 6) as least_share from (select branch, cast(sum(case when lane = 'view' then tokens else 0 end) over (partition by branch order by step rows unbounded preceding) as double) / greatest(sum(tokens) over (partition by branch order by step rows unbounded preceding), 1) as share from ({_steps(e)}) s) t group by branch"


def resume_equivalence(e) -> str:
    """Two ledgers, the second with one step lost and one changed, record by record."""
    second = f"select step, case when step = 11 then tokens + 1 else tokens end as tokens from ({_steps(e)}) s where step <> 7"
    return f"select coalesce(a.step, b.step) as step, case when a.step is null then 'extra' when b.step is null then 'missing' else 'changed' end as problem from ({_steps(e)}) a full outer join ({second}) b on a.step = b.step where a.step is null or b.step is null or a.tokens <> b.tokens"


def fork_lineage(e) -> str:
    fork = f"select step, case when step < 500 then tokens else tokens + step % 2 end as tokens from ({_steps(e)}) s"
    return f"select cast(count(case when a.step < 500 and a.tokens = b.tokens then 1 end) as bigint) as same_prefix, cast(count(case when a.step >= 500 then 1 end) as bigint) as after_fork, cast(count(case when a.step >= 500 and a.tokens <> b.tokens then 1 end) as bigint) as diverged from ({_steps(e)}) a join ({fork}) b on a.step = b.step"


def learning_trace(e) -> str:
    return f"select branch, round(avg(case when rn <= k then tokens end), 4) as first_mean, round(avg(case when rn > n - k then tokens end), 4) as last_mean from (select branch, tokens, rn, n, greatest(1, cast(floor(n / 5) as bigint)) as k from (select branch, cast(tokens as double) as tokens, row_number() over (partition by branch order by step) as rn, count(*) over (partition by branch) as n from ({_steps(e)}) s) t) u group by branch"


def json_ledger(e) -> str:
    return f"select cast({e.json('props', '$.k')} as bigint) as k, cast(count(*) as bigint) as records, cast(min(event_id) as bigint) as first_id from {{events}} group by cast({e.json('props', '$.k')} as bigint)"


def throughput(e) -> str:
    return f"select lane, cast(count(*) as bigint) as records, cast(sum(tokens) as bigint) as tokens, round(cast(sum(tokens) as double) / count(tokens), 6) as mean, {e.quantile('tokens', 0.9)} as p90, {e.quantile('tokens', 0.5)} as median, cast(max(tokens) as bigint) as most from ({_steps(e)}) s group by lane"


#: Words of a text that a profile is made of.
HEAD = 512


def _profile(e, first: int | None = HEAD) -> str:
    """(doc_id, w, n, v) of the ``first`` words of texts, of all where None."""
    taken = e.words("text") if first is None else e.head(e.words("text"), first)
    words = f"select doc_id, {e.each(taken)} as w from {{documents}}"
    if e.name == "spark":  # heads of texts are dealt by id, once, instead of words that would be dealt twice
        heads = f"select doc_id, array_join({taken}, ' ') as head from {{documents}}"
        words = f"select doc_id, {e.each(e.words('head'))} as w from ({e.near(heads, 'doc_id')}) h"
    counts = f"select doc_id, w, cast(count(*) as bigint) as n from ({words}) t group by doc_id, w"
    return f"select doc_id, w, n, n / sqrt(sum(n * n) over (partition by doc_id)) as v from ({counts}) c"


def token_profile(e) -> str:
    return f"select doc_id, cast(count(*) as bigint) as types, round(max(v), 6) as top from ({_profile(e)}) p group by doc_id"


def _golden(e) -> str:
    return f"select w, g / sqrt(sum(g * g) over ()) as g from (select w, cast(count(*) as double) as g from (select {e.each(e.words('text'))} as w from {{benchmark}}) t group by w) u"


def _scores(e, first: int | None = HEAD) -> str:
    return f"select {e.hint('broadcast(g)')}p.doc_id, sum(p.v * g.g) as score from ({_profile(e, first)}) p join ({_golden(e)}) g on p.w = g.w group by p.doc_id"


#: Lanes whose documents no score keeps out.
PROTECTED = "('src0', 'src1')"


def _decided(e, first: int | None = HEAD) -> str:
    scored = f"select d.doc_id, d.source, round(coalesce(s.score, cast(0 as double)), 9) as score from {{documents}} d left join ({_scores(e, first)}) s on s.doc_id is not distinct from d.doc_id"
    cut = f"select round({e.quantile('score', 0.6)}, 9) as hi, round({e.quantile('score', 0.35)}, 9) as lo from ({scored}) q"
    ruled = "case when s.score >= c.hi then 'accept' when s.score >= c.lo then 'defer' else 'reject' end"
    return f"select s.doc_id, s.source, s.score, {ruled} as would_be, case when s.source in {PROTECTED} and s.score < c.hi then 'protected_override' else {ruled} end as decision from ({scored}) s cross join ({cut}) c"


def selection_decisions(e) -> str:
    """A decision for every document, one that shares no word with the benchmark scoring 0; a score at a threshold passes it.

    A protected lane's document that would not be accepted is, by an override that says what it would have been. Scores and
    thresholds are rounded, so that both engines compare the same numbers.
    """
    return f"select doc_id, source, would_be, decision from ({_decided(e)}) x"


def selection_audit(e) -> str:
    return f"select source, {', '.join(f'cast(count(case when decision = {chr(39)}{k}{chr(39)} then 1 end) as bigint) as {k}s' for k in ('accept', 'defer', 'reject'))}, cast(count(case when decision = 'protected_override' then 1 end) as bigint) as overrides from ({selection_decisions(e)}) x group by source"


def label_centroids(e) -> str:
    return f"select label, cast(count(*) as bigint) as vectors, round(avg(sqrt({e.dot('embedding', 'embedding')})), 4) as mean_norm from {{embeddings}} group by label"


def nearest_to_queries(e) -> str:
    """For every vector whose id is divisible by 100, the nearest others of its label by cosine."""
    cos = f"{e.dot('q.embedding', 'v.embedding')} / sqrt({e.dot('q.embedding', 'q.embedding')} * {e.dot('v.embedding', 'v.embedding')})"
    return f"select query, vec_id, rank from (select q.vec_id as query, v.vec_id, cast(row_number() over (partition by q.vec_id order by round({cos}, 9) desc, v.vec_id) as bigint) as rank from {{embeddings}} q join {{embeddings}} v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 100 = 0) t where rank <= 5"


QUERIES = {f.__name__: f for f in (ledger_contiguity, replay_state, cumulative_floor, resume_equivalence, fork_lineage, learning_trace, json_ledger, throughput, token_profile, selection_decisions, selection_audit, label_centroids, nearest_to_queries)}
