"""Supply, demand and mixture study over runs taken from ``events``: run = user, lane = event type, loss = mean value in cents."""

from __future__ import annotations


def _runs(e) -> str:
    """(run, name, seed, lane, share, loss): two seeds of each of 25 mixtures."""
    return "select cast(user_id % 50 as bigint) as run, cast(user_id % 25 as bigint) as name, event_type as lane, cast(count(*) as bigint) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from {events} group by user_id % 50, user_id % 25, event_type"


def _study(e) -> str:
    return f"select run, name, lane, n, n * 1000 / sum(n) over (partition by run) as share, cast(cents as double) / n as loss from ({_runs(e)}) r"


def noise_floor(e) -> str:
    return f"select lane, round(max(spread), 6) as floor from (select lane, name, max(loss) - min(loss) as spread from ({_study(e)}) s group by lane, name having count(*) > 1) t group by lane"


def monotonicity_violations(e) -> str:
    """Larger share and loss worse by more than the floor; the self-join is by lane over one row a run and lane."""
    return f"select a.lane, a.run as low_run, b.run as high_run, round(b.loss - a.loss, 6) as worse from ({_study(e)}) a join ({_study(e)}) b on a.lane = b.lane and b.share > a.share + 1e-9 join ({noise_floor(e)}) f on f.lane = a.lane where b.loss - a.loss > f.floor + 1e-6"


def interaction_pairs(e) -> str:
    return f"select a.lane, a.run as run_a, b.run as run_b, round(abs(a.loss - b.loss), 6) as gap from ({_study(e)}) a join ({_study(e)}) b on a.lane = b.lane and round(a.share / 10) = round(b.share / 10) and a.run < b.run and a.name <> b.name"


def effect_table(e) -> str:
    """A verdict for every mixture and lane: an effect is real above the floor, both rounded, and one at the floor isn't."""
    return f"select a.lane, a.name, case when round(abs(a.loss - o.loss), 6) > f.floor then 'REAL' else 'not readable' end as verdict from (select lane, name, avg(loss) as loss from ({_study(e)}) s group by lane, name) a join (select lane, avg(loss) as loss from ({_study(e)}) s group by lane) o on a.lane = o.lane join ({noise_floor(e)}) f on f.lane = a.lane"


def lane_wins(e) -> str:
    return f"select lane, run from (select lane, run, row_number() over (partition by lane order by round(loss, 6), run) as rn from ({_study(e)}) s) t where rn = 1"


def supply_ledger(e) -> str:
    """Demand by nation against supply of its region's suppliers: epochs, capped at 4, and what has to be generated."""
    return "select n_name, demand, supply, round(case when supply > 0 then cast(demand as double) / supply else 0.0 end, 6) as epochs, greatest(demand - 4 * supply, 0) as generated, case when demand <= supply then 'met' when demand <= 4 * supply then 'repeated' else 'short' end as verdict from (select n.n_name, cast(coalesce(d.q, 0) as bigint) as demand, cast(coalesce(s.q, 0) as bigint) as supply from {nation} n left join (select c_nationkey as k, count(*) as q from {customer} group by c_nationkey) d on d.k = n.n_nationkey left join (select s_nationkey as k, 6 * count(*) as q from {supplier} group by s_nationkey) s on s.k = n.n_nationkey) t"


def mixture_compliance(e) -> str:
    plan = "select * from (values ('view', 40), ('click', 25), ('purchase', 15), ('error', 10), ('login', 10)) p(lane, share)"
    return f"select a.lane, a.tokens, round(cast(100 as double) * a.tokens / t.total, 4) as actual, cast(p.share as bigint) as planned, round(cast(100 as double) * a.tokens / t.total - p.share, 4) as delta from (select event_type as lane, cast(count(*) as bigint) as tokens from {{events}} group by event_type) a cross join (select count(*) as total from {{events}}) t join ({plan}) p on p.lane = a.lane"


def stage_boundaries(e) -> str:
    stages = "select * from (values (0, 'warm', 10), (1, 'main', 70), (2, 'anneal', 20)) s(ord, stage, weight)"
    runs = f"select stage, weight, ord, sum(weight) over (order by ord rows unbounded preceding) as upto from ({stages}) s"
    return f"select t.step, s.stage from (select {e.each(e.range('0', '99'))} as step) t join ({runs}) s on t.step * 100 < s.upto * 100 and t.step * 100 >= (s.upto - s.weight) * 100"


def hit_rates(e) -> str:
    return "select lang, cast(count(*) as bigint) as docs, round(cast(count(case when l.quality = 1 then 1 end) as double) / count(*), 6) as quality_rate, round(cast(count(case when l.toxic = 1 then 1 end) as double) / count(*), 6) as toxic_rate from {documents} d join {labels} l on d.doc_id = l.doc_id group by lang"


QUERIES = {f.__name__: f for f in (noise_floor, monotonicity_violations, interaction_pairs, effect_table, lane_wins, supply_ledger, mixture_compliance, stage_boundaries, hit_rates)}
