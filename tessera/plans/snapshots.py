"""Selection by snapshots that rotate: golden profiles of reference sources, thresholds from a calibration sample by share, decisions of every document under each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.written import Steps

from .dialect import Spark
from .ledgers import PROTECTED, _profile
from .shards import running

#: Sources that make up the golden profile; each generation one of them counts half.
REFERENCE = ["src2", "src3", "src4"]
GENERATIONS, REFERENCE_DOCS, CALIBRATION_DOCS, KEPT, DEFERRED = 3, 80, 40, 0.5, 0.25

#: Shares of the sources in order of their names, repeating.
SHARES = [5, 2, 1]


def _placed(e) -> str:
    """Every document with its place in its source, in order of id, and how many that has."""
    rows = f"select doc_id, source as lane, text, cast(1 as bigint) as one from {{documents}} where {e.size(e.words('text'))} > 0"
    return f"select doc_id, lane, text, off as place, total from ({running(rows, ['lane'], 'one')}) r"


def _of_reference() -> str:
    return "lane in (" + ", ".join(f"'{x}'" for x in REFERENCE) + ")"


def _share() -> str:
    """How many documents of a lane the calibration sample has."""
    return f"cast(greatest(4, floor(cast({CALIBRATION_DOCS} * lanes * share as double) / all_shares + 0.5)) as bigint)"


def _turns() -> str:
    return " union all ".join(f"select cast({g} as bigint) as generation, '{x}' as lane, {0.5 if i == g % len(REFERENCE) else 1.0} as weight" for g in range(GENERATIONS) for i, x in enumerate(sorted(REFERENCE)))


def _strides(e, wanted: str, where: str, placed: str = "placed") -> str:
    """Places (i * 7919) % n of the sources that ``where`` picks, ``wanted`` of each, as many as there are at most; a place may come twice."""
    ranked = f"select lane, total, row_number() over (order by lane nulls last) - 1 as turn from (select distinct lane, total from {placed}) d"
    shares = f"select lane, total, case turn % {len(SHARES)} {' '.join(f'when {i} then {s}' for i, s in enumerate(SHARES))} end as share from ({ranked}) r"
    picked = f"select lane, total, share, sum(share) over () as all_shares, count(*) over () as lanes from ({shares}) s where {where}"
    return f"select lane, i, (i * 7919) % total as place from (select lane, total, {e.each(e.range('0', f'least({wanted}, total) - 1'))} as i from ({picked}) p) x"


def _with(e) -> str:
    sampled = "select p.doc_id, p.lane, p.text from placed p join ({}) s on s.place = p.place and s.lane is not distinct from p.lane"
    counts = f"select lane, w, cast(count(*) as double) as c from (select lane, {e.each(e.words('text'))} as w from ({sampled.format(_strides(e, str(REFERENCE_DOCS), _of_reference()))}) t) u group by lane, w"
    golden = f"select generation, w, sum(weight * c / norm) as x from (select *, sqrt(sum(c * c) over (partition by lane)) as norm from ({counts}) c) n join ({_turns()}) t on t.lane = n.lane group by generation, w"
    scored = f"select g.generation, p.doc_id, sum(p.v * g.x) as score from profiles p join golden g on g.w = p.w group by g.generation, p.doc_id"
    calibration = f"select s.doc_id, g.generation from ({sampled.format(_strides(e, _share(), f'lane is null or lane not in {PROTECTED}'))}) s cross join (select distinct generation from golden) g"
    cuts = f"select c.generation, round({e.quantile('coalesce(s.score, cast(0 as double))', 1 - KEPT)}, 9) as accept_at, round({e.quantile('coalesce(s.score, cast(0 as double))', 1 - KEPT - DEFERRED)}, 9) as reject_at from ({calibration}) c left join scores s on s.doc_id = c.doc_id and s.generation = c.generation group by c.generation"
    return f"with placed as ({_placed(e)}), profiles as ({_profile(e)}), golden as (select generation, w, x / sqrt(sum(x * x) over (partition by generation)) as x from ({golden}) h), scores as ({scored}), cuts as ({cuts})"


def snapshot_thresholds(e) -> str:
    """Each snapshot's thresholds: half of the calibration sample is accepted, a quarter more deferred."""
    return f"{_with(e)} select c.generation, round(c.accept_at, 6) as accept_at, round(c.reject_at, 6) as reject_at, cast(n.types as bigint) as golden_types from cuts c join (select generation, count(*) as types from golden group by generation) n on n.generation = c.generation"


def rotating_decisions(e) -> str:
    """What each snapshot decides of every document with words; protected sources override what they would have been."""
    ruled = "case when s.score >= c.accept_at then 'accept' when s.score >= c.reject_at then 'defer' else 'reject' end"
    every = "select p.doc_id, p.lane, c.generation, c.accept_at, c.reject_at, round(coalesce(s.score, cast(0 as double)), 9) as score from placed p cross join cuts c left join scores s on s.doc_id = p.doc_id and s.generation = c.generation"
    return f"{_with(e)} select s.generation, s.doc_id, {ruled.replace('c.', 's.')} as would_be, case when s.lane in {PROTECTED} and s.score < s.accept_at then 'protected_override' else {ruled.replace('c.', 's.')} end as decision from ({every}) s"


QUERIES = {f.__name__: f for f in (snapshot_thresholds, rotating_decisions)}


def _places(e) -> str:
    """``_placed`` without texts, which are only read again for what is sampled; ``twin`` tells rows of one id apart."""
    rows = f"select doc_id, source as lane, xxhash64(text) as twin, cast(1 as bigint) as one from {{documents}} where {e.any_word('text')}"
    return f"select doc_id, lane, twin, off as place, total from ({running(rows, ['lane'], 'one')}) r"


def _golden(e) -> str:
    """(generation, w, x): words of the reference sample. A text counts as often as its places come."""
    places = _strides(e, str(REFERENCE_DOCS), _of_reference(), "{placed}")
    picked = f"select p.doc_id, p.lane, p.twin, count(*) as times from {{placed}} p join ({places}) s on s.place = p.place and s.lane = p.lane group by p.doc_id, p.lane, p.twin"
    texts = f"select /*+ broadcast(k) */ k.lane, k.times, any_value(d.text) as text from {{documents}} d join ({picked}) k on d.doc_id is not distinct from k.doc_id and d.source = k.lane and xxhash64(d.text) = k.twin group by k.doc_id, k.lane, k.twin, k.times"
    counts = f"select lane, w, cast(sum(times) as double) as c from (select lane, times, {e.each(e.words('text'))} as w from ({texts}) t) u group by lane, w"
    weighed = f"select generation, w, sum(weight * c / norm) as x from (select *, sqrt(sum(c * c) over (partition by lane)) as norm from ({counts}) c) n join ({_turns()}) t on t.lane = n.lane group by generation, w"
    return f"select generation, w, x / sqrt(sum(x * x) over (partition by generation)) as x from ({weighed}) h"


def _scores(e) -> str:
    """(doc_id, score0, score1, ...): one pass over the heads of texts, dealt by id, for all generations; words are counted and added up where they lie."""
    xs = ", ".join(f"max(case when generation = {g} then x end) as x{g}" for g in range(GENERATIONS))
    heads = f"select doc_id, array_join({e.words_head('text', 512)}, ' ') as head from {{documents}} where doc_id is not null and {e.any_word('text')}"
    counts = f"select doc_id, w, count(*) as n from (select doc_id, explode(split(head, ' ')) as w from ({e.near(heads, 'doc_id')}) h) t group by doc_id, w"
    sums = ", ".join(f"sum(c.n * g.x{k}) / sqrt(sum(c.n * c.n)) as score{k}" for k in range(GENERATIONS))
    return f"select /*+ broadcast(g) */ c.doc_id, {sums} from ({counts}) c left join (select w, {xs} from {{golden}} group by w) g on g.w = c.w group by c.doc_id"


def _score(generation: str) -> str:
    return f"coalesce(case {generation} {' '.join(f'when {g} then s.score{g}' for g in range(GENERATIONS))} end, cast(0 as double))"


def _cuts(e) -> str:
    places = _strides(e, _share(), f"lane is null or lane not in {PROTECTED}", "{placed}")
    sample = f"select p.doc_id, g.generation from (select p.doc_id from {{placed}} p join ({places}) s on s.place = p.place and s.lane is not distinct from p.lane) p cross join (select distinct generation from {{golden}}) g"
    scored = f"select /*+ broadcast(c) */ c.generation, {_score('c.generation')} as score from ({sample}) c left join {{scores}} s on s.doc_id = c.doc_id"
    return f"select generation, round({e.quantile('score', 1 - KEPT)}, 9) as accept_at, round({e.quantile('score', 1 - KEPT - DEFERRED)}, 9) as reject_at from ({scored}) q group by generation"


def _thresholds(e) -> str:
    return "select c.generation, round(c.accept_at, 6) as accept_at, round(c.reject_at, 6) as reject_at, cast(n.types as bigint) as golden_types from {cuts} c join (select generation, count(*) as types from {golden} group by generation) n on n.generation = c.generation"


def _decisions(e) -> str:
    ruled = "case when score >= accept_at then 'accept' when score >= reject_at then 'defer' else 'reject' end"
    every = f"select p.doc_id, p.lane, c.generation, c.accept_at, c.reject_at, round({_score('c.generation')}, 9) as score from {{placed}} p left join {{scores}} s on s.doc_id = p.doc_id cross join {{cuts}} c"
    return f"select generation, doc_id, {ruled} as would_be, case when lane in {PROTECTED} and score < accept_at then 'protected_override' else {ruled} end as decision from ({every}) d"


def _stepwise(text: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query on Spark: places, golden profiles, scores and thresholds are each written once, and read wherever they stand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, steps, tables = Spark(), Steps(spark, "snapshots"), {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}
        for name, step in (("placed", _places), ("golden", _golden), ("scores", _scores), ("cuts", _cuts)):
            tables[name] = steps.keep(spark.sql(step(e), **tables))
        return spark.sql(text(e), **tables)

    return run


STEPWISE = {"snapshot_thresholds": _stepwise(_thresholds), "rotating_decisions": _stepwise(_decisions)}
