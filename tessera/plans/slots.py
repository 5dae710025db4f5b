"""Filling batch slots from lanes by hashed draws: firewall, reserve, difficulty band, selection, and preference among what is left.

A draw is a pure function of (seed, step, slot, attempt), so all slots are filled side by side: 24 draws meet the lane's
catalogue by place, and windows over one slot's draws say where drawing stops and what is taken. Spark writes the lanes and
the catalogue first (``_stepwise``), and makes draws from a range of numbers whose size it knows, so that none are sent to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import profiles
from tessera.operators.written import Steps

from .dialect import Spark
from .ledgers import HEAD, PROTECTED, _decided
from .shards import SEQ, _banded, _split, running

SEED, SLOTS, ATTEMPTS = 20260824, 8, 24

#: Draws that a task makes.
DRAWS = 100_000


def _catalogue(e, first: int | None = HEAD) -> str:
    """Every document with words: its place in its lane in order of id, band, whether it is held back for the end, and its selection."""
    rows = f"select b.doc_id, b.lane, b.n, b.split, b.band, {_reserved('b')} as reserved, d.score, d.decision, cast(1 as bigint) as one from ({_banded(e)}) b join ({_decided(e, first)}) d on d.doc_id = b.doc_id where b.n > 0"
    return f"select doc_id, lane, n, split, band, reserved, score, decision, off as place, total as lane_docs from ({running(rows, ['lane'], 'one')}) r"


def _reserved(t: str) -> str:
    return f"({t}.band = 'B5' or ({t}.lane in ('src0', 'src1') and {t}.band in ('B3', 'B4')))"


def _draws(e, made: int | None = None) -> str:
    """(step, slot, attempt, stage, lane, place): a step for each hundred documents, six at least; slots go to the lanes in turn.

    With ``made``, the number of steps, lanes are read from {lanes}, and draws are numbers dealt over tasks.
    """
    staged = "case when step < 0.2 * steps then 'warm' when step < 0.8 * steps then 'main' else 'anneal' end as stage"
    steps = "select cast(greatest(6, floor(count(*) / 100)) as bigint) as steps from {documents}"
    numbers = f"select steps, {e.each(e.range('0', 'steps - 1'))} as step from ({steps}) s"
    stages = f"select *, {staged} from ({numbers}) n"
    slots = f"select step, stage, {e.each(e.range('0', f'{SLOTS - 1}'))} as slot from ({stages}) g"
    tries = f"select step, stage, slot, {e.each(e.range('0', f'{ATTEMPTS - 1}'))} as attempt from ({slots}) s"
    if made is not None:
        n = made * SLOTS * ATTEMPTS
        tries = f"select step, {staged}, slot, attempt from (select id div {SLOTS * ATTEMPTS} as step, cast({made} as bigint) as steps, id div {ATTEMPTS} % {SLOTS} as slot, id % {ATTEMPTS} as attempt from range(0, {n}, 1, {n // DRAWS + 1})) r"
    key = "concat('" + str(SEED) + ":', cast(step as varchar(20)), ':', cast(slot as varchar(20)), ':', cast(attempt as varchar(20)))"
    hashed = f"select *, {e.hex('substr(h, 1, 8)')} as high, {e.hex('substr(h, 9, 8)')} as low from (select *, {e.sha(key)} as h from ({tries}) t) u"
    lanes = f"select lane, cast(row_number() over (order by lane nulls last) - 1 as bigint) as turn, lane_docs from (select lane, count(*) as lane_docs from ({_banded(e)}) b where n > 0 group by lane) l"
    turns = f"(select count(*) from (select distinct source from {{documents}} where {e.size(e.words('text'))} > 0) s)"
    if made is not None:
        lanes = "select lane, cast(row_number() over (order by lane nulls last) - 1 as bigint) as turn, lane_docs from {lanes} where lane_docs > 0"
        turns = "nullif((select count(*) from {lanes} where lane_docs > 0), 0)"
    turned = f"select *, (step + slot) % {turns} as turn from ({hashed}) h"
    # the first 16 digits are 64 bits without a sign: too many for a long, so the rest is taken in halves
    return f"select x.step, x.slot, x.attempt, x.stage, l.lane, ((x.high % l.lane_docs) * (4294967296 % l.lane_docs) + x.low) % l.lane_docs as place from ({turned}) x join ({lanes}) l on l.turn = x.turn"


def _judged(e, first: int | None = HEAD, made: int | None = None) -> str:
    """Every draw with the verdicts of the gates, whether it counts, and what the slot takes from it."""
    catalogue = _catalogue(e, first) if made is None else "select * from {catalogue}"
    bands = "(case x.stage when 'warm' then c.band between 'B0' and 'B2' when 'main' then c.band between 'B1' and 'B4' else c.band >= 'B2' end)"
    keys = "step, slot, lane"
    drawn = f"select {'' if made is None else e.hint('merge(c)')}x.step, x.slot, x.attempt, x.stage, c.lane, c.doc_id, c.n, c.score, c.decision, c.split = 'train' as admitted, c.reserved and x.stage <> 'anneal' as held_back, not {bands} as out_of_band, c.decision in ('accept', 'protected_override') as taken from ({_draws(e, made)}) x join ({catalogue}) c on c.place = x.place and c.lane is not distinct from x.lane"
    before = f"over (partition by {keys} order by attempt rows unbounded preceding)"
    first = f"select *, admitted and not held_back and not out_of_band as fits, admitted and not held_back as fits_relaxed, coalesce(sum(case when admitted and not held_back and not out_of_band and taken then n end) {before}, 0) - case when admitted and not held_back and not out_of_band and taken then n else 0 end as had, count(case when admitted and not held_back and taken then 1 end) {before} - case when admitted and not held_back and taken then 1 else 0 end as had_relaxed from ({drawn}) d"
    live = f"select *, had < {SEQ} as live from ({first}) f"
    counted = f"select *, count(case when live and fits then 1 end) over (partition by {keys}) as fitting, count(case when live and admitted and held_back then 1 end) over (partition by {keys}) as reserve_filtered, count(case when live and admitted and not held_back and out_of_band then 1 end) over (partition by {keys}) as band_filtered, count(case when live and not admitted then 1 end) over (partition by {keys}) as refused from ({live}) l"
    relaxed = f"select *, fitting = 0 and reserve_filtered + band_filtered > 0 as relaxed from ({counted}) c"
    pooled = f"select *, case when case when relaxed then fits_relaxed and had_relaxed = 0 else fits and live end then case when taken then 0 when decision = 'defer' then 1 else 2 end end as pool from ({relaxed}) r"
    return f"select *, count(case when pool < 2 then 1 end) over (partition by {keys}) as wanted, coalesce(sum(case when pool < 2 then n end) over (partition by {keys} order by coalesce(pool, 3), attempt rows between unbounded preceding and 1 preceding), 0) as filled, row_number() over (partition by {keys} order by case when pool is null then 1 else 0 end, score desc, attempt) as by_score from ({pooled}) p"


def filled_slots(e, made: int | None = None) -> str:
    """What every slot takes from its lane: accepted draws, then deferred ones, until 512 words are met; where there are neither, the best of the rejected."""
    chosen = f"case when pool < 2 then filled < {SEQ} else pool = 2 and wanted = 0 and by_score = 1 end"
    place = "row_number() over (partition by step, slot, lane order by pool, attempt)"
    return f"select step, slot, lane, cast({place} as bigint) as place, doc_id, n, case pool when 0 then 'accept' when 1 then 'defer' else 'exhaustion' end as filled_from, relaxed from ({_judged(e, made=made)}) j where {chosen}"


def slot_gates(e, made: int | None = None) -> str:
    """By stage and lane: draws that the firewall refused, that were held back or out of band, slots relaxed for want of others, and slots that stay empty.

    Documents are selected by profiles of whole texts here, by those of their heads in the other two.
    """
    slots = f"select step, slot, lane, stage, max(refused) as refused, max(reserve_filtered) as held_back, max(band_filtered) as out_of_band, max(case when relaxed then 1 else 0 end) as relaxed, count(pool) as pooled from ({_judged(e, None, made)}) j group by step, slot, lane, stage"
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("refused", "held_back", "out_of_band", "relaxed"))
    return f"select stage, lane, cast(count(*) as bigint) as slots, {sums}, cast(count(case when pooled = 0 then 1 end) as bigint) as empty_slots from ({slots}) s group by stage, lane"


def batch_accounts(e, made: int | None = None) -> str:
    """Each step's batch: slots that got something, documents, packed words (512 a slot at most), and where the documents came from."""
    slots = f"select step, slot, count(*) as docs, least(sum(n), {SEQ}) as packed, count(case when filled_from = 'accept' then 1 end) as accepted, count(case when filled_from = 'defer' then 1 end) as deferred, count(case when filled_from = 'exhaustion' then 1 end) as exhausted from ({filled_slots(e, made)}) r group by step, slot"
    return f"select step, cast(count(*) as bigint) as slots, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('docs', 'packed', 'accepted', 'deferred', 'exhausted'))} from ({slots}) s group by step"


QUERIES = {f.__name__: f for f in (filled_slots, slot_gates, batch_accounts)}


#: Words of a text as ``profiles`` cuts them.
WORDS = r"filter(split(text, '[ \\t\\n\\r\\f\\x0B]+'), w -> w <> '')"


def _squares(first: int | None) -> str:
    """(doc_id, common, squares) of ids that several rows have: their texts are one profile."""
    words = f"select d.doc_id, explode({WORDS if first is None else f'slice({WORDS}, 1, {first})'}) as w from {{documents}} d join {{repeated}} r on d.doc_id is not distinct from r.doc_id"
    counts = f"select doc_id, w, count(*) as n from ({words}) t group by doc_id, w"
    return f"select r.doc_id, r.common, s.squares from {{repeated}} r left join (select doc_id, sum(n * n) as squares from ({counts}) c group by doc_id) s on s.doc_id is not distinct from r.doc_id"


def _scored(golden: int, repeated: bool) -> str:
    """{docs} with their scores; ``golden`` is the golden profile's sum of squares."""
    docs = "select * from {docs}"
    if repeated:
        docs = "select /*+ merge(m) */ d.doc_id, d.lane, d.n, d.split, coalesce(m.common, d.common) as common, coalesce(m.squares, d.squares) as squares from {docs} d left join {merged} m on m.doc_id is not distinct from d.doc_id"
    score = f"coalesce(common / (sqrt(nullif(squares, 0)) * sqrt(nullif(cast({golden} as double), 0D))), 0D)"
    return f"select doc_id, lane, n, split, round({score}, 9) as score from ({docs}) d"


def _lanes() -> str:
    """Of each lane the thresholds of its bands and how many documents with words it has."""
    counts = "select lane, n, count(*) as m from {docs} group by lane, n"
    return f"select lane, percentile(n, array(0.15D, 0.35D, 0.6D, 0.82D, 0.95D), m) as t, sum(case when n > 0 then m end) as lane_docs from ({counts}) c group by lane"


def _cuts() -> str:
    """The scores to accept and to defer at: sums of counts by blocks of scores lead to the places, so that no task holds all scores."""
    rows = running("select score, m, cast(1 as bigint) as one from {counts}", ["one"], "m", "cast(floor(score * 10000) as bigint)", "score")
    found, cuts = [], []
    for name, share in (("hi", 0.6), ("lo", 0.35)):
        at = f"{share}D * (total - 1)"
        found += [f"max({at}) as {name}_at"] + [f"max(case when off <= {to}({at}) and {to}({at}) < off + m then score end) as {name}_{to}" for to in ("floor", "ceil")]
        cuts += [f"round(case when {name}_floor = {name}_ceil then {name}_floor else (ceil({name}_at) - {name}_at) * {name}_floor + ({name}_at - floor({name}_at)) * {name}_ceil end, 9) as {name}"]
    return f"select {', '.join(cuts)} from (select {', '.join(found)} from ({rows}) r) f"


def _rows(repeated: bool) -> str:
    """Documents with words, banded and decided; of an id that several rows have, every one with the decision of every one."""
    banded = "select s.*, case " + " ".join(f"when s.n <= t.t[{i}] then 'B{i}'" for i in range(5)) + " else 'B5' end as band from {scored} s join {lanes} t on s.lane is not distinct from t.lane where s.n > 0 and s.doc_id is not null"
    both = f"select /*+ merge(d) */ b.*, d.lane as source from ({banded}) b join {{scored}} d on d.doc_id = b.doc_id" if repeated else f"select b.*, b.lane as source from ({banded}) b"
    ruled = "case when x.score >= c.hi then 'accept' when x.score >= c.lo then 'defer' else 'reject' end"
    return f"select x.doc_id, x.lane, x.n, x.split, x.band, {_reserved('x')} as reserved, x.score, case when x.source in {PROTECTED} and x.score < c.hi then 'protected_override' else {ruled} end as decision, cast(1 as bigint) as one from ({both}) x cross join {{cuts}} c"


def _stepwise(text: Callable[..., str], first: int | None = HEAD) -> Callable[[SparkSession, str], DataFrame]:
    """The same query on Spark. Texts are read once, by tasks that keep numbers alone of them; only texts of repeated ids are dealt by words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, steps, tables = Spark(), Steps(spark, "slots"), {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark")}

        def keep(name: str, sql: str) -> DataFrame:
            tables[name] = steps.keep(spark.sql(sql, **{k: t for k, t in tables.items() if f"{{{k}}}" in sql}))
            return tables[name]

        golden = {r["w"].encode(): r["n"] for r in spark.sql(f"select w, count(*) as n from (select explode({WORDS}) as w from {{benchmark}}) t group by w", benchmark=tables["benchmark"]).collect()}
        of = profiles.profile(spark, golden, first)
        tables["docs"] = steps.keep(tables["documents"].select("doc_id", F.col("source").alias("lane"), F.expr(_split(e)).alias("split"), of(F.col("text")).alias("p")).select("doc_id", "lane", "split", "p.*"))
        repeated = not keep("repeated", "select doc_id, cast(sum(common) as bigint) as common from {docs} group by doc_id having count(*) > 1").isEmpty()
        if repeated:
            keep("merged", _squares(first))
        keep("scored", _scored(sum(n * n for n in golden.values()), repeated))
        keep("lanes", _lanes())
        keep("counts", "select score, count(*) as m from {scored} group by score")
        keep("cuts", _cuts())
        keep("rows", _rows(repeated))
        keep("catalogue", f"select doc_id, lane, n, split, band, reserved, score, decision, off as place from ({running('select * from {rows}', ['lane'], 'one', hint='/*+ merge(p) */ ')}) r")
        made = max(6, tables["docs"].count() // 100)
        return spark.sql(text(e, made=made), lanes=tables["lanes"], catalogue=tables["catalogue"])

    return run


STEPWISE = {"batch_accounts": _stepwise(batch_accounts), "filled_slots": _stepwise(filled_slots), "slot_gates": _stepwise(slot_gates, None)}
