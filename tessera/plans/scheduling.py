"""Lane schedules, draws, splits by seed, batches, branches of a ledger and checks of shards."""

from __future__ import annotations

from .cleaning import rule_failures
from .ledgers import _steps
from .shards import SEQ, _banded, _docs, pack_concat, running
from .study import interaction_pairs, monotonicity_violations

#: Lanes of ``events`` with their planned shares, the largest name first: it wins ties.
SHARES = {"view": 40, "purchase": 15, "login": 10, "error": 10, "click": 25}
SLOTS = 48


def _schedule() -> str:
    """Each slot goes to the lane that would be furthest below its share of all words after the slot."""
    due = {k: f"({v} * (slot + 1) * {SEQ} - 100 * {k}_taken)" for k, v in SHARES.items()}
    ladder = " ".join(f"when {x} = greatest({', '.join(due.values())}) then '{k}'" for k, x in due.items())
    start = ", ".join(f"cast(0 as bigint) as {k}_taken" for k in SHARES)
    after = ", ".join(f"{k}_taken + case when pick = '{k}' then {SEQ} else 0 end" for k in SHARES)
    return f"recursive s as (select cast(0 as bigint) as slot, 'none' as lane, {start} union all select slot + 1, pick, {after} from (select *, case {ladder} end as pick from s where slot < {SLOTS}) t)"


def deficit_schedule(e) -> str:
    return f"with {_schedule()} select slot, lane, {', '.join(f'{k}_taken' for k in SHARES)} from s where slot > 0"


def schedule_state(e) -> str:
    """The schedule's state after its last slot, with the hash that a checkpoint keeps."""
    state = "concat(" + ", '|', ".join(f"'{k}:', cast({k}_taken as varchar(20))" for k in sorted(SHARES)) + ")"
    return f"with {_schedule()} select slot, {state} as state, {e.sha(state)} as state_hash from s where slot = {SLOTS}"


def schedule_compliance(e) -> str:
    """Share of every lane after the last slot against its plan."""
    rows = " union all ".join(f"select '{k}' as lane, {v} as planned, round(cast({k}_taken as double) / (slot * {SEQ}) * 100, 4) as actual from s where slot = {SLOTS}" for k, v in SHARES.items())
    return f"with {_schedule()} {rows}"


def benchmark_readiness(e) -> str:
    """What feeds each of four targets: weighted share, how much of it real supply backs at four epochs, and a verdict."""
    feeds = "select * from (values ('reading', 'view', 0.75), ('reading', 'click', 0.25), ('trade', 'purchase', 1.0), ('care', 'error', 0.5), ('care', 'login', 0.5), ('reach', 'click', 0.5), ('reach', 'ship', 0.5)) f(target, lane, weight)"
    plan = "select * from (values ('view', 40, 30.0), ('click', 25, 4.0), ('purchase', 15, 0.5), ('error', 10, 0.5), ('login', 10, 2.0), ('ship', 5, 9.0)) p(lane, share, supply)"
    tested = "select event_type as lane, count(*) as runs from {events} group by event_type"
    base = f"select f.target, sum(f.weight * p.share) as gradient, sum(cast(f.weight as double) * least(1.0, cast(p.supply as double) * 4 / p.share)) as backing, count(case when t.runs is null then 1 end) as untested from ({feeds}) f join ({plan}) p on p.lane = f.lane left join ({tested}) t on t.lane = f.lane group by f.target"
    return f"select target, cast(gradient as double) as gradient, round(backing, 6) as backing, case when untested > 0 then 'unevidenced' when backing < 0.35 then 'supply-limited' when backing < 0.8 then 'partly supply-limited' else 'on track' end as verdict from ({base}) b"


def band_range_docs(e) -> str:
    """Documents that each stage's range of difficulty bands lets in."""
    stages = "select * from (values ('warm', 'B0-B2'), ('main', 'B1-B4'), ('anneal', 'B4-B5')) s(stage, bands)"
    return f"select s.stage, b.lane, cast(count(*) as bigint) as docs, cast(sum(b.n) as bigint) as tokens from ({stages}) s join ({_banded(e)}) b on b.band between substr(s.bands, 1, 2) and substr(s.bands, 4, 2) group by s.stage, b.lane"


def lane_affinity_order(e) -> str:
    """Order within a lane: the source that is native by band, hardest last; others by length; ids part ties."""
    return f"select doc_id, lane, cast(row_number() over (partition by lane order by case when lane = 'src1' then band else '' end, case when lane = 'src1' then 0 else n end, doc_id) as bigint) as place from ({_banded(e)}) b"


def packing_provenance(e) -> str:
    """Every piece of a packed window: its segment, where it lies, and that positions start anew."""
    return f"select lane, seq, doc_id, cast(row_number() over (partition by lane, seq order by seq_start) as bigint) as segment, tok_start, tok_end, seq_start, seq_start + tok_end - tok_start as seq_end, cast(0 as bigint) as first_position, tok_end - tok_start - 1 as last_position from ({pack_concat(e)}) p"


def stack_batches(e) -> str:
    """Windows stacked by eight: sequences, words and padding of each batch."""
    return f"select lane, batch, cast(count(*) as bigint) as sequences, cast(sum(used) as bigint) as tokens, cast(count(*) * {SEQ} - sum(used) as bigint) as padding from (select lane, cast(floor(seq / 8) as bigint) as batch, seq, sum(tok_end - tok_start) as used from ({pack_concat(e)}) p group by lane, seq) q group by lane, batch"


def _hashed_batches(e, tokens: str = "tokens") -> str:
    row = f"concat(cast(step as varchar(20)), ':', lane, ':', cast({tokens} as varchar(20)))"
    return f"select batch, cast(count(*) as bigint) as records, {e.sha(e.string(row, 'step', '|'))} as batch_hash from (select cast(floor(step / 100) as bigint) as batch, step, lane, tokens from ({_steps(e)}) s) t group by batch"


def batch_hashes(e) -> str:
    """A hash of each hundred steps with their provenance."""
    return _hashed_batches(e)


def replay_check(e) -> str:
    """A recorded ledger, one step of which was changed, against batches recomputed: which agree."""
    return f"select a.batch, a.records, a.batch_hash = b.batch_hash as same from ({_hashed_batches(e)}) a join ({_hashed_batches(e, 'case when step = 250 then tokens + 1 else tokens end')}) b on a.batch = b.batch"


def ledger_truncate(e) -> str:
    """A ledger rewound to a checkpoint at step 600: records kept and dropped by lane, and the next step."""
    return f"select lane, cast(count(case when step < 600 then 1 end) as bigint) as kept, cast(count(case when step >= 600 then 1 end) as bigint) as dropped, cast(max(case when step < 600 then step end) + 1 as bigint) as next_step from ({_steps(e)}) s group by lane"


def fork_ledger(e) -> str:
    """A branch: the parent's records below its fork, then its own."""
    return f"select branch, step, lane, tokens from (select 'main' as branch, step, lane, tokens from ({_steps(e)}) a where step < 500 union all select 'fork', step, lane, tokens + 1 from ({_steps(e)}) b where step >= 500) t"


def run_order(e) -> str:
    """Runs that the plan names in its order, then what is left over by name."""
    plan = "select * from (values ('purchase', 1), ('view', 2), ('missing', 3)) p(name, ord)"
    return f"select r.name, p.name is not null as planned, cast(row_number() over (order by coalesce(p.ord, 1000), r.name) as bigint) as place from (select distinct event_type as name from {{events}}) r left join ({plan}) p on p.name = r.name"


def generations(e) -> str:
    """The snapshot generation of each step, a new one every 250, with its first and last step."""
    return f"select cast(floor(step / 250) as bigint) as generation, cast(min(step) as bigint) as first_step, cast(max(step) as bigint) as last_step, cast(count(*) as bigint) as steps from ({_steps(e)}) s group by cast(floor(step / 250) as bigint)"


def _drawn(e, seed: int) -> str:
    key = f"concat('{seed}:', cast(doc_id as varchar(20)))"
    return f"select doc_id, source, {e.sha(key)} as draw, {e.size(e.words('text'))} as n from {{documents}}"


def seeded_prefix(e) -> str:
    """Each source's documents in an order that a seed gives, until a budget of 4,000 words is met, the crossing one included."""
    return f"select doc_id, source, n from ({running(_drawn(e, 11), ['source'], 'n', 'substr(draw, 1, 3)', 'draw')}) t where off < 4000"


def seeded_choice(e) -> str:
    """Five documents of each source, chosen without replacement by a seed."""
    return f"select doc_id, source, place from (select doc_id, source, cast(row_number() over (partition by source order by draw, doc_id) as bigint) as place from ({_drawn(e, 13)}) d) t where place <= 5"


def permutation_split(e) -> str:
    """Whole documents to validation by a seeded hash, a tenth of its range: no document is in both, no sort is needed."""
    part = f"{e.hex('substr(draw, 1, 8)')} % 10 = 0"
    return f"select source, cast(count(case when {part} then 1 end) as bigint) as validation, cast(count(case when not ({part}) then 1 end) as bigint) as train from ({_drawn(e, 17)}) d group by source"


def weighted_lane_draws(e) -> str:
    """Two hundred draws of a lane by planned share, each from its own counter."""
    bound, ladder = 0, ""
    for k, v in sorted(SHARES.items()):
        bound += v
        ladder += f" when u < {bound} then '{k}'"
    u = e.hex("substr(" + e.sha("concat('19:', cast(i as varchar(20)))") + ", 1, 12)")
    return f"select i, u, case{ladder} end as lane from (select i, {u} % 100 as u from (select {e.each(e.range('0', '199'))} as i) t) d"


def slot_draws(e) -> str:
    """Draws by seed, step, slot and attempt, each a whole number below 1,000."""
    key = "concat('7:', cast(step as varchar(20)), ':', cast(slot as varchar(20)), ':', cast(attempt as varchar(20)))"
    axes = f"select step, slot, {e.each(e.range('0', '3'))} as attempt from (select step, {e.each(e.range('0', '7'))} as slot from (select {e.each(e.range('0', '9'))} as step) a) b"
    return f"select step, slot, attempt, {e.hex(f'substr({e.sha(key)}, 1, 12)')} % 1000 as draw from ({axes}) c"


def lane_sets(e) -> str:
    """The set of languages of each source, in order, and how many sources have the same."""
    each = "select distinct source, lang from {documents}"
    return f"select source, langs, cast(count(*) over (partition by langs) as bigint) as alike from (select source, {e.string('lang', 'lang', ',')} as langs from ({each}) d group by source) t"


def ordered_catalogue(e) -> str:
    """Sources and splits in one total order: most words first, names part ties."""
    return f"select lane, split, tokens, cast(row_number() over (order by tokens desc, lane, split) as bigint) as place from (select lane, split, cast(sum(n) as bigint) as tokens from ({_docs(e)}) d group by lane, split) t"


def largest_effects(e) -> str:
    """The largest violation of each lane and its six largest interactions."""
    worst = f"select lane, 'violation' as kind, low_run as run_a, high_run as run_b, worse as size, cast(row_number() over (partition by lane order by worse desc, low_run, high_run) as bigint) as place from ({monotonicity_violations(e)}) v"
    pairs = f"select lane, 'interaction' as kind, run_a, run_b, gap as size, cast(row_number() over (partition by lane order by gap desc, run_a, run_b) as bigint) as place from ({interaction_pairs(e)}) i"
    return f"select * from ({worst}) w where place = 1 union all select * from ({pairs}) p where place <= 6"


def _shards(e, text: str = "text") -> str:
    """Shards of a hundred ids of a lane: bounded, so that the hashes of one fit in a string."""
    inner = e.string(e.sha(text), "doc_id", ",")
    return f"select lane, split, idx, cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as tokens, {e.sha(inner)} as content from (select doc_id, lane, split, n, text, cast(floor(doc_id / 100) as bigint) as idx from ({_docs(e)}) d) t group by lane, split, idx"


def shard_identity(e) -> str:
    """A shard's identity: the hash of its lane, split, number and contents."""
    return f"select lane, split, idx, docs, tokens, {e.sha(chr(39).join(['concat(lane, ', '|', ', split, ', '|', ', cast(idx as varchar(20)), ', '|', ', content)']))} as shard_id from ({_shards(e)}) s"


def shard_integrity(e) -> str:
    """Recorded shards, in which one text was other and a shard is missing, against recomputed ones: the problems."""
    recorded = f"select * from ({_shards(e, 'case when doc_id = 3 then lower(text) else text end')}) r where not (idx = 1 and lane = 'src2')"
    return f"select a.lane, a.split, a.idx, case when b.lane is null then 'not recorded' else 'changed' end as problem from ({_shards(e)}) a left join ({recorded}) b on b.lane = a.lane and b.split = a.split and b.idx = a.idx where b.lane is null or b.content <> a.content"


def counters(e) -> str:
    """Documents by source and by claimed language, and failures by rule, in one table."""
    by = lambda c: f"select '{c}' as kind, {c} as name, cast(count(*) as bigint) as n from {{documents}} group by {c}"
    return f"{by('source')} union all {by('lang')} union all select 'rule' as kind, rule as name, failures as n from ({rule_failures(e)}) r"


QUERIES = {f.__name__: f for f in (deficit_schedule, schedule_state, schedule_compliance, benchmark_readiness, band_range_docs, lane_affinity_order, packing_provenance, stack_batches, batch_hashes, replay_check, ledger_truncate, fork_ledger, run_order, generations, seeded_prefix, seeded_choice, permutation_split, weighted_lane_draws, slot_draws, lane_sets, ordered_catalogue, largest_effects, shard_identity, shard_integrity, counters)}
