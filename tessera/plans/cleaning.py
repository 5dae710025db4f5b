"""Cleaning: text statistics, normalisation, language, quality, duplicates, personal data, contamination, manifests."""

from __future__ import annotations

from tessera.functions.text import NOISE

from .dialect import Spark

# The script blocks counted by the language detector (name, first and last code point), and its languages.
SCRIPTS = [
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Odia", 0x0B00, 0x0B7F),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F),
]
# English stop-words of the quality rules.
STOP_WORDS = ["the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "as"]
# The symbols counted by the quality rules.
SYMBOLS = "[#•·►▪●…]"


def text_stats(e) -> str:
    visible = e.replace("text", r"[ \t\n\r\f\v]+", "")
    units = e.count("text", UNITS)
    return f"select doc_id, cast(length(text) as bigint) as chars, cast(length({visible}) as bigint) as visible_chars, {e.bytes('text')} as utf8_bytes, {units} as units, {e.size(e.words('text'))} as words from {{documents}}"


#: Unicode's blanks without the newline, which is apart.
BLANK = r"\t\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def normalized(e, x: str = "text") -> str:
    """Tags of up to 40 characters and runs of blanks become a blank, noise goes, two newlines at most stay together; forms and entities are left to clean_text."""
    x = e.replace(x, r"<[^>]{1,40}>", " ")
    x = e.replace(x, NOISE, "")
    x = e.replace(x, f"[{BLANK}]+", " ")
    x = e.replace(x, r"\n{3,}", r"\n\n") if e.name == "spark" else f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return e.replace(x, rf"\A[\n{BLANK}]+|[\n{BLANK}]+\z", "")


def normalize_text(e) -> str:
    x = normalized(e)
    return f"select doc_id, {e.sha(x)} as content_hash, cast(length({x}) as bigint) as chars, ({x}) <> text as changed from {{documents}}"


def _metrics(e) -> str:
    w, lines = e.words("text"), e.raw_lines("text")
    stops = ", ".join(f"'{s}'" for s in STOP_WORDS)
    return f"""select doc_id, source, lang, text, {e.size('w')} as n_words, {e.count('text', f'[{"".join(_blocks().values())}]')} as other_script,
        case when {e.size('w')} > 0 then cast({e.total(e.map('w', 'v', 'cast(length(v) as bigint)'))} as double) / {e.size('w')} else 0.0 end as mean_word,
        case when {e.size('w')} > 0 then cast({e.count('text', SYMBOLS)} as double) / {e.size('w')} else 0.0 end as symbol_ratio,
        case when {e.size('l')} > 0 then 1.0 - cast({e.size(e.distinct('l'))} as double) / {e.size('l')} else 0.0 end as dup_lines,
        case when {e.size('l')} > 0 then cast({e.size(e.where('l', 'v', "substr(ltrim(v), 1, 1) in ('-', '*')"))} as double) / {e.size('l')} else 0.0 end as bullet_lines,
        {e.size(e.where(e.head('w', 200), 'v', f'lower(v) in ({stops})'))} as stops
        from (select *, {e.once(lines)} as l from (select *, {e.once(w)} as w from {{documents}}) s) t"""


NEUTRAL = "n_words >= 8 and symbol_ratio < 0.10 and dup_lines < 0.30 and bullet_lines < 0.90"
ENGLISH = "mean_word between 3 and 10 and stops >= 2"


def quality_metrics(e) -> str:
    return f"select doc_id, n_words, round(mean_word, 6) as mean_word, round(symbol_ratio, 6) as symbol_ratio, round(dup_lines, 6) as dup_lines, round(bullet_lines, 6) as bullet_lines, stops from ({_metrics(e)}) m"


#: What is judged by the English rules too: texts whose detected language is English, or none. A letter of another script makes it another.
DETECTED_ENGLISH = "other_script = 0"


def quality_filter(e) -> str:
    return f"select doc_id, {NEUTRAL} and (not {DETECTED_ENGLISH} or ({ENGLISH})) as kept, ({NEUTRAL}) and not {DETECTED_ENGLISH} and not ({ENGLISH}) as saved_by_language from ({_metrics(e)}) m"


def rule_failures(e) -> str:
    rules = {"word_count": "n_words >= 8", "mean_word": f"not {DETECTED_ENGLISH} or mean_word between 3 and 10", "symbols": "symbol_ratio < 0.10", "dup_lines": "dup_lines < 0.30", "bullets": "bullet_lines < 0.90", "stop_words": f"not {DETECTED_ENGLISH} or stops >= 2"}
    return " union all ".join(f"select '{k}' as rule, cast(count(*) as bigint) as failures from ({_metrics(e)}) m where not ({v})" for k, v in rules.items())


def _blocks() -> dict[str, str]:
    """The inside of a character class for each script."""
    blocks: dict[str, str] = {}
    for n, a, b in SCRIPTS:
        blocks[n] = blocks.get(n, "") + f"{chr(a)}-{chr(b)}"
    return blocks


def _scripts(e, more: str = "") -> str:
    """Letters of each script in every document, with ``more`` columns from the same scan. In Spark ``indic`` has the runs of those blocks, a blank between two, so that text of other scripts is read twice alone."""
    counts = ", ".join(f"{e.letters(e.of('text', 'indic'), x)} as {n}" for n, x in _blocks().items())
    rows = "{documents}" if e.name == "duckdb" else f"(select *, {e.once(e.replace('text', f'[^{chr(min(a for _, a, _ in SCRIPTS))}-{chr(max(b for _, _, b in SCRIPTS))}]+', ' '))} as indic from {{documents}}) r"
    return f"select doc_id, lang, {counts}, {e.letters('text', 'A-Za-z')} as Latin{more} from {rows}"


def _detected(e) -> str:
    names = [*_blocks(), "Latin"]
    top = f"greatest({', '.join(names)})"
    total = " + ".join(names)
    first = " ".join(f"when {n} = {top} then '{n}'" for n in names)
    indic = " + ".join(names[:-1])
    return f"select doc_id, lang, case when {total} = 0 then 'und' {first} end as script, round(case when {total} = 0 then 0.0 else cast({top} as double) / ({total}) end, 6) as confidence, {total} > 0 and ({indic}) >= 0.15 * ({total}) and Latin >= 0.15 * ({total}) as code_switched from ({_scripts(e)}) s"


def script_detect(e) -> str:
    return f"select doc_id, script, confidence, code_switched from ({_detected(e)}) d"


def claimed_vs_detected(e) -> str:
    return f"select lang as claimed, script as detected, cast(count(*) as bigint) as docs, cast(count(case when (script = 'Latin' and lang <> 'en') or script = 'und' then 1 end) as bigint) as mismatches, cast(count(case when code_switched then 1 end) as bigint) as code_switched, cast(count(case when confidence < 0.6 then 1 end) as bigint) as low_confidence from ({_detected(e)}) d group by lang, script"


def exact_dedup(e) -> str:
    """The first document of each text, and how many have it; counts and least ids are combined before rows of a text meet."""
    return f"select min(doc_id) as doc_id, {e.sha('text')} as content_hash, cast(count(*) as bigint) as copies from {{documents}} group by {e.sha('text')}"


def _shingles(e, k: int) -> str:
    w = "w"
    return f"select doc_id, case when {e.size(w)} = 0 then {e.grams(w, k)} when {e.size(w)} < {k} then {e.map(e.head(w, 1), 'x', 'text')} else {e.distinct(e.grams(w, k))} end as sh from (select doc_id, text, {e.once(e.words('text'))} as w from {{documents}}) t"


def _signature(e, n: int) -> str:
    """Least hashes per document; each shingle is hashed once, and the minima are combined before the shuffle.

    Spark has them by text from ``functions/minhash.py``: no row is made of a shingle.
    """
    if e.name == "spark":
        mins = ", ".join(f"min(h[{k}]) as m{k}" for k in range(n))
        return f"select doc_id, {mins} from (select doc_id, {e.once('least_hashes(text)')} as h from {{documents}}) t where h is not null group by doc_id"
    mins = ", ".join(f"min((({k * 7919 + 1}) * v + {k * 104729}) % 2147483647) as m{k}" for k in range(n))
    hashed = e.hex(f"substr({e.sha('s')}, 1, 7)")
    return f"select doc_id, {mins} from (select doc_id, {hashed} as v from (select doc_id, {e.each('sh')} as s from ({_shingles(e, 5)}) x) y) z group by doc_id"


def minhash_signatures(e) -> str:
    return _signature(e, 64)


def _buckets(e) -> str:
    ids = ", ".join(f"concat('{b}:', concat_ws(',', {', '.join(f'm{8 * b + i}' for i in range(8))}))" for b in range(8))
    return e.each(e.list(ids))


def _bands(e) -> str:
    """Eight bands of eight least hashes, spread from one row a document."""
    return f"select doc_id, {_buckets(e)} as bucket from ({_signature(e, 64)}) g"


def lsh_buckets(e) -> str:
    """Who is in each bucket of two documents or more: two are candidates for each other where they share one."""
    return f"select md5(bucket) as bucket, doc_id from (select bucket, doc_id, count(*) over (partition by bucket) as members from ({_bands(e)}) c) t where members > 1"


_FIRST = f"min(doc_id) over (partition by {', '.join(f'm{k}' for k in range(64))})"


def signature_classes(e) -> str:
    """Documents of one signature, and the first of them, which stands for all in pairs: copies always share every bucket."""
    return f"select doc_id, {_FIRST} as first_id from ({_signature(e, 64)}) g"


def jaccard_of_candidates(e) -> str:
    """All pairs of unlike signatures that share a bucket, by the first documents of each: shared shingles, similarity, and whether it is 0.7 or more.

    With ``signature_classes`` these are all candidate pairs, and copies don't multiply them.
    """
    if e.name == "spark":  # one signature for all, and texts of the pairs' documents alone are cut into shingles, in the tasks
        firsts = f"select doc_id, {_buckets(e)} as bucket from (select *, {_FIRST} as first_id from ({_signature(e, 64)}) g) s where first_id = doc_id"
        pairs = f"select distinct x.doc_id as first_id, y.doc_id as second_id from ({firsts}) x join ({firsts}) y on x.bucket = y.bucket and x.doc_id < y.doc_id"
        rows = "select d.doc_id, d.text from {documents} d left semi join (select explode(array(first_id, second_id)) as doc_id from pairs) i on i.doc_id = d.doc_id"
        common = f"select p.first_id, p.second_id, {e.once('shared_shingles(a.text, b.text)')} as shared from pairs p join met a on a.doc_id = p.first_id join met b on b.doc_id = p.second_id"
        return f"with pairs as ({pairs}), met as ({rows}) select first_id, second_id, shared.common as common, round(cast(shared.common as double) / (shared.both_sizes - shared.common), 6) as jaccard, 10 * shared.common >= 7 * (shared.both_sizes - shared.common) as near from ({common}) c"
    firsts = f"select b.bucket, b.doc_id from ({_bands(e)}) b join ({signature_classes(e)}) s on s.doc_id = b.doc_id and s.first_id = b.doc_id"
    pairs = f"select distinct x.doc_id as first_id, y.doc_id as second_id from ({firsts}) x join ({firsts}) y on x.bucket = y.bucket and x.doc_id < y.doc_id"
    common = f"select p.first_id, p.second_id, {e.overlap('a.sh', 'b.sh')} as common, {e.size('a.sh')} + {e.size('b.sh')} as both_sizes from ({pairs}) p join ({_shingles(e, 5)}) a on a.doc_id = p.first_id join ({_shingles(e, 5)}) b on b.doc_id = p.second_id"
    return f"select first_id, second_id, common, round(cast(common as double) / (both_sizes - common), 6) as jaccard, 10 * common >= 7 * (both_sizes - common) as near from ({common}) c"


def _grams8(e, rows: str, key: str) -> str:
    return f"select {key}, {e.each(e.distinct(e.grams('w', 8)))} as gram from (select {key}, {e.once(e.words('lower(text)'))} as w from {rows}) t where {e.size('w')} >= 8"


def _hashes8(rows: str, key: str) -> str:
    """Spark's 64-bit hashes of all word 8-grams."""
    return f"select {key}, explode(transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8)))) as h from (select {key}, {Spark().once(Spark().words('lower(text)'))} as w from {rows}) t where size(w) >= 8"


def decontaminate_8gram(e) -> str:
    """Documents that share a word 8-gram with the benchmark, and how many.

    In Spark hashes of the grams are compared first, so that only documents with a common hash are cut into strings; the
    strings decide.
    """
    rows = "{documents}"
    if e.name == "spark":
        met = f"select distinct doc_id from ({_hashes8('{documents}', 'doc_id')}) g where h in (select h from ({_hashes8('{benchmark}', 'item_id')}) b)"
        rows = f"(select d.* from {{documents}} d left semi join ({met}) c on c.doc_id <=> d.doc_id)"
    return f"select g.doc_id, cast(count(*) as bigint) as shared_grams from ({_grams8(e, rows, 'doc_id')}) g where g.gram in (select gram from ({_grams8(e, '{benchmark}', 'item_id')}) b) group by g.doc_id"


def survivors(e) -> str:
    return f"select d.doc_id, d.source from {{documents}} d left join ({decontaminate_8gram(e)}) c on d.doc_id = c.doc_id where c.doc_id is null"


# Words that drop a text of a toxic source.
TOXIC_MARKERS = ["kill", "hate", "stupid", "idiot", "bastard", "rape", "terrorist", "slur"]


def _toxic_labels() -> str:
    """One row a document, however often it is labelled."""
    return "select doc_id, max(toxic) as toxic from {labels} where doc_id is not null group by doc_id"


def _marked(e) -> str:
    return f"{e.overlap(e.words('lower(text)'), e.list(', '.join(repr(m) for m in TOXIC_MARKERS)))} > 0"


def safety_drop(e) -> str:
    """Documents that share a gram with the benchmark go, and labelled ones that hold a marker as a whole word."""
    return f"select d.doc_id, case when c.doc_id is not null then 'contaminated' when l.toxic = 1 and d.marked then 'toxic' else 'kept' end as verdict from (select doc_id, {_marked(e)} as marked from {{documents}}) d left join ({decontaminate_8gram(e)}) c on d.doc_id = c.doc_id left join ({_toxic_labels()}) l on d.doc_id = l.doc_id"


def cleaning_funnel(e) -> str:
    """Documents of each source left after the quality rules, without copies, and after the safety drop: one scan for the rules, the hash and the markers."""
    judged = f"select doc_id, source, {NEUTRAL} and (not {DETECTED_ENGLISH} or ({ENGLISH})) as good, {e.sha('text')} as h, {_marked(e)} as marked from ({_metrics(e)}) m"
    first = "doc_id = min(doc_id) over (partition by h)"
    flagged = f"select doc_id, source, good, marked, {first} as fresh from ({judged}) j"
    out = f"select f.source, f.good, f.good and f.fresh as fresh, f.good and f.fresh and c.doc_id is null and not (coalesce(l.toxic, 0) = 1 and f.marked) as safe from ({flagged}) f left join ({decontaminate_8gram(e)}) c on c.doc_id = f.doc_id left join ({_toxic_labels()}) l on l.doc_id = f.doc_id"
    count = lambda c: f"cast(count(case when {c} then 1 end) as bigint)"
    return f"select source, cast(count(*) as bigint) as docs_in, {count('good')} as after_quality, {count('fresh')} as after_dedup, {count('safe')} as docs_out, round(cast(100 as double) * count(case when safe then 1 end) / count(*), 4) as survival from ({out}) o group by source"


def source_manifest(e) -> str:
    """Each source's documents, words, languages, and a hash of its contents by blocks of ids; one without a name or without text is blocked."""
    from .shaping import hashed_contents

    hashed = hashed_contents(e, "select source, doc_id, text, lang from {documents}", "source", f"count(*) as docs; sum({e.size(e.words('text'))}) as tokens; sum(length(text)) as chars")
    langs = "select source, count(distinct lang) as langs from {documents} group by source"
    return f"select h.source, h.docs, h.tokens, cast(l.langs as bigint) as langs, h.content_hash, case when h.docs > 0 and h.chars > 0 and h.source <> '' then 'ADMITTED' else 'BLOCKED' end as gate from ({hashed}) h join ({langs}) l on l.source is not distinct from h.source"


UNITS = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"


def fertility(e) -> str:
    """Units a word of the first 600 documents of each language; the feature reads those only. No figure below 200 words."""
    first = "select * from (select lang, text, row_number() over (partition by lang order by doc_id) as rn from {documents}) t where rn <= 600"
    counted = f"select lang, {e.size(e.words('text'))} as words, {e.count('text', UNITS)} as units from ({first}) f"
    return f"select lang, case when sum(words) >= 200 then round(cast(sum(units) as double) / sum(words), 6) end as fertility, cast(sum(words) as bigint) as words from ({counted}) c group by lang"


def html_prune(e) -> str:
    x = "html"
    for tag in ("script", "style", "noscript"):
        x = e.replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    x = e.replace(x, r"(?is)<!--.*?-->|<(meta|link)[^>]*>", " ")
    x = e.replace(x, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    x = e.replace(x, r"[ \t\n\r]+", " ")
    return f"select page_id, {e.extract('url', '^https?://([^/]+)')} as host, cast(length(body) as bigint) as chars, {e.sha('body')} as body_hash from (select page_id, url, trim({x}) as body from {{pages}}) t"


def conversation_spans(e) -> str:
    return f"select conv_id, cast(count(*) as bigint) as spans, cast(sum(case when role = 'assistant' then {e.size(e.words('text'))} else 0 end) as bigint) as loss_words, cast(sum({e.size(e.words('text'))}) as bigint) as words, {e.sha(e.string('text', 'turn', '|'))} as record_hash from {{conversations}} group by conv_id having count(case when role = 'assistant' then 1 end) > 0"


QUERIES = {f.__name__: f for f in (text_stats, normalize_text, quality_metrics, quality_filter, rule_failures, script_detect, claimed_vs_detected, exact_dedup, minhash_signatures, lsh_buckets, signature_classes, jaccard_of_candidates, decontaminate_8gram, survivors, safety_drop, cleaning_funnel, source_manifest, fertility, html_prune, conversation_spans)}
