"""Shaping sources: licences, long texts in chunks, questions and chats as spans, an index of frozen sources."""

from __future__ import annotations

# Licences that let a text be used freely.
PERMISSIVE = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0"]

#: What a licence line says, and the licence's name.
NAMES = {r"apache license,? version 2": "apache-2.0", r"mit license": "mit", r"bsd 2-clause": "bsd-2-clause", r"bsd 3-clause": "bsd-3-clause", r"isc license": "isc", r"general public license": "gpl", r"cc by-nc": "cc-by-nc", r"cc0": "cc0-1.0", r"unlicense": "unlicense"}


def licensed_documents(e) -> str:
    """Every document's licence, by its first line that names one, and whether it is taken: a permissive licence, 200 characters or more, and not said to be generated."""
    line = f"select doc_id, text, {e.once(e.first_line('lower(text)', 'licen[cs]e'))} as line from {{documents}}"
    ladder = " ".join(f"when {e.like('line', k)} then '{v}'" for k, v in NAMES.items())
    named = f"select doc_id, text, {e.once(f"case {ladder} when line <> '' then 'other' end")} as licence from ({line}) l"
    free = ", ".join(f"'{x}'" for x in PERMISSIVE)
    verdict = f"case when licence is null then 'no licence' when licence not in ({free}) then 'not permissive' when {e.like('lower(text)', 'auto-?generated|do not edit')} then 'generated' when length(text) < 200 then 'short' else 'taken' end"
    return f"select doc_id, licence, {verdict} as verdict from ({named}) n"


CHUNK, LEAST = 60000, 10000


def long_chunks(e) -> str:
    """Long texts in chunks of 60,000 characters, those of more than 10,000."""
    each = f"select doc_id, text, {e.each(e.range('0', f'cast(floor((length(text) - 1) / {CHUNK}) as bigint)'))} as chunk from {{documents}} where length(text) > {LEAST}"
    cut = f"select doc_id, chunk, substr(text, cast(chunk * {CHUNK} + 1 as int), {CHUNK}) as body from ({each}) x"
    return f"select doc_id, chunk, cast(length(body) as bigint) as chars, {e.sha('body')} as chunk_hash from ({cut}) c where length(body) > {LEAST}"


def answer_spans(e) -> str:
    """Each assistant's answer to a user's turn as two spans: the question, which isn't learned, and the answer, which is."""
    pairs = "select * from (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as asked_by, lag(text) over (partition by conv_id order by turn) as question from {conversations}) p where role = 'assistant' and asked_by = 'user' and trim(question) <> '' and trim(text) <> ''"
    spans = f"select conv_id, turn, concat('Question: ', trim(question), chr(10), 'Answer:') as prompt, concat(' ', trim(text)) as answer from ({pairs}) q"
    both = " union all ".join(f"select conv_id, turn, '{k}' as role, {start} as start_char, cast({end} as bigint) as end_char, {loss} as loss, {e.sha(k)} as span_hash from ({spans}) s" for k, start, end, loss in (("prompt", "cast(0 as bigint)", "length(prompt)", 0), ("answer", "cast(length(prompt) as bigint)", "length(prompt) + length(answer)", 1)))
    return both


# What opens a part of a chat, and whose it is.
MARKS = {"USER:": "user", "ASSISTANT:": "assistant", "FUNCTION RESPONSE:": "tool"}


def _chats(e) -> str:
    """Conversations as one string each: a mark before every turn but the system's."""
    turn = f"concat(case role when 'assistant' then 'ASSISTANT: ' when 'user' then 'USER: ' when 'tool' then 'FUNCTION RESPONSE: ' else '' end, text, chr(10), '<|endoftext|>')"
    return f"select conv_id, {e.string(turn, 'turn', ' ')} as chat from {{conversations}} where text is not null group by conv_id"


def chat_spans(e) -> str:
    """Chats cut at their marks into spans of a role, empty ones dropped; only the assistant's are learned, and a chat without any goes."""
    mark = "|".join(MARKS)
    parted = e.replace("chat", f"({mark})", f"{chr(1)}{e.group(1)}")
    split = f"split({parted}, '{chr(1)}')" if e.name == "spark" else f"string_split({parted}, '{chr(1)}')"
    numbered = f"select conv_id, parts, {e.each(e.range('2', e.size('parts')))} as i from (select conv_id, {split} as parts from ({_chats(e)}) c) p"  # what stands before the first mark is no span
    part = "element_at(parts, cast(i as int))" if e.name == "spark" else "parts[i]"
    bare = e.replace(e.replace(part, f"^({mark})", ""), r"<\|endoftext\|>", "")
    body = e.replace(bare, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    ladder = " ".join(f"when {e.like(part, f'^{k}')} then '{v}'" for k, v in MARKS.items())
    spans = f"select conv_id, i, case {ladder} end as role, {body} as body from ({numbered}) n"
    kept = f"select conv_id, role, body, row_number() over (partition by conv_id order by i) as span, max(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id) as learned from ({spans}) s where body <> ''"
    return f"select conv_id, cast(span as bigint) as span, role, case when role = 'assistant' then 1 else 0 end as loss, cast(length(body) as bigint) as chars, {e.sha('body')} as span_hash from ({kept}) k where learned = 1"


def hashed_contents(e, rows: str, keys: str, sums: str) -> str:
    """``sums`` of ``rows`` (keys, doc_id, text) by ``keys`` and content_hash: a hash of the texts' hashes in order of id, by blocks of a thousand ids, then of the blocks."""
    block = "coalesce(cast(floor(doc_id / 1000) as bigint), cast(-1 as bigint))"
    blocks = f"select {keys}, {block} as block, {e.sha(e.string('h', 'doc_id, h', ','))} as part, {', '.join(f'{v} as {k}' for k, v in _partial(sums).items())} from (select *, {e.sha('coalesce(text, ' + chr(39) * 2 + ')')} as h from ({rows}) r) x group by {keys}, {block}"
    return f"select {keys}, {', '.join(f'cast(sum({k}) as bigint) as {k}' for k in _partial(sums))}, {e.sha(e.string('part', 'block', ','))} as content_hash from ({blocks}) b group by {keys}"


def _partial(sums: str) -> dict[str, str]:
    return {x.rsplit(" as ", 1)[1]: x.rsplit(" as ", 1)[0] for x in sums.split("; ")}


def frozen_index(e) -> str:
    """Each source's documents, characters, bytes and content hash: what a frozen copy is checked against."""
    return hashed_contents(e, "select source, doc_id, text from {documents}", "source", f"count(*) as docs; sum(length(text)) as chars; sum({e.bytes('text')}) as bytes")


def cleaning_examples(e) -> str:
    """The first five pages that normalisation changes, before and after, 300 characters of each: a report."""
    from .cleaning import normalized

    return f"select page_id, substr(html, 1, 300) as before_text, substr(clean, 1, 300) as after_text from (select page_id, html, {normalized(e, 'html')} as clean from {{pages}}) t where clean <> html order by page_id limit 5"


def low_digit_keys(e) -> str:
    """Types of words that become one when each of the first 16 characters keeps its low byte alone, with the first character's block as a tag and without."""
    types = f"select lang as lane, w, count(*) as n from (select lang, {e.each(e.words('text'))} as w from {{documents}}) t group by lang, w"
    codes = e.map(e.chars("substr(w, 1, 16)"), "c", f"cast({e.code('c')} % 256 as varchar(20))")
    joined = f"array_join({codes}, '.')" if e.name == "spark" else f"array_to_string({codes}, '.')"
    keyed = f"select lane, n, {joined} as k, cast(floor({e.code('substr(w, 1, 1)')} / 256) as bigint) as block from ({types}) y"
    groups = f"select lane, k, block, count(*) as types, sum(n) as n from ({keyed}) z group by lane, k, block"
    tagged = "select lane, 'tagged' as form, count(*) as colliding_groups, sum(types) as colliding_types, sum(n) as occurrences from (" + groups + ") g where types > 1 group by lane"
    untagged = "select lane, 'untagged' as form, count(*) as colliding_groups, sum(types) as colliding_types, sum(n) as occurrences from (select lane, k, sum(types) as types, sum(n) as n from (" + groups + ") g group by lane, k) h where types > 1 group by lane"
    return f"select lane, form, cast(colliding_groups as bigint) as colliding_groups, cast(colliding_types as bigint) as colliding_types, cast(occurrences as bigint) as occurrences from ({tagged} union all {untagged}) u"


QUERIES = {f.__name__: f for f in (licensed_documents, long_chunks, answer_spans, chat_spans, frozen_index, cleaning_examples, low_digit_keys)}
