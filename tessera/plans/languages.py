"""Languages, scripts and tidy text."""

from __future__ import annotations

from .cleaning import SCRIPTS, _blocks, _scripts

# Languages of the scripts that have one.
LANGUAGES = {"Gurmukhi": "pa", "Gujarati": "gu", "Odia": "or", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Arabic": "ur"}
# Marathi words that Hindi lacks, its letter, and the letters of Assamese that Bengali lacks.
MARATHI = ["आहे", "आणि", "मला", "तू", "नाही", "होते", "त्या", "मध्ये", "काय", "यांनी", "आम्ही", "करणे", "आपण", "तसेच", "म्हणून", "होता"]
MARATHI_LETTER = "ळ"
ASSAMESE = ["ৰ", "ৱ"]

NAMES = [*dict.fromkeys(n for n, _, _ in SCRIPTS)]


def language_detect(e) -> str:
    """Language, script, confidence and shares: the commonest Indic or Arabic script decides, of equal ones the first in the text; cues part languages of one script."""
    cues = " + ".join(f"case when contains({e.of('text', 'indic')}, '{x}') then 1 else 0 end" for x in [*MARATHI, MARATHI_LETTER])
    assamese = " or ".join(f"contains({e.of('text', 'indic')}, '{x}')" for x in ASSAMESE)
    total, top = " + ".join(NAMES), f"greatest({', '.join(NAMES)})"
    # of tied scripts, how much text comes before the first letter; where all have none, no place is asked for
    tied = "tied > 1 and most > 0" if e.name == "spark" else "tied > 1"
    places = ", ".join(f"case when {n} = most and {tied} then length({e.extract('text', f'^([^{x}]*)')}) when {n} = most then 0 end as at_{n}" for n, x in _blocks().items())
    ladder = " ".join(f"when at_{n} = place then '{n}'" for n in NAMES)
    counted = _scripts(e, f", text, {cues} as cues, {assamese} as assamese")
    most = f"select *, {total} as indic, {top} as most, {' + '.join(f'case when {n} = {top} then 1 else 0 end' for n in NAMES)} as tied from ({counted}) s"
    placed = f"select doc_id, lang, Latin, indic, most, cues, assamese, {places} from ({most}) m"
    base = f"select doc_id, lang as claimed, Latin, indic, most, cues, assamese, case when indic = 0 then 'Latin' {ladder} end as script from (select *, least({', '.join(f'coalesce(at_{n}, 2147483647)' for n in NAMES)}) as place from ({placed}) p) q"
    mapped = " ".join(f"when script = '{k}' then '{v}'" for k, v in LANGUAGES.items())
    lang = f"case when Latin + indic = 0 then 'und' when indic = 0 then 'en' when script = 'Devanagari' then case when cues >= 2 then 'mr' else 'hi' end when script = 'Bengali' then case when assamese then 'as' else 'bn' end {mapped} else 'und' end"
    share = lambda x: f"round(case when Latin + indic = 0 then 0.0 else cast({x} as double) / (Latin + indic) end, 3)"
    sure = "round(case when indic > 0 then cast(most as double) / indic when Latin > 0 then 1.0 else 0.0 end, 3)"
    return f"select doc_id, {lang} as lang, case when Latin + indic = 0 then 'none' else script end as script, {sure} as confidence, {share('indic')} as indic_frac, {share('Latin')} as latin_frac, indic > 0 and Latin >= 0.15 * (Latin + indic) and indic >= 0.15 * (Latin + indic) as code_switched, {lang} <> claimed as mismatch, claimed <> 'en' and indic = 0 and Latin > 0 as romanized from ({base}) b"


def language_counts(e) -> str:
    """Documents by detected language, with those that are code-switched, of low confidence, mismatched or romanized."""
    flags = {"code_switched": "code_switched", "low_confidence": "confidence < 0.6", "mismatched": "mismatch", "romanized": "romanized"}
    return f"select lang, cast(count(*) as bigint) as docs, {', '.join(f'cast(count(case when {v} then 1 end) as bigint) as {k}' for k, v in flags.items())} from ({language_detect(e)}) x group by lang"


def script_purity_gate(e) -> str:
    """Share of Indic letters among the letters of the first 2,000 characters, and whether it is 0.35 or more; the feature reads that head only."""
    head = "substr(text, 1, 2000)"
    indic = "".join(f"{chr(a)}-{chr(b)}" for n, a, b in SCRIPTS if n != "Arabic")
    return f"select doc_id, round(share, 6) as share, share >= 0.35 as admitted from (select doc_id, case when letters = 0 then 0.0 else cast(hits as double) / letters end as share from (select doc_id, {e.count(head, r'\p{L}')} as letters, {e.count(e.replace(head, r'[^\p{L}]', ''), f'[{indic}]')} as hits from {{documents}}) t) u"


def majority_script(e) -> str:
    """The script of most letters, its share and how many letters there are; of equal counts the larger name, of none COMMON."""
    counts = {n.upper(): n for n in [*NAMES, "Latin"]}
    order = sorted(counts, reverse=True)
    top = f"greatest({', '.join(counts.values())})"
    total = " + ".join(counts.values())
    ladder = " ".join(f"when {counts[n]} = {top} then '{n}'" for n in order)
    return f"select doc_id, case when {total} = 0 then 'COMMON' {ladder} end as script, round(case when {total} = 0 then 1.0 else cast({top} as double) / ({total}) end, 6) as purity, {total} as letters from ({_scripts(e)}) s"


def tidy_text(e) -> str:
    """No-break blanks become blanks, line ends lose theirs, at most two blank lines stay, one newline ends the text."""
    x = e.replace("replace(text, chr(160), ' ')", r"[ \t\r\f\x0B]+(\n|$)", e.group(1))
    x = e.replace(x, r"\n{4,}", "\n\n\n")
    x = e.replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return f"select doc_id, {e.sha('t')} as tidy_hash, cast(length(t) as bigint) as chars, t <> text as changed from (select doc_id, text, concat({x}, chr(10)) as t from {{documents}}) y"


def html_markdown(e) -> str:
    """Pages as Markdown: links, pictures, emphasis and headings kept, scripts and styles gone, nothing wrapped."""
    x = "html"
    for tag in ("script", "style", "noscript"):
        x = e.replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    x = e.replace(x, r"(?is)<!--.*?-->|<(meta|link)[^>]*>", "")
    x = e.replace(x, r'(?is)<img[^>]*src="([^"]*)"[^>]*>', f"![]({e.group(1)})")
    x = e.replace(x, r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', f"[{e.group(2)}]({e.group(1)})")
    x = e.replace(x, r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", f"**{e.group(1)}**")
    x = e.replace(x, r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", f"_{e.group(1)}_")
    for i in range(1, 4):
        x = e.replace(x, rf"(?is)<h{i}[^>]*>(.*?)</h{i}>", f" {'#' * i} {e.group(1)} ")
    x = e.replace(x, r"<[^>]*>", " ")
    x = e.replace(x, r"[ \t]+", " ")
    return f"select page_id, cast(length(body) as bigint) as chars, {e.sha('body')} as body_hash from (select page_id, trim({x}) as body from {{pages}}) t"


QUERIES = {f.__name__: f for f in (language_detect, language_counts, script_purity_gate, majority_script, tidy_text, html_markdown)}
