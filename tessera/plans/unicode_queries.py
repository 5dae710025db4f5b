"""Script runs, written clusters and articles from lines: one text for two engines, but for cutting into rows."""

from __future__ import annotations

from tessera.functions.scripts import JOINER, classes, runs_pattern

from .dialect import Duck, Spark
from .shards import running


def _types(e) -> str:
    return f"select w, cast(count(*) as bigint) as n from (select {e.each(e.words('text'))} as w from {{documents}}) t group by w"


def _clusters(e, x: str) -> str:
    """Written clusters of ``x``: characters that are no mark or joiner and follow none that joins; at least one where there is text."""
    bases = e.count(x, rf"[^\p{{M}}{JOINER}]")
    joined = e.count(x, rf"[{classes()['JOINS']}][^\p{{M}}{JOINER}]")  # a base is no joiner, so matches don't overlap
    return f"greatest({bases} - {joined}, case when {x} = '' then 0 else 1 end)"


def _runs(e, x: str) -> str:
    return f"regexp_extract_all({x}, r'{runs_pattern()}', 0)" if e.name == "spark" else f"regexp_extract_all({x}, '{runs_pattern()}')"


def _script(e, x: str) -> str:
    ladder = " ".join(f"when {e.like(x, f'^[{v}]')} then '{k}'" for k, v in sorted(classes().items()) if k != "JOINS")
    return f"case {ladder} else 'OTHER' end"


def script_runs(e) -> str:
    """Maximal runs of one script within words: by script how many there are, of how many types, and their characters, bytes and written clusters."""
    runs = f"select r, cast(sum(n) as bigint) as n from (select n, {e.each(_runs(e, 'w'))} as r from ({_types(e)}) w) x group by r"
    named = f"select {_script(e, 'r')} as script, n, cast(length(r) as bigint) as chars, {e.bytes('r')} as bytes, {_clusters(e, 'r')} as clusters from ({runs}) y"
    return f"select script, cast(count(*) as bigint) as types, cast(sum(n) as bigint) as runs, {', '.join(f'cast(sum(n * {c}) as bigint) as {c}' for c in ('chars', 'bytes', 'clusters'))} from ({named}) z group by script"


def cluster_counts(e) -> str:
    """Every document's characters and written clusters: marks, joiners and what follows a virama belong to the cluster before."""
    return f"select doc_id, cast(length(text) as bigint) as chars, cast({_clusters(e, 'text')} as bigint) as clusters from {{documents}} where text is not null"


QUERIES = {f.__name__: f for f in (script_runs, cluster_counts)}

#: A line of one word starts an article.
HEADING = r"^[^\s]+$"


def _articles(e, lines: str) -> str:
    """Articles of over 400 characters from ``lines`` (lane, doc_id, i, line, one: 1 for a heading)."""
    at = running(lines, ["lane"], "one", order="doc_id, r.i")
    parts = f"select lane, off + one as article, doc_id, i, line from ({at}) a"
    # a heading's number counts itself, so its article begins with it
    return f"select lane, article, cast(min(doc_id) as bigint) as first_doc, cast(count(*) as bigint) as lines, cast(length({e.string('line', 'doc_id, i', chr(10))}) as bigint) as chars, {e.sha(e.string('line', 'doc_id, i', chr(10)))} as text_hash from ({parts}) p group by lane, article having length({e.string('line', 'doc_id, i', chr(10))}) > 400"


def articles(spark, sf_dir: str):
    """Lines of the documents of a source, in order of id, put together to articles that a line of one word begins; articles run on over documents.

    Kept are those of over 400 characters, whole. What comes before a source's first heading is article 0. Headings are
    counted by blocks of ids, so no task sees a whole source.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = spark.sql(r"select source as lane, doc_id, cast(i as bigint) as i, line, case when rlike(line, r'^[^\s]+$') then 1 else 0 end as one from (select source, doc_id, posexplode(split(text, '\\n')) as (i, line) from {docs}) x where trim(line) <> ''", docs=docs)
    return spark.sql(_articles(Spark(), "select * from {lines}"), lines=lines)


_LINES = r"select lane, doc_id, i, line, case when regexp_matches(line, '^[^\s]+$') then 1 else 0 end as one from (select source as lane, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents) x where trim(line) <> ''"
ARTICLES = {"articles": articles}
ARTICLES_SQL = {"articles": _articles(Duck(), _LINES)}
