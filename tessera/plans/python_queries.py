"""Queries that DataFrames state better than SQL text."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import minhash, text, tokens
from tessera.operators.greedy import keep_first
from tessera.operators.nearest import nearest_gaps
from tessera.shipping import ship
from tessera.sources import files

from .cleaning import _bands
from .dialect import Duck, Spark

# What is masked, in this order. (?U) makes \d, \w, \s and \b Unicode, as in Python; PHONE looks behind, which
#: DuckDB's patterns can't.
PII = [
    ("email", r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("phone", r"(?U)(?:\+91[\s-]?)?(?<!\d)\d{5}[\s-]?\d{5}(?!\d)"),
    ("ip", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("aadhaar", r"(?U)\b\d{4}\s\d{4}\s\d{4}\b"),
    ("name", r"(?U)\b(?:Shri|Sri|Smt|Dr|Mr|Mrs|Ms|Prof)\.?\s+[A-Z][a-z]+(?:\s[A-Z][a-z]+)?"),
]


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data masked as the reference does, later patterns seeing earlier masks: counts and the hash of the masked text."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for label, pattern in PII:
        out = out.select("doc_id", *[c for c in out.columns if c.startswith("n_")], F.regexp_count("text", F.lit(pattern)).cast("long").alias(f"n_{label}"), F.regexp_replace("text", pattern, f"[{label.upper()}]").alias("text"))
    return out.select("doc_id", *[f"n_{label}" for label, _ in PII], F.sha2("text", 256).alias("masked_hash"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unicode_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in Unicode's composed form: the hash, and whether that changed them."""
    ship(spark)
    t = text.nfc(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(t, 256).alias("nfc_hash"), (t != F.col("text")).alias("changed"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of cleaning: joiners and chat markers counted, then the cleaned text's hash and length; an empty one is to be dropped."""
    ship(spark)
    out = _documents(spark, sf_dir).select("doc_id", "text", text.cleaned(F.col("text")).alias("clean"))
    out = out.select("doc_id", "text", text.without_ghosts(F.col("text"), F.col("clean")).alias("clean"))
    marks = F.regexp_count("text", F.lit(r"[\x{200C}\x{200D}]")).cast("long").alias("joiners"), F.regexp_count("text", F.lit(text.GHOST)).cast("long").alias("markers")
    return out.select("doc_id", *marks, F.sha2("clean", 256).alias("content_hash"), F.length("clean").cast("long").alias("chars"), (F.length("clean") < 1).alias("dropped"))


def checksum_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of words that become one in windows whose last byte is a checksum of what is cut."""
    words = F.explode(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    types = _documents(spark, sf_dir).select(F.col("lang").alias("lane"), words.alias("w")).groupBy("lane", "w").agg(F.count(F.lit(1)).alias("n"))
    forms = [F.struct(F.lit(name).alias("scheme"), F.lit(k).alias("bytes"), f(F.col("w"), k).alias("k")) for k in (8, 16, 32) for name, f in (("overflow_hash", text.overflow_checksum), ("both_ends_hash", text.ends_checksum))]
    groups = types.select("lane", "n", F.explode(F.array(*forms)).alias("f")).groupBy("lane", "f.scheme", "f.bytes", "f.k").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).where("types > 1")
    return groups.groupBy("lane", "scheme", "bytes").agg(F.count(F.lit(1)).alias("colliding_groups"), F.sum("types").alias("colliding_types"), F.sum("n").alias("occurrences"))


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors along the two axes of greatest variance, the largest weight of an axis being positive; those that are null or not finite are left out."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    whole = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    points = whole.select("vec_id", array_to_vector("v").alias("p"))
    model = PCA(k=2, inputCol="p", outputCol="q").fit(points)
    axes = model.pc.toArray().T
    means = points.select(Summarizer.mean(F.col("p")).alias("m")).head()["m"].toArray()
    signs = [1.0 if max(a, key=abs) > 0 else -1.0 for a in axes.tolist()]
    shift = [float(a @ means) for a in axes]
    xy = vector_to_array("q")
    return model.transform(points).select("vec_id", *[F.round((xy[i] - shift[i]) * signs[i], 4).alias(n) for i, n in enumerate(("x", "y"))])


def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as JSON lines and read again."""
    path, docs = files.scratch(spark, "jsonl"), _documents(spark, sf_dir)
    files.append_json_lines(docs, path)
    return files.read_json_lines(spark, path, docs.schema).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_hash"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a tree of folders by source, those labelled toxic apart, and read again: source and flag come from the path alone."""
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = _documents(spark, sf_dir).join(toxic, "doc_id", "left")
    folder = F.concat(F.coalesce("source", F.lit("none")), F.when(F.col("toxic") == 1, "-toxic").otherwise(""))
    root = files.scratch(spark, "tree")
    docs.select("doc_id", "text", folder.alias("folder")).write.partitionBy("folder").parquet(root)
    rows = files.parquet_tree(spark, root).select("doc_id", "text", F.regexp_replace(files.source_of(F.col("file")), "^folder=", "").alias("folder"))
    flagged = rows.select("text", F.regexp_replace("folder", "-toxic$", "").alias("source"), F.col("folder").contains("toxic").alias("toxic_source"))
    return flagged.groupBy("source", "toxic_source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as lines of JSON in which their own properties are put unchecked: rows that are read, and lines that are no row, by kind."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    line = F.concat(F.lit('{"click_id": '), F.col("click_id").cast("string"), F.lit(', "kind": "'), F.coalesce("kind", F.lit("none")), F.lit('", "props": '), F.coalesce("props", F.lit("")), F.lit("}"))
    path = files.scratch(spark, "lines")
    clicks.select(line.alias("value")).where("value is not null").write.text(path)
    schema = "click_id long, kind string, props map<string, string>"
    read = files.read_json_lines(spark, path, schema).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
    bad = files.malformed_lines(spark, path, schema).select(F.regexp_extract("value", '"kind": "([^"]*)"', 1).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("broken"))
    both = read.join(bad, "kind", "full")
    return both.select("kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "broken")])


def lane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written by source; of two sources, what is read back."""
    path = files.scratch(spark, "lanes")
    files.write_lanes(_documents(spark, sf_dir).withColumn("lane", F.col("source")), path, "lane")
    rows = files.read_lane(spark, path, "doc_id long, text string", ["src0", "src3"])
    return rows.groupBy("lane").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("doc_id").alias("last_id"))


def capped_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of 30 characters or more by source, until 20,000 bytes are met."""
    return files.capped(_documents(spark, sf_dir), "source", "doc_id", "text", 20000, 30).select("lane", "key", "start", "size")


def uint16_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths as 16-bit numbers in bytes, read back."""
    sizes = F.transform(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), lambda w: F.length(w))
    out = _documents(spark, sf_dir).select("doc_id", F.explode(F.array(files.to_uint16(sizes))).alias("data"))
    numbers = files.from_uint16(F.col("data"))
    return out.select("doc_id", F.octet_length("data").cast("long").alias("bytes"), F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order of id: kept, an exact copy of a kept one, or near to a kept one, that is in a bucket of its signature.

    kept_by is the document that rules it out, a kept one itself. Only kept documents rule others out, so what is near to a dropped one alone stays. Texts without words have no
    signature and only meet exact copies. Ids are distinct and not null.
    """
    minhash.register(spark)
    bands = spark.sql(_bands(Spark()).replace("{documents}", "{docs}"), docs=_documents(spark, sf_dir))
    chosen = keep_first(bands.select(F.col("doc_id").alias("id"), F.md5("bucket").alias("key"))).withColumnRenamed("id", "doc_id")
    rows = _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash")).join(chosen, "doc_id", "left")
    first = rows.where("kept_by is null").groupBy("hash").agg(F.min("doc_id").alias("first"))
    out = rows.join(first, "hash", "left")
    copy = F.col("first") < F.col("doc_id")
    verdict = F.when(copy, "exact").when(F.col("kept_by").isNotNull(), "near").otherwise("kept")
    return out.select("doc_id", verdict.alias("verdict"), F.when(copy, F.col("first")).otherwise(F.coalesce("kept_by", "doc_id")).alias("kept_by"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE tokens of every document, the kinds of token it has, and whether decoding gives the text again, white space aside."""
    ship(spark)
    out = _documents(spark, sf_dir).select("doc_id", "text", tokens.encode(F.col("text")).alias("ids"))
    out = out.select("doc_id", "text", "ids", tokens.decode(F.col("ids")).alias("again"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return out.select("doc_id", F.size("ids").cast("long").alias("tokens"), F.size(F.array_distinct("ids")).cast("long").alias("token_types"), (bare("text") == bare("again")).alias("faithful"))


def bpe_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE tokens a word, a character and a byte by language, over all documents; no figure below 200 words."""
    ship(spark)
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).cast("long")
    rows = _documents(spark, sf_dir).select("lang", words.alias("w"), F.length("text").alias("c"), F.octet_length("text").alias("b"), F.size(tokens.encode(F.col("text"))).cast("long").alias("t"))
    sums = rows.groupBy("lang").agg(*[F.sum(x).cast("long").alias(x) for x in "wcbt"])
    return sums.select("lang", F.col("w").alias("words"), F.col("t").alias("tokens"), F.when(F.col("w") >= 200, F.round(F.col("t") / F.col("w"), 6)).alias("fertility"), F.round(F.col("c") / F.col("t"), 6).alias("chars_token"), F.round(F.col("b") / F.col("t"), 6).alias("bytes_token"))


def span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns encoded by themselves, so that no token straddles two roles: where each lies in its conversation, and which count for the loss."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.size(tokens.encode(F.col("text"))).cast("long").alias("n"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", (end - F.col("n")).alias("start"), end.alias("end"), (F.col("role") == "assistant").alias("loss"))


def vocabulary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids of the vocabulary are of each kind, and how long their surfaces are."""
    return tokens.vocabulary(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("ids"), F.max(F.length("surface")).cast("long").alias("longest"))


def nearest_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``windows.nearest_separation`` by products of blocks: the joined rows would be as many as queries times vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    out = nearest_gaps(rows, F.col("id") % 100 == 0)
    return out.select(F.col("id").alias("vec_id"), F.round(F.sqrt(F.greatest("gap", F.lit(0.0))), 4).alias("nearest"), F.col("equal").alias("equal_vectors"))


PYTHON_QUERIES: dict = {f.__name__: f for f in (nearest_separation, bpe_round_trip, bpe_fertility, span_tokens, vocabulary_kinds, pii_mask, greedy_dedup, unicode_nfc, clean_text, checksum_collisions, pca_2d, json_lines_round_trip, source_tree, broken_lines, lane_files, capped_lanes, uint16_round_trip)}

_SIZES = "list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: length(w))"
_GREEDY = f"""with recursive bands as materialized (select doc_id, list(md5_number_lower(bucket)) as b from ({_bands(Duck()).replace("{documents}", "documents")}) x group by doc_id),
    numbered as materialized (select row_number() over (order by d.doc_id) as i, d.doc_id, sha256(d.text) as hash, coalesce(b.b, []) as b from documents d left join bands b on b.doc_id = d.doc_id),
    walk as (select cast(0 as bigint) as i, cast([] as ubigint[]) as taken, cast(null as bigint) as doc_id, false as kept
        union all select n.i, case when list_has_any(w.taken, n.b) then w.taken else list_concat(w.taken, n.b) end, n.doc_id, not list_has_any(w.taken, n.b) from walk w join numbered n on n.i = w.i + 1),
    owners as (select n.doc_id, n.hash, unnest(n.b) as k from numbered n join walk w on w.doc_id = n.doc_id where w.kept),
    near as (select x.doc_id, min(o.doc_id) as kept_by from (select n.doc_id, unnest(n.b) as k from numbered n join walk w on w.doc_id = n.doc_id where not w.kept) x join owners o on o.k = x.k group by x.doc_id),
    firsts as (select n.hash, min(n.doc_id) as first from numbered n join walk w on w.doc_id = n.doc_id where w.kept group by n.hash)
    select n.doc_id, case when f.first < n.doc_id then 'exact' when r.doc_id is not null then 'near' else 'kept' end as verdict, case when f.first < n.doc_id then f.first else coalesce(r.kept_by, n.doc_id) end as kept_by
    from numbered n left join near r on r.doc_id = n.doc_id left join firsts f on f.hash = n.hash"""
PYTHON_SQL: dict[str, str] = {
    "greedy_dedup": _GREEDY,
    "unicode_nfc": "select doc_id, sha256(nfc_normalize(text)) as nfc_hash, nfc_normalize(text) <> text as changed from documents",
    "json_lines_round_trip": "select doc_id, lang, source, n_chars, sha256(text) as text_hash from documents",
    "source_tree": "select coalesce(d.source, 'none') as source, coalesce(l.toxic = 1, false) as toxic_source, count(*) as docs, cast(coalesce(sum(length(d.text)), 0) as bigint) as chars from documents d left join (select doc_id, max(toxic) as toxic from labels group by doc_id) l on l.doc_id = d.doc_id group by 1, 2",
    "broken_lines": "select coalesce(kind, 'none') as kind, count(case when json_valid(props) then 1 end) as rows, count(case when json_valid(props) then null else 1 end) as broken from clicks where click_id is not null group by 1",
    "lane_files": "select source as lane, count(*) as docs, cast(sum(length(text)) as bigint) as chars, max(doc_id) as last_id from documents where source in ('src0', 'src3') group by source",
    "capped_lanes": "select lane, key, start, size from (select *, cast(sum(size) over (partition by lane order by key, text) - size as bigint) as start from (select source as lane, min(doc_id) as key, trim(replace(text, chr(13), ''), ' ') as text, cast(strlen(trim(replace(any_value(text), chr(13), ''), ' ')) as bigint) as size from documents where length(trim(replace(text, chr(13), ''), ' ')) >= 30 group by 1, 3) t) u where start < 20000",
    "uint16_round_trip": f"select doc_id, cast(2 * len({_SIZES}) as bigint) as bytes, cast(coalesce(list_sum({_SIZES}), 0) as bigint) as total from documents",
}
