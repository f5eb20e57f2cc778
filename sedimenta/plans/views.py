"""The tables of the model, as views of the given test tables; each has its SQL as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import language_of, short_sha1
from sedimenta.operators.chunks import line_windows, with_chunk_ids
from sedimenta.operators.graph import html_links
from sedimenta.operators.inverted import Index, build_index
from sedimenta.sources.scratch import Scratch, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of long texts are dealt out where they come in fewer splits than there are cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document, of the project that its source names."""
    docs = read(spark, sf_dir, "documents")
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("error", F.lit("read-error"))
    ext = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "md", "fr", "py", "de", "ts", "es", "go")]), F.col("lang"))
    rel_path = F.concat("lang", F.lit("/doc_"), "doc_id", F.lit("."), ext)
    at = docs.join(toxic, "doc_id", "left").withColumn("rel_path", rel_path)
    return at.select(
        "doc_id", short_sha1(F.concat(F.col("source"), F.lit(":"), F.col("rel_path"))).alias("file_id"), F.col("source").alias("project_id"), "rel_path", language_of(F.col("rel_path")).alias("language"),
        F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha"), "error", F.col("n_chars").alias("indexed_at"), "text",
    )


FILES = r"""files AS (
    SELECT d.doc_id, substr(sha1(source || ':' || rel_path), 1, 16) AS file_id, source AS project_id, rel_path, CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'typescript' WHEN 'es' THEN 'go' END AS language,
           octet_length(encode(text))::BIGINT AS size, sha256(text) AS content_sha, CASE WHEN toxic = 1 THEN 'read-error' END AS error, n_chars AS indexed_at, text
    FROM (SELECT *, lang || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'ts' WHEN 'es' THEN 'go' END AS rel_path FROM documents) d
    LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l USING (doc_id))"""


def chunks(spark: SparkSession, sf_dir: str, size: int = 8, overlap: int = 2) -> DataFrame:
    """Windows of few lines, as the documents have few."""
    return with_chunk_ids(line_windows(files(spark, sf_dir), size, overlap)).drop("size", "content_sha", "error", "indexed_at")


_indexes: dict[tuple[str, str, bool], Index] = {}


def index(spark: SparkSession, sf_dir: str, stem: bool = False) -> Index:
    """The inverted index of the chunks, with language and project as their symbols: written once for a session, as a store would hold it."""
    named = (spark.sparkContext.applicationId, sf_dir, stem)
    if named not in _indexes:
        rows = chunks(spark, sf_dir).withColumn("symbols", F.array("language", "project_id"))
        path = Scratch(spark, "lexical").path("index")
        _indexes[named] = build_index(rows, path, symbols="symbols", keep=["doc_id", "project_id", "rel_path", "language"], stem=stem, buckets=16)
    return _indexes[named]


CHUNKS = (
    FILES
    + r""", cut AS (
    SELECT *, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS l FROM files)),
starts AS (SELECT *, unnest(range(0, greatest(len(ls) - 2, 1), 6)) AS s FROM cut WHERE len(ls) > 0),
chunks AS (
    SELECT doc_id, file_id, project_id, rel_path, language, (s + 1)::INTEGER AS start_line, least(s + 8, len(ls))::INTEGER AS end_line, 'window' AS kind, array_to_string(ls[s + 1:s + 8], chr(10)) AS document,
           file_id || ':' || lpad((s + 1)::VARCHAR, 6, '0') || '-' || lpad(least(s + 8, len(ls))::VARCHAR, 6, '0') || ':' || substr(sha256(array_to_string(ls[s + 1:s + 8], chr(10))), 1, 8) AS chunk_id
    FROM starts)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("file_id"), (F.col("label") % 2).alias("project_id"), F.col("embedding").alias("vector"))


VECTORS = "vectors AS (SELECT vec_id AS chunk_id, label AS file_id, label % 2 AS project_id, embedding::DOUBLE[] AS vector FROM embeddings)"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("R", "def", "A", "call", "N", "import")]), F.col("l_returnflag"))
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part_"), "l_partkey").alias("symbol"), (F.col("l_suppkey") % 10).alias("project_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"), kind.alias("kind")
    )


REFS = "refs AS (SELECT 'part_' || l_partkey AS symbol, l_suppkey % 10 AS project_id, l_orderkey AS file_id, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'def' WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' END AS kind FROM lineitem)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_links(read(spark, sf_dir, "pages"))


LINKS = """links AS (SELECT page_id AS from_file_id, unnest(h) AS to_path, (unnest(range(len(h))))::INTEGER AS position FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)', 1) AS h FROM pages))"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per labelled document."""
    at = read(spark, sf_dir, "labels").join(files(spark, sf_dir).select("doc_id", "file_id", "rel_path", "project_id"), "doc_id")
    severity = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("info")
    rule = F.when(F.col("toxic") == 1, "label/toxic").when(F.col("quality") == 0, "label/quality").otherwise("label/seen")
    return at.select("doc_id", "file_id", "rel_path", "project_id", rule.alias("rule_id"), severity.alias("severity"), F.lit(1).alias("line_from"), (8 + F.col("doc_id") % 5).cast("int").alias("line_to"))


FINDINGS = (
    FILES
    + """, findings AS (
    SELECT doc_id, file_id, rel_path, project_id, CASE WHEN toxic = 1 THEN 'label/toxic' WHEN quality = 0 THEN 'label/quality' ELSE 'label/seen' END AS rule_id,
           CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity, 1 AS line_from, (8 + doc_id % 5)::INTEGER AS line_to
    FROM labels JOIN files USING (doc_id))"""
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"), F.col("event_type").alias("tool"), F.col("props").alias("arguments_json"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed_ms"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of past queries: a turn of a conversation each."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("role").alias("project_id"), F.col("turn").alias("file_id"), F.col("text").alias("snippet"), F.when(F.col("turn") % 3 != 0, 4000).cast("long").alias("file_bytes")
    )


RESULTS = "results AS (SELECT conv_id AS query_id, role AS project_id, turn AS file_id, text AS snippet, CASE WHEN turn % 3 <> 0 THEN 4000::BIGINT END AS file_bytes FROM conversations)"


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of an item as a query: each document of the label table with the item's remainder mod 40, graded by quality."""
    at = read(spark, sf_dir, "labels").join(files(spark, sf_dir).select("doc_id", "rel_path"), "doc_id")
    kinds = F.array(*[F.lit(x) for x in ("literal", "symbol", "concept", "mixed", "prose")])
    q = F.col("doc_id") % 40
    return at.select(q.alias("query_id"), F.element_at(kinds, (q % 5 + 1).cast("int")).alias("query_type"), "rel_path", F.lit(1).alias("start_line"), F.lit(8).alias("end_line"), (F.col("quality") + (F.col("doc_id") % 3 == 0).cast("int") * F.col("quality")).alias("relevance"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked run for those queries: the files by a fixed hash, each with its first lines."""
    from pyspark.sql import Window

    at = files(spark, sf_dir).select((F.col("doc_id") % 40).alias("query_id"), "rel_path", F.md5(F.col("rel_path").cast("binary")).alias("_h"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("_h", "rel_path"))
    return at.withColumn("rank", turn).where("rank <= 50").select("query_id", "rank", "rel_path", F.lit(1).alias("start_line"), F.lit(8).alias("end_line"))
