"""Statistics of files and chunks, the request log, and accounting of use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import capped, extension, round_half_up


def chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, n_chunks) of every file, 0 included. Chunks are counted before the join."""
    n = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    return files.select("file_id").join(n, "file_id", "left").na.fill(0, ["n_chunks"])


def file_stats(files: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(project_id, n_files, n_errors, bytes, last) per project that has files, or of all the projects given, those without files with zeros and a null `last`."""
    stats = files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.count("error").alias("n_errors"), F.sum("size").alias("bytes"), F.max("indexed_at").alias("last"))
    return stats if projects is None else projects.select("project_id").distinct().join(stats, "project_id", "left").na.fill(0, ["n_files", "n_errors", "bytes"])


def extension_rollup(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ext, n_files, n_chunks); `<none>` where a name has none."""
    ext = F.when(extension(F.col("rel_path")) == "", "<none>").otherwise(extension(F.col("rel_path")))
    both = files.select("file_id", ext.alias("ext")).join(chunk_counts(files, chunks), "file_id")
    return both.groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("n_chunks").alias("n_chunks"))


def newest(requests: DataFrame, n: int, order: str = "request_id") -> DataFrame:
    """The rows that a log of n rows keeps."""
    return requests.orderBy(F.desc(order)).limit(n)


def project_chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, n_chunks) of every project that has files, 0 included."""
    n = chunks.groupBy("project_id").agg(F.count("*").alias("n_chunks"))
    return files.select("project_id").distinct().join(n, "project_id", "left").na.fill(0, ["n_chunks"])


def capped_fields(requests: DataFrame, fields: list[str], most: int) -> DataFrame:
    """The log with long fields cut and marked."""
    return requests.withColumns({c: capped(F.col(c), most) for c in fields})


def usage_report(usage: DataFrame) -> DataFrame:
    """usage (project_id, queries, returned_bytes, baseline_bytes, zero_hits, elapsed_ms) as usage_summary() with zero_hit_pct and mean_ms, those who saved most first."""
    n = F.col("queries")
    each = usage_summary(usage).join(usage.select("project_id", F.when(n > 0, round_half_up(100 * F.col("zero_hits") / n)).otherwise(0).alias("zero_hit_pct"), F.when(n > 0, round_half_up(F.col("elapsed_ms") / n)).otherwise(0).alias("mean_ms")), "project_id")
    return each.orderBy(F.desc("tokens_saved"), "project_id")


def usage_deltas(results: DataFrame) -> DataFrame:
    """(query_id, project_id, n_files, returned_bytes, baseline_bytes) per query and project, and per query over all as project ''.

    results: query_id, project_id, file_id, snippet, file_bytes (null unknown). A file's size counts once however many of its snippets are returned.
    """
    once = results.groupBy("query_id", "project_id", "file_id").agg(F.sum(F.octet_length("snippet")).alias("r"), F.max("file_bytes").alias("b"))
    sums = [F.count("*").alias("n_files"), F.sum("r").alias("returned_bytes"), F.coalesce(F.sum("b"), F.lit(0)).alias("baseline_bytes")]
    sets = once.groupingSets([["query_id", "project_id"], ["query_id"]], "query_id", "project_id").agg(*sums, F.grouping("project_id").alias("_all"))
    return sets.withColumn("project_id", F.when(F.col("_all") == 1, "").otherwise(F.col("project_id"))).drop("_all")


def usage_rollup(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("project_id").agg(F.count("*").alias("queries"), *[F.sum(c).alias(c) for c in ("n_files", "returned_bytes", "baseline_bytes")])


def usage_summary(usage: DataFrame) -> DataFrame:
    """Tokens returned and saved (four bytes each, halves up), and the reduction in percent."""
    base, back = round_half_up(F.col("baseline_bytes") / 4), round_half_up(F.col("returned_bytes") / 4)
    saved = F.greatest(base - back, F.lit(0))
    return usage.select("project_id", "queries", back.alias("tokens_returned"), saved.alias("tokens_saved"), F.when(base > 0, round_half_up(100 * saved / base)).otherwise(0).alias("reduction"))
