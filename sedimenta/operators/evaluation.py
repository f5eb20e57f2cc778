"""Scores of ranked runs against graded judgements."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run (query_id, rank, rel_path, start_line, end_line) with `grade`: the best of the judgements whose lines overlap, else 0."""
    q = qrels.select(F.col("query_id").alias("_q"), F.col("rel_path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), "relevance")
    on = (run.query_id == q._q) & (run.rel_path == q._p) & (run.start_line <= q._e) & (run.end_line >= q._s)
    return run.join(q, on, "left").groupBy(*run.columns).agg(F.coalesce(F.max("relevance"), F.lit(0)).alias("grade"))


def query_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, hit_1, hit_3, hit_10, rr_10, recall_20, recall_50) of every query with judgements; 0 where nothing was found."""
    graded = judged(run, qrels)
    good = F.col("grade") >= 1
    found = graded.groupBy("query_id").agg(
        *[F.max(F.when(good & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in (1, 3, 10)],
        F.coalesce(1.0 / F.min(F.when(good & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("rr_10"),
    )
    q = qrels.where("relevance >= 1").withColumn("_id", F.xxhash64("query_id", "rel_path", "start_line", "end_line"))
    r = run.select(F.col("query_id").alias("_q"), "rank", F.col("rel_path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    on = (q.query_id == r._q) & (q.rel_path == r._p) & (r._s <= q.end_line) & (r._e >= q.start_line)
    covered = q.join(r, on, "left").groupBy("query_id").agg(*[(F.count_distinct(F.when(F.col("rank") <= k, F.col("_id"))) / F.count_distinct("_id")).alias(f"recall_{k}") for k in (20, 50)])
    out = qrels.select("query_id").distinct().join(found, "query_id", "left").join(covered, "query_id", "left")
    return out.na.fill(0.0)


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): gain 2^grade - 1, logarithmic discount; in the order of ranks each row takes the best judgement that overlaps and is not yet taken.

    Taking is sequential, so a query's top k and its judgements, which are few by nature, meet in one group.
    """
    kind = qrels.schema["query_id"].dataType.simpleString()

    def one(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"query_id": [], "ndcg": []})
        left, got = wanted.reset_index(drop=True), 0.0
        ideal = sum((2.0**g - 1) / math.log2(i + 2) for i, g in enumerate(sorted(left["relevance"], reverse=True)[:k]))
        order = wanted["query_id"].iat[0]
        for row in found.sort_values("rank").itertuples():
            hit = left[(left["rel_path"] == row.rel_path) & (left["start_line"] <= row.end_line) & (left["end_line"] >= row.start_line)]
            if len(hit):
                best = hit["relevance"].idxmax()
                got += (2.0 ** hit.at[best, "relevance"] - 1) / math.log2(row.rank + 1)
                left = left.drop(best)
        return pd.DataFrame({"query_id": [order], "ndcg": [got / ideal if ideal else 0.0]})

    top = run.where(F.col("rank") <= k).groupBy("query_id")
    return top.cogroup(qrels.groupBy("query_id")).applyInPandas(one, f"query_id {kind}, ndcg double")


def mean_by_type(metrics: DataFrame, kinds: DataFrame, names: list[str]) -> DataFrame:
    """(query_type, n, means): per type and over all as `overall`, by grouping sets in one pass."""
    both = metrics.join(kinds, "query_id").select("query_type", *names)
    each = both.rollup("query_type").agg(F.count("*").alias("n"), F.grouping("query_type").alias("_all"), *[F.round(F.avg(c), 6).alias(c) for c in names])
    return each.withColumn("query_type", F.when(F.col("_all") == 1, "overall").otherwise(F.col("query_type"))).drop("_all")


def qrel_status(qrels: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, rel_path, start_line, end_line, status): exact, drift, no-overlap or missing-file."""
    c = chunks.select(F.col("rel_path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    f = files.select(F.col("rel_path").alias("_f")).distinct()
    keys = ["query_id", "rel_path", "start_line", "end_line"]
    both = qrels.join(f, F.col("rel_path") == F.col("_f"), "left").join(c, (F.col("rel_path") == F.col("_p")) & (F.col("_s") <= F.col("end_line")) & (F.col("_e") >= F.col("start_line")), "left")
    exact = F.max(((F.col("_s") == F.col("start_line")) & (F.col("_e") == F.col("end_line"))).cast("int")) == 1
    status = F.when(F.max("_f").isNull(), "missing-file").when(exact, "exact").when(F.max("_p").isNotNull(), "drift").otherwise("no-overlap")
    return both.groupBy(*keys).agg(status.alias("status"))


def boundary_digest(chunks: DataFrame, group: str, path: str = "rel_path") -> DataFrame:
    """(group, path, n, digest): of each file of a group, SHA-256 over its sorted `path:start-end` lines, each with its end of line."""
    line = F.concat(F.col(path), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("\n"))
    return chunks.groupBy(group, path).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "").cast("binary"), 256).alias("digest"))


def group_digest(digests: DataFrame, group: str, path: str = "rel_path", buckets: int = 1024) -> DataFrame:
    """(group, n, digest) of boundary_digest()'s rows in two levels, so that no task holds a group's files: the digest of each of the buckets that a hash of the path deals
    files into, and the digest of the buckets that are not empty, in order."""
    entry = F.struct(path, "digest")
    bucket = F.conv(F.substring(F.md5(F.col(path).cast("binary")), 1, 4), 16, 10).cast("int") % buckets
    each = digests.withColumn("_b", bucket).groupBy(group, "_b").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["digest"]), "").cast("binary"), 256).alias("digest"))
    return each.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "digest"))), lambda e: e["digest"]), "").cast("binary"), 256).alias("digest"))


def run_of(scored: DataFrame, fetch: int = 50) -> DataFrame:
    """All queries' ranked lists at once from scored (query_id, rel_path, start_line, end_line, score): the `fetch` best of each, by score and then by place."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rel_path", "start_line"))
    return scored.withColumn("rank", turn).where(F.col("rank") <= fetch)


def gate(run: DataFrame, qrels: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """One row: n queries, the share with a judged place among the first k, and whether that is enough."""
    good = judged(run.where(F.col("rank") <= k), qrels).where("grade >= 1").select("query_id").distinct().withColumn("hit", F.lit(1))
    each = qrels.select("query_id").distinct().join(good, "query_id", "left")
    return each.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*"), 6).alias("share")).withColumn("passed", F.col("share") >= least)
