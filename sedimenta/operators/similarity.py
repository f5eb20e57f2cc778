"""Vector search, centroids, cohesion and similarity groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.vectors import constant, cosine, dot, to_unit
from sedimenta.operators.components import connected_components
from sedimenta.sources.scratch import Scratch


def vector_topk(vectors: DataFrame, query: list[float], k: int, where=None, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k rows of highest cosine; ties go to the smaller key. Each task keeps its own k, so only k rows a task are shuffled."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("score", F.round(cosine(F.col(vector), constant(query)), 6)).drop(vector).where("score is not null").orderBy(F.desc("score"), key).limit(max(1, k))


def vector_scan(vectors: DataFrame, limit: int, where=None, key: str = "chunk_id", columns: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The `limit` rows of smallest key, without the other columns; sorted before the cut, so that the same rows stay in every run."""
    rows = vectors if where is None else vectors.where(where)
    return rows.select(key, *columns).orderBy(key).limit(limit)


def vector_index(vectors: DataFrame, least: int = 10_000, vector: str = "vector", bucket: float = 0.25, tables: int = 8, seed: int = 21):
    """A fitted index of random projections over unit vectors for nearest_of(), or None for fewer than `least` rows, where the exact search is enough."""
    if vectors.limit(least).count() < least:
        return None
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    return BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(_dense(vectors, vector).limit(1))


def _dense(vectors: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("_u", to_unit(F.col(vector))).where("_u is not null").withColumn("_u", array_to_vector("_u"))


def nearest_of(vectors: DataFrame, index, query: list[float], k: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k rows of highest cosine: exact without an index, else among those that share a bucket with the query, widened until there are k."""
    if index is None:
        return vector_topk(vectors, query, k, key=key, vector=vector)
    from pyspark.ml.linalg import Vectors

    length = math.sqrt(sum(x * x for x in query))
    near = index.approxNearestNeighbors(_dense(vectors, vector), Vectors.dense([x / length for x in query]), k)
    return near.select(*[c for c in vectors.columns if c != vector], F.round(1 - F.col("distCol") ** 2 / 2, 6).alias("score")).orderBy(F.desc("score"), key)


def centroids(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Per group the mean of its unit vectors, element by element, and how many there were. Means are combined before the shuffle."""
    unit = vectors.select(group, to_unit(F.col(vector)).alias("_u")).where("_u is not null")
    n = unit.groupBy(group).agg(F.count("*").alias("n"))
    mean = unit.select(group, F.posexplode("_u").alias("_i", "_x")).groupBy(group, "_i").agg(F.avg("_x").alias("_x"))
    mean = mean.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_c"))
    return mean.join(n, group).select(group, "n", F.transform("_c", lambda s: s["_x"]).alias("centroid"))


def cohesion(vectors: DataFrame, group: str, least: int = 3, vector: str = "vector") -> DataFrame:
    """Per group of at least `least` vectors: n and the mean cosine of the vectors to the group's centroid, to 4 places."""
    middle = centroids(vectors, group, vector).where(F.col("n") >= least).select(group, to_unit(F.col("centroid")).alias("_c"))
    return vectors.join(middle, group).groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(dot(to_unit(F.col(vector)), F.col("_c"))), 4).alias("cohesion"))


def low_cohesion(scores: DataFrame, group: str, share: float = 0.1, ceiling: float = 0.5) -> DataFrame:
    """The lowest `share` of the population, rounded down, of those below the ceiling. The rank is found by a limit of a size that is counted first, not in one partition."""
    most = int(scores.count() * share)
    return scores.orderBy("cohesion", group).limit(most).where(F.col("cohesion") < ceiling)


def similar_groups(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component, size, similarity): components of pairs, with the mean similarity of each component's edges."""
    scratch = scratch or Scratch(pairs.sparkSession, "similar")
    return linked_groups(pairs.withColumn("n", F.lit(1)).withColumn("total", F.col("similarity")), scratch)


def linked_groups(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """similar_groups() from links (a, b, n, total), each for n pairs of the component that it lies in, whose similarities add up to total."""
    scratch = scratch or Scratch(links.sparkSession, "similar")
    links = scratch.keep(links, "links")
    labels = scratch.keep(connected_components(links.select("a", "b"), scratch), "labels")
    mean = F.round(F.sum("total") / F.sum("n"), 4)
    edge = links.where("n > 0").join(labels, links.a == labels.node).groupBy("component").agg(mean.alias("similarity"))
    size = labels.groupBy("component").agg(F.count("*").alias("size"))
    return labels.join(size, "component").join(edge, "component").select("node", "component", "size", "similarity")


def doc_drift(docs: DataFrame, refs: DataFrame, vectors: DataFrame, doc: str = "doc_id", most: int = 20, floor: float = 0.35, vector: str = "vector") -> DataFrame:
    """(doc, n_refs, similarity, drifted): how near each document's own vectors are to those of what it refers to; drifted below the floor.

    refs: (doc, line, resolved), of which a document's first `most` by line count that lead somewhere, one as often as it is named; vectors: (doc, vector). Both sides are pooled to the
    mean of unit vectors, before the shuffle as far as they meet. A document without a live reference, or without vectors on either side, has no row.
    """
    turn = F.row_number().over(Window.partitionBy(doc).orderBy("line", "resolved"))
    live = refs.join(docs.select(doc).distinct(), doc, "left_semi").where(F.col("resolved").isNotNull()).withColumn("_turn", turn).where(F.col("_turn") <= most)
    of = vectors.select(F.col(doc).alias("resolved"), F.col(vector))
    pooled = centroids(live.select(doc, "resolved").join(of, "resolved"), doc, vector).select(doc, F.col("centroid").alias("_refs"))
    own = centroids(vectors.join(docs.select(doc).distinct(), doc, "left_semi"), doc, vector).select(doc, F.col("centroid").alias("_own"))
    n = live.groupBy(doc).agg(F.count("*").alias("n_refs"))
    out = own.join(pooled, doc).join(n, doc).select(doc, "n_refs", F.round(cosine(F.col("_own"), F.col("_refs")), 6).alias("similarity"))
    return out.withColumn("drifted", F.col("similarity") < floor)


def diverse(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most `most` rows, taken one per group in each round, groups in their order."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("round", turn).where(F.col("round") <= most).orderBy("round", group).limit(most)


def model_embeddings(files: DataFrame, embed, text: str = "text", batch: int = 8, prefix: str = "", most_tokens: int = 512, pooling: str = "mean") -> DataFrame:
    """The rows with `vector`: embed() makes, once per task, a function from a list of texts to their token vectors (one array of rows per text) or vectors.

    It gets `batch` texts at a time, each behind the prefix of its kind (query or document). Of token vectors, the first `most_tokens` count; they are pooled to their mean, or
    to the first one (`cls`). A model that pools by itself returns one vector a text, which is taken as it is.
    """

    def pooled(found) -> list[float]:
        rows = np.asarray(found, np.float32)
        if rows.ndim == 1:
            return rows.tolist()
        return (rows[0] if pooling == "cls" else rows[:most_tokens].mean(0)).tolist()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embed()
        for part in parts:
            values = [prefix + v for v in part.fillna("").tolist()]
            yield pd.Series([pooled(v) for i in range(0, len(values), batch) for v in model(values[i : i + batch])])

    return files.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(text)))
