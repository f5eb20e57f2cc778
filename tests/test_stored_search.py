"""Trigrams, vectors in cells, the pruned similarity join, and drift of documents, against plain scans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import cells, lexical, similarity, store, trigrams, versions
from sedimenta.sources.scratch import Scratch


def test_literal_search_by_trigrams(spark, tmp_path):
    rng = random.Random(4)
    parts = ["Élan vital", "naïve", "漢字", "foo_bar(baz)", "FOO", "foo", "a", "\t", "ab", "xyz" * 5, "%_\\", "é"]
    texts = ["\n".join(" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(5))) for _ in range(120)] + [None, "", "ab", "needle in the hay"]
    rows = spark.createDataFrame([(f"f{i}", t, "p" if i % 2 else "q") for i, t in enumerate(texts)], "file_id string, text string, project_id string")
    index = trigrams.build_trigrams(rows, f"{tmp_path}/index", buckets=8, parts=4)
    joined = [t for t in texts if t]
    patterns = ["a", "ab", "é", "Él", "foo", "FOO", "Foo", "naïve", "漢", "漢字", "%_\\", "zxy", "needle", "not there at all", "foo_bar(baz)"] + [(t := rng.choice(joined))[(at := rng.randrange(len(t))) : at + n] for n in range(1, 51, 7)]
    said = lambda df: sorted((r.file_id, r.line, r.column, r.snippet, r.project_id) for r in df.collect())
    for pattern in patterns:
        assert said(trigrams.find_literal(index, pattern)) == said(lexical.literal_matches(rows, pattern)), pattern
    assert [r.key for r in trigrams.candidates(index, "NEEDLE").collect()] == [f"f{len(texts) - 1}"] and trigrams.candidates(index, "ab") is None
    assert said(trigrams.find_literal(index, "foo", where=F.col("project_id") == "p")) == said(lexical.literal_matches(rows.where("project_id = 'p'"), "foo"))
    assert "bucket#" in index.of_grams("postings", [1, 9])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    none = trigrams.build_trigrams(rows.where("false"), f"{tmp_path}/none")
    assert trigrams.find_literal(none, "foo").count() == 0 and trigrams.find_literal(none, "f").count() == 0


def test_literal_search_of_rows_that_share_a_key(spark, tmp_path):
    """Each text counts by itself; a task's texts fill several blocks, and neither they nor their postings are shuffled."""
    rows = spark.createDataFrame([("same", "one needle"), ("same", "two needles"), ("same", "hay"), (None, "NEEDLE needle")] + [(f"k{i}", f"n{i} eed le") for i in range(9000)], "file_id string, text string").coalesce(1)
    index = trigrams.build_trigrams(rows, f"{tmp_path}/index", buckets=4, parts=2)
    assert sorted((str(r.file_id), r.snippet) for r in trigrams.find_literal(index, "needle").collect()) == [("None", "NEEDLE needle"), ("same", "one needle"), ("same", "two needles")]
    assert sorted(str(r.key) for r in trigrams.candidates(index, "Needle").collect()) == ["None", "same", "same"]
    assert index.table("texts").select("block").distinct().count() == 3 and index.table("texts").count() == 9004
    assert trigrams.find_literal(index, "n8999 e").count() == 1


def clustered(n, d, groups, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    return middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))


def cosines(a):
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("groups", [12, 600])
def test_cells_find_what_a_scan_finds(spark, tmp_path, groups):
    data = clustered(600, 16, groups, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(1000, None), (1001, [0.0] * 16)], "chunk_id long, vector array<double>")
    index = cells.build_cells(df, f"{tmp_path}/index")
    assert index.rows().count() == 600 and len(index.centres) == 24
    hit = 0
    for q in range(0, 600, 60):
        exact = similarity.vector_topk(df, data[q].tolist(), 10).collect()
        assert [(r.chunk_id, r.score) for r in cells.nearest_in_cells(index, data[q].tolist(), 10, probes=2).collect()] == [(r.chunk_id, r.score) for r in exact]
        near = cells.nearest_in_cells(index, data[q].tolist(), 10, probes=4 if groups == 12 else 16, exact=False)
        hit += len({r.chunk_id for r in exact} & {r.chunk_id for r in near.collect()})
    assert hit >= 0.9 * 100
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()
    none = cells.build_cells(df.where("false"), f"{tmp_path}/none")
    assert len(none.centres) == 0


@pytest.mark.parametrize("threshold, block", [(0.92, 32), (0.5, 2048), (-1.0, 64)])
def test_pruned_pairs(spark, threshold, block):
    n = 400 if threshold > 0 else 90
    data = clustered(n, 8, 20, 3)
    data[: n // 3] = data[0]  # a third of all rows are equal
    df = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(data)] + [(9999, 0, None)], "chunk_id long, file_id int, vector array<double>")
    score = cosines(data)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if i % 7 != j % 7 and round(score[i, j], 6) >= threshold}
    got = cells.similar_pairs(df, threshold, block=block).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(math.isclose(r.similarity, score[r.a, r.b], abs_tol=1e-6) for r in got)
    assert cells.similar_pairs(df.where("false"), threshold).count() == 0


@pytest.mark.parametrize("threshold, block", [(0.92, 32), (0.5, None), (-1.0, 8)])
def test_links_stand_for_all_pairs(spark, threshold, block):
    """Fewer links than pairs, with the same groups and means; null keys and groups take no part."""
    data = clustered(300, 8, 20, 3)
    df = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(data)] + [(None, 1, [1.0] * 8), (9999, None, [1.0] * 8)], "chunk_id long, file_id int, vector array<double>")
    pairs = cells.similar_pairs(df, threshold, block=block).toPandas()
    links = cells.similar_links(df, threshold, block=block)
    told = links.toPandas()
    assert told.n.sum() == len(pairs) > len(told) and abs(told.total.sum() - pairs.similarity.sum()) < 1e-4
    said = lambda found: sorted(tuple(r) for r in found.collect())
    assert said(similarity.linked_groups(links)) == said(similarity.similar_groups(spark.createDataFrame(pairs)))


def test_few_rows_are_sent(spark):
    """Cells too far apart don't meet: far fewer rows than all pairs of blocks would take."""
    data = clustered(2000, 16, 60, 5, 0.05)
    df = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(data)], "chunk_id long, file_id int, vector array<double>")
    sent = cells.dealt_rows(df, 0.92, "chunk_id", "file_id", "vector", 40, Scratch(spark, "t"))
    most = sent.groupBy("cell", "block").agg(F.sum((F.col("visits") == 0).cast("int")).alias("n")).agg(F.max("n")).first()[0]
    assert sent.where("visits = 0").count() == 2000 and sent.count() < 2000 * 2000 / 40 / 4 and most <= 80


def test_drift_of_documents(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(6)], "doc_id long, text string")
    refs = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 3), (2, 1, None), (3, 1, 4), (4, 5, 5)] + [(5, k, 0 if k < 20 else 3) for k in range(25)], "doc_id long, line int, resolved long")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 1.0]), (3, [0.0, 5.0]), (5, [1.0, 0.0]), (5, None)], "doc_id long, vector array<double>")
    got = {r.doc_id: (r.n_refs, r.similarity, r.drifted) for r in similarity.doc_drift(docs, refs, vectors).collect()}
    own = 1 / math.sqrt(5)  # (1, 0) with the mean of (1, 0), (0, 1), (0, 1)
    assert got == {0: (2, round(own, 6), False), 1: (1, round(math.sqrt(0.5), 6), False), 5: (20, 1.0, False)}
    assert similarity.doc_drift(docs, refs, vectors, floor=0.5).where("drifted").select("doc_id").collect()[0][0] == 0


def test_versions_share_what_is_not_touched(spark, tmp_path):
    path = f"{tmp_path}/index"
    files = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("file_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"))
    chunks = files.select("file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk"), "text")
    assert versions.read_version(spark, path) == {} and versions.manifest(spark, path) is None
    versions.first_version({"files": files, "chunks": chunks}, path, "v1", buckets=512)
    of_first = versions.read_version(spark, path)
    fresh = files.where("file_id LIKE 'f100_'").withColumn("text", F.lit("new"))
    told = versions.next_version(spark, path, "v2", {"files": fresh, "chunks": fresh.select("file_id", F.lit(1).alias("chunk"), "text")}, spark.createDataFrame([("f3",), ("f4",), ("none",)], "file_id string"), buckets=512)
    assert 5 <= told <= 13
    size = lambda v: store.table_bytes(spark, f"{path}/data/{v}")[1]
    assert size("v2") < 0.05 * size("v1")
    now = versions.read_version(spark, path)
    assert now["files"].count() == 1998 and now["chunks"].count() == 2 * 1988 + 10 and now["files"].where("text = 'new'").count() == 10
    assert of_first["files"].count() == 2000 and versions.read_version(spark, path, "v1")["chunks"].where("text = 'new'").count() == 0
    assert versions.next_version(spark, path, "v3", {"files": fresh.limit(0), "chunks": chunks.limit(0)}, files.select("file_id").limit(0), buckets=512) == 0
    assert versions.read_version(spark, path)["files"].count() == 1998 and store.table_bytes(spark, f"{path}/data")[0] == store.table_bytes(spark, f"{path}/data/v1")[0] + store.table_bytes(spark, f"{path}/data/v2")[0]
