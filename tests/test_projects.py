"""Operators on projects beside their SQL: rules, stems, runs, suppressions, indexes and versions."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sedimenta.functions.stems import porter
from sedimenta.operators import chunks, code, components, definitions, graph, ignoring, lexical, similarity, store
from sedimenta.sources import formats, runs
from sedimenta.sources.scratch import Scratch


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("sky", "sky"), ("happy", "happi"), ("agreed", "agre"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("is", "is"), ("naïve", "naïve")],
)
def test_stems(word, stem):
    assert porter(word) == stem


def test_postings_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", "x y x", ["Y", None]), ("a", "x z y", None), ("b", None, ["q"]), ("c", "", None)], "chunk_id string, document string, symbols array<string>")
    index = lexical.postings(rows, symbols="symbols")
    assert sorted(tuple(r) for r in index.collect()) == [("x", "a", 1, 3), ("x", "a", 2, 4), ("y", "a", 1, 3), ("y", "a", 2, 4), ("z", "a", 1, 3)]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_stems_find_other_forms(spark):
    rows = spark.createDataFrame([("a", "hopping hops"), ("b", "a rabbit hopped"), ("c", "hope")], "chunk_id string, document string")
    index = lexical.postings(rows, stem=True)
    lengths = rows.select("chunk_id", F.size(lexical.words_of("document", None)).alias("len"))
    assert [r.chunk_id for r in lexical.bm25_of_postings(index, lengths, "hop", 5, True).collect()] == ["a", "b"]
    assert lexical.bm25_of_postings(lexical.postings(rows), lengths, "hop", 5).count() == 0 and lexical.bm25_of_postings(index, lengths, "", 5).count() == 0


def test_ignore_rules(spark):
    rules = ignoring.ignore_rules(spark, {"": ["*.log", "!keep.log", "build/", "/top.txt", "docs/**/x.md", "a?c", "[!b]z", "", "# no", "\\#yes"], "sub": ["*.txt", "!log.log"]})
    cases = {
        "x.log": True, "keep.log": False, "d/y.log": True, "build/a.c": True, "build": False, "src/build/k": True, "top.txt": True, "d/top.txt": False, "docs/x.md": True, "docs/p/q/x.md": True, "abc": True, "a/c": False,
        "az": True, "bz": False, "#yes": True, "sub/n.txt": True, "sub/d/n.txt": True, "n.txt": False, "sub/log.log": True, "X.LOG": True, ".claude/a.md": False, "build/keep.log": True,
    }
    got = {r.rel_path: r.is_ignored for r in ignoring.ignored(spark.createDataFrame([(p,) for p in cases], "rel_path string"), rules).collect()}
    assert got == cases


def test_references_stay_in_the_project(spark):
    files = spark.createDataFrame([("p", "a/b.md"), ("p", "c.md"), ("q", "x/y.md")], "project_id string, rel_path string")
    refs = spark.createDataFrame([("p", "a/b.md", 1, "../c.md#t"), ("p", "a/b.md", 2, "../../c.md"), ("p", "a/b.md", 3, "y.md"), ("p", "a/b.md", 4, "b.md"), ("p", "a/b.md", 5, "~/c.md"), ("q", "x/y.md", 6, "y.md")], "project_id string, rel_path string, line int, target string")
    got = {r.line: r.resolved for r in graph.resolve_refs(refs, files).collect()}
    assert got == {1: "c.md", 2: None, 3: None, 4: "a/b.md", 6: "x/y.md"}


def test_front_matter_that_cannot_be_read():
    assert definitions.parse_block("a: 1\nb:\n  - x\n  - 'y'\nc: {k: [1, 2]}\nd: \"q\\n\"\ne: 1.5 # note") == {"a": 1, "b": ["x", "y"], "c": {"k": [1, 2]}, "d": "q\n", "e": 1.5}
    for bad in ("no map", "a: 1\na: 2", "a: [1"):
        with pytest.raises(ValueError):
            definitions.parse_block(bad)


def test_runs_are_checked(spark, tmp_path):
    each = spark.createDataFrame([("q1", "literal", *[0.5] * 7), ("q2", "prose", *[1.0] * 7)], f"queryId string, queryType string, {', '.join(f'{m} double' for m in runs.METRICS)}")
    run = runs.run_rows({f: f"<{f}>" for f in runs.RUN_FIELDS}, each)
    runs.write_run(run, f"{tmp_path}/a")
    back = runs.read_runs(spark, f"{tmp_path}/a")
    assert back.collect() == run.collect()
    text = runs.report(back)
    assert "| Hit@1 | 0.750 |" in text and "| literal | 0.500 |" in text
    assert "| overall | nDCG@10 | 0.750 | 0.750 | · |" in runs.comparison(back, back)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text(next((tmp_path / "a").glob("*.json")).read_text().replace('"hitAt1":0.75', '"hitAt1":"x"'))
    with pytest.raises(PySparkException, match="not a run"):
        runs.read_runs(spark, f"{tmp_path}/b").collect()


def test_judgements_tell_the_line(spark, tmp_path):
    good = '{"query_id":"1","query":"q","query_type":"prose","rel_path":"a","start_line":1,"end_line":2,"relevance":1}'
    (tmp_path / "q.jsonl").write_text(f"# c\n\n{good}\n// d\n")
    assert formats.read_qrels(spark, f"{tmp_path}/q.jsonl").count() == 1
    (tmp_path / "q.jsonl").write_text(f"# c\n{good}\n{good.replace(':1,', ':0,')}\n")
    with pytest.raises(PySparkException, match="line 3"):
        formats.read_qrels(spark, f"{tmp_path}/q.jsonl").collect()


def test_suppressions_and_baselines(spark, tmp_path):
    rules, problems = runs.suppression_rules("# x\nsuppressions:\n  - rule: a/b\n    path: 'src/*'\n    reason: old code\n  - rule: c\n    path: d\n  - path: e\n    reason: f\nother: 1\n")
    assert rules == [{"rule": "a/b", "path": "src/*", "reason": "old code"}] and len(problems) == 2
    found = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b"), ("q", "b")], "rule_id string, rel_path string")
    runs.write_baseline(found, f"{tmp_path}/base")
    assert [tuple(r) for r in runs.read_baseline(spark, f"{tmp_path}/base").collect()] == [("r", "a"), ("q", "b"), ("r", "b")]


def test_vector_index_finds_most(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    assert similarity.vector_index(df) is None
    index, hit = similarity.vector_index(df, least=100, bucket=1.0), 0
    for q in range(20):
        exact = {r.chunk_id for r in similarity.nearest_of(df, None, rows[q][1], 10).collect()}
        hit += len(exact & {r.chunk_id for r in similarity.nearest_of(df, index, rows[q][1], 10).collect()})
    assert hit >= 0.9 * 200


def test_versions_and_compaction(spark, tmp_path):
    assert store.committed_index(spark, f"{tmp_path}/none") == {}
    df = spark.range(100).withColumn("file_id", F.col("id") % 10)
    df.repartition(8).write.parquet(f"{tmp_path}/many")
    told = store.compact(spark, f"{tmp_path}/many", f"{tmp_path}/one")
    assert told["files_after"] < told["files_before"] and spark.read.parquet(f"{tmp_path}/one").count() == 100


def test_components_raise_when_not_settled(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        components.connected_components(chain, Scratch(spark, "t"), rounds=2)
    assert components.connected_components(chain, Scratch(spark, "t")).select("component").distinct().count() == 1


def test_code_with_quotes_and_generics(spark):
    rust = "pub fn f<'a>(x: &'a str) -> char {\n    if x.len() > 1 { return '}'; }\n    '\\''\n}\n\nimpl<T> K<T> {\n    pub fn new() -> Self { K(0) }\n}\n"
    java = "package p;\npublic final class A<T> {\n  // } not here\n  void m() { for (int i = 0; i < 3; i++) { while (true) { go(); } } }\n}\n"
    rows = spark.createDataFrame([("r", "rust", rust), ("j", "java", java), ("n", "go", "// nothing"), ("e", "go", None)], "file_id string, language string, text string")
    got = {(r.file_id, r.start_line): r for r in code.code_definitions(rows).collect()}
    assert set(got) == {("r", 1), ("r", 6), ("j", 2)} and got["r", 1].end_line == 4 and got["r", 6].end_line == 8 and got["j", 2].end_line == 5
    assert got["j", 2].max_loops == 2 and ("m", "def", 4) in [tuple(x) for x in got["j", 2].refs]
    routed = code.routed_chunks(rows).select("file_id", "kind").collect()
    assert ("n", "window") in [tuple(r) for r in routed] and chunks.line_windows(rows).count() > 0
