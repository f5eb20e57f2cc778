"""Edge cases of the operators on inline rows."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import cells, chunks, duplicates, evaluation, filtering, fusion, graph, lexical, quality, similarity, store
from sedimenta.operators.components import connected_components
from sedimenta.sources import formats
from sedimenta.sources.scratch import Scratch
from sedimenta.streaming import events


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, text string")


def test_line_windows_stop_at_the_end(spark):
    for n in (0, 1, 60, 61, 110, 111):
        got = [(r.start_line, r.end_line) for r in chunks.line_windows(files(spark, "x\n" * n)).orderBy("start_line").collect()]
        want, start = [], 0
        while n and (start == 0 or start + 10 < n):
            want.append((start + 1, min(start + 60, n)))
            start += 50
        assert got == want
    assert chunks.line_windows(files(spark, None, "")).count() == 0


def test_markdown_sections(spark):
    text = "intro\n# A\nx\n```\n# not a heading\n```\n## B\ny\n# C\nz\n"
    got = [(r.start_line, r.end_line, r.kind, r.symbols) for r in chunks.markdown_sections(files(spark, text)).orderBy("start_line").collect()]
    assert got == [(1, 6, "section-h1", ["A"]), (7, 8, "section-h2", ["A", "B"]), (9, 10, "section-h1", ["C"])]
    long = chunks.markdown_sections(files(spark, "# A\n" + "x\n" * 250)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in long] == [(1, 200), (193, 251)]
    assert [r.kind for r in chunks.markdown_sections(files(spark, "plain")).collect()] == ["window"]


def test_gaps_and_caps(spark):
    parts = spark.createDataFrame([("f0", 1, 10), ("f0", 60, 70)], "file_id string, start_line int, end_line int")
    got = chunks.fill_gaps(parts, files(spark, "x\n" * 100)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.kind) for r in got] == [(11, 59, "window-fill"), (71, 100, "window-fill")]
    one = spark.createDataFrame([("f0", 5, 134, "function", "\n".join("abc"[i % 3] for i in range(130)))], "file_id string, start_line int, end_line int, kind string, document string")
    got = chunks.cap_sizes(one).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.kind, len(r.document.split("\n"))) for r in got] == [(5, 64, "function", 60), (55, 114, "window", 60), (105, 134, "window", 30)]


def test_python_definitions(spark):
    code = "import os\n\n@dec\ndef f(a, b):\n    for x in a:\n        if x:\n            os.remove(x)\n\nclass C:\n    async def m(self):\n        pass\n"
    got = chunks.python_definitions(files(spark, code, "def (", None)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.kind, r.symbols, r.imports) for r in got] == [(3, 7, "function", ["f"], ["os"]), (9, 11, "class", ["C"], [])]
    assert (got[0].max_nesting, got[0].max_loops, got[0].params, got[0].calls, got[1].has_async) == (2, 1, 2, ["os.remove"], True)


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "red red fish"), ("b", "blue fish"), ("c", "green bird"), ("d", None)], "chunk_id string, document string")
    got = {r.chunk_id: r.bm25 for r in lexical.bm25_topk(docs, "RED", 5).collect()}
    assert list(got) == ["a"] and got["a"] > 0
    assert lexical.bm25_topk(docs, " ! ", 5).count() == 0
    assert T.query_terms("Foo_bar, x ÉÇ") == ["foo_bar", "éç"]


def test_literal(spark):
    got = lexical.literal_matches(files(spark, "ab\nxab ab\nAB"), "ab").orderBy("line").collect()
    assert [(r.line, r.column) for r in got] == [(1, 1), (2, 2)]


def test_fusion_and_reasons(spark):
    b = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 1)], "chunk_id string, branch string, rank int")
    got = {r.chunk_id: (r.rrf, r.sources) for r in fusion.rrf([b]).collect()}
    assert got["b"] == (round(1 / 62 + 1 / 61, 9), ["x", "y"]) and got["a"][1] == ["x"]
    meta = "exports array<string>, imports array<string>, calls array<string>, risky_calls array<string>, max_nesting int, max_loops int, params int, has_recursion boolean, has_async boolean"
    df = spark.createDataFrame([((["Login"], ["./auth/jwt"], [], ["eval"], 4, 0, 0, False, True),), (None,)], f"meta struct<{meta.replace(' ', ':').replace(',:', ',')}>")
    got = [r[0] for r in df.select(fusion.match_reasons(F.col("meta"), ["login", "jwt"], ["eval"], True, False)).collect()]
    assert got == [["symbol_match", "exported", "import_match", "risky_call_category", "complexity_signal"], []]
    paths = spark.createDataFrame([("slides/a.md",), ("docs/index.md",), ("a/b.slides.md",), ("src/slide.py",)], "p string")
    assert [r[0] for r in paths.select(fusion.is_derivative(F.col("p"))).collect()] == [True, True, True, False]


def test_links(spark):
    text = '[a](x.md "t") [b](#top)\n[c](https://e.org) `src/a.py` `no path.py/x` `plain`'
    got = [(r.line, r.target, r.kind) for r in graph.markdown_links(files(spark, text)).orderBy("line", "target").collect()]
    assert got == [(1, "#top", "anchor"), (1, "x.md", "internal"), (2, "https://e.org", "external")]
    assert {(r.line, r.target) for r in graph.path_mentions(files(spark, text)).collect()} == {(1, "x.md"), (2, "src/a.py")}
    df = spark.createDataFrame([("a/b", "../c/./d.md#x"), ("a", "/r.md"), ("", "x")], "f string, t string")
    assert [r[0] for r in df.select(T.resolve_path(F.col("f"), F.col("t"))).collect()] == ["a/c/d.md", "r.md", "x"]


def test_mentions_once_per_line(spark):
    """Without a shuffle where ids differ; rows that share an id are compared."""
    text = "[a](x.md) `s/a.py` [b](x.md) `s/a.py` [c](s/a.py) [d](#t) [e](http://e.org/a.py)\n[a](x.md)"
    want = {("f0", 1, "x.md"), ("f0", 1, "s/a.py"), ("f0", 2, "x.md"), ("f1", 1, "x.md")}
    found = graph.path_mentions(files(spark, text, "[a](x.md)"))
    assert {tuple(r) for r in found.collect()} == want and found.count() == 4
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    again = files(spark, text, "[a](x.md)").unionByName(files(spark, "[z](x.md)\n`t/b.py`"))
    got = graph.path_mentions(again).collect()
    assert {tuple(r) for r in got} == want | {("f0", 2, "t/b.py")} and len(got) == 5


def test_duplicate_window_limits(spark):
    ok, few, dominant = " ".join(f"t{i % 15}" for i in range(50)), " ".join(f"t{i % 14}" for i in range(50)), " ".join(["x"] * 31 + [f"t{i}" for i in range(19)])
    got = duplicates.duplicate_windows(files(spark, ok, few, dominant, ok, ok + " z")).collect()
    assert sorted(r.file_id for r in got) == ["f0", "f3", "f4", "f4"]
    w = duplicates.duplicate_windows(files(spark, ok, ok))
    assert [(r.members, r.n_files) for r in duplicates.duplicate_groups(w).collect()] == [(2, 2)]
    names = spark.createDataFrame([("a/LICENSE",), ("notice.txt",), ("license-check.py",)], "p string")
    assert [r[0] for r in names.select(duplicates.is_license_like(F.col("p"))).collect()] == [True, True, False]


def test_repeated_windows_of_odd_files(spark):
    """Rows that share an id or have none, equal rows, and groups beyond both limits, against plain counts of all windows."""
    rng = random.Random(3)
    words = [[f"{c}{i % 17}" for i in range(70)] for c in "abcdef"]
    said = [" ".join(rng.choice(words)[rng.randrange(15) :][:60]) + rng.choice(["", "\n", " q\nq q"]) + " ".join(rng.choice(words)) for _ in range(40)]
    rows = [(f"f{i // 2}" if i % 7 else None, t) for i, t in enumerate(said)] + [("f3", said[6]), ("f3", None), ("x", " ".join(["y"] * 40 + words[0]))]
    df = spark.createDataFrame(rows, "file_id string, text string")
    each = [tuple(r) for r in duplicates.duplicate_windows(df).collect()]
    of: dict = {}
    for r in each:
        of.setdefault(r[1], []).append(r)
    for least in (2, 3):
        often = {h for h, m in of.items() if len({r[0] for r in m} - {None}) >= least}
        got = sorted((tuple(r) for r in duplicates.repeated_windows(df, least_files=least).collect()), key=str)
        assert got == sorted((r for r in each if r[1] in often), key=str) and 0 < len(got) < len(each) - (least == 3)
    for members, groups in ((4, 9), (50, 10_000)):
        kept = {h: sorted(of[h], key=lambda r: (r[0] is None, r[0] or "", r[2]))[:members] for h in of if len({r[0] for r in of[h]} - {None}) >= 2}
        want = sorted(((h, len(m), len({r[0] for r in m} - {None}), min((r[0] for r in m if r[0]), default=None)) for h, m in kept.items()), key=lambda g: (-g[1], g[0]))[:groups]
        assert [tuple(r) for r in duplicates.repeated_groups(df, most_members=members, most_groups=groups).collect()] == want


def test_overlaps_across_buckets(spark):
    c = spark.createDataFrame([("c", "f", 1, 1000)], "chunk_id string, file_id string, start_line int, end_line int")
    f = spark.createDataFrame([("f", 0, 250, 600), ("f", 1, 1, 351), ("f", 2, 1000, 1001), ("f", 3, 1001, 1002)], "file_id string, ordinal int, line_from int, line_to int")
    assert {(r.ordinal, r.shared) for r in quality.overlapping(c, f).collect()} == {(0, 351), (1, 351), (2, 1)}
    assert [(r.ordinal, r.shared) for r in quality.best_overlap(c, f, "chunk_id", "ordinal").collect()] == [(0, 351)]


def test_ndcg_takes_each_judgement_once(spark):
    run = spark.createDataFrame([("q", 1, "p", 1, 5), ("q", 2, "p", 2, 6)], "query_id string, rank int, rel_path string, start_line int, end_line int")
    qrels = spark.createDataFrame([("q", "p", 1, 5, 2), ("q", "z", 1, 5, 1), ("r", "z", 1, 5, 0)], "query_id string, rel_path string, start_line int, end_line int, relevance int")
    got = {r.query_id: r.ndcg for r in evaluation.ndcg(run, qrels).collect()}
    assert got["q"] == pytest.approx(3 / (3 + 1 / math.log2(3))) and got["r"] == 0
    m = {r.query_id: r for r in evaluation.query_metrics(run, qrels).collect()}
    assert (m["q"].hit_1, m["q"].rr_10, m["q"].recall_20, m["r"].recall_20) == (1.0, 1.0, 0.5, 0.0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_similarity(spark):
    rows = [(i, i % 3, [math.cos(i), math.sin(i)]) for i in range(30)] + [(99, 9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id long, file_id long, vector array<float>")
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if i % 3 != j % 3 and math.cos(i - j) >= 0.9}
    for block in (4, 2048):
        assert {(r.a, r.b) for r in cells.similar_pairs(df, 0.9, block=block).collect()} == want
    assert similarity.vector_topk(df, [1.0, 0.0], 1).first().chunk_id == 0


def test_filter_reasons(spark):
    rows = [("a.py", 1, "x"), ("node_modules/a.py", 1, "x"), (".env", 1, "x"), (".env.example", 1, "x"), ("yarn.lock", 1, "x"), ("a.bin", 1, "x"), ("Makefile", 1, "x"), ("a.py", None, "x"), ("a.py", 2**21, "x"), ("a.py", 1, "x\0")]
    df = spark.createDataFrame(rows, "p string, s long, h string").select(filtering.decision(F.col("p"), F.col("s"), F.col("h")))
    assert [r[0] for r in df.collect()] == ["ok", "ignored-directory", "secret", "ok", "noise", "unsupported-extension", "ok", "missing", "oversized", "binary"]
    assert filtering.Rules().merged({"remove_extensions": ["py"], "max_bytes": 5}).max_bytes == 5
    with pytest.raises(ValueError):
        filtering.Rules().merged({"nonsense": []})


def test_store(spark):
    c = spark.createDataFrame([("a", "x")], "name string, identity string")
    assert store.register_collection(c, "b", "x").count() == 2
    with pytest.raises(ValueError):
        store.register_collection(c, "a", "y")
    base = spark.createDataFrame([("p", 1, 1)], "k string, n long, at int")
    assert [tuple(r) for r in store.add_counters(base, spark.createDataFrame([("p", 2, 3)], "k string, n long, at int"), ["k"], ["n"], "at").collect()] == [("p", 3, 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("# note\n\n" + json.dumps({"query_id": "1", "query": "x", "query_type": "prose", "rel_path": "a", "start_line": 1, "end_line": 2, "relevance": 2}) + "\n")
    assert formats.read_qrels(spark, str(tmp_path / "q.jsonl")).first().relevance == 2
    (tmp_path / "bad.jsonl").write_text('{"query_id": "1"}\n')
    with pytest.raises(Exception, match="bad judgement"):
        formats.read_qrels(spark, str(tmp_path / "bad.jsonl")).collect()
    reports = spark.createDataFrame([("f", '{"results": [{"check_id": "r", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR"}}, {"check_id": "s"}]}'), ("g", "nonsense")], "file_id string, report string")
    assert [(r.rule_id, r.severity, r.line_from) for r in formats.semgrep_findings(reports).collect()] == [("r", "error", 3)]
    reports = spark.createDataFrame([("f", '[{"ruleId": "r", "severity": "hint", "message": "m", "range": {"start": {"line": 0}, "end": {"line": 2}}}]')], "file_id string, report string")
    assert [(r.rule_id, r.severity, r.line_from, r.line_to) for r in formats.ast_grep_findings(reports).collect()] == [("r", "info", 1, 3)]
    reports = spark.createDataFrame([("f", '10,3,55,2,12,"f@1-12@a.py","a.py","f","f(a, b)",1,12\nbroken\n')], "file_id string, report string")
    assert [(r.name, r.nloc, r.ccn, r.line_to) for r in formats.lizard_metrics(reports).collect()] == [("f", 10, 3, 12)]
    assert formats.read_settings('[corpus]\nname = "n"', "corpus") == {"name": "n"}
    paths = spark.createDataFrame([("ws/a/.git",), ("ws/a/package.json",), ("ws/a/b/go.mod",), ("ws/c/x.py",), ("ws/d/pom.xml",)], "path string")
    assert {(r.root, r.marker) for r in formats.projects_of(paths).collect()} == {("ws/a", ".git"), ("ws/d", "pom.xml")}


def test_workspace_files(spark, tmp_path):
    (tmp_path / "ws" / "d").mkdir(parents=True)
    (tmp_path / "ws" / "d" / "a.py").write_bytes(b"ok")
    (tmp_path / "ws" / "b.bin").write_bytes(b"\xff\xfe")
    assert {(r.rel_path, r.size, r.text) for r in formats.workspace_files(spark, f"file:{tmp_path}/ws").collect()} == {("d/a.py", 2, "ok"), ("b.bin", 2, None)}


def test_stream_agrees_with_batch_on_closed_sessions(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("user_id", "key").select("event_id", "key", F.col("ts").cast("timestamp").alias("ts"))
    for i in range(3):
        rows.where(f"event_id % 3 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    events.run_available(events.debounce(stream, "30 minutes", delay="40 days"), f"{tmp_path}/cp", lambda df, i: seen.extend(df.collect())).awaitTermination(120)
    batch = {tuple(r) for r in events.debounce(rows, "30 minutes").collect()}
    assert {tuple(r) for r in seen} <= batch
    waits = []
    with pytest.raises(ZeroDivisionError):
        events.with_backoff(lambda: 1 // 0, waits.append, 1.0, 3.0, 4)
    assert waits == [1.0, 2.0, 3.0]


def test_the_first_event_opens_a_window(spark):
    at = lambda s: f"2024-01-01 00:00:{s}"
    rows = [("a", at("01.9"), "x"), ("a", at("02.1"), "y"), ("a", at("03.9"), "x"), ("a", at("03.95"), "x"), ("a", at("05.8"), "z"), ("b", at("02.0"), None), ("a", at("30"), "x"), ("a", None, "x"), (None, at("01"), "x")]
    df = spark.createDataFrame(rows, "user string, ts string, kind string")
    got = sorted((r.user, str(r.window_start)[17:22], r.kind or "", r.n) for r in events.coalesce(df, "2 seconds", ["kind"], "user").collect())
    assert got == [("a", "01.90", "x", 1), ("a", "01.90", "y", 1), ("a", "03.90", "x", 2), ("a", "03.90", "z", 1), ("a", "30", "x", 1), ("b", "02", "", 1)]
    assert events.coalesce(df.where("false"), "2 seconds", ["kind"], "user").count() == 0


def test_stream_of_windows_agrees_with_the_batch(spark, tmp_path):
    """Files come out of order; what the watermark has passed is told, as in the batch, and no more."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").where("user_id % 10 = 1")
    for i in (0, 1):
        rows.where(F.pmod(F.xxhash64("ts"), F.lit(2)) == i).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    last = rows.agg(F.max("ts")).first()[0]
    spark.createDataFrame([(10**6, last + datetime.timedelta(days=60), "end")], rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    try:
        events.run_available(events.coalesce(stream, "2 days", ["event_type"], "user_id", delay="40 days"), f"{tmp_path}/cp", lambda df, i: seen.extend(map(tuple, df.collect()))).awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = sorted(map(tuple, events.coalesce(rows, "2 days", ["event_type"], "user_id").collect()))
    assert seen and sorted(seen) == batch


def test_window_totals_of_ids_that_rows_share(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [("a", text), ("b", text + " u"), ("b", text), (None, text), (None, text), ("c", "few"), ("d", None)]
    got = {r.file_id: (r.n, r.hashes, r.tokens, r.spans) for r in duplicates.window_totals(spark.createDataFrame(rows, "file_id string, text string")).collect()}
    assert got == {"a": (11, 11, 550, 0), "b": (23, 12, 1150, 0), None: (22, 11, 1100, 0)}
