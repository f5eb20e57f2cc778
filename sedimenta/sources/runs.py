"""Results of an evaluation: as JSON files, and as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a run that are text, and its metrics with their names in reports.
RUN_FIELDS = ["runId", "goldenSet", "corpusSha", "engineSha", "embedder", "runtime", "chunkingConfig", "retrievalConfig", "chunkBoundaryHash", "startedAt", "finishedAt"]
METRICS = {"hitAt1": "Hit@1", "hitAt3": "Hit@3", "hitAt10": "Hit@10", "mrrAt10": "MRR@10", "ndcgAt10": "nDCG@10", "recallAt20": "Recall@20", "recallAt50": "Recall@50"}
QUERY_TYPES = ["literal", "symbol", "concept", "mixed", "prose"]
_metrics = ", ".join(f"{m}: double" for m in METRICS)
RUN = f"struct<{', '.join(f'{f}: string' for f in RUN_FIELDS)}, metrics: struct<overall: struct<{_metrics}>, byQueryType: map<string, struct<{_metrics}>>>, perQuery: array<struct<queryId: string, queryType: string, {_metrics}>>>"


def run_rows(fields: dict[str, str], per_query: DataFrame) -> DataFrame:
    """One row, a run, of per_query (queryId, queryType and the metrics): means over all and by type, and a row for each query in the order of its id. Judged queries
    are a curated set, so that one row holds them."""
    means = lambda: F.struct(*[F.avg(m).alias(m) for m in METRICS])
    each = F.struct("queryId", "queryType", *METRICS)
    overall = per_query.agg(means().alias("overall"), F.array_sort(F.collect_list(each)).alias("perQuery"))
    by_type = per_query.groupBy("queryType").agg(means().alias("m")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("queryType", "m")))).alias("byQueryType"))
    return overall.crossJoin(by_type).select(*[F.lit(fields[f]).alias(f) for f in RUN_FIELDS], F.struct("overall", "byQueryType").alias("metrics"), "perQuery")


def write_run(run: DataFrame, path: str) -> None:
    run.coalesce(1).write.mode("errorifexists").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs from JSON lines; a run that lacks a field or holds one of another kind is an error that names the file."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    run = raw.select("value", "file", F.from_json("value", RUN).alias("r"))
    whole = lambda m: F.forall(F.array(*[m[k].isNull() for k in METRICS]), lambda x: ~x)
    ok = F.col("r").isNotNull()
    for f in RUN_FIELDS:
        ok = ok & F.col(f"r.{f}").isNotNull()
    ok = ok & whole(F.col("r.metrics.overall")) & F.col("r.metrics.byQueryType").isNotNull() & F.col("r.perQuery").isNotNull()
    ok = ok & F.forall(F.map_values("r.metrics.byQueryType"), whole) & F.forall("r.perQuery", lambda q: q["queryId"].isNotNull() & q["queryType"].isin(*QUERY_TYPES) & whole(q))
    kind = run.schema["r"].dataType
    return run.withColumn("r", F.when(F.coalesce(ok, F.lit(False)), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a run: "), "file")).cast(kind))).select("r.*")


def _number(value) -> object:
    return F.format_string("%.3f", value)


def overall_lines(run: DataFrame) -> DataFrame:
    """(ord, line): the table of the metrics over all queries."""
    each = F.posexplode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"metrics.overall.{m}").alias("v")) for m, name in METRICS.items()]))
    return run.select(each.alias("ord", "e")).select("ord", F.concat(F.lit("| "), "e.name", F.lit(" | "), _number(F.col("e.v")), F.lit(" |")).alias("line"))


def type_lines(run: DataFrame) -> DataFrame:
    """(query_type, line): a row of the table by type."""
    cells = F.concat(*[F.concat(F.lit(" "), _number(F.col(f"m.{m}")), F.lit(" |")) for m in METRICS])
    return run.select(F.explode("metrics.byQueryType").alias("query_type", "m")).select("query_type", F.concat(F.lit("| "), "query_type", F.lit(" |"), cells).alias("line"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_type, metric, a, b, delta) of two runs as text; '' is over all. A type that only one has is n/a in the other, without a difference."""
    rows = lambda run: run.select(F.explode(F.map_concat("metrics.byQueryType", F.create_map(F.lit(""), F.col("metrics.overall")))).alias("query_type", "m")).select("query_type", F.posexplode(F.array(*[F.col(f"m.{m}") for m in METRICS])).alias("k", "v"))
    both = rows(a).withColumnRenamed("v", "va").join(rows(b).withColumnRenamed("v", "vb"), ["query_type", "k"], "full")
    cell = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(_number(F.col(c)))
    d = F.col("vb") - F.col("va")
    delta = F.when(d.isNull(), "—").when(d == 0, "·").otherwise(F.format_string("%+.3f", d))
    return both.select("query_type", F.element_at(F.array(*map(F.lit, METRICS.values())), F.col("k") + 1).alias("metric"), cell("va").alias("a"), cell("vb").alias("b"), delta.alias("delta"))


def report(run: DataFrame) -> str:
    """A run as Markdown; what comes to the driver is one run's summary."""
    r = run.select(*RUN_FIELDS).first()
    lines = [f"# Evaluation report: {r['runId']}", "", *[f"- {f}: `{r[f]}`" for f in RUN_FIELDS[1:]], "", "## Overall", "", "| metric | value |", "| --- | --- |"]
    lines += [x["line"] for x in overall_lines(run).orderBy("ord").collect()]
    lines += ["", "## By query type", "", "| type |" + "".join(f" {n} |" for n in METRICS.values()), "| --- |" + " --- |" * len(METRICS)]
    return "\n".join(lines + [x["line"] for x in type_lines(run).orderBy("query_type").collect()]) + "\n"


def comparison(a: DataFrame, b: DataFrame) -> str:
    """Two runs side by side as Markdown, with a warning where they were not made of the same judgements or texts."""
    x, y = a.select(*RUN_FIELDS).first(), b.select(*RUN_FIELDS).first()
    lines = [f"# Comparison: {x['runId']} and {y['runId']}", ""]
    lines += [f"> warning: {name} differ; the differences don't compare like with like." for f, name in (("goldenSet", "judgements"), ("corpusSha", "corpora")) if x[f] != y[f]]
    lines += ["", "| type | metric | a | b | difference |", "| --- | --- | --- | --- | --- |"]
    order = {n: k for k, n in enumerate(METRICS.values())}
    rows = sorted(compared(a, b).collect(), key=lambda r: (r["query_type"], order[r["metric"]]))
    return "\n".join(lines + [f"| {r['query_type'] or 'overall'} | {r['metric']} | {r['a']} | {r['b']} | {r['delta']} |" for r in rows]) + "\n"


def suppression_rules(text: str) -> tuple[list[dict[str, str]], list[str]]:
    """Rules (rule, path, reason) of a file with `suppressions:` and a list of maps, and what is wrong with the others: each needs all three."""
    found, problems, entry = [], [], None
    entries: list[dict[str, str]] = []
    inside = False
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if not bare.startswith((" ", "-")):
            inside = bare == "suppressions:"
            continue
        if not inside:
            continue
        part = bare.strip()
        if part.startswith("- "):
            entry, part = {}, part[2:]
            entries.append(entry)
        key, sep, value = part.partition(":")
        if entry is None or not sep:
            return [], [f"line {n}: not a list of rules"]
        entry[key.strip()] = value.strip().strip("\"'")
    for i, e in enumerate(entries, 1):
        if not e.get("rule") or not e.get("path"):
            problems.append(f"entry {i}: needs rule and path")
        elif not e.get("reason"):
            problems.append(f"entry {i}: {e['rule']} on {e['path']} has no reason")
        else:
            found.append({k: e[k] for k in ("rule", "path", "reason")})
    return found, problems


def write_baseline(findings: DataFrame, path: str) -> None:
    """The different (rule_id, rel_path) of the findings as JSON lines, sorted by path and rule."""
    findings.select("rule_id", "rel_path").distinct().orderBy("rel_path", "rule_id").write.mode("errorifexists").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, rel_path); lines without both are left out."""
    return spark.read.schema("rule_id string, rel_path string").json(path).dropna()
