"""Sources and sinks: files of a workspace, judgements, runs, and reports of other tools."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What marks a folder as a project, and its rank.
MARKERS = {
    ".git": 0, ".idea": 1, ".vscode": 1, "package.json": 2, "pyproject.toml": 2, "Cargo.toml": 2, "go.mod": 2, "pom.xml": 2, "build.gradle": 2,
    "build.gradle.kts": 2, "Makefile": 2, "CMakeLists.txt": 2,
}
# Fixed value: the ending of files that mark a folder as a project too, with the rank of .vscode.
MARKER_ENDING, MARKER_ENDING_RANK = ".code-workspace", 1


def workspace_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size, mtime, text) below a root; text is null where it isn't UTF-8."""
    top = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(top), F.lit("\\E"))), -1)
    return raw.select("path", rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.try_validate_utf8(F.col("content")).cast("string").alias("text"))


def projects_of(paths: DataFrame, depth: int = 4) -> DataFrame:
    """(root, marker) of the topmost folders that hold a marker, at most `depth` deep; of several markers the one of least rank."""
    leaf, parent = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    inner = paths.select(parent.alias("root"), leaf.alias("marker")).where(_is_marker(F.col("marker")))
    found = inner.where(F.size(F.split("root", "/")) <= depth).groupBy("root").agg(F.min_by("marker", F.struct(_rank(F.col("marker")), F.col("marker"))).alias("marker"))
    parts = F.split("root", "/")
    above = found.select(F.col("root").alias("_r"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root")).where("_r <> root")
    inside = above.join(found.select("root"), "root", "left_semi").select(F.col("_r").alias("root")).distinct()
    return found.join(inside, "root", "left_anti")


def _is_marker(name: Column) -> Column:
    return name.isin(*MARKERS) | name.endswith(MARKER_ENDING)


def _rank(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), name), F.lit(MARKER_ENDING_RANK))


def absorbed_markers(paths: DataFrame, root: str, skipped: list[str], depth: int = 4) -> DataFrame:
    """(rel_path, marker) of the topmost folders below a project's root that hold a marker of their own, at most `depth` deep; not those inside hidden or skipped folders."""
    rel = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    inner = paths.where(F.col("path").startswith(root.rstrip("/") + "/")).select(rel.alias("_r"))
    at = inner.select(F.regexp_replace("_r", "/?[^/]*$", "").alias("rel_path"), F.substring_index("_r", "/", -1).alias("marker")).where((F.col("rel_path") != "") & _is_marker(F.col("marker")))
    parts = F.split("rel_path", "/")
    at = at.where((F.size(parts) <= depth) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*skipped)))
    found = at.groupBy("rel_path").agg(F.min_by("marker", F.struct(_rank(F.col("marker")), F.col("marker"))).alias("marker"))
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = found.select("rel_path", F.explode(up).alias("up")).where("up <> rel_path")
    inside = above.join(found.select(F.col("rel_path").alias("up")), "up", "left_semi").select("rel_path").distinct()
    return found.join(inside, "rel_path", "left_anti").orderBy("rel_path")


QREL = "query_id string, query string, query_type string, rel_path string, start_line int, end_line int, relevance int, provenance string, notes string"


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements in JSON lines; blank lines and those that begin with # or // are left out, and a bad one is an error that shows it."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("_at", "value")).where(~F.col("value").rlike(r"^\s*(#|//|$)"))
    q = raw.select(F.concat(F.lit("line "), F.col("_at") + 1, F.lit(": "), "value").alias("value"), F.from_json("value", QREL).alias("q"))
    ok = (
        F.col("q.query_id").isNotNull() & F.col("q.rel_path").isNotNull() & F.col("q.query_type").isin("literal", "symbol", "concept", "mixed", "prose") & (F.col("q.start_line") >= 1)
        & (F.col("q.end_line") >= F.col("q.start_line")) & F.col("q.relevance").isin(0, 1, 2)
    )
    return q.withColumn("q", F.when(F.coalesce(ok, F.lit(False)), F.col("q")).otherwise(F.raise_error(F.concat(F.lit("bad judgement: "), "value")).cast(q.schema["q"].dataType))).select("q.*")


def trec_lines(run: DataFrame, tag: str) -> DataFrame:
    """One column of lines `query Q0 document rank score tag`."""
    return run.select(F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("doc").cast("string"), F.col("rank").cast("int"), F.col("score").cast("double"), F.lit(tag)).alias("value"))


def read_settings(text: str, table: str) -> dict[str, str]:
    """One table of strings of a TOML text; anything else is an error."""
    found = tomllib.loads(text)
    if set(found) != {table} or not all(isinstance(v, str) for v in found[table].values()):
        raise ValueError(f"expected strings in [{table}]")
    return found[table]


def semgrep_findings(reports: DataFrame, report: str = "report") -> DataFrame:
    """(file_id, rule_id, severity, message, line_from, line_to) of JSON reports; a bad one has none, and rows without rule or lines are left out."""
    kind = "results array<struct<check_id:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string>>>"
    r = reports.select("file_id", F.explode(F.from_json(report, kind)["results"]).alias("r"))
    sev = F.element_at(F.create_map(*[F.lit(x) for x in ("ERROR", "error", "WARNING", "warning", "INFO", "info")]), F.upper("r.extra.severity"))
    out = r.select("file_id", F.col("r.check_id").alias("rule_id"), F.coalesce(sev, F.lit("info")).alias("severity"), F.col("r.extra.message").alias("message"), F.col("r.start.line").alias("line_from"), F.col("r.end.line").alias("line_to"))
    return out.dropna(subset=["rule_id", "line_from", "line_to"])


def ast_grep_findings(reports: DataFrame, report: str = "report") -> DataFrame:
    """As semgrep_findings(), for a JSON array of matches whose lines count from 0."""
    kind = "array<struct<ruleId:string,severity:string,message:string,range:struct<start:struct<line:int>,end:struct<line:int>>>>"
    r = reports.select("file_id", F.explode(F.from_json(report, kind)).alias("r"))
    sev = F.when(F.lower("r.severity").isin("error", "warning"), F.lower("r.severity")).otherwise("info")
    out = r.select("file_id", F.col("r.ruleId").alias("rule_id"), sev.alias("severity"), F.col("r.message").alias("message"), (F.col("r.range.start.line") + 1).alias("line_from"), (F.col("r.range.end.line") + 1).alias("line_to"))
    return out.dropna(subset=["rule_id", "line_from", "line_to"])


def lizard_metrics(reports: DataFrame, report: str = "report") -> DataFrame:
    """(file_id, name, nloc, ccn, tokens, parameters, line_from, line_to) of CSV reports, a line per function; lines without numbers are left out."""
    kind = "nloc int, ccn int, tokens int, parameters int, length int, location string, file string, name string, long_name string, line_from int, line_to int"
    r = reports.select("file_id", F.explode(F.split(report, "\r?\n")).alias("_l")).where("_l <> ''").select("file_id", F.from_csv("_l", kind).alias("r"))
    return r.select("file_id", "r.name", "r.nloc", "r.ccn", "r.tokens", "r.parameters", "r.line_from", "r.line_to").dropna(subset=["name", "nloc", "line_from", "line_to"])
