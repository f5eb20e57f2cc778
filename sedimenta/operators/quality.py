"""Findings: overlap with chunks, rules, suppression, roll-up and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import glob_to_regex, lines

SEVERITIES = ("error", "warning", "info")
# Weights by severity and thresholds of the rules.
WEIGHTS = {"error": 3, "warning": 2, "info": 1}
GOD_LINES, GOD_EXPORTS, LONG_PARAMETERS, DEEP_NESTING, COMPLEX, FAN_OUT, FAN_IN = 400, 10, 5, 4, 10, 20, 25


def ordinal(severity: Column) -> Column:
    """0 for the worst; unknown ones come last."""
    return reduce(lambda done, s: done.when(severity == s[1], s[0]), enumerate(SEVERITIES), F).otherwise(len(SEVERITIES))


def weight(severity: Column) -> Column:
    return reduce(lambda done, s: done.when(severity == s, WEIGHTS[s]), SEVERITIES, F).otherwise(0)


def overlap(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Lines that two inclusive ranges share; 0 or less for none."""
    return F.least(hi, other_hi) - F.greatest(lo, other_lo) + 1


def overlapping(chunks: DataFrame, findings: DataFrame, file: str = "file_id", bucket: int = 256) -> DataFrame:
    """Pairs of a chunk (start_line, end_line) and a finding (line_from, line_to) of one file that share a line, with `shared`.

    Both sides are dealt into buckets of lines, so a file with very many chunks isn't one join key; a pair is told in the bucket where it begins.
    """
    a = chunks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))))
    b = findings.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line_from") / bucket), F.floor(F.col("line_to") / bucket))))
    shared = overlap(F.col("start_line"), F.col("end_line"), F.col("line_from"), F.col("line_to"))
    first = F.floor(F.greatest("start_line", "line_from") / bucket)
    return a.join(b, [file, "_b"]).withColumn("shared", shared).where((F.col("shared") > 0) & (F.col("_b") == first)).drop("_b")


def best_overlap(chunks: DataFrame, functions: DataFrame, key: str, ordinal_column: str, file: str = "file_id") -> DataFrame:
    """Per chunk the function that shares most lines with it; the earlier one on ties. Found by a maximum, without a sort."""
    both = overlapping(chunks, functions, file)
    rest = [c for c in functions.columns if c != file]
    best = both.groupBy(key).agg(F.max_by(F.struct("shared", *rest), F.struct(F.col("shared"), -F.col(ordinal_column))).alias("_best"))
    return best.select(key, "_best.*")


def file_findings(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, rule_id, severity, value) of files (file_id, text, n_exports, n_imports, max_params, max_nesting, max_ccn)."""
    loc = F.size(F.filter(lines(F.col(text)), lambda x: F.trim(x) != ""))
    rule = lambda name, ok, severity, value: F.when(ok, F.struct(F.lit(name).alias("rule_id"), severity.alias("severity"), value.cast("long").alias("value")))
    found = F.array_compact(F.array(
        rule("quality/god-file", (loc > GOD_LINES) & (F.col("n_exports") > GOD_EXPORTS), F.lit("warning"), loc),
        rule("quality/high-fan-out", F.col("n_imports") > FAN_OUT, F.lit("info"), F.col("n_imports")),
        rule("quality/long-params", F.col("max_params") > LONG_PARAMETERS, F.lit("info"), F.col("max_params")),
        rule("quality/deep-nesting", F.col("max_nesting") >= DEEP_NESTING, F.when(F.col("max_ccn") > COMPLEX, "warning").otherwise("info"), F.col("max_nesting")),
    ))
    return files.select("file_id", F.explode(found).alias("_f")).select("file_id", "_f.*")


def suppressed(findings: DataFrame, rules: list[tuple[str, str]], baseline: DataFrame) -> DataFrame:
    """The findings (rule_id, rel_path, ...) with `suppressed_by`: rule, baseline or null.

    Rules are (rule id or *, path glob) from a configuration file and become one expression; the baseline (rule_id, rel_path) is joined on equality.
    """
    hit = lambda r: (F.lit(True) if r[0] == "*" else F.col("rule_id") == r[0]) & F.col("rel_path").rlike(glob_to_regex(r[1]))
    by_rule = reduce(Column.__or__, map(hit, rules), F.lit(False))
    marks = baseline.select("rule_id", "rel_path").distinct().withColumn("_marked", F.lit(True))
    return findings.join(marks, ["rule_id", "rel_path"], "left").withColumn("suppressed_by", F.when(by_rule, "rule").when(F.col("_marked"), "baseline")).drop("_marked")


def rule_rollup(findings: DataFrame) -> DataFrame:
    """(rule_id, n, n_files, worst) per rule."""
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES], F.lit("unknown")), F.min(ordinal(F.col("severity"))) + 1)
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"), worst.alias("worst"))


def file_ranking(findings: DataFrame, limit: int) -> DataFrame:
    """The files of greatest weight: (file_id, rel_path, weight, n). Totals count every finding."""
    return findings.groupBy("file_id", "rel_path").agg(F.sum(weight(F.col("severity"))).alias("weight"), F.count("*").alias("n")).orderBy(F.desc("weight"), "rel_path").limit(limit)


def attached(results: DataFrame, findings: DataFrame, functions: DataFrame, most: int = 50) -> DataFrame:
    """results (chunk_id, file_id, start_line, end_line) with `findings`, those whose lines overlap, the worst first and then by line, and `function`, the one
    that shares most lines. Results are a ranked list's top; a chunk shows `most` findings and tells in n_findings how many there are.
    """
    at = results.select("chunk_id", "file_id", "start_line", "end_line")
    each = overlapping(at, findings)
    turn = F.row_number().over(Window.partitionBy("chunk_id").orderBy(ordinal(F.col("severity")), "line_from", "rule_id"))
    shown = each.withColumn("_n", turn)
    entry = F.struct(F.col("_n"), "rule_id", "severity", "line_from", "line_to")
    lists = shown.groupBy("chunk_id").agg(F.count("*").alias("n_findings"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("_n") <= most, entry)))).alias("_f"))
    lists = lists.select("chunk_id", "n_findings", F.transform("_f", lambda e: e.dropFields("_n")).alias("findings"))
    best = best_overlap(at, functions, "chunk_id", "ordinal").select("chunk_id", F.col("ordinal").alias("function"))
    return results.join(lists, "chunk_id", "left").join(best, "chunk_id", "left").na.fill(0, ["n_findings"])


def fan_in_findings(counts: DataFrame, least: int = FAN_IN) -> DataFrame:
    return counts.where(F.col("fan_in") > least).select("file_id", F.lit("quality/high-fan-in").alias("rule_id"), F.lit("info").alias("severity"))


def report(stored: DataFrame, at_query: list[DataFrame], files: DataFrame, rules: list[tuple[str, str]], baseline: DataFrame) -> DataFrame:
    """The findings (file_id, rule_id, severity) of the analyzers and of the rules of query time, of files that are in the index, with suppressed_by."""
    each = reduce(DataFrame.unionByName, [df.select("file_id", "rule_id", "severity") for df in (stored, *at_query)])
    return suppressed(each.join(files.select("file_id", "rel_path"), "file_id"), rules, baseline)


def metadata_union(chunks: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, n_exports, n_imports): how many different names the chunks of a file export and import."""
    names = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    both = F.concat(F.transform(names("exports"), lambda x: F.struct(F.lit("e").alias("kind"), x.alias("name"))), F.transform(names("imports"), lambda x: F.struct(F.lit("i").alias("kind"), x.alias("name"))))
    each = chunks.select(file, F.explode_outer(both).alias("_x"))  # a null where a chunk has neither, so that its file has a row
    return each.select(file, "_x.*").distinct().groupBy(file).agg(F.count_if(F.col("kind") == "e").alias("n_exports"), F.count_if(F.col("kind") == "i").alias("n_imports"))


def shown_findings(findings: DataFrame, most: int = 50) -> DataFrame:
    """At most `most` findings per file, the worst first, then by line."""
    turn = F.row_number().over(Window.partitionBy("file_id").orderBy(ordinal(F.col("severity")), "line_from", "rule_id"))
    return findings.withColumn("turn", turn).where(F.col("turn") <= most)
