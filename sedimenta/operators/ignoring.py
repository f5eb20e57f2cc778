"""Layered ignore rules: those of the root, and those of every folder that has a rule file of its own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: This library's own rule file; where another name is in use, pass `rule_files(name)`.
OWN_RULES = ".sedimentaignore"


# The names of rule files, in the order in which they are read, and the folders of tools that the root layer takes in again.
def rule_files(own: str = OWN_RULES) -> list[str]:
    return [".gitignore", own, ".cursorignore", ".aiderignore", ".ignore"]


TAKEN_IN = ["!.claude/", "!.claude/**", "!.cursor/", "!.cursor/**", "!.aider/", "!.aider/**"]
RULE = "layer string, turn int, pattern string, again boolean, folders boolean"


def _part(glob: str) -> str:
    """One part of a path, between slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression over a path relative to the layer, whether it takes in again, whether for folders only); None for blanks and comments."""
    text = line.rstrip("\r\n")
    text = text if text.endswith("\\ ") else text.rstrip(" ")
    if not text or text.startswith("#"):
        return None
    again = text.startswith("!")
    text = text.removeprefix("!")
    folders = text.endswith("/")
    parts = text.rstrip("/").split("/")
    anchored = len(parts) > 1
    parts = parts[1:] if parts[0] == "" else parts
    if not any(parts):
        return None
    out = "" if anchored and parts[0] != "**" else "(?:.*/)?"
    parts = parts[1:] if parts[0] == "**" else parts
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _part(part) + ("" if last else "/")
    return f"(?i)^{out}$", again, folders


def ignore_rules(spark: SparkSession, layers: dict[str, list[str]], built_in: list[str] = TAKEN_IN) -> DataFrame:
    """(layer, turn, pattern, again, folders) of rule lines by folder; '' is the root, which begins with the built-in rules."""
    rows = []
    for layer, lines in layers.items():
        for turn, line in enumerate([*(built_in if layer == "" else []), *lines]):
            if found := ignore_rule(line):
                rows.append((layer, turn, *found))
    return spark.createDataFrame(rows, RULE)


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(rel_path, ...) with `is_ignored`: whether the root layer, or that of any folder above, ignores the path or a folder on the way to it.

    In a layer the last rule that fits decides; what lies in an ignored folder can't be taken in again, and no layer takes in what another ignores. A
    path is held against the layers above itself, a row for each of them and each folder below it, so the join is on equality.
    """
    parts = F.split("rel_path", "/")
    upto = lambda a, n: F.array_join(F.slice(parts, a, n), "/")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.when(i == 0, "").otherwise(upto(1, F.greatest(i, F.lit(1)))).alias("layer"), i.alias("depth"))))
    layers = rules.select("layer").distinct()
    each = paths.select("rel_path").distinct().withColumn("_a", above).select("rel_path", "_a.*").join(layers, "layer")
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - F.col("depth")), lambda n: F.struct(upto(F.col("depth") + 1, n).alias("path"), (n < F.size(parts) - F.col("depth")).alias("folder"))))
    each = each.withColumn("_s", step).select("rel_path", "layer", "_s.*")
    hit = each.join(rules, "layer").where(F.rlike("path", F.col("pattern")) & (~F.col("folders") | F.col("folder")))
    last = hit.groupBy("rel_path", "layer", "path").agg(F.max_by("again", "turn").alias("again"))
    gone = last.where(~F.col("again")).select("rel_path").distinct().withColumn("_gone", F.lit(True))
    return paths.join(gone, "rel_path", "left").withColumn("is_ignored", F.coalesce("_gone", F.lit(False))).drop("_gone")
