"""Symbol references and links between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import resolve_path


def usages(refs: DataFrame, symbol: str, project_id: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """References to one symbol, definitions first."""
    found = refs.where(F.col("symbol") == symbol)
    found = found if project_id is None else found.where(F.col("project_id") == project_id)
    found = found.where(F.col("kind").isin(*kinds)) if kinds else found
    return found.withColumn("is_definition", F.col("kind") == "def")


def fan_in(refs: DataFrame, least: int = 0) -> DataFrame:
    """(project_id, file_id, fan_in): how many other files refer to a symbol that the file defines.

    Definitions and references are made distinct first, so a symbol's join has a row per file and not per occurrence.
    """
    defs = refs.where("kind = 'def'").select("project_id", "symbol", "file_id").distinct()
    uses = refs.where("kind <> 'def'").select("project_id", "symbol", F.col("file_id").alias("user")).distinct()
    both = defs.join(uses, ["project_id", "symbol"]).where(F.col("user") != F.col("file_id"))
    return both.groupBy("project_id", "file_id").agg(F.count_distinct("user").alias("fan_in")).where(F.col("fan_in") >= least)


def inbound_links(links: DataFrame) -> DataFrame:
    """(to_path, inbound): the different files that link to a path."""
    return links.groupBy("to_path").agg(F.count_distinct("from_file_id").alias("inbound"))


def broken_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links to a path that is not among paths(path)."""
    return links.join(paths.select(F.col("path").alias("to_path")).distinct(), "to_path", "left_anti")


def html_links(pages: DataFrame) -> DataFrame:
    """(from_file_id, to_path, position) of the href attributes of pages(page_id, html), without fragments; targets of fragments alone are left out."""
    return pages.select(F.col("page_id").alias("from_file_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), 1)).alias("position", "to_path"))


LINK = r'\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+"[^"]*")?\s*\)'


def _kind(target: Column) -> Column:
    return F.when(target.startswith("#"), "anchor").when(target.rlike(r"^(?i:[a-z][a-z0-9+.-]*:|//)"), "external").otherwise("internal")


def markdown_links(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, line, label, target, kind) of [label](target "title") in Markdown, with kind internal, external or anchor."""
    line = files.select("file_id", F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    each = line.withColumn("_both", F.explode(F.arrays_zip(F.regexp_extract_all("_line", F.lit(LINK), 1).alias("label"), F.regexp_extract_all("_line", F.lit(LINK), 2).alias("target"))))
    target = F.col("_both.target")
    return each.select("file_id", (F.col("_at") + 1).alias("line"), F.col("_both.label").alias("label"), target.alias("target"), _kind(target).alias("kind"))


def path_mentions(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, line, target) of internal links and of back-quoted words that look like paths, once per line.

    A line's targets are made distinct where it is read. Only those of ids that several rows share are compared across rows.
    """
    ids = F.col("file_id").alias("_id")
    shared = files.select(ids).groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if shared.isEmpty():
        return _mentions(files, text)
    same = F.col("file_id").eqNullSafe(F.col("_id"))
    return _mentions(files.join(shared, same, "left_anti"), text).unionByName(_mentions(files.join(shared, same, "left_semi"), text).distinct())


def _mentions(files: DataFrame, text: str) -> DataFrame:
    line = files.select("file_id", F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    linked = F.filter(F.regexp_extract_all("_line", F.lit(LINK), 2), lambda t: _kind(t) == "internal")
    path = lambda t: t.contains("/") & ~t.rlike(r"\s") & (F.length(t) <= 200) & t.rlike(r"\.[A-Za-z][A-Za-z0-9]*$")
    quoted = F.filter(F.regexp_extract_all("_line", F.lit("`([^`]+)`"), 1), path)
    return line.select("file_id", (F.col("_at") + 1).alias("line"), F.explode(F.array_distinct(F.concat(linked, quoted))).alias("target"))


def resolve_suffix(refs: DataFrame, files: DataFrame) -> DataFrame:
    """The refs (project_id, ref) with rel_path: the file of that path, or the shortest whose path ends in /ref; null if none.

    A file is offered under each suffix of its path, so the join is on equality.
    """
    parts = F.split("rel_path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    offered = files.select("project_id", "rel_path", F.explode(suffix).alias("ref"))
    best = offered.groupBy("project_id", "ref").agg(F.min(F.struct(F.length("rel_path").alias("n"), F.col("rel_path"))).alias("_best"))
    return refs.join(best, ["project_id", "ref"], "left").withColumn("rel_path", F.col("_best.rel_path")).drop("_best")


def coverage(hits: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """Chunks that use what the hits export: (project_id, file_id, line, symbol, hit_rank), at most twice the limit, in the order of the hits.

    hits: project_id, file_id, rank, exports (array). They are a ranked list's top, so the side that joins the references is small.
    """
    exported = hits.select("project_id", F.col("file_id").alias("_own"), F.col("rank").alias("hit_rank"), F.explode("exports").alias("symbol"))
    found = refs.where("kind <> 'def'").join(exported, ["project_id", "symbol"]).where(F.col("file_id") != F.col("_own"))
    once = found.groupBy("project_id", "file_id", "line").agg(F.min(F.struct("hit_rank", "symbol")).alias("_b"))
    return once.select("project_id", "file_id", "line", F.col("_b.symbol").alias("symbol"), F.col("_b.hit_rank").alias("hit_rank")).orderBy("hit_rank", "project_id", "file_id", "line").limit(2 * limit)


def scope_of(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The paths with project_id of the deepest active project above them, prefix (what follows its root, ending in /) and scope: project, subtree or all.

    A path is held against its own ancestors, one row each, so the join is on equality.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = paths.select("path", F.explode(up).alias("root"))
    active = projects.where("active").select("project_id", "root")
    best = above.join(active, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "root", "project_id")).alias("_b"))
    out = paths.join(best, "path", "left")
    rest = F.expr("substring(path, length(_b.root) + 2)")
    scope = F.when(F.col("_b").isNull(), "all").when(rest == "", "project").otherwise("subtree")
    return out.withColumn("scope", scope).withColumn("prefix", F.when(scope == "subtree", F.concat(rest, F.lit("/")))).withColumn("project_id", F.col("_b.project_id")).drop("_b")


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def usage_snippets(refs: DataFrame, files: DataFrame, chunks: DataFrame, symbol: str, project_id: str | None = None) -> DataFrame:
    """usages() of a symbol, each with the path of its file and the lines and text of its chunk: definitions first, then by path and line.

    The symbol's references are few, so that they meet the tables as the small side of equi-joins.
    """
    found = usages(refs, symbol, project_id).select("symbol", "project_id", "file_id", "chunk_id", "line", "kind", "is_definition")
    at = found.join(files.select("file_id", "rel_path"), "file_id")
    body = chunks.select("chunk_id", F.col("start_line").alias("chunk_start"), F.col("end_line").alias("chunk_end"), "document")
    return at.join(body, "chunk_id").orderBy(F.desc("is_definition"), "kind", "rel_path", "line", "chunk_id")


def _lowest(target: Column) -> Column:
    """How far a relative path climbs above where it starts: 0 or less."""

    def step(s: Column, part: Column) -> Column:
        now = s["now"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(now.alias("now"), F.least(s["least"], now).alias("least"))

    return F.aggregate(F.split(target, "/+"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), step)["least"]


def resolve_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(project_id, rel_path, line, target) with `resolved`: the path that the target has from the document's folder, else from the root, else as
    the suffix of a file's path; null if none. Targets in a home folder (~) are left out; what leads out of the project isn't looked up.
    """
    kept = refs.where(~F.col("target").startswith("~"))
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    depth = F.size(F.filter(F.split(folder, "/"), lambda p: p != ""))
    bare = F.regexp_replace("target", "#.*$", "")
    here = F.when(_lowest(bare) + depth >= 0, resolve_path(folder, F.col("target")))
    root = F.when(_lowest(bare) >= 0, resolve_path(F.lit(""), F.col("target")))
    known = files.select("project_id", F.col("rel_path").alias("_path")).distinct()
    at = kept.withColumn("_here", here).withColumn("_root", root)
    for name in ("_here", "_root"):
        at = at.join(known.select("project_id", F.col("_path").alias(name), F.lit(True).alias(f"{name}_is")), ["project_id", name], "left")
    suffix = resolve_suffix(kept.select("project_id", F.col("target").alias("ref")).distinct(), files.select("project_id", "rel_path")).select("project_id", F.col("ref").alias("target"), F.col("rel_path").alias("_suffix"))
    out = at.join(suffix, ["project_id", "target"], "left")
    found = F.coalesce(F.when(F.col("_here_is"), F.col("_here")), F.when(F.col("_root_is"), F.col("_root")), F.col("_suffix"))
    return out.withColumn("resolved", found).select(*refs.columns, "resolved")


def stale_refs(resolved: DataFrame) -> DataFrame:
    """A finding for each reference of resolve_refs() that leads nowhere."""
    return resolved.where(F.col("resolved").isNull()).select("project_id", "rel_path", F.lit("quality/stale-ref").alias("rule_id"), F.lit("warning").alias("severity"), "target", F.col("line").alias("line_from"), F.col("line").alias("line_to"))


def common_prefix(roots: DataFrame, root: str = "root") -> DataFrame:
    """One row with `prefix`, the folders that all roots share: the same as those that the least and the greatest share. Empty for fewer than two roots, and
    where only the leading slash is shared."""
    ends = roots.agg(F.count("*").alias("n"), F.min(F.split(root, "/")).alias("lo"), F.max(F.split(root, "/")).alias("hi"))
    same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
    n = F.coalesce(F.array_position(same, False).cast("int") - 1, F.lit(0))
    n = F.when(F.array_contains(same, False), n).otherwise(F.least(F.size("lo"), F.size("hi")))
    return ends.select(F.when((F.col("n") > 1) & (n > 1), F.array_join(F.slice("lo", 1, F.greatest(n, F.lit(1))), "/")).otherwise("").alias("prefix"))
