"""Tables of the index: upserts, deletes, classification of changes, inventories and compaction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The base with the rows of the delta in place of those with the same keys, and the delta's new ones."""
    return base.join(delta.select(keys).distinct(), keys, "left_anti").unionByName(delta)


def add_counters(base: DataFrame, delta: DataFrame, keys: list[str], counters: list[str], stamp: str) -> DataFrame:
    """Counters of equal keys are summed, and the latest stamp stays."""
    return base.unionByName(delta).groupBy(keys).agg(*[F.sum(c).alias(c) for c in counters], F.max(stamp).alias(stamp))


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows with new keys are added, one of each."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(keys), keys, "left_anti"))


def replace_children(base: DataFrame, delta: DataFrame, changed: DataFrame, parent: str = "file_id") -> DataFrame:
    """The base without the rows of the changed parents, and the delta."""
    return base.join(changed.select(parent).distinct(), parent, "left_anti").unionByName(delta)


def replace_chunks(base: DataFrame, delta: DataFrame, changed: DataFrame, parent: str = "file_id") -> DataFrame:
    """replace_children() for chunks: the symbol that a new chunk defines is its `symbol_def`, or where that is null the first of its `symbols`, if it has any."""
    return replace_children(base, delta.withColumn("symbol_def", F.coalesce("symbol_def", F.try_element_at("symbols", F.lit(1)))), changed, parent)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, parent: str = "file_id", keep: tuple[str, ...] = ("enrichments",)) -> dict[str, DataFrame]:
    """Each table without the rows of the parents that are gone; the tables in `keep` stay as they are."""
    ids = gone.select(parent).distinct()
    return {name: df if name in keep else df.join(ids, parent, "left_anti") for name, df in tables.items()}


def missing_enrichments(files: DataFrame, enrichments: DataFrame, analyzer: str, version: str) -> DataFrame:
    """Files without a complete result of this analyzer and version for their present content."""
    done = enrichments.where((F.col("analyzer") == analyzer) & (F.col("analyzer_version") == version) & (F.col("status") == "complete"))
    return files.join(done.select("file_id", "content_sha"), ["file_id", "content_sha"], "left_anti")


def classify_changes(listing: DataFrame, recorded: DataFrame, identity: str, key: str = "rel_path") -> DataFrame:
    """(key, state): new, deleted, excluded, changed or same. listing: key, content_sha, eligible; recorded: key, content_sha, embedding_identity, error."""
    a = listing.select(key, F.col("content_sha").alias("_now"), F.col("eligible"))
    b = recorded.select(key, F.col("content_sha").alias("_then"), "embedding_identity", "error", F.lit(True).alias("_old"))
    both = a.join(b, key, "full")
    same = F.col("error").isNull() & F.col("_now").eqNullSafe(F.col("_then")) & (F.col("embedding_identity") == identity)
    state = (
        F.when(F.col("eligible").isNull(), "deleted").when(~F.col("eligible") & F.col("_old"), "excluded").when(~F.col("eligible"), "ignored")
        .when(F.col("_old").isNull(), "new").when(same, "same").otherwise("changed")
    )
    return both.select(key, state.alias("state"))


def inventory(discovered: DataFrame, recorded: DataFrame, roots: list[str]) -> DataFrame:
    """(project_id, state): active, inactive, new, outside-roots or missing, of discovered(project_id, root) and recorded(project_id, root, active)."""
    a = discovered.select("project_id", F.col("root").alias("_found"))
    both = a.join(recorded.select("project_id", "root", "active"), "project_id", "full")
    inside = F.lit(False)
    for r in roots:
        inside = inside | (F.col("root") == r) | F.col("root").startswith(r.rstrip("/") + "/")
    state = (
        F.when(F.col("root").isNull(), "new").when(F.col("_found").isNotNull() & F.col("active"), "active").when(F.col("_found").isNotNull(), "inactive")
        .when(~inside, "outside-roots").otherwise("missing")
    )
    return both.select("project_id", state.alias("state"))


def register_collection(collections: DataFrame, name: str, identity: str) -> DataFrame:
    """The registry (name, identity) with this entry; a name under another identity is an error. One row is looked up."""
    held = collections.where(F.col("name") == name).select("identity").first()
    if held and held[0] != identity:
        raise ValueError(f"collection {name} belongs to {held[0]}")
    return collections if held else collections.unionByName(collections.sparkSession.createDataFrame([(name, identity)], "name string, identity string"))


def compact(spark: SparkSession, old: str, path: str, bytes_per_file: int = 256 << 20) -> dict[str, int]:
    """Rewrites a table of many small files into a new folder, and tells files and bytes before and after; readers switch to it when it is whole."""
    n, size = table_bytes(spark, old)
    spark.read.parquet(old).repartition(max(1, -(-size // bytes_per_file))).write.mode("errorifexists").parquet(path)
    after = table_bytes(spark, path)
    return {"files_before": n, "bytes_before": size, "files_after": after[0], "bytes_after": after[1]}


def delete_where(collections: dict[str, DataFrame], **equal) -> dict[str, DataFrame]:
    """Every registered collection without the rows whose columns have these values; a collection that lacks one of the columns stays as it is."""
    out = {}
    for name, df in collections.items():
        hit = F.lit(True)
        for column, value in equal.items():
            hit = hit & F.col(column).eqNullSafe(F.lit(value)) if column in df.columns else F.lit(False)
        out[name] = df.where(~hit)
    return out


def reconciled(recorded: DataFrame, listing: DataFrame, identity: str, key: str = "rel_path") -> dict[str, DataFrame]:
    """What a reconciliation does: `kept` rows of the record, and the keys to `index` and to `prune`. With its own result as the record it does nothing."""
    state = classify_changes(listing, recorded, identity, key)
    keys = lambda *names: state.where(F.col("state").isin(*names)).select(key)
    return {"kept": recorded.join(keys("same"), key, "left_semi"), "index": keys("new", "changed"), "prune": keys("deleted", "excluded")}


def backfill(files: DataFrame, enrichments: DataFrame, wanted: dict[str, str], after: dict[str, list[str]]) -> DataFrame:
    """(file_id, content_sha, analyzer) still to be run: what has no complete result for the present content, and what depends on one of these.

    wanted: analyzer -> version; after: analyzer -> the ones whose completion makes it run again, in any order.
    """
    done = enrichments.where("status = 'complete'").select("file_id", "content_sha", "analyzer", "analyzer_version").distinct()
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("analyzer"), F.lit(v).alias("analyzer_version")) for a, v in sorted(wanted.items())]))
    todo = files.select("file_id", "content_sha", asked.alias("_w")).select("file_id", "content_sha", "_w.*").join(done, ["file_id", "content_sha", "analyzer", "analyzer_version"], "left_anti")
    of = {a: sorted(b for b, first in after.items() if a in _all_before(b, after)) for a in wanted}
    next_ = F.element_at(F.create_map(*[x for a, bs in sorted(of.items()) for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))]), F.col("analyzer"))
    return todo.select("file_id", "content_sha", F.explode(F.concat(F.array("analyzer"), F.coalesce(next_, F.array().cast("array<string>")))).alias("analyzer")).distinct()


def _all_before(analyzer: str, after: dict[str, list[str]]) -> set[str]:
    found, todo = set(), list(after.get(analyzer, ()))
    while todo:
        a = todo.pop()
        if a not in found:
            found.add(a)
            todo += after.get(a, ())
    return found


def commit_index(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Writes a version of the index: its tables first, its marker last. What has no marker is read by nobody and written again by the next try."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/committed/{version}")


def committed_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the greatest version that has a marker; none where nothing was committed."""
    try:
        found = spark.read.schema("version string, tables array<string>").option("recursiveFileLookup", True).json(f"{path}/committed").orderBy(F.desc("version")).first()
    except AnalysisException:
        return {}
    return {name: spark.read.parquet(f"{path}/{found['version']}/{name}") for name in found["tables"]} if found else {}


def next_version(recorded: dict[str, DataFrame], fresh: dict[str, DataFrame], gone: DataFrame, parent: str = "file_id") -> dict[str, DataFrame]:
    """The tables of an incremental index: rows of changed and gone parents leave, those of the changed ones come."""
    changed = fresh["files"].select(parent).unionByName(gone.select(parent)).distinct()
    return {name: df.join(changed, parent, "left_anti").unionByName(fresh[name]) for name, df in recorded.items()}


def table_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) below a path."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count("*").alias("n"), F.sum("length").alias("b")).first()
    return r["n"], r["b"] or 0
