"""Versions of an index by buckets of its files: a version rewrites the buckets that a change touches, and shares all others with the versions before.

The data of a version lie in a folder of its own, by table and bucket. Its manifest, written last and in one file, says for each table in which version's folder each bucket is;
a version without a manifest is read by nobody. Readers of an older version go on with the files that they know.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, name string, bucket int, held string"


def bucket_of(parent: str, buckets: int):
    return F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """Where the buckets of a version are, the greatest one if none is named; None where nothing was committed."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifests")
        version = version or rows.agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return rows.where(F.col("version") == version)


def read_version(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version. Of each folder only the buckets that the version holds there are read; what is gathered is a row for each bucket of each table."""
    rows = manifest(spark, path, version)
    places: dict[str, dict[str, list[int]]] = {}
    for r in rows.collect() if rows is not None else []:
        places.setdefault(r["name"], {}).setdefault(r["held"], []).append(r["bucket"])
    out = {}
    for name, held in places.items():
        for at, buckets in sorted(held.items()):
            part = spark.read.parquet(f"{path}/data/{at}/{name}").where(F.col("bucket").isin(*sorted(buckets)))
            out[name] = part if name not in out else out[name].unionByName(part)
    return out


def _write(tables: dict[str, DataFrame], path: str, version: str, shared: DataFrame | None) -> None:
    spark = next(iter(tables.values())).sparkSession
    places = shared
    for name, df in tables.items():
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{version}/{name}")
        if not df.isEmpty():
            mine = spark.read.parquet(f"{path}/data/{version}/{name}").select("bucket").distinct()
            mine = mine.select(F.lit(version).alias("version"), F.lit(name).alias("name"), "bucket", F.lit(version).alias("held"))
            places = mine if places is None else places.unionByName(mine)
    if places is None:
        raise ValueError("a version needs a row")
    places.coalesce(1).write.mode("overwrite").json(f"{path}/manifests/{version}")  # a row for each bucket


def first_version(tables: dict[str, DataFrame], path: str, version: str, parent: str = "file_id", buckets: int = 1024) -> None:
    """Writes all tables, each of which has the parent's column, as a version."""
    _write({name: df.withColumn("bucket", bucket_of(parent, buckets)) for name, df in tables.items()}, path, version, None)


def next_version(spark: SparkSession, path: str, version: str, fresh: dict[str, DataFrame], gone: DataFrame, parent: str = "file_id", buckets: int = 1024, after: str | None = None) -> int:
    """Writes a version in which the rows of changed and gone parents are left out and those of the fresh tables come in, after the greatest version or the one named; how many
    buckets it wrote. The numbers of the touched buckets are gathered, `buckets` at most."""
    before = manifest(spark, path, after)
    if before is None:
        raise ValueError("there is no version before")
    after = before.first()["version"]
    changed = gone.select(parent)
    for df in fresh.values():
        changed = changed.unionByName(df.select(parent))
    changed = changed.distinct()
    touched = sorted(r["b"] for r in changed.select(bucket_of(parent, buckets).alias("b")).distinct().collect())
    if not touched:
        before.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{path}/manifests/{version}")
        return 0
    old, tables = read_version(spark, path, after), {}
    for name, df in fresh.items():
        new = df.withColumn("bucket", bucket_of(parent, buckets))
        stay = old[name].where(F.col("bucket").isin(*touched)).join(changed, parent, "left_anti") if name in old else None
        tables[name] = new if stay is None else stay.unionByName(new)
    shared = before.where(~F.col("bucket").isin(*touched) | ~F.col("name").isin(*fresh)).withColumn("version", F.lit(version))
    _write(tables, path, version, shared)
    return len(touched)
