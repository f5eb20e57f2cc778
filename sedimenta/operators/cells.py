"""Unit vectors in cells around centroids: a stored index for search, and an exact similarity join that leaves out cells too far apart.

Angles on the sphere obey the triangle inequality: what lies in a cell of radius r is at least the angle to its centroid less r away. The centroids are fitted on a bounded
sample, which decides only how much is left out, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.vectors import to_unit
from sedimenta.operators.similarity import vector_topk
from sedimenta.sources.scratch import Scratch

SLACK = 1e-6
#: Rows of a block, where they aren't given; and how many rows of it meet how many visitors at once.
LEAST, LARGEST, RESIDENTS, VISITORS = 256, 1 << 16, 4096, 256


def fit_centroids(units: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centroids of spherical k-means over `sample` rows (u) at most, those of least hash; the sample and the cells are bounded, so that the driver can hold them."""
    rows = np.array([r["u"] for r in units.select("u").orderBy(F.xxhash64("u")).limit(sample).collect()], np.float64)
    if not len(rows):
        return np.zeros((0, 0))
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        length = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def in_cells(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with `cell`, that of the nearest centroid, and `away`, the angle to it. The vectors' column is u."""
    at = units.columns.index("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = angles(_matrix(batch.column(at)), centres)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], names=[*batch.schema.names, "cell", "away"])

    return units.mapInArrow(run, units.withColumn("cell", F.lit(0)).withColumn("away", F.lit(0.0)).schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows with u, the vector at length one; rows without a direction are left out."""
    return vectors.withColumn("u", to_unit(F.col(vector))).where("u is not null")


@dataclass(frozen=True)
class CellIndex:
    """Vectors by cell below a path, and of each cell the centroid, the radius and the number of rows."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    radii: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def build_cells(vectors: DataFrame, path: str, vector: str = "vector", cells: int | None = None, sample: int = 20_000) -> CellIndex:
    """Writes the rows in a folder for each cell; about sqrt(n) cells, 4096 at most."""
    spark = vectors.sparkSession
    units = unit_rows(vectors, vector)
    cells = cells or max(1, min(4096, math.isqrt(units.count())))
    centres = fit_centroids(units, cells, sample)
    dealt = in_cells(units, centres).drop("u") if len(centres) else units.drop("u").withColumn("cell", F.lit(0)).withColumn("away", F.lit(0.0))
    dealt.repartition("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    radii = np.zeros(len(centres))
    for r in spark.read.schema(dealt.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("away").alias("r")).collect():
        radii[r["cell"]] = r["r"]
    return CellIndex(spark, path, centres, radii)


def nearest_in_cells(index: CellIndex, query: list[float], k: int, probes: int = 8, exact: bool = True, where=None, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k rows of highest cosine (rounded to 6 places, ties to the smaller key). The `probes` nearest cells are read first; unless exact is false, then all
    others in which a row might reach the k-th score of these."""
    far = angles(np.array([query], float) / math.sqrt(sum(x * x for x in query)), index.centres)[0]
    order = np.argsort(far, kind="stable")
    search = lambda cells: vector_topk(index.rows().where(F.col("cell").isin(*cells)), query, k, where, key, vector).drop("cell", "away")
    some = search(order[:probes].tolist())
    if not exact or len(order) <= probes:
        return some
    some = Scratch(index.spark, "probed").keep(some, "some")
    least = [r["score"] for r in some.select("score").collect()]  # k rows
    bound = np.cos(np.maximum(0, far - index.radii - SLACK)) + SLACK
    rest = [int(c) for c in order[probes:] if len(least) < k or bound[c] >= min(least)]
    return some if not rest else some.unionByName(search(rest)).orderBy(F.desc("score"), key).limit(k)


def dealt_rows(vectors: DataFrame, threshold: float, key: str, group: str, vector: str, block: int | None, scratch: Scratch) -> DataFrame:
    """(cell, block, visits, key, grp, u): each vector once in a block of its cell, and as a visitor in the blocks of its cell before its own and of each later
    cell in which a vector may be similar to it. Rows whose key or group is null are left out.

    What visitors take is the number of rows times that of blocks. So blocks grow with the table, to LARGEST rows, and there are about two for each core.
    """
    units = unit_rows(vectors.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(vector)).where("key is not null and grp is not null"), vector).drop(vector)
    n = units.count()
    block = block or min(max(LEAST, -(-n // (2 * vectors.sparkSession.sparkContext.defaultParallelism))), LARGEST)
    centres = fit_centroids(units, max(1, min(4096, -(-n // block))))
    if not len(centres):
        return units.select(F.lit(0).alias("cell"), F.lit(0).alias("block"), F.lit(0).alias("visits"), "key", "grp", "u")
    placed = scratch.keep(in_cells(units, centres), "cells")
    radii, blocks = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # a row for each cell
        radii[r["cell"]], blocks[r["cell"]] = r["r"], -(-r["n"] // block)
    reach = math.acos(max(-1.0, min(1.0, threshold - SLACK))) + radii + SLACK  # scores are rounded before they are compared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            cell, own = batch.column(names.index("cell")).to_numpy(), batch.column(names.index("own")).to_numpy()
            for a in range(0, batch.num_rows, 64):  # a row has as many visits as there are blocks
                yield from visited(batch.slice(a, 64), cell[a : a + 64], own[a : a + 64])

    def visited(batch: pa.RecordBatch, cell: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = (angles(_matrix(batch.column("u")), centres) <= reach) & (np.arange(len(centres)) > cell[:, None])
        out = [(i, int(c), int(b), 0) for i, (c, b) in enumerate(zip(cell, own, strict=True))]
        out += [(i, int(c), b, 1) for i, (c, o) in enumerate(zip(cell, own, strict=True)) for b in range(int(o))]
        out += [(i, c, b, 1) for i, c in zip(*(x.tolist() for x in np.nonzero(near)), strict=True) for b in range(int(blocks[c]))]
        for a in range(0, len(out), 4096):
            at, to, block_no, visits = zip(*out[a : a + 4096], strict=True)
            taken = batch.select(["key", "grp", "u"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(block_no, pa.int32()), pa.array(visits, pa.int32()), *taken.columns], names=["cell", "block", "visits", "key", "grp", "u"])

    split = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks]), F.col("cell") + 1)
    shape = placed.select("cell", F.lit(0).alias("block"), F.lit(0).alias("visits"), "key", "grp", "u").schema
    return placed.withColumn("own", F.pmod(F.xxhash64("key"), split).cast("int")).mapInArrow(run, shape)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "chunk_id", group: str = "file_id", vector: str = "vector", block: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, similarity) with a < b, different groups and a cosine of at least the threshold; all of them, from those cells alone that may hold one.

    A task holds one block of a cell, about `block` rows however many a cell has, and the visitors stream past it. Vectors without a direction take no part.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "cells")
    dealt = dealt_rows(vectors, threshold, key, group, vector, block, scratch).repartition("cell", "block").sortWithinPartitions("cell", "block", "visits")
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, keys, groups, rows, visits in _met(batches):
            if keys is None:
                continue
            for lo, i, j, score in _tiles(held, keys, groups, rows, visits, threshold):
                left, right = held[0][i + lo], keys[j]
                swap = left > right
                yield pa.RecordBatch.from_arrays([_keys(np.where(swap, right, left), kind), _keys(np.where(swap, left, right), kind), pa.array(score)], names=["a", "b", "similarity"])

    names = dict(a=F.lit(None).cast(kind), b=F.lit(None).cast(kind), similarity=F.lit(0.0))
    shape = vectors.sparkSession.range(0).select(*[c.alias(n) for n, c in names.items()]).schema
    out = dealt.mapInArrow(run, shape)
    return out.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= threshold)


def similar_links(vectors: DataFrame, threshold: float, key: str = "chunk_id", group: str = "file_id", vector: str = "vector", block: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, n, total): links that connect what similar_pairs() connects, and with each how many pairs it stands for and the sum of their similarities.

    A vector has one link into each block that holds something similar to it, and each of the block's own vectors one to the block's component; so pairs are counted, not written.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "cells")
    dealt = dealt_rows(vectors, threshold, key, group, vector, block, scratch).repartition("cell", "block").sortWithinPartitions("cell", "block", "visits")
    kind = vectors.schema[key].dataType.simpleString()

    def row(a: np.ndarray, b: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_keys(a, kind), _keys(b, kind), pa.array(n), pa.array(total)], names=["a", "b", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.zeros(0, np.int64)  # of the block's own vectors, by place: the least place of each one's component
        for last, held, keys, groups, rows, visits in _met(batches):
            if keys is None:  # the block is done
                own = np.flatnonzero(root[: len(last)] != np.arange(len(last)))
                yield row(last[own], last[root[own]], np.zeros(len(own), np.int64), np.zeros(len(own)))
                root = np.zeros(0, np.int64)
                continue
            root = np.concatenate((root, np.arange(len(root), len(held[0]))))
            n, total, first = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.full(len(keys), -1)
            for lo, i, j, score in _tiles(held, keys, groups, rows, visits, threshold):
                parts = np.rint(score * 1e6) / 1e6
                good = parts >= threshold
                i, j, parts = i[good] + lo, j[good], parts[good]
                np.add.at(n, j, 1)
                np.add.at(total, j, parts)
                first[j] = i
                if not visits:  # the row itself lies in the block
                    i, j = np.concatenate((i, len(held[0]) - len(keys) + j)), np.concatenate((j, j))
                _join(root, i, j)
            some = np.flatnonzero(n)
            yield row(keys[some], held[0][first[some]], n[some], total[some])

    names = dict(a=F.lit(None).cast(kind), b=F.lit(None).cast(kind), n=F.lit(0).cast("long"), total=F.lit(0.0))
    return dealt.mapInArrow(run, vectors.sparkSession.range(0).select(*[c.alias(n) for n, c in names.items()]).schema)


def _join(root: np.ndarray, places: np.ndarray, by: np.ndarray) -> None:
    """Makes the components of places with the same `by` one, in `root`."""
    order = np.lexsort((root[places], by))
    at, by = root[places][order], by[order]
    differ = (by[1:] == by[:-1]) & (at[1:] != at[:-1])
    pairs = np.unique(np.stack((at[:-1][differ], at[1:][differ])), axis=1)
    for a, b in pairs.T.tolist():
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    if pairs.size:
        while (root[root] != root).any():
            root[:] = root[root]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of sorted dealt rows, each stretch of a block as (None, the block's own so far, keys, groups, vectors, visits), and (the block's keys, None, None, None, None, None) when a block ends.

    What is the block's own so far holds the stretch itself, where it isn't of visitors.
    """
    own, held, whole = None, [], None
    for batch in batches:
        place = np.stack([batch.column(i).to_numpy() for i in range(3)])
        edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            keys, groups = (batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in (3, 4))
            rows, at, visits = _matrix(batch.column(5).slice(lo, hi - lo)), (place[0, lo], place[1, lo]), place[2, lo]
            if at != own:
                if whole is not None:
                    yield whole[0], None, None, None, None, None
                own, held, whole = at, [], None
            if not visits:
                held.append((keys, groups, rows))
                whole = None
            if whole is None:
                whole = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else (keys[:0], groups[:0], rows[:0])
                held = [whole] if held else []
            yield None, whole, keys, groups, rows, visits
    if whole is not None:
        yield whole[0], None, None, None, None, None


def _tiles(held: tuple, keys: np.ndarray, groups: np.ndarray, rows: np.ndarray, visits: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, i, j, score): pairs of the block's row lo + i and row j, of different keys and groups and similar enough but for rounding. A pair of rows that both lie in the block comes once."""
    begin = None if visits else len(held[0]) - len(keys)
    for lo in range(0, len(held[0]), RESIDENTS):
        some = held[2][lo : lo + RESIDENTS]
        for a in range(0, len(keys), VISITORS):
            score = some @ rows[a : a + VISITORS].T
            i, j = np.nonzero(score >= threshold - SLACK)
            found = score[i, j]
            j = j + a
            keep = (held[0][lo + i] != keys[j]) & (held[1][lo + i] != groups[j])
            if begin is not None:
                keep &= lo + i < begin + j
            if keep.any():
                yield lo, i[keep], j[keep], found[keep]


def _keys(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array(values, pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64())
