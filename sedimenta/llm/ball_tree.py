"""Exact top-k by inner product with a ball tree in each shard.

Candidates are dealt into shards by a hash, and each shard's ball tree is built once and written. The trees answer queries by branch and bound: a node's
inner products are at most <query, centre> + |query| * radius; nodes are taken in the order of that bound, and a query ends where
the bound falls below the k-th score it has. Shards are asked in waves, each several times as large as all before it; after a wave, every query's k-th
score over all shards so far goes to the next, where most trees are left at their root.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.rows import tidy
from sedimenta.sources.scratch import Scratch

TREE = "shard int, width int, tree binary"
FOUND = "query_id long, vec_id long, score long"
#: Whole numbers below this are float64 numbers.
EXACT = 2.0**53


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component; null where the vector or a component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    wide = embedding.cast("array<double>")
    whole = lambda x: F.when(F.abs(x) < 2.0**55, F.floor(256 * x).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for a whole number of 64 bits")).cast("long"))
    return F.when(F.forall(wide, finite), F.transform(wide, whole))


class BallTree:
    """Nodes over rows in one array; a leaf holds `leaf` rows at most. Components are whole numbers: float64 products are exact as long as the lengths of
    two vectors have a product below 2**53; beyond that whole numbers of any size are taken, and floats serve for bounds alone."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 128) -> None:
        self.ids, self.rows = ids, rows.astype(np.float64)
        self.longest = float(np.sqrt((self.rows**2).sum(1)).max()) if len(ids) else 0.0
        self.whole = rows if self.longest >= EXACT else None  # components that float64 may not hold
        self.order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo = [(0, len(ids), -1, 0)] if len(ids) else []
        while todo:
            a, b, parent, side = todo.pop()
            own = self.rows[self.order[a:b]]
            centre = own.mean(0)
            distance = np.sqrt(((own - centre) ** 2).sum(1))
            node = len(self.spans)
            self.spans.append((a, b))
            self.children.append(None)
            centres.append(centre)
            radii.append(distance.max())
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            if b - a > leaf and distance.max() > 0:
                far = own[distance.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                middle = a + (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own @ (other - far), (b - a) // 2)]
                todo += [(a, middle, node, 0), (middle, b, node, 1)]
        self.centres, self.radii = np.array(centres).reshape(len(centres), -1), np.array(radii)
        self.rows, self.ids = self.rows[self.order], self.ids[self.order]
        self.whole = None if self.whole is None else self.whole[self.order]

    def scores(self, a: int, b: int, query: np.ndarray, exact: bool) -> np.ndarray:
        """The inner products of rows a to b with the query, in floats where these are exact."""
        if exact:
            return self.rows[a:b] @ query.astype(np.float64)
        rows = self.rows[a:b].astype(np.int64) if self.whole is None else self.whole[a:b]
        return rows.astype(object) @ query.astype(object)

    def top(self, whole: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, -id) that reach `least`, but for the query's own id; ties go to smaller ids."""
        if not len(self.ids):
            return []
        query = whole.astype(np.float64)
        norm = float(np.sqrt(query @ query))
        bounds = self.centres @ query + norm * self.radii
        bounds += 1e-9 * (np.abs(bounds) + 1) + 1e-9 * norm * (self.radii + 1)
        exact = norm * self.longest * (1 + 1e-9) < EXACT
        best: list[tuple[int, int]] = []
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < least:
                break
            if (pair := self.children[node]) is not None:
                for child in pair:
                    if bounds[child] >= least:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            scores = self.scores(a, b, whole, exact)
            at = np.flatnonzero((scores >= least) & (self.ids[a:b] != own))
            if len(at) > 4 * k:  # only those that can be among the best here, with all ties of the last
                if exact:
                    edge = np.partition(scores[at], len(at) - k - 1)[len(at) - k - 1]
                    at = at[scores[at] >= edge]
                    at = at[np.lexsort((self.ids[a:b][at], -scores[at]))][:k]
                else:
                    at = np.array(sorted(at.tolist(), key=lambda i: (-scores[i], self.ids[a + i]))[:k])
            for i in at.tolist():
                entry = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                least = max(least, best[0][0])
        return best


def top_inner_products(
    queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None, shards: int | None = None, shard_rows: int = 20_000, block: int = 4096, growth: int = 8
) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Components count as floor(256 * x), scores are exact whole numbers of 64 bits; what is larger is an error and never a wrong score. Vectors that are null or hold a null or a number that isn't finite take no part,
    nor do null keys. All rows with the query's own key are left out; repeated rows of another key count once each. Vectors of other lengths than the query's
    are not compared with it. An empty table gives no rows. Queries go over the trees in blocks of about `block`, which bounds what is sent to
    the executors and comes back (k scores a query); a tree holds about `shard_rows` rows, and sends at most k rows for each query.
    """
    spark = candidates.sparkSession
    scratch = scratch or Scratch(spark, "ball-trees")
    shape = lambda df: df.select(df[key].cast("long").alias("vec_id"), quantised(df[vector]).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    asked = shape(queries)
    total = candidates.count()
    shards = shards or max(spark.sparkContext.defaultParallelism, -(-total // shard_rows))
    dealt = shape(candidates).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    built = dealt.repartition(shards, "shard").groupBy("shard", F.size("v").alias("width")).applyInArrow(_tree, TREE)
    trees = scratch.keep(built, "trees")
    sizes = sorted((r["d"], r["n"]) for r in asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect())
    out = None
    for width, n in sizes:
        blocks = -(-n // block)
        for b in range(blocks):
            mine = asked.where((F.size("v") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b))
            got = sorted((r["vec_id"], r["v"]) for r in mine.toLocalIterator())
            held = {"ids": np.array([i for i, _ in got], np.int64), "rows": np.array([v for _, v in got], np.int64).reshape(len(got), width), "least": [-math.inf] * len(got)}
            best, low, high = None, 0, 1
            while low < shards:
                wave = _answers(trees.where((F.col("width") == width) & (F.col("shard") >= low) & (F.col("shard") < high)), held, k)
                best = scratch.keep(_best(wave if best is None else best.unionByName(wave), k), f"best-{width}-{b}-{low}")
                low, high = high, min(shards, high * growth)
                if low < shards:
                    kth = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
                    scores = {r["query_id"]: r["least"] for r in kth.toLocalIterator()}
                    held = held | {"least": [scores.get(q, -math.inf) for q in held["ids"].tolist()]}
            out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(out, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller id; a query has k rows a tree at most."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.explode("best").alias("e")).select("query_id", F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score")
    )


def _tree(part: pa.Table) -> pa.Table:
    """A shard's tree in one row: its arrays, rows in the order of the leaves. A shard's rows are bounded."""
    tidy()
    width = part.column("width")[0].as_py() if "width" in part.column_names else len(part.column("v")[0].as_py())
    rows = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    tree = BallTree(part.column("vec_id").to_numpy(), rows)
    return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _answers(trees: DataFrame, held: dict, k: int) -> DataFrame:
    shared = trees.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        queries = shared.value
        for batch in batches:
            for packed in batch.column(0):
                tree = pickle.loads(packed.as_buffer())
                out = [(q, -i, s) for q, v, least in zip(queries["ids"].tolist(), queries["rows"], queries["least"], strict=True) for s, i in tree.top(v, q, k, least)]
                columns = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return trees.select("tree").mapInArrow(run, FOUND)
