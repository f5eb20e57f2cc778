"""Literal search over a stored index of trigrams.

Texts lie in blocks, those of one task. A trigram is a sequence of three bytes, ASCII letters in lower case; for each trigram and block one row, in a folder for its bucket, lists the places of
the block's texts that hold it. A search takes the rarest trigrams of its pattern, intersects their lists block by block, and looks into those texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sedimenta.operators.lexical import literal_matches
from sedimenta.sources.scratch import Scratch

FOLD = np.arange(256, dtype=np.int32) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))


def grams_of(text: str) -> np.ndarray:
    """The different trigrams of a text as numbers below 2**24."""
    data = FOLD[np.frombuffer(text.encode(), np.uint8)]
    return np.unique((data[:-2] << 16) | (data[1:-1] << 8) | data[2:]) if len(data) > 2 else data[:0]


POSTED = "gram int, block long, ats array<int>"
#: The folders of texts have numbers below zero. How many texts a block has, and how many trigrams, but for those of its last text.
BLOCK, HELD = 4096, 4 << 20


@dataclass(frozen=True)
class Trigrams:
    """The tables of an index below a path. texts: block, at (the place in it) and the rows' columns, in `parts` folders by block; postings (POSTED), in folders by bucket."""

    spark: SparkSession
    path: str
    buckets: int
    key: str
    texts: StructType

    def table(self, name: str) -> DataFrame:
        every = [f for f in self.texts if f.name != "block"]
        posted = StructType.fromDDL(POSTED)
        rows = self.spark.read.schema(StructType([*posted, *every]).add("bucket", "integer")).parquet(self.path)
        if name == "texts":
            return rows.where("bucket < 0").select(*self.texts.names)
        return rows.where("bucket >= 0").select(*posted.names, "bucket")

    def of_grams(self, name: str, grams: list[int]) -> DataFrame:
        """The rows of some trigrams; no other buckets are read."""
        return self.table(name).where(F.col("bucket").isin(*sorted({g % self.buckets for g in grams})) & F.col("gram").isin(*grams))


def build_trigrams(rows: DataFrame, path: str, key: str = "file_id", text: str = "text", buckets: int = 64, parts: int = 64) -> Trigrams:
    """Writes the index of rows, with all their columns; null texts have no trigrams. Nothing is shuffled: a task makes blocks of its own texts."""
    texts = rows.select(F.lit(0).cast("long").alias("block"), F.lit(0).alias("at"), "*").schema
    shape = StructType([*StructType.fromDDL(POSTED), *(StructField(f.name, f.dataType) for f in texts if f.name != "block")]).add("bucket", "integer")
    place = rows.columns.index(text)
    made = rows.mapInArrow(lambda batches: _blocks(batches, shape.names, place, buckets, parts), shape)
    made.sortWithinPartitions("bucket", "gram", "block", "at").write.partitionBy("bucket").parquet(path)
    return Trigrams(rows.sparkSession, path, buckets, key, texts)


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str], place: int, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of rows: a row for each trigram of a block, and one for each text. Blocks are numbered apart from those of other tasks."""
    turn, n, size = TaskContext.get().partitionId() << 32, 0, 0
    grams: list[np.ndarray] = []
    own = {"gram": pa.int32(), "block": pa.int64(), "ats": pa.list_(pa.int32()), "at": pa.int32(), "bucket": pa.int32()}

    def row(n: int, kinds: dict[str, pa.DataType], **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in names], names=names)

    def listed(kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        gram, at = np.concatenate(grams), np.repeat(np.arange(n, dtype=np.int32), [len(g) for g in grams])
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1])))
        for i in range(0, len(heads), 1 << 14):
            some = heads[i : i + (1 << 14)]
            end = heads[i + len(some)] if i + len(some) < len(heads) else len(gram)
            ats = pa.ListArray.from_arrays(pa.array(np.append(some - some[0], end - some[0]).astype(np.int32)), pa.array(at[some[0] : end]))
            chosen = gram[some].astype(np.int32)
            yield row(len(some), kinds, gram=pa.array(chosen), block=pa.array(np.full(len(some), turn)), ats=ats, bucket=pa.array(chosen % buckets))

    kinds = own
    for batch in batches:
        kinds = own | {f.name: f.type for f in batch.schema}
        begin = 0
        for i, content in enumerate(batch.column(place)):
            grams.append(grams_of(content.as_py() or ""))
            n, size = n + 1, size + len(grams[-1])
            full = n == BLOCK or size >= HELD
            if full or i + 1 == batch.num_rows:
                m = i + 1 - begin
                some = batch.slice(begin, m)
                at = pa.array(np.arange(n - m, n, dtype=np.int32))
                yield row(m, kinds, block=pa.array(np.full(m, turn)), at=at, bucket=pa.array(np.full(m, -1 - turn % parts, np.int32)), **dict(zip(some.schema.names, some.columns, strict=True)))
                begin = i + 1
            if full:
                yield from listed(kinds)
                grams.clear()
                turn, n, size = turn + 1, 0, 0
    if grams:
        yield from listed(kinds)


def _places(index: Trigrams, pattern: str, rarest: int) -> DataFrame | None:
    """(block, ats): of each block the places of the texts that hold the pattern's rarest trigrams; None for a pattern that has none."""
    grams = grams_of(pattern).tolist()
    if not grams:
        return None
    posted = index.of_grams("postings", grams)
    counts = sorted((r["n"], r["gram"]) for r in posted.groupBy("gram").agg(F.sum(F.size("ats")).alias("n")).collect())  # a row for each trigram of the pattern
    if len(counts) < len(grams):
        return posted.select("block", "ats").limit(0)
    wanted = [g for _, g in counts[:rarest]]
    lists = index.of_grams("postings", wanted).groupBy("block").agg(F.collect_list("ats").alias("lists")).where(F.size("lists") == len(wanted))
    return lists.select("block", F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b)).alias("ats")).where(F.size("ats") > 0)


def _chosen(index: Trigrams, texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts at these places. What meets the texts is a bit for each of a block's texts, small enough to be sent to them, so that they aren't shuffled."""
    word = F.explode("ats").alias("place")
    bits = places.select("block", word).groupBy("block", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits"))
    bits = Scratch(index.spark, "places").keep(bits, "bits")
    found = texts.withColumn("word", F.shiftright("at", 6)).join(bits, ["block", "word"])
    return found.where(F.expr("shiftright(bits, at & 63) & 1L") == 1).drop("word", "bits", "block", "at")


def candidates(index: Trigrams, pattern: str, rarest: int = 4) -> DataFrame | None:
    """(key) of the texts that hold the pattern's rarest trigrams, in whatever case; None for a pattern of fewer than three bytes, which any text may hold."""
    places = _places(index, pattern, rarest)
    return None if places is None else _chosen(index, index.table("texts").select("block", "at", F.col(index.key).alias("key")), places)


def find_literal(index: Trigrams, pattern: str, text: str = "text", where: Column | None = None, rarest: int = 4) -> DataFrame:
    """The rows of literal_matches() over all texts of the index - in exact case - of which only the candidates are looked into."""
    texts = index.table("texts")
    texts = texts if where is None else texts.where(where)
    places = _places(index, pattern, rarest)
    return literal_matches(texts.drop("block", "at") if places is None else _chosen(index, texts, places), pattern, text)
