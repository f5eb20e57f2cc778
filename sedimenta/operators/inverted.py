"""A stored inverted index: postings with positions, in blocks of chunks of like length, searched best blocks first.

Texts become terms by lower case, without diacritics, at everything but letters and digits, and as Porter stems if asked. A task makes blocks of its own chunks and writes one row for each term and
block, with what the block's chunks have of it in lists, to a folder for each bucket of terms; nothing is shuffled for that, and no row repeats a chunk's key. A search reads the rows of its terms, bounds the
blocks' scores by them, scores the most promising blocks, and of all others only those whose bound reaches the k-th score so far.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sedimenta.functions.stems import porter
from sedimenta.operators.lexical import IDF_FLOOR, K1, B
from sedimenta.sources.scratch import Scratch

WORD = re.compile(r"[^\W_]+")
#: Of a term and a block: the chunks that have it by their place in the block, with how often and how long they are, and all positions one after the other.
POSTED = "term string, block long, ats array<int>, tfs array<int>, lens array<int>, positions array<int>"
#: The folder of rows for chunks, beside those of the buckets of terms, and how many tokens a task holds at most before it makes blocks of them, but for one text's.
DOCS, HELD = -1, 4 << 20


@cache
def _marks() -> dict[int, None]:
    """What diacritics are when they stand apart, for str.translate() to leave out."""
    return {i: None for i in range(0x110000) if unicodedata.category(chr(i)) == "Mn"}


def terms_of(text: str | None, stem: bool, known: dict[str, str] | None = None) -> list[str]:
    """The terms of a text in their order."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_marks())
    found = WORD.findall(text)
    if not stem:
        return found
    known = {} if known is None else known
    for w in found:
        if w not in known:
            known[w] = porter(w)
    return [known[w] for w in found]


def phrases_of(query: str, stem: bool) -> list[tuple[str, ...]]:
    """What a query asks for: each of its words of two characters or more; a word with underscores is the sequence of its parts."""
    words = [w for w in re.split(r"[^\w]+", query.lower()) if len(w) >= 2]
    return sorted({p for w in words if (p := tuple(terms_of(w, stem)))})


@dataclass(frozen=True)
class Index:
    """The tables of an index below a path. docs: key, block, at (the place in it), len and the columns kept; postings (POSTED); blocks: for each term and block, how many chunks have it and the greatest share it
    adds to a score; totals: one row (n, average length)."""

    spark: SparkSession
    path: str
    stem: bool
    buckets: int
    docs: StructType

    def table(self, name: str) -> DataFrame:
        if name == "totals":
            return self.spark.read.schema("n long, average double").parquet(f"{self.path}/totals")
        every = [f for f in self.docs if f.name != "block"]
        posted = StructType.fromDDL(POSTED)
        rows = self.spark.read.schema(StructType([*posted, *every]).add("bucket", "integer")).parquet(f"{self.path}/index")
        if name == "docs":
            return rows.where(F.col("bucket") == DOCS).select(*self.docs.names)
        rows = rows.where(F.col("bucket") != DOCS).select(*posted.names, "bucket")
        if name == "postings":
            return rows
        average = self.table("totals").first()["average"]
        return rows.select("term", "block", F.size("ats").cast("long").alias("n"), best_share(average).alias("best"), "bucket")

    def of_terms(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms: of the buckets that they fall into, no other folder is read."""
        wanted = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.table(name).where(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms))


def build_index(chunks: DataFrame, path: str, key: str = "chunk_id", document: str = "document", symbols: str | None = None, keep: list[str] | None = None, stem: bool = False, buckets: int = 64, block_chunks: int = 4096) -> Index:
    """Writes the index of chunks below a path. The key becomes text. Null texts and symbols are empty; a chunk without terms counts for the average length. Phrases don't run from a text into its symbols.

    Each task holds up to 16 blocks' chunks, sorts them by length, cuts blocks in which none is twice as long as another, and writes their terms; its own rows are sorted by term and block.
    """
    spark = chunks.sparkSession
    kept = [F.col(c) for c in keep or []]
    said = F.array(*([F.col(document)] if symbols is None else [F.col(document), F.array_join(symbols, " ")])).cast("array<string>")
    cut = chunks.select(F.col(key).cast("string").alias("key"), *kept, said.alias("said"))
    docs = cut.drop("said").select("key", F.lit(0).cast("long").alias("block"), F.lit(0).alias("at"), F.lit(0).alias("len"), *(keep or [])).schema
    shape = StructType([*StructType.fromDDL(POSTED), *(StructField(f.name, f.dataType) for f in docs if f.name != "block")]).add("bucket", "integer")
    made = cut.mapInArrow(lambda batches: _blocks(batches, shape.names, stem, buckets, block_chunks), shape)
    made.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/index")
    index = Index(spark, path, stem, buckets, docs)
    index.table("docs").agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average")).write.parquet(f"{path}/totals")
    return index


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str], stem: bool, buckets: int, block_chunks: int) -> Iterator[pa.RecordBatch]:
    """Of chunks (key, columns kept, texts): the rows of their blocks' terms, and one for each chunk. Blocks are numbered apart from those of other tasks."""
    known: dict[str, str] = {}
    ids: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows: list[pa.RecordBatch] = []
    turn, size = TaskContext.get().partitionId() << 32, 0

    def row(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in names], names=names)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        terms = list(ids)
        bucket = np.array([zlib.crc32(t.encode()) % buckets for t in terms], np.int32)
        texts, every = pa.array(terms, pa.string()), pa.Table.from_batches(rows).combine_chunks()
        lengths = np.array([len(t) for t, _ in held], np.int32)
        by_length = np.argsort(lengths, kind="stable")
        ranges = np.split(by_length, np.flatnonzero(np.diff(np.log2(lengths[by_length] + 1).astype(np.int32))) + 1)
        for some in (r[i : i + block_chunks] for r in ranges for i in range(0, len(r), block_chunks)):
            size = lengths[some]
            term, place = (np.concatenate([held[i][k] for i in some]) for k in (0, 1))
            order = np.argsort(term, kind="stable")
            term, at, place = term[order], np.repeat(np.arange(len(some), dtype=np.int32), size)[order], place[order]
            new = np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1]))
            first = np.flatnonzero(new | np.concatenate((new[:1], at[1:] != at[:-1])))  # where each chunk's part of a term begins
            heads = np.flatnonzero(new)
            ends, places = (np.append(x, n).astype(np.int32) for x, n in ((np.searchsorted(first, heads), len(first)), (heads, len(term))))
            listed = lambda values, by: pa.ListArray.from_arrays(pa.array(by), pa.array(values, pa.int32()))
            chosen, n = term[heads], len(heads)
            yield row(
                n, term=texts.take(pa.array(chosen)), block=pa.array(np.full(n, turn)), ats=listed(at[first], ends), tfs=listed(np.diff(np.append(first, len(term))), ends), lens=listed(size[at[first]], ends),
                positions=listed(place, places), bucket=pa.array(bucket[chosen], pa.int32()),
            )
            n, mine = len(some), every.take(pa.array(some)).combine_chunks()
            columns = {c: mine.column(c).combine_chunks() for c in mine.column_names}
            yield row(n, block=pa.array(np.full(n, turn)), at=pa.array(np.arange(n, dtype=np.int32)), len=pa.array(size), bucket=pa.array(np.full(n, DOCS, np.int32)), **columns)
            turn += 1
        held.clear(), rows.clear(), ids.clear()
        if len(known) > 1 << 20:
            known.clear()

    kinds = {"term": pa.string(), "block": pa.int64(), "at": pa.int32(), "len": pa.int32(), "bucket": pa.int32()} | dict.fromkeys(("ats", "tfs", "lens", "positions"), pa.list_(pa.int32()))
    for batch in batches:
        kinds |= {f.name: f.type for f in batch.schema if f.name != "said"}
        begin = 0
        for i, texts in enumerate(batch.column(batch.num_columns - 1)):
            found, places, at = [], [], 0
            for text in texts.as_py() or []:
                some = terms_of(text, stem, known)
                found += some
                places.append(np.arange(at, at + len(some), dtype=np.int32))
                at += len(some) + 1
            held.append((np.array([ids.setdefault(t, len(ids)) for t in found], np.int32), np.concatenate(places) if places else np.zeros(0, np.int32)))
            size += len(found)
            if len(held) >= 16 * block_chunks or size >= HELD:
                rows.append(batch.slice(begin, i + 1 - begin).select(range(batch.num_columns - 1)))
                yield from flush()
                begin, size = i + 1, 0
        if begin < batch.num_rows:
            rows.append(batch.slice(begin).select(range(batch.num_columns - 1)))
    if held:
        yield from flush()


def share(tf: str, length: str, average: float) -> Column:
    """What a term adds to a score, but for its weight."""
    return _share(F.col(tf), F.col(length), average)


def _share(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(max(average, 1e-9))))


def best_share(average: float) -> Column:
    """The greatest of a row's shares."""
    return F.array_max(F.zip_with("tfs", "lens", lambda tf, n: _share(tf, n, average)))


def each_posting(rows: DataFrame) -> DataFrame:
    """(phrase, block, at, tf, len) of the chunks in the lists of (phrase, block, ats, tfs, lens)."""
    return rows.select("phrase", "block", F.explode(F.arrays_zip("ats", "tfs", "lens")).alias("p")).select("phrase", "block", F.col("p.ats").alias("at"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))


LISTS = "phrase string, block long, ats array<int>, tfs array<int>, lens array<int>"


def phrase_postings(index: Index, phrase: tuple[str, ...]) -> DataFrame:
    """(phrase, block, ats, tfs, lens) of the chunks that hold the terms one after the other; the lists of the terms meet by block, and their positions are intersected there."""
    terms, said = sorted(set(phrase)), " ".join(phrase)
    found = index.of_terms("postings", terms).groupBy("block").agg(F.collect_list(F.struct("term", "ats", "tfs", "lens", "positions")).alias("lists")).where(F.size("lists") == len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lists in zip(*batch.columns, strict=True):
                rows = lists.values
                of = {t: {c: rows.field(c)[i].values.to_numpy() for c in ("ats", "tfs", "lens", "positions")} for i, t in enumerate(rows.field("term").to_pylist())}
                left = None
                for by, term in enumerate(phrase):  # chunk and position in one number
                    mine = of[term]
                    places = (np.repeat(mine["ats"], mine["tfs"]).astype(np.int64) << 32) + mine["positions"] + (len(phrase) - by)
                    left = places if left is None else np.intersect1d(left, places, assume_unique=True)
                ats, tfs = np.unique((left >> 32).astype(np.int32), return_counts=True)
                if len(ats):
                    lens = of[phrase[0]]["lens"][np.searchsorted(of[phrase[0]]["ats"], ats)]
                    yield pa.RecordBatch.from_pylist([{"phrase": said, "block": block.as_py(), "ats": ats, "tfs": tfs.astype(np.int32), "lens": lens}], pa.schema([("phrase", pa.string()), ("block", pa.int64())] + [(c, pa.list_(pa.int32())) for c in ("ats", "tfs", "lens")]))

    return found.mapInArrow(run, LISTS)


def search_index(index: Index, query: str, k: int, where: Column | None = None, first: int = 8) -> DataFrame:
    """The k best chunks: key, the columns kept, and bm25 (6 decimals, higher is better); ties go to the smaller key. A query without terms has no hits.

    `where` is a scope over the kept columns; the corpus's statistics are those of all chunks. Scores are the sum over the query's phrases. Blocks are scored in two waves: the `first`
    of greatest bound, then those whose bound isn't below the k-th score of these. Rows of other blocks aren't joined, and no result is lost by that.
    """
    phrases = phrases_of(query, index.stem)
    docs = index.table("docs")
    if not phrases:
        return docs.limit(0).drop("block", "at", "len").withColumn("bm25", F.lit(0.0))
    n, average = index.table("totals").first()
    single = [p[0] for p in phrases if len(p) == 1]
    scratch = Scratch(index.spark, "search")
    lists = [index.of_terms("postings", single).select(F.col("term").alias("phrase"), "block", "ats", "tfs", "lens")] if single else []
    lists += [phrase_postings(index, p) for p in phrases if len(p) > 1]
    listed = scratch.keep(reduce(DataFrame.unionByName, lists), "listed")
    bounded = listed.select("phrase", "block", F.size("ats").alias("n"), best_share(average).alias("best"))
    weight = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = bounded.groupBy("phrase").agg(F.sum("n").alias("df")).select("phrase", weight.alias("weight"))  # a row for each phrase
    block = bounded.join(F.broadcast(weights), "phrase").groupBy("block").agg(F.sum(F.col("weight") * F.col("best")).alias("bound"))

    def best(blocks: DataFrame, least: float | None = None) -> DataFrame:
        hits = each_posting(listed.join(blocks, "block", "left_semi")).join(F.broadcast(weights), "phrase")
        scored = hits.groupBy("block", "at").agg(F.round(F.sum(F.col("weight") * share("tf", "len", average)), 6).alias("bm25"))
        scored = scored if least is None else scored.where(F.col("bm25") >= F.lit(least))  # what doesn't reach the k-th score needs no columns
        whole = docs.drop("len").join(scored, ["block", "at"]).drop("block", "at")
        return (whole if where is None else whole.where(where)).orderBy(F.desc("bm25"), "key").limit(k)

    block = scratch.keep(block, "bounds")
    leading = block.orderBy(F.desc("bound"), "block").limit(first)
    some = scratch.keep(best(F.broadcast(leading)), "some")
    least = some.agg(F.count("*").alias("n"), F.min("bm25").alias("least")).first()
    rest = block.join(F.broadcast(leading), "block", "left_anti")
    if least["n"] >= k:
        rest = rest.where(F.col("bound") + 1e-6 >= F.lit(least["least"]))
    return some.unionByName(best(rest, least["least"] if least["n"] >= k else None)).orderBy(F.desc("bm25"), "key").limit(k).select(*[c for c in docs.columns if c not in ("block", "at", "len")], "bm25")
