"""BM25 over chunks, and literal search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.stems import porter
from sedimenta.functions.text import let, query_terms, tokens
from sedimenta.sources.scratch import Scratch

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def words_of(document: str, symbols: str | None) -> Column:
    """The terms of a chunk: those of its text, and those of its symbols after them."""
    found = tokens(F.col(document), 1)
    return found if symbols is None else F.concat(found, F.flatten(F.transform(F.coalesce(F.array_compact(symbols), F.array().cast("array<string>")), lambda s: tokens(s, 1))))


def bm25_scores(chunks: DataFrame, query: str, document: str = "document", symbols: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The chunks that hold a term of the query, with bm25 (higher is better). An empty query has no hits.

    Texts are cut into terms once: what is counted of each chunk that matters - its length and the counts of the query's terms - is written, and both the
    statistics of the corpus and the hits come from there. The only shuffle is that of the one row of statistics, which is also all that is broadcast.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.withColumn("bm25", F.lit(0.0)).limit(0)
    scratch = scratch or Scratch(chunks.sparkSession, "bm25")
    counts = lambda words: F.struct(F.size(words).alias("len"), F.transform(F.array(*map(F.lit, terms)), lambda t: F.size(F.filter(words, lambda w: w == t))).alias("tf"))
    counted = chunks.withColumn("_c", let(words_of(document, symbols), counts)).drop(document)
    counted = scratch.keep(counted.withColumn("_len", F.col("_c.len")).withColumn("_tf", F.col("_c.tf")).drop("_c"), "counted")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.sum((F.col("_tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("_df"))
    hit = counted.where(F.exists("_tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    return _scored(hit).drop("_len", "_tf", "_n", "_avg", "_df")


def _scored(hit: DataFrame) -> DataFrame:
    idf = F.transform("_df", lambda d: F.greatest(F.log((F.col("_n") - d + 0.5) / (d + 0.5)), F.lit(IDF_FLOOR)))
    part = F.zip_with("_tf", idf, lambda tf, i: i * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))))
    return hit.withColumn("bm25", F.aggregate(part, F.lit(0.0), lambda s, x: s + x))


def postings(chunks: DataFrame, document: str = "document", symbols: str | None = None, stem: bool = False, key: str = "chunk_id") -> DataFrame:
    """The index: (term, key, tf, len), a row for each term of a chunk. With `stem`, terms are Porter stems. Chunks are counted one by one where they are read, and nothing is shuffled."""
    shape = chunks.select(F.lit("").alias("term"), key, F.lit(0).alias("tf"), F.lit(0).alias("len")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                at, terms, tfs, lens = [], [], [], []
                for i, words in enumerate(batch.column(1).slice(a, 256).to_pylist(), a):
                    if stem:
                        known.update({w: porter(w) for w in set(words).difference(known)})
                    counts = Counter(map(known.__getitem__, words) if stem else words)
                    at += [i] * len(counts)
                    terms += counts.keys()
                    tfs += counts.values()
                    lens += [len(words)] * len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(tfs, pa.int32()), pa.array(lens, pa.int32())], names=shape.names)
                if len(known) > 1 << 20:
                    known.clear()

    return chunks.select(key, F.coalesce(words_of(document, symbols), F.array().cast("array<string>")).alias("_w")).mapInArrow(run, shape)


def bm25_of_postings(index: DataFrame, lengths: DataFrame, query: str, k: int, stem: bool = False, key: str = "chunk_id") -> DataFrame:
    """The k best chunks (key, bm25) of a written index; only the rows of the query's terms are read. lengths: (key, len) of every chunk, also those without a term."""
    terms = query_terms(query)
    terms = sorted({porter(t) for t in terms}) if stem else terms
    found = index.where(F.col("term").isin(*terms)) if terms else index.limit(0)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("a"))
    each = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row for each term of the query, and one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("a")))
    return each.groupBy(key).agg(F.round(F.sum(score), 6).alias("bm25")).orderBy(F.desc("bm25"), key).limit(k)


def bm25_topk(chunks: DataFrame, query: str, k: int, scope=None, key: str = "chunk_id") -> DataFrame:
    """The k best chunks; ties go to the smaller key. A scope is a Column; corpus statistics are those of all chunks, as an index has them."""
    scored = bm25_scores(chunks, query)
    scored = scored if scope is None else scored.where(scope)
    return scored.withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), key).limit(k)


def in_scope(project_id: str | None = None, prefix: str | None = None, language: str | None = None):
    """The predicate of a search scope; plain comparisons, which reach the scan."""
    found = F.lit(True)
    for name, value in (("project_id", project_id), ("language", language)):
        found = found if value is None else found & (F.col(name) == value)
    return found if prefix is None else found & F.col("rel_path").startswith(prefix)


def literal_matches(files: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """A row per line that holds the pattern: the files' columns without the text, line (from 1), column (of the first match, from 1), snippet."""
    hit = files.where(F.col(text).contains(pattern))
    each = hit.select(*[c for c in files.columns if c != text], F.posexplode(F.split(text, "\n")).alias("_at", "snippet"))
    return each.where(F.col("snippet").contains(pattern)).withColumn("line", F.col("_at") + 1).withColumn("column", F.instr("snippet", pattern)).drop("_at")
