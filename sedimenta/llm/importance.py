"""Importance resampling towards a target: documents are drawn by how much likelier their words are in the target than in the corpus.

Identical texts are collapsed by grouping the full text, so that features are computed and a weight is found once for each different text; its
counts enter the corpus's bucket counts times its multiplicity. The weights go back to the documents before each adds noise of its own (Gumbel noise from a
hash of its id), and the highest sums are drawn, which is sampling without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.bytehash import LOWER, column_bytes, pieces, words
from sedimenta.llm.rows import tidy
from sedimenta.sources.scratch import Scratch

#: Bytes that are not part of a word: all of ASCII but digits and lower-case letters.
OTHER = np.isin(np.arange(256), [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
FEATURES = "digest string, n long, n_words long, n_features long, bucket array<int>, times array<int>"


def _table() -> np.ndarray:
    """The steps of CRC-32 (reflected polynomial) for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ (np.uint32(0xEDB88320) * (table & 1))
    return table


CRC = _table()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 48) -> np.ndarray:
    """CRC-32 states after the bytes of each span, all spans one byte at a time; what is left of longer ones is taken alone."""
    state, length, k = state.copy(), ends - starts, 0
    active = np.flatnonzero(length > 0)
    while len(active) and k < most:
        now = state[active]
        state[active] = CRC[(now ^ data[starts[active] + k]) & 0xFF] ^ (now >> 8)
        k += 1
        active = active[length[active] > k]
    for i in active.tolist():
        state[i] = zlib.crc32(data[starts[i] + k : ends[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, and the row and bucket of every run of 1 to `longest` of its words, repeats included."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, OTHER)
    of_row, of_bucket = [], []
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(longest):
        at = np.arange(len(starts) - k)
        at = at[row[at] == row[at + k]]
        state = state[: len(starts) - k][at] if k == 0 else state[np.searchsorted(before, at)]
        if k:  # a blank, then the next word
            state = CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        state, before = advance(state, data, starts[at + k], ends[at + k]), at
        of_row.append(row[at])
        of_bucket.append((state ^ 0xFFFFFFFF).astype(np.int64) % buckets)
    return np.bincount(row, minlength=len(offsets) - 1), np.concatenate(of_row), np.concatenate(of_bucket)


def text_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Of (digest, n, text): the digest, n, numbers of words and features, and each bucket that the text meets with its number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in pieces(offsets):
                n_words, row, bucket = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest, buckets)
                key, times = np.unique(row * buckets + bucket, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(j - i + 1) * buckets).astype(np.int32))
                columns = [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n_words.astype(np.int64)), pa.array(np.bincount(row, minlength=j - i).astype(np.int64))]
                columns += [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (key % buckets, times)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "n_words", "n_features", "bucket", "times"])

    return texts.mapInArrow(run, FEATURES)


def collapsed(docs: DataFrame, text: str) -> DataFrame:
    """(digest, n, text): each different text once, with its number of rows; a null counts as an empty text. Copies are counted before they are shuffled."""
    whole = docs.groupBy(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    return whole.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "n", "text")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is met, over all rows: counts times multiplicity. What comes to the driver is one number a bucket."""
    rows = found.select("n", F.explode(F.arrays_zip("bucket", "times")).alias("e")).groupBy("e.bucket").agg(F.sum(F.col("n") * F.col("e.times")).alias("s")).collect()
    out = np.zeros(buckets)
    for r in rows:
        out[r["bucket"]] = r["s"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, with one more count in each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def text_weights(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """(digest, n, n_words, n_features, weight): the mean gain over a text's features, rounded down; without features 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            bucket, times = batch.column(4), batch.column(5)
            sums = np.concatenate(([0], np.cumsum(gains[bucket.flatten().to_numpy()] * times.flatten().to_numpy())))
            length = np.concatenate(([0], np.cumsum(bucket.value_lengths().to_numpy(zero_copy_only=False))))
            total, n = np.diff(sums[length]), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["digest", "n", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "digest string, n long, n_words long, n_features long, weight long")


def with_weights(rows: DataFrame, weights: DataFrame, total: int, hot: int = 1000) -> DataFrame:
    """Rows (doc_id, digest) with the weights of their texts. A text that more than total / hot rows have meets its rows in a broadcast join: there are fewer
    than `hot` of them, and no task gets all rows of one; all others are joined by their digests."""
    often = F.col("n") * hot > total
    flagged = rows.join(F.broadcast(weights.where(often).select("digest", F.lit(True).alias("often"))), "digest", "left")
    many = flagged.where("often").drop("often").join(F.broadcast(weights.where(often)), "digest")
    return flagged.where("often IS NULL").drop("often").join(weights.where(~often), "digest").unionByName(many).drop("n")


def noise(key, seed: int):
    """floor(1000 g), g a Gumbel variable from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_sample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, scratch: Scratch | None = None
) -> DataFrame:
    """Per row of docs: doc_id, digest (SHA-256 of the text), n_words, n_features, weight, score and rank, which is null where the row isn't drawn.

    Of the N rows with `least_words` words, the floor(percent * N / 100) highest scores are drawn; ties go to the smaller key (null last), then the smaller
    digest; equal rows get ranks of their own. Words are runs of ASCII letters (lower-cased), digits and whatever isn't ASCII. A null text or one without words has no features and
    weight 0; a null key takes part with the noise of an empty one. An empty target gives gains all the same (no counts), and empty docs no rows. Other columns are
    neither read nor returned: `drawn` gives whole rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "importance")
    found = scratch.keep(text_features(collapsed(docs, text), longest, buckets), "features")
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(text_features(collapsed(target, target_text), longest, buckets), buckets))
    weights = scratch.keep(text_weights(found, gains), "weights")
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    scratch.drop("features")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"), 256).alias("digest"))
    scored = scratch.keep(with_weights(rows, weights, total).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    scratch.drop("weights")
    return ranked(scored, F.col("n_words") >= least_words, percent)


def ranked(scored: DataFrame, able, percent: int) -> DataFrame:
    """The ranks of the rows drawn. Scores are whole numbers of a narrow range, so that rows are counted by score, and only those of one score are sorted together."""
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("wide", F.floor(F.col("score") / 256))
    higher = Window.orderBy(F.desc("wide")).rowsBetween(Window.unboundedPreceding, -1)
    bases = by_score.groupBy("wide").agg(F.sum("n").alias("n")).select("wide", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("base"))
    within = Window.partitionBy("wide").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = by_score.join(bases, "wide").select("score", "n", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))
    total = scored.where(able).count() * percent // 100
    cut = before.where(F.col("before") < total).agg(F.min("score").alias("cut")).first()["cut"]
    inside = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "digest"))
    rank = (F.col("before") + F.col("place")).cast("long")
    some = scored.where(inside).withColumn("place", place).join(before.select("score", "before"), "score").withColumn("rank", F.when(rank <= total, rank)).select(*scored.columns, "rank")
    return some.unionByName(scored.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole rows of docs that the sample drew; rows equal in key and text come if one of them was drawn."""
    chosen = sample.where("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    digest = F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"), 256)
    return docs.join(chosen, docs[key].cast("long").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_semi")
