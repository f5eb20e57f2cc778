"""Collocations: phrases whose words come together much more often than their parts come elsewhere.

Texts are cut into pieces and words, and the runs of 1 to `longest` words become rows, which are counted per language by hashing. A phrase that is
often enough has only parts that are, so that from two words on a run becomes a row only where the runs inside it may be often enough, by a filter of fixed
size from the counts one word below; a filter's false hits cost rows, never results. Each candidate is cut in two at every place and joined with
the counts of both halves; scores are exact decimals. Candidates inside a longer one that is nearly as frequent go by an anti-join with the parts of all
extensions by one word, and a window ranks the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.bytehash import BASE, LOWER, U, column_bytes, mix64, pieces, word_hashes, words
from sedimenta.llm.rows import tidy
from sedimenta.sources.scratch import Scratch

#: Bytes that end a piece, and those that end a word.
PIECE = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
BLANK = PIECE | np.isin(np.arange(256), [0x20, 0x09])
RUNS = "lang string, phrase string, size int, n long"


class Words:
    """The words of a batch of texts, each with its place in line: `line` tells pieces apart, `code` equal words, `hash` is that of the word and its language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, language: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, row = words(data, offsets, BLANK)
        broken = np.concatenate(([0], np.cumsum(PIECE[data])))
        self.line, self.language = broken[starts] + row, language[row]  # a new row is a new line, as is each mark
        length = ends - starts
        self.ends = np.cumsum(length)
        self.data = data[np.repeat(starts - np.concatenate(([0], self.ends[:-1])), length) + np.arange(length.sum())]
        self.hash = mix64(word_hashes(data, starts, ends) ^ self.language.view(np.uint64)) if len(starts) else np.zeros(0, np.uint64)

    def texts(self) -> pa.Array:
        at = np.concatenate(([0], self.ends)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.ends), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(self.data)))


def run_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each place on, whatever lines they are in."""
    out = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        out = mix64(out * U(BASE) + word[k : k + len(out)])
    return out


def language_hashes(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little", signed=True) for n in names], np.int64)


def count_runs(batches: Iterator[pa.RecordBatch], size: int, often: Broadcast | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): rows (lang, phrase, size, n) of the runs of `size` words, those of a piece of the batch with their number. Equal runs are told by their words, not by hashes."""
    tidy()
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            names = batch.column(0).dictionary_encode()
            known = names.dictionary.to_pylist()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in pieces(offsets):
                found = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], language_hashes(known)[code[i:j]])
                total = len(found.line) - size + 1
                if total <= 0:
                    continue
                good = found.line[:total] == found.line[size - 1 :]
                if often is not None:  # both runs of one word less must be often enough
                    cell = run_hashes(found.hash, size - 1) >> U(64 - bits)
                    hit = np.frombuffer(often.value, np.uint8)[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8) & 1
                    good &= (hit[:total] & hit[1 : total + 1]).astype(bool)
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                coded = found.texts().dictionary_encode()
                of_word, width = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + 1
                key = np.unique(found.language[at], return_inverse=True)[1].astype(np.int64)
                for k in range(size):
                    key = np.unique(key * width + of_word[at + k], return_inverse=True)[1].astype(np.int64)
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                lead = at[first]
                parts = [coded.dictionary.take(pa.array(of_word[lead + k])) for k in range(size)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
                spoken = {int(h): n for h, n in zip(language_hashes(known), known, strict=True)}
                langs = pa.array([spoken[h] for h in found.language[lead].tolist()], pa.string())
                for a in range(0, len(lead), 20_000):
                    b = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays([langs[b], phrase[b].cast(pa.string()), pa.array(np.full(len(lead[b]), size, np.int32)), pa.array(times[b].astype(np.int64))], names=["lang", "phrase", "size", "n"])


def cells(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Of (lang, phrase): the place of each in the filter, as a 64-bit word's number and its bit."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = Words(data, offsets, language_hashes(batch.column(0).to_pylist()))
            place = run_hashes(found.hash, size)[::size] >> U(64 - bits)  # each row is one run
            yield pa.RecordBatch.from_arrays([pa.array((place >> U(6)).astype(np.int64)), pa.array((U(1) << (place & U(63))).view(np.int64))], names=["cell", "bit"])


def filter_bits(counted: DataFrame, size: int, bits: int) -> Broadcast:
    """A filter of 2**bits bits that holds all rows of `counted`: one bit each, put together by hashing; at most 2**(bits - 6) numbers come to the driver, and so many go out."""
    rows = counted.select("lang", "phrase").mapInArrow(lambda b: cells(b, size, bits), "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    found, filled = rows.toArrow(), np.zeros(1 << (bits - 6), np.int64)
    filled[found.column("cell").to_numpy()] = found.column("bit").to_numpy()
    return counted.sparkSession.sparkContext.broadcast(filled.tobytes())


def phrase_counts(docs: DataFrame, longest: int, least: int, scratch: Scratch, lang: str = "lang", text: str = "text", bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to `longest` words that come `least` times, and (lang, n) with all words' occurrences."""
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    counted, total, often = None, None, None
    for size in range(1, longest + 1):
        runs = rows.mapInArrow(lambda b, size=size, often=often: count_runs(b, size, often, bits), RUNS)
        level = runs.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f"))
        if size == 1:
            level = scratch.keep(level, "words")
            total = scratch.keep(level.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        level = scratch.keep(level.where(F.col("f") >= least), f"level-{size}")
        scratch.drop("words")
        counted = level if counted is None else counted.unionByName(level)
        if size < longest:
            often = filter_bits(level, size, bits)
    return counted, total


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, scale: int = 2_000_000, cover: int = 80, lang: str = "lang", text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """Per language the `most` best phrases: lang, rank, phrase, a, l, r, n, score (the floor of scale * a / (l + r) at the worst cut, ties to the first).

    A null language is `und`, a null text is empty, and neither they nor texts without words give rows; repeated rows count as often as they come. Ties
    go to the greater a, then to the lesser phrase by bytes. An empty table gives no rows; other columns aren't read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    counted, total = phrase_counts(docs, longest, least, scratch, lang, text)
    longer = counted.where("size > 1").withColumnRenamed("f", "a")
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    part = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast(a AS decimal(20,0)) * {scale}BD) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    scored = scored.select("lang", "phrase", "size", "a", "w.l", "w.r", "w.score")
    # a part of a longer candidate that isn't one word shorter lies inside one that is, which is at least as frequent
    ends = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    inside = longer.where("size > 2").select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("of"))
    left = scored.alias("s").join(inside.alias("i"), (F.col("s.lang") == F.col("i.lang")) & (F.col("s.phrase") == F.col("i.phrase")) & (100 * F.col("of") >= cover * F.col("a")), "left_anti")
    return _best(scratch.keep(left, "left"), most).join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _best(rows: DataFrame, most: int, spread: int = 64) -> DataFrame:
    """The first `most` rows of each language: first those of each of `spread` shares of its rows, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    some = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most).drop("share", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
