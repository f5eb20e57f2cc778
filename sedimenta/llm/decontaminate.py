"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, in lower case. Seeds are every n-gram of a test item, and every n words with a gap of one before the last, which
are left where every n-th word is changed; an item of fewer than n words is a seed by itself. One pass over the corpus counts how often each seed
occurs in it; a second finds passages with seeds and aligns the item's words with the passage's. A rare seed has its passage aligned at once; a passage
that holds only frequent ones is left out where too few of the item's words are in it for any alignment to reach the share. Rare is what occurs no
oftener than the median seed of its block. So the counts decide what is tried first, never what is found, and a copy is found with as little as one seed
left, in a corpus of any size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bytehash import BASE, U, column_bytes, mix64, pieces, word_hashes, words
from sedimenta.llm.rows import tidy

MATCH, MISMATCH, GAP = 2, -1, -1
SCHEMA = "doc_id long, text_hash long, item_id long, score int, share double, n_seeds int, first_word long, last_word long"
_byte = np.arange(256)
#: All but ASCII letters and digits and the bytes of longer characters.
SEPARATOR = ~((_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column_bytes(pc.utf8_lower(column))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's begin."""
    starts, ends, row = words(data, offsets, SEPARATOR)
    return word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def row_seeds(word: np.ndarray, first: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at these distances from each place; 0 where they would run over the row's end."""
    out = np.full(len(word), U(len(shape)) * U(BASE) + U(shape[-1]), np.uint64)
    for k in shape:
        some = max(0, len(word) - k)
        out[:some] = mix64(out[:some] * U(BASE) + word[k:])
    out |= U(1)
    row_end = np.repeat(first[1:], np.diff(first))
    out[np.arange(len(word)) + shape[-1] + 1 > row_end] = 0
    return out


def shapes(n: int, length: int) -> list[tuple[int, ...]]:
    """The seeds of an item: its n words in sequence, and with a gap before the last; all of it if it is shorter."""
    if length < n:
        return [tuple(range(length))]
    return [tuple(range(n))] + [(*range(n - 1), n)] * (length > n > 1)


@dataclass
class Items:
    """A block of test items, of bounded size: word hashes, and the items of each seed with its first and last place there and its number."""

    shapes: list[tuple[int, ...]]
    words: dict[int, np.ndarray]
    places: dict[int, list[tuple[int, int, int, int]]]
    keys: np.ndarray
    rare: frozenset[int] = frozenset()

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> Items:
        data, offsets = lowered(pa.array([t or "" for _, t in rows], pa.string()))
        with np.errstate(over="ignore"):
            word, first = hashed_words(data, offsets)
        held, places, found = {}, defaultdict(list), set()
        for k, (item, _) in enumerate(rows):
            own = word[first[k] : first[k + 1]]
            if len(own):
                held[item] = own
                for shape in shapes(n, len(own)):
                    found.add(shape)
                    with np.errstate(over="ignore"):
                        seeds = row_seeds(own, np.array([0, len(own)]), shape)
                    seed, inverse, times = np.unique(seeds, return_inverse=True, return_counts=True)
                    least, last = np.full(len(seed), len(own)), np.zeros(len(seed), np.int64)
                    np.minimum.at(least, inverse, np.arange(len(own)))
                    np.maximum.at(last, inverse, np.arange(len(own)))
                    for g, *at in zip(seed.tolist(), least.tolist(), last.tolist(), times.tolist(), strict=True):
                        if g:
                            places[g].append((item, *at))
        return cls(sorted(found), held, dict(places), np.array(sorted(places), np.uint64))

    def seeds(self, counts: dict[int, int]) -> Items:
        """The same seeds, with those told apart that occur no oftener than the median one."""
        each = sorted(counts.get(g, 0) for g in self.places)
        median = each[len(each) // 2] if each else 0
        return Items(self.shapes, self.words, self.places, self.keys, frozenset(g for g in self.places if counts.get(g, 0) <= median))


class Lookup:
    """Which of many hashes are among a few: a bitmap first, a search for what passes it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(16, int(len(keys) * 16).bit_length())
        self.shift = U(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[(keys >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are among the keys."""
        at = np.flatnonzero(self.map[(hashes >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        return at[self.keys[k] == hashes[at]]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two word sequences, and where its alignment begins and ends in the passage (end excluded)."""
    m = len(passage)
    ramp = np.arange(m + 1) * -GAP
    score, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    here = np.arange(m + 1)
    for w in item:
        diagonal = np.empty(m + 1, np.int64)
        diagonal[0] = 0
        diagonal[1:] = score[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = score + GAP
        from_diagonal = np.concatenate(([0], begin[:-1]))
        new = np.where(diagonal >= up, diagonal, up)
        origin = np.where(diagonal >= up, from_diagonal, begin)
        fresh = new <= 0
        new[fresh], origin[fresh] = 0, here[fresh]
        lifted = new + ramp  # a gap in the item: the best cell to the left, less what the way costs
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, here, 0))
        left = top - ramp
        better = left > new
        new, origin = np.where(better, left, new), np.where(better, origin[source], origin)
        score, begin = new, origin
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k)
    return best


def passages(hits: list[tuple[int, int, int, int, bool]], length: int, share: float) -> Iterator[tuple[int, int, int, bool]]:
    """Stretches of a text that may hold an item of so many words, from the places of seeds in the text - with the seed's first and last place in the item, its number there and
    whether it is rare: start, end, seeds, and whether one is rare. An alignment with this share of the item's score has no more gaps than the slack, so it lies inside its seeds' stretch."""
    hits, slack = sorted(hits), int(MATCH * length * (1 - share) / -GAP) + 2
    start = 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k][0] - hits[k - 1][0] > length:
            group = hits[start:k]
            yield min(t - last for t, _, last, _, _ in group) - slack, max(t - least for t, least, *_ in group) + length + slack, sum(n for *_, n, _ in group), any(r for *_, r in group)
            start = k


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 3, share: float = 0.45, block_items: int = 20_000) -> DataFrame:
    """A row per document (doc_id, text_hash) and test item that it holds a copy of: the best alignment's score, its share of a whole copy's score, and its words.

    A copy is an alignment with at least `share` of the score that the item has with itself. Items go over the corpus in blocks of about `block_items`,
    so what is sent to the executors is bounded. A copy none of whose seeds is left isn't found. Items without words, null items and null or empty texts match nothing; a repeated
    document gives its rows again, a null key stays null, equal items each match. Very long texts are searched whole; a passage
    with many seeds is one stretch, so its cost follows its length. Other columns are ignored.
    """
    tests = benchmark.select(benchmark[item_key].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    blocks = max(1, -(-tests.count() // block_items))
    out = None
    for k in range(blocks):
        block = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        items = Items.of([(r["item_id"], r["text"]) for r in block.toLocalIterator()], n)
        counts = {r["gram"] & (1 << 64) - 1: r["n"] for r in gram_counts(rows, items).toLocalIterator()}
        found = aligned(rows, items.seeds(counts), share)
        out = found if out is None else out.unionByName(found)
    return out


def gram_counts(rows: DataFrame, items: Items) -> DataFrame:
    """How often each n-gram of the items occurs in all texts; summed in each task before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast((items.keys, items.shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        keys, shapes = shared.value
        lookup, total = Lookup(keys), np.zeros(len(keys), np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = lowered(batch.column(1))
                for i, j in pieces(offsets):
                    held = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for shape in shapes:
                        seeds = row_seeds(*held, shape)
                        total += np.bincount(np.searchsorted(keys, seeds[lookup.hits(seeds)]), minlength=len(keys))[: len(keys)]
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def aligned(rows: DataFrame, items: Items, share: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        items, out = shared.value, []
        lookup = Lookup(items.keys)
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = lowered(batch.column(1))
                ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                for i, j in pieces(offsets):
                    word, first = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    hits: dict[tuple[int, int], list[tuple[int, int, int, int, bool]]] = defaultdict(list)
                    for shape in items.shapes:
                        seeds = row_seeds(word, first, shape)
                        at = lookup.hits(seeds)
                        row = np.searchsorted(first, at, "right") - 1
                        for r, p, g in zip(row.tolist(), (at - first[row]).tolist(), seeds[at].tolist(), strict=True):
                            for item, least, last, n in items.places[g]:
                                hits[r, item].append((p, least, last, n, g in items.rare))
                    for (r, item), found in hits.items():
                        text, own = word[first[r] : first[r + 1]], items.words[item]
                        best = (0, 0, 0, 0)
                        for a, b, seeds, rare in passages(found, len(own), share):
                            a, b = max(0, a), min(len(text), b)
                            if not rare and np.isin(own, text[a:b]).sum() < share * len(own):
                                continue
                            score, s, e = smith_waterman(own, text[a:b])
                            best = max(best, (score, seeds, a + s, a + e))
                        if best[0] >= share * MATCH * len(own):
                            out.append((ids[i + r], hashes[i + r], item, best[0], best[0] / (MATCH * len(own)), best[1], best[2], best[3]))
                if len(out) > 10_000:
                    yield table(out)
                    out = []
        yield table(out)

    return rows.mapInArrow(run, SCHEMA)


def table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])
