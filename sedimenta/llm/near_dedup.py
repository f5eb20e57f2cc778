"""Near-duplicate groups by SuperMinHash, banding, verification on whole sets, and grouping of the links.

A document's set holds its distinct `width`-word shingles. Equal sets are one node. A node's SuperMinHash signature (each shingle ranks the
places of the signature by a correlated permutation; a document stops once no later rank can win) is cut into bands; nodes that share
a band are candidates. First every member of a band's bucket is held against the bucket's most central node, which links groups of copies in
linear time; then, in buckets that still hold several components, the members of different components are compared, and only links that join two of
them leave the bucket. Links are confirmed on the full sets, and components come from repeated grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bytehash import BLANK, LOWER, U, column_bytes, gram_hashes, mix64, pieces, word_hashes, words
from sedimenta.llm.rows import tidy
from sedimenta.operators.components import connected_components
from sedimenta.sources.scratch import Scratch

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
NODE = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, signature binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted hashes of its different shingles; with fewer words than the width, of the whole sequence."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, BLANK)
    word = word_hashes(data, starts, ends)
    grams = gram_hashes(word, width)
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(gram_hashes(word[a:b], int(b - a)) + U(int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def superminhash(elements: np.ndarray, row: np.ndarray, n_rows: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n_rows x places) of sets given as hashes and the row of each; rows without elements keep the largest value.

    In round j every element still in play draws a fraction and swaps one more entry of its own permutation (Fisher-Yates); its value at the
    place drawn is j plus the fraction, and each place keeps its least. A row is done when its largest rank is at most j.
    """
    best = np.full((n_rows, places), ~U(0), np.uint64)
    flat, order = best.reshape(-1), None
    for j in range(places):
        if not len(elements):
            break
        draw = mix64(elements + U(j + 1) * U(0x9E3779B97F4A7C15))
        pick = j + ((draw >> U(44)) * U(places - j) >> U(20)).astype(np.int64)
        if j == 0:
            place, drawn = pick, pick
        else:
            if order is None:
                order = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
                each = np.arange(len(elements))
                order[each, 0], order[each, drawn] = drawn, 0
            each = np.arange(len(elements))
            place = order[each, pick].astype(np.int64)
            order[each, pick] = order[each, j]
        np.minimum.at(flat, row * places + place, (U(j) << U(44)) | (draw & U((1 << 44) - 1)))
        playing = (best.max(1) >> U(44) > U(j))[row]
        if not playing.all():
            elements, row = elements[playing], row[playing]
            order, drawn = None if order is None else order[playing], None if j else drawn[playing]
    return best


def signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, text_hash): the first and the last, the set's size and digest, the hashes of its bands, and a byte of each place of its signature with 4 of each band."""
    tidy()
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sizes = np.array([len(s) for s in sets], np.int64)
                signature = mix64(superminhash(np.concatenate(sets), np.repeat(np.arange(j - i), sizes), j - i))
                bands = signature.reshape(j - i, BANDS, ROWS)
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (j - i, 1))
                for k in range(ROWS):
                    key = mix64(key * U(0x9E3779B97F4A7C15) + bands[:, :, k])
                nodes = [digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(sizes), pa.array(nodes, pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in np.concatenate(((signature >> U(56)).astype(np.uint8), key.astype(np.uint32).view(np.uint8)), axis=1)], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands", "signature"],
                )


def digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def whole_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of (node, text): the node, the digest of the text's set, and the set."""
    tidy()
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                held = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([digest(s) for s in held], pa.binary()), pa.array(held, pa.binary())], names=["node", "made", "shingles"])


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, most: int = 1024, room: int = 32 << 20) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id that links reach), kept (it is its own component), text_hash, stays (it is the group's first row).

    Two documents are linked where 100 * |A and B| >= percent * |A or B|. A document without words has an empty set and stands alone. Equal texts,
    repeated rows and repeated keys of linked texts share a component; a null key takes part, is never the least unless alone, and isn't kept. `stays` tells rows apart where
    `kept` can't: of each group the row of least key, null last, and then of least text hash, and every copy of exactly that row; and each row without words. Buckets of more than
    `most` nodes, or whose sets take more than `room` bytes, are cut into blocks, of which all pairs are compared; none is dropped.
    The banding and the signatures' estimate together miss a pair at exactly the threshold about once in 200,000 and closer ones still less often.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dedup")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    base = scratch.keep(rows.mapInArrow(lambda b: signed(b, width), NODE), "rows")
    nodes = scratch.keep(
        base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")), "nodes"
    )
    entry = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node", "n_shingles")
    # tables of their own, so that Spark can split the nodes of a bucket that has very many
    full = scratch.keep(entry.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), "full")
    members = scratch.keep(entry.join(full, "bucket"), "members")
    # what the others were copied from shares more buckets, and larger ones, than they share with each other
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    centres = members.where("n > 2").join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", "node"))["node"].alias("centre"))
    centres = centres.unionByName(members.where("n = 2").groupBy("bucket").agg(F.min("node").alias("centre")))
    apart = members.join(scratch.keep(centres, "centres"), "bucket").where(F.col("node") != F.col("centre"))
    stars = scratch.keep(apart.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "stars")
    links = scratch.keep(confirmed(scratch.keep(_close(stars, nodes, percent), "tried"), nodes, rows, scratch, width, percent), "links-0")
    labels = scratch.keep(connected_components(links, scratch, "first"), "labels")
    scratch.drop("full", "centres", "stars", "tried", "sets-stars", "first")
    found = scratch.keep(_across(members, nodes, rows, labels, scratch, width, percent, most, room), "links-1")
    if not found.isEmpty():
        labels = scratch.keep(connected_components(links.unionByName(found), scratch, "second"), "labels-2")
    scratch.drop("nodes", "members", "held", "several", "dealt", "sets-across", "links-0", "links-1", "second")
    labelled = base.select("doc_id", "text_hash", "n_shingles", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = labelled.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("first"))
    alone = labelled.where(F.col("component").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("stays"))
    out = labelled.join(scratch.keep(least, "least"), "component").select("doc_id", "n_shingles", "component_id", "text_hash", place.eqNullSafe(F.col("first")).alias("stays")).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree in nearly as many places as a link's would (six standard deviations less)."""
    least = estimate_floor(percent)
    of = nodes.select("node", "signature")
    both = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES + 4 * BANDS)[:, :PLACES] for c in ("sa", "sb")]
            yield batch.select(["a", "b"]).filter(pa.array((data[0] == data[1]).sum(1) >= least))

    return both.mapInArrow(keep, "a binary, b binary")


def estimate_floor(percent: int) -> int:
    share = percent / 100
    return int(PLACES * share - 6 * (PLACES * share * (1 - share)) ** 0.5)


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Pairs that are links by their full sets."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = scratch.keep(_sets(nodes.select("node", "doc_id").join(ends, "node", "left_semi"), rows, width), "sets-stars")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            yes = [similar(a.as_buffer(), b.as_buffer(), percent) for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(keep, "a binary, b binary")


def _sets(wanted: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of nodes (node, doc_id), each made once, from the text of the node's least document."""
    made = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id)).select("node", "text").mapInArrow(lambda b: whole_sets(b, width), "node binary, made binary, shingles binary")
    return made.where("made = node").select("node", "shingles").dropDuplicates(["node"])  # a key may have several texts


def _across(members: DataFrame, nodes: DataFrame, rows: DataFrame, labels: DataFrame, scratch: Scratch, width: int, percent: int, most: int, room: int) -> DataFrame:
    """Links between different components, out of the buckets that hold several; of each bucket only those that join two components."""
    held = scratch.keep(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("n"), "held")
    n, size = F.count("*"), 8 * F.sum("n_shingles")
    several = held.groupBy("bucket").agg(F.ceil(F.greatest(n / most, size / room)).cast("int").alias("fills"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = several.where(F.col("lo") != F.col("hi")).select("bucket", F.when(F.col("fills") <= 1, 1).otherwise(2 * F.col("fills")).alias("blocks"))
    several = scratch.keep(several, "several")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    dealt = held.join(several, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band", "node", "component")
    dealt = scratch.keep(dealt, "dealt")
    sets = scratch.keep(_sets(dealt.select("node").distinct().join(nodes, "node").select("node", "doc_id"), rows, width), "sets-across")
    least = estimate_floor(percent)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(-1, PLACES + 4 * BANDS)
        data, bands = data[:, :PLACES], np.ascontiguousarray(data[:, PLACES:]).view(np.uint32)
        component = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        block, square = group["own"].to_numpy(), group["lo"].iat[0] != group["hi"].iat[0]
        node, band, out = group["node"].to_numpy(), group["band"].to_numpy(), []
        sizes = group["shingles"].str.len().to_numpy() // 8
        ends = np.concatenate(([0], np.cumsum(sizes)))
        names, shingle = np.unique(np.frombuffer(b"".join(group["shingles"]), np.uint64), return_inverse=True)
        mine = np.zeros(len(names), bool)
        for i in range(len(node) - 1):
            wanted = component[i + 1 :] != component[i]
            if square:  # pairs of one block are compared where both blocks are the same
                wanted &= block[i + 1 :] != block[i]
            others = np.flatnonzero(wanted) + i + 1
            others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
            near = others[(data[others] == data[i]).sum(1) >= least]
            first = (bands[near] == bands[i]).argmax(1)  # the pair is compared in the first band that it shares, and in no other
            near = near[(first == band[i]) | (first == band[near])]
            mine[shingle[ends[i] : ends[i + 1]]] = True
            for k in near.tolist():
                if component[k] != component[i]:
                    both = int(mine[shingle[ends[k] : ends[k + 1]]].sum())
                    if 100 * both >= percent * int(sizes[i] + sizes[k] - both):
                        out.append((node[i], node[k]))
                        component[component == component[k]] = component[i]
            mine[shingle[ends[i] : ends[i + 1]]] = False
        return pd.DataFrame(out, columns=["a", "b"])

    full = dealt.join(nodes.select("node", "signature"), "node").join(sets, "node")
    return full.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a binary, b binary").distinct()
