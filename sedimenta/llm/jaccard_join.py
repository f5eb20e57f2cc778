"""Jaccard join of documents on word shingles, exact: size bands cut into tiles, bitmap signatures, and intersections of sorted arrays.

A document's set is the sorted hashes of its different shingles; equal sets are one node. Sizes fall into bands so wide that linked sets lie in the same
band or in neighbours. Linked sets differ in few shingles, at most d in a pair of bands, so that of d + 1 equal parts of the hash space one at least holds exactly the same
shingles in both: a tile is a band with its next, a part, and what the part holds. Nodes that share a tile are compared by their bitmaps, whose cells
hold the parity of the shingles that fall there: each cell that differs is due to a shingle of one set alone, which bounds the overlap from above. Pairs
within the bound are confirmed on the sorted sets. For classes, each tile's members are first held against its most central node, then only members of different
components meet; nothing is estimated and no pair is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bytehash import BASE, U, column_bytes, mix64, pieces
from sedimenta.llm.near_dedup import confirmed, digest, shingle_sets
from sedimenta.llm.rows import tidy
from sedimenta.operators.components import connected_components
from sedimenta.sources.scratch import Scratch

NODE = "doc_id long, n_shingles long, node binary, tiles array<long>, bits binary"


def band_ends(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """The largest size of each band: from a band's least size up to what may be linked with it."""
    ends, least = [], 1
    while least <= largest:
        ends.append(max(least, least * 100 // percent))
        least = ends[-1] + 1
    return np.array(ends, np.int64)


def most_apart(end: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles linked sets may have alone, where the smaller has at most `end`: |A| + |B| - 2 |A and B| is at most this share of |A| + |B|."""
    return (end + end * 100 // percent) * (100 - percent) // (100 + percent)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each cell; cells are a power of two, at least twice the shingles, and halves fold onto each other."""
    width = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8))


def folded(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    """A bitmap (or rows of them) with fewer cells."""
    while bits.shape[-1] > n_bytes:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def tile_keys(shingles: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a set: in its own band with the next, and in the one before with its own; where linked sets are equal there are none."""
    own, sums, out = int(np.searchsorted(ends, len(shingles))), np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(shingles ^ U(BASE)), dtype=np.uint64))), []
    for band in (own - 1, own):
        apart = int(most_apart(ends[band], percent)) if band >= 0 else 0
        if apart:
            edges = (np.arange(1, apart + 1, dtype=np.float64) * (2.0**64 / (apart + 1))).astype(np.uint64)
            at = np.concatenate(([0], np.searchsorted(shingles, edges), [len(shingles)]))
            part = np.arange(apart + 1, dtype=np.uint64) + U(band << 40)
            out.append(mix64((sums[at[1:]] - sums[at[:-1]]) ^ mix64(part * U(BASE))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def described(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text): the id, the set's size and digest, its tiles and its bitmap."""
    tidy()
    ends = band_ends(percent)
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([tile_keys(s, ends, percent).view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "tiles", "bits"],
                )


def may_link(apart, a, b, percent: int):
    """Whether sets of these sizes may be linked if at least so many shingles are in one of them alone."""
    both = np.minimum((a + b - apart) // 2, np.minimum(a, b))
    return 100 * both >= percent * (a + b - both)


def within_bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps leave room for a link."""
    of = nodes.select("node", "n_shingles", "bits")
    both = pairs.join(of.toDF("a", "na", "ba"), "a").join(of.toDF("b", "nb", "bb"), "b").select("a", "b", "na", "nb", "ba", "bb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            apart = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                p, q, n = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), min(len(x), len(y))
                apart.append(int(np.bitwise_count(folded(p, n) ^ folded(q, n)).sum()))
            yes = may_link(np.array(apart, np.int64), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return both.mapInArrow(keep, "a binary, b binary")


def _meeting(members: DataFrame, nodes: DataFrame, labels: DataFrame | None, scratch: Scratch, percent: int, most: int, room: int) -> DataFrame:
    """Pairs of nodes that share a tile, lie in different components and stay within the bound. A tile of many nodes is cut into blocks, which meet two by two."""
    held = members.withColumn("component", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = scratch.keep(held.drop("n"), "held")
    fills = F.ceil(F.greatest(F.count("*") / most, F.sum("n_shingles") / room)).cast("int")
    several = held.groupBy("tile").agg(fills.alias("fills"), F.min("component").alias("least"), F.max("component").alias("greatest")).where("least <> greatest")
    several = scratch.keep(several.select("tile", F.when(F.col("fills") <= 1, 1).otherwise(2 * F.col("fills")).alias("blocks")), "several")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    dealt = held.join(several, "tile").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tile", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "n_shingles").join(nodes.select("node", "bits"), "node")

    dealt = dealt.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi")
    return dealt.select("tile", "lo", "hi", "own", "node", "component", "n_shingles", "bits").mapInArrow(lambda b: _compared(b, percent), "a binary, b binary").distinct()


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their blocks: the pairs within the bound of each block. What is held is a batch and the block that it cuts, which is of bounded size."""
    tidy()
    rest = None
    for batch in itertools.chain(batches, [None]):
        table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table is None:
            return
        keys = np.stack([table.column(c).to_numpy() for c in (0, 1, 2)])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        upto = edges[-1] if batch is None else edges[-2]
        whole, rest = table.slice(0, upto).combine_chunks(), table.slice(upto)
        own, size, square = whole.column(3).to_numpy(), whole.column(6).to_numpy(), keys[1] != keys[2]
        component = whole.column(5).combine_chunks().dictionary_encode().indices.to_numpy() if upto else own
        node, bits, out = whole.column(4).to_pylist(), whole.column(7).to_pylist(), []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi <= upto:
                some = slice(lo, hi)
                for i, k in _pairs(component[some], own[some], square[lo], size[some], bits[some], percent):
                    out.append((node[lo + i], node[lo + k]) if node[lo + i] < node[lo + k] else (node[lo + k], node[lo + i]))
        columns = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])


def _pairs(component: np.ndarray, own: np.ndarray, square: bool, size: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Places of rows of different components - of different blocks, where two meet - that are within the bound. One of any two is not in the largest component, so only
    those rows are held against all."""
    width = min(map(len, bits))
    cells = np.stack([folded(np.frombuffer(b, np.uint8), width) for b in bits]).view(np.uint64)
    largest = np.bincount(component).argmax()
    minor = component != largest
    order = np.concatenate((np.flatnonzero(minor), np.flatnonzero(~minor)))
    component, own, size, cells = component[order], own[order], size[order], cells[order]
    for i in range(int(minor.sum())):
        other = component[i + 1 :] != component[i]
        if square:
            other &= own[i + 1 :] != own[i]
        other = np.flatnonzero(other) + i + 1
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        apart = np.bitwise_count(cells[other] ^ cells[i]).sum(1, dtype=np.int64)
        for k in other[may_link(apart, size[other], size[i], percent)].tolist():
            yield int(order[i]), int(order[k])


def _tables(docs: DataFrame, scratch: Scratch, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts (doc_id, text), rows (doc_id, n_shingles, node), nodes, and the members of tiles that have several."""
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = scratch.keep(texts.mapInArrow(lambda b: described(b, width, percent), NODE), "rows")
    first = [F.any_value(c).alias(c) for c in ("n_shingles", "tiles", "bits")]
    nodes = scratch.keep(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *first), "nodes")
    entry = nodes.select(F.explode("tiles").alias("tile"), "node", "n_shingles")
    full = scratch.keep(entry.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1"), "full")
    return texts, rows.select("doc_id", "n_shingles", "node"), nodes.drop("tiles"), scratch.keep(entry.join(full, "tile"), "members")


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, most: int = 1024, room: int = 32 << 20, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs (a, b) of the digests of sets, and the membership (doc_id, n_shingles, node, copies); equal sets are one node, and are linked with each other.

    The pairs of one group of n near copies are up to n * n / 2; where classes will do, `jaccard_classes` doesn't make them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    texts, rows, nodes, members = _tables(docs, scratch, key, text, width, percent)
    pairs = scratch.keep(_meeting(members, nodes, None, scratch, percent, most, room), "pairs")
    return confirmed(pairs, nodes, texts, scratch, width, percent), rows.join(nodes.select("node", "copies"), "node", "left").select("doc_id", "n_shingles", "node", "copies")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, most: int = 1024, room: int = 32 << 20, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included).

    Two documents are linked where 100 * |A and B| >= percent * |A or B|; with fewer words than `width` the whole sequence is the one shingle. Nulls, empty texts and texts without words have an
    empty set and stand alone. Equal texts and repeated rows share a component; a null key takes part and is never the least unless alone. An empty
    table gives no rows, and other columns aren't read. Tiles of more than `most` nodes, or of more than `room` shingles, are cut into blocks that meet two by two; none is dropped.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    texts, rows, nodes, members = _tables(docs, scratch, key, text, width, percent)
    # what the others were copied from shares more tiles than they share with each other
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    centres = members.where("n > 2").join(rank, "node").groupBy("tile").agg(F.max(F.struct("rank", "node"))["node"].alias("centre"))
    centres = centres.unionByName(members.where("n = 2").groupBy("tile").agg(F.min("node").alias("centre")))
    apart = members.select("tile", "node").join(scratch.keep(centres, "centres"), "tile").where("node <> centre")
    stars = scratch.keep(apart.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "stars")
    links = scratch.keep(confirmed(scratch.keep(within_bound(stars, nodes, percent), "tried"), nodes, texts, scratch, width, percent), "links-0")
    labels = scratch.keep(connected_components(links, scratch, "first"), "labels")
    scratch.drop("full", "centres", "sets-stars", "first")
    tried = scratch.keep(_meeting(members, nodes, labels, scratch, percent, most, room).join(stars, ["a", "b"], "left_anti"), "pairs")
    scratch.drop("members", "held", "several", "stars", "tried")
    found = scratch.keep(confirmed(tried, nodes, texts, scratch, width, percent), "links-1")
    if not found.isEmpty():
        labels = scratch.keep(connected_components(links.unionByName(found), scratch, "second"), "labels-2")
    scratch.drop("nodes", "pairs", "sets-stars", "links-0", "links-1", "second")
    labelled = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = scratch.keep(labelled.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    alone = labelled.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)
