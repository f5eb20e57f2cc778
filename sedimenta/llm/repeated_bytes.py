"""Removal of every byte inside a long string that occurs twice, by sorting sampled suffixes.

Sampling: in each window of `length - CORE + 1` places of a text, the place whose CORE-byte string hashes least is an anchor. Two copies of a
string of `length` bytes hold the same anchor at the same distance, so only strings around anchors with equal cores need to be compared. An
anchor's context is all that those strings can cover. Equal contexts are counted before anything is sorted, which settles
copies of any number; what is left are anchors whose surroundings differ somewhere.

Sorting: in each task the suffixes that begin at such anchors, and the reversed prefixes that end there, are put in order by deep-shallow
sorting: multikey quicksort over 8-byte symbols to a shallow depth, then, for groups with a longer common prefix, a blind trie. The longest common prefixes
of neighbours tell, for each distance a, which anchors share a bytes to the left and length - a to the right: those strings occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bytehash import Rolling, U, column_bytes, mix64, pieces
from sedimenta.llm.rows import tidy
from sedimenta.sources.scratch import Scratch

CORE = 101
SHALLOW = 32
ANCHOR = "doc_id long, text_hash long, core long, context long, at int, low int, high int, times int"
SPAN = "doc_id long, text_hash long, start int, end int"


# Sampling


def window_minima(keys: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` keys in sequence."""
    n = len(keys)
    blocks = -(-n // size)
    padded = np.full(blocks * size, ~U(0), np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts with at least `length` bytes: row, core hash, context hash, place, and the least and the greatest distance at which a string can begin."""
    window = length - CORE + 1
    rolling = Rolling(data, wide=True)
    long = np.flatnonzero(np.diff(offsets) >= length)
    found, rows = [], []
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    place = np.arange(len(data) - CORE + 1)
    core = mix64(rolling.span(place, place + CORE))
    keys = (core & ~U((1 << 24) - 1)) if len(data) < 1 << 24 else None
    for r in long.tolist():
        a, b = int(offsets[r]), int(offsets[r + 1]) - CORE + 1
        if keys is not None:
            least = window_minima(keys[a:b] | np.arange(b - a, dtype=np.uint64), window)
            at = np.unique(least & U((1 << 24) - 1)).astype(np.int64) + a
        else:  # a text of over 16 MB: ranks by the same upper bits serve as keys
            order = np.argsort(core[a:b] & ~U((1 << 24) - 1), kind="stable")
            rank = np.empty(b - a, np.uint64)
            rank[order] = np.arange(b - a, dtype=np.uint64)
            at = order[np.unique(window_minima(rank, window)).astype(np.int64)] + a
            at.sort()
        found.append(at)
        rows.append(np.full(len(at), r))
    at, row = np.concatenate(found), np.concatenate(rows)
    left = np.minimum(at - offsets[row], window - 1)
    right = np.minimum(offsets[row + 1] - at, length)
    context = mix64(mix64(rolling.span(at - left, at + right)) + (left * (length + 1) + right).astype(np.uint64))
    return row, core[at].view(np.int64), context.view(np.int64), at - offsets[row], length - right, left


def sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text_hash, text): a row for each different context of a text, at its first place, with the number of its places; and one without
    a core for each stretch that contexts cover which occur twice in the text itself."""
    tidy()
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in pieces(offsets):
                row, core, context, at, low, high = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                order = np.lexsort((at, context, core, row))
                same = np.zeros(len(order), bool)
                if len(order) > 1:
                    a, b = order[1:], order[:-1]
                    same[1:] = (row[a] == row[b]) & (core[a] == core[b]) & (context[a] == context[b])
                group = np.cumsum(~same) - 1
                times = np.bincount(group) if len(order) else np.zeros(0, np.int64)
                twice = order[times[group] > 1] if len(order) else order
                lead = order[~same]
                inner = merged(row[twice], at[twice] - high[twice], at[twice] - low[twice] + length)
                ids, hashes = batch.column(0)[i:j], batch.column(1)[i:j]
                k = len(inner[0])
                take = pa.array(np.concatenate((row[lead], inner[0])))
                blank = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), hashes.take(take),
                        pa.concat_arrays([pa.array(core[lead]), blank]), pa.concat_arrays([pa.array(context[lead]), blank]),
                        *(pa.array(np.concatenate((x, y)).astype(np.int32)) for x, y in ((at[lead], np.zeros(k)), (low[lead], inner[1]), (high[lead], inner[2]), (times, np.zeros(k)))),
                    ],
                    names=[f.split()[0] for f in ANCHOR.split(", ")],
                )


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each row, with those that touch made one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.concatenate((first[1:] - 1, [len(row) - 1]))] - shift[first]


# Deep-shallow sorting


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A trie that keeps of each inner node only the depth and the branching bytes; strings are compared once per insertion. A string's end sorts first."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth, self.root = strings, depth, None

    def _byte(self, k: int, at: int) -> int:
        s = self.strings[k]
        return s[at] + 1 if at < len(s) else 0

    def insert(self, k: int) -> None:
        """A leaf is [string, ...] of equal strings, an inner node (depth, {byte: child})."""
        if self.root is None:
            self.root = [k]
            return
        node, path = self.root, []
        while isinstance(node, tuple):
            path.append(node)
            node = node[1].get(self._byte(k, node[0])) or next(iter(node[1].values()))
        lcp = common_prefix(self.strings[k], self.strings[node[0]], self.depth)
        if lcp == len(self.strings[k]) == len(self.strings[node[0]]):
            node.append(k)
            return
        parent, below = None, self.root
        for inner in path:
            if inner[0] >= lcp:
                below = inner
                break
            parent, below = inner, inner[1].get(self._byte(k, inner[0]))
        if isinstance(below, tuple) and below[0] == lcp:
            below[1][self._byte(k, lcp)] = [k]
        elif below is None:
            parent[1][self._byte(k, parent[0])] = [k]
        else:
            split = (lcp, {self._byte(node[0], lcp): below, self._byte(k, lcp): [k]})
            if parent is None:
                self.root = split
            else:
                parent[1][self._byte(k, parent[0])] = split

    def ordered(self) -> Iterator[tuple[int, int]]:
        """Each string, and how many bytes it shares with the one before (the first: `depth`)."""
        todo, lcp = [(self.root, self.depth)] if self.root is not None else [], self.depth
        while todo:
            node, lcp = todo.pop()
            if isinstance(node, tuple):
                children = sorted(node[1].items())
                todo += [(child, node[0]) for _, child in reversed(children[1:])]
                todo.append((children[0][1], lcp))
                continue
            for n, k in enumerate(node):
                yield k, lcp if n == 0 else len(self.strings[k])


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and what each shares with the one before it (the first: 0).

    Multikey quicksort runs on all open groups of a depth at once: symbols of 8 bytes are compared with the middle one of the group and split it in
    three. Groups that still hold together at SHALLOW bytes, and small ones, go to a blind trie.
    """
    n = len(strings)
    symbols = SHALLOW // 8
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, symbols).astype(np.uint64) if n else np.zeros((0, symbols), np.uint64)
    order: list[int] = []
    todo = [(np.arange(n), 0)] if n else []
    deep: list[tuple[np.ndarray, int]] = []
    while todo:
        own, depth = todo.pop()
        if len(own) <= 12 or depth == symbols:
            deep.append((own, depth))
            continue
        symbol = words[own, depth]
        pivot = np.partition(symbol, len(own) // 2)[len(own) // 2]
        less, more = symbol < pivot, symbol > pivot
        parts = [(own[less], depth), (own[~less & ~more], depth + 1), (own[more], depth)]
        todo += [p for p in reversed(parts) if len(p[0])]
    shared = np.zeros(n, np.int64)
    for own, depth in deep:
        if len(own) == 1:
            order.append(int(own[0]))
            continue
        at = min(8 * depth, min(len(strings[k]) for k in own.tolist()))
        trie = BlindTrie(strings, at)
        for k in own.tolist():
            trie.insert(k)
        for place, (k, lcp) in enumerate(trie.ordered()):
            if place:
                shared[len(order)] = lcp
            order.append(k)
        # groups of padded symbols hold shorter strings first, as the trie does
    done = np.array(order, np.int64)
    starts = np.cumsum([0, *(len(own) for own, _ in deep)])[:-1][1:]
    for i in starts.tolist():
        shared[i] = common_prefix(strings[order[i - 1]], strings[order[i]])
    return done, shared


def repeated_distances(group: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor the least and greatest distance a for which a bytes to its left and length - a to its right stand at another anchor of the
    group too; -1 where there is none. left is given backwards from the anchor."""
    n = len(group)
    head = [int(g).to_bytes(8, "big", signed=True) for g in group]
    classes = []
    for strings in (left, right):
        order, shared = deep_shallow([h + s for h, s in zip(head, strings, strict=True)])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        classes.append((rank, shared - 8))
    n_left, n_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    low, high = np.full(n, -1), np.full(n, -1)
    for a in range(length - CORE + 1):
        (rank_l, lcp_l), (rank_r, lcp_r) = classes
        of_left, of_right = np.cumsum(lcp_l < a)[rank_l], np.cumsum(lcp_r < length - a)[rank_r]
        able = np.flatnonzero((n_left >= a) & (n_right >= length - a))
        if not len(able):
            continue
        pair = of_left[able] * (n + 1) + of_right[able]
        ordered = np.argsort(pair, kind="stable")
        same = pair[ordered][1:] == pair[ordered][:-1]
        twice = np.zeros(len(able), bool)
        twice[ordered[1:][same]] = twice[ordered[:-1][same]] = True
        hit = able[twice]
        high[hit] = a
        low[hit[low[hit] < 0]] = a
    return low, high


# The job


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int, most: int) -> DataFrame:
    """(doc_id, text_hash, start, end) of stretches that are covered by strings of `length` bytes which occur twice; those of a text may overlap."""
    all_rows = scratch.keep(docs.mapInArrow(lambda b: sampled(b, length), ANCHOR), "anchors")
    inner = all_rows.where(F.col("core").isNull()).select("doc_id", "text_hash", F.col("low").alias("start"), F.col("high").alias("end"))
    rows = all_rows.where(F.col("core").isNotNull())
    contexts = rows.groupBy("core", "context").agg(F.sum("times").alias("n"), F.count("*").alias("texts"), F.min(F.struct("doc_id", "text_hash", "at", "low", "high")).alias("first"))
    contexts = scratch.keep(contexts, "contexts")
    cores = contexts.groupBy("core").agg(F.sum("n").alias("all"), F.count("*").alias("k")).where(F.col("all") > 1)
    # a table of its own, so that Spark can split the contexts of a core that has very many
    shared = scratch.keep(contexts.join(scratch.keep(cores, "cores"), "core").select("core", "context", "n", "texts", "k", "first.*"), "shared")
    scratch.drop("contexts", "cores")

    mixed = shared.where("k > 1")
    surrounding = scratch.keep(_surroundings(docs, mixed, length), "surroundings")
    few = surrounding.where(F.col("k") <= most)
    settled = few.repartition("core").sortWithinPartitions("core").mapInArrow(lambda b: _sorted_groups(b, length), "core long, context long, lo int, hi int")
    many = surrounding.where(F.col("k") > most)
    if not many.isEmpty():
        settled = settled.unionByName(_by_halves(many, scratch, length))
    # a context that occurs twice is covered as far as it goes
    whole = shared.where("n > 1").select("core", "context", F.col("low").alias("lo"), F.col("high").alias("hi"))
    covered = whole.unionByName(settled).groupBy("core", "context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = rows.select("core", "context", "doc_id", "text_hash", "at").join(scratch.keep(covered, "covered"), ["core", "context"])
    return spans.where("lo <= hi").select("doc_id", "text_hash", (F.col("at") - F.col("hi")).cast("int").alias("start"), (F.col("at") - F.col("lo") + length).cast("int").alias("end")).unionByName(inner)


def _surroundings(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """The bytes around the first place of each context in `mixed`, left ones backwards."""
    wanted = mixed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("core", "context", "at", "low", "high", "n", "k")).alias("places"))
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.text_hash == wanted.text_hash)).select("text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1), strict=True):
                data, out = text.as_py().encode(), []
                for p in places.as_py():
                    at = p["at"]
                    out.append((p["core"], p["context"], p["n"], p["k"], data[at - p["high"] : at][::-1], data[at : at + length - p["low"]]))
                for i in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), [pa.int64()] * 4 + [pa.binary()] * 2, strict=True)], names=["core", "context", "n", "k", "left", "right"])

    return texts.mapInArrow(run, "core long, context long, n long, k long, left binary, right binary")


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of rows in core order: sorts about 20,000 suffixes at a time, whole groups only."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        core = np.array([r[0] for r in rows], np.int64)
        low, high = repeated_distances(core, [r[2] for r in rows], [r[3] for r in rows], length)
        yes = np.flatnonzero(low >= 0)
        return pa.RecordBatch.from_arrays([pa.array(core[yes]), pa.array([rows[i][1] for i in yes.tolist()], pa.int64()), pa.array(low[yes].astype(np.int32)), pa.array(high[yes].astype(np.int32))], names=["core", "context", "lo", "hi"])

    for batch in batches:
        fresh = list(zip(*(batch.column(c).to_pylist() for c in ("core", "context", "left", "right")), strict=True))
        for row in fresh:
            if len(held) >= 20_000 and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _by_halves(many: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """The exact way for anchors of a core with very many contexts, which no task could sort: ranges of distances are cut until they are settled.

    Of a range of distances, the bytes that all its strings share must occur at two contexts, else the range is dropped; where the bytes that its
    strings cover together occur twice, it is settled whole; other ranges are cut. Counts are combined before the shuffle.
    """
    schema = "core long, context long, range_lo int, range_hi int, common binary, hull binary, left binary, right binary"

    def cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for core, context, lo, hi, left, right in zip(*(batch.column(c).to_pylist() for c in ("core", "context", "range_lo", "range_hi", "left", "right")), strict=True):
                for a in range(lo - lo % width, hi + 1, width):  # the same ranges for all, wherever their texts end
                    b = min(a + width - 1, length - CORE)
                    if a > len(left) or length - b > len(right):
                        continue  # no string of this range fits into the text
                    first, last = max(a, length - len(right)), min(b, len(left))  # those that fit
                    common = left[:a][::-1] + right[: length - b]
                    hull = left[:last][::-1] + right[: length - first]
                    digests = (hashlib.blake2b(x, digest_size=16, key=f"{tag}".encode()).digest() for x, tag in ((common, (a, b)), (hull, (a, b, first, last))))
                    out.append((core, context, first, last, *digests, left, right))
                if len(out) >= 2000:
                    yield _ranges(out)
                    out = []
            yield _ranges(out)

    now, found = many.select("core", "context", F.lit(0).alias("range_lo"), F.lit(length - CORE).alias("range_hi"), "left", "right"), None
    for k, width in enumerate((75, 15, 5, 1)):
        pieces_ = scratch.keep(now.mapInArrow(lambda b, w=width: cut(b, w), schema), f"ranges-{k}")
        hulls = scratch.keep(pieces_.groupBy("core", "common", "hull").agg(F.count("*").alias("n"), F.min("context").alias("one")), f"hulls-{k}")
        commons = scratch.keep(hulls.groupBy("core", "common").agg(F.sum("n").alias("all"), F.min("n").alias("least")).where(F.col("all") > 1), f"commons-{k}")
        told = scratch.keep(pieces_.join(hulls, ["core", "common", "hull"]).join(commons, ["core", "common"]), f"told-{k}")
        settled = told.where("n > 1").select("core", "context", F.col("range_lo").alias("lo"), F.col("range_hi").alias("hi"))
        found = settled if found is None else found.unionByName(settled)
        # what is still open, and of each hull that is settled one context that may be its match
        now = told.where("least = 1 AND (n = 1 OR context = one)").select("core", "context", "range_lo", "range_hi", "left", "right")
        scratch.drop(f"ranges-{k}", f"hulls-{k}", f"commons-{k}")
        if now.isEmpty():
            break
    return found.groupBy("core", "context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["core", "context", "range_lo", "range_hi", "common", "hull", "left", "right"])


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text", length: int = 400, most: int = 256) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (runs removed) and kept (the bytes that are left, in their order).

    Every byte goes that is covered by a string of `length` bytes which starts anywhere else too, in the same or another row; strings are judged on
    the input. Null and empty texts, and texts shorter than `length`, keep what they have. Repeated rows are copies of each other and lose
    whatever lies in long strings; a null key is a key like any other. Very long texts are read whole. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spans = scratch.keep(repeated_spans(rows, scratch, length, most).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop("anchors", "shared", "surroundings", "covered", *(f"told-{k}" for k in range(4)))
    joined = rows.join(spans, rows.doc_id.eqNullSafe(spans.doc_id) & (rows.text_hash == spans.text_hash), "left").select(rows.doc_id, rows.text, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(runs), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
