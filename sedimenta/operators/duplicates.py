"""Duplicate windows of tokens, and the groups they make."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources.scratch import Scratch

# Fixed value: names of licence texts, which are alike by design.
LICENSE_NAMES = r"(?i)^(licen[cs]e|notice|copying)(\..*)?$"


def is_license_like(rel_path: Column) -> Column:
    return F.substring_index(F.translate(rel_path, "\\", "/"), "/", -1).rlike(LICENSE_NAMES)


def _no_licences(files: DataFrame) -> DataFrame:
    return files.where(~is_license_like(F.col("rel_path"))) if "rel_path" in files.columns else files


TOKEN = r"[\p{L}\p{N}_]+"
DETAIL = "file_id string, hash string, start_line int, end_line int, unique_tokens int"


def _details(files: DataFrame, size: int, least_distinct: int, most_share: float) -> DataFrame:
    """Of files (file_id, text, at): the windows at these places, null for all, but for those with too few different tokens or one that is too frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = regex.compile(TOKEN)
        for batch in batches:
            out: list[tuple] = []
            for file, text, at in zip(*batch.columns, strict=True):
                name = file.as_py()
                out += [(name, *w) for w in _windows(token, text.as_py() or "", at.values.to_pylist() if at.is_valid else None, size, least_distinct, most_share)]
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return files.select(F.col("file_id").cast("string"), "text", "at").mapInArrow(run, DETAIL)


def _tokens(token: regex.Pattern, text: str) -> tuple[list[str], list[int]]:
    """A text's tokens, and the line of each."""
    found, lines = [], []
    for k, line in enumerate(text.split("\n"), 1):
        some = token.findall(line)
        found += some
        lines += [k] * len(some)
    return found, lines


def _mixed(found: list[str], size: int, least_distinct: int, most_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: how many different tokens, and whether they are enough and none is too frequent.

    A token that also stands before, within reach of a window, takes one off all windows that hold both; one that stands so often that its share is too great bars all that hold them.
    """
    n, ids = len(found) - size + 1, {}
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    word = np.fromiter((ids.setdefault(t, len(ids)) for t in found), np.int64, len(found))
    order = np.argsort(word, kind="stable")

    def both(back: int) -> np.ndarray:
        """For each window, how many of its tokens stand in it `back` times before, too."""
        now, then = order[back:], order[: max(0, len(order) - back)]
        near = (word[now] == word[then]) & (now - then < size)
        first, last = np.maximum(now[near] - size + 1, 0), np.minimum(then[near], n - 1)
        steps = np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)
        return np.cumsum(steps[: n + 1])[:n]

    distinct = size - both(1)
    return distinct, (distinct >= least_distinct) & (both(int(most_share * size)) == 0 if int(most_share * size) else False)


def _windows(token: regex.Pattern, text: str, at: list[int] | None, size: int, least_distinct: int, most_share: float) -> Iterator[tuple[str, int, int, int]]:
    """(hash, first line, last line, different tokens) of a text's windows at these places, or at all."""
    found, lines = _tokens(token, text)
    distinct, kept = _mixed(found, size, least_distinct, most_share)
    for i in np.flatnonzero(kept).tolist() if at is None else at:
        if kept[i]:
            yield hashlib.sha1("\0".join(found[i : i + size]).encode()).hexdigest(), lines[i], lines[i + size - 1], int(distinct[i])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=[f.split()[0] for f in DETAIL.split(", ")])


def duplicate_windows(files: DataFrame, size: int = 50, least_distinct: int = 15, most_share: float = 0.6, text: str = "text") -> DataFrame:
    """(file_id, hash, start_line, end_line, unique_tokens) of every run of `size` identifiers, unless too few are different or one is too frequent.

    Files with a rel_path that names a licence text are left out. Nothing is shuffled.
    """
    kept = _no_licences(files).select("file_id", F.col(text).alias("text"), F.lit(None).cast("array<int>").alias("at"))
    return _details(kept, size, least_distinct, most_share)


def window_totals(files: DataFrame, size: int = 50, least_distinct: int = 15, most_share: float = 0.6, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(file_id, n, hashes, tokens, least, spans) of each file with duplicate_windows(): how many, how many different ones, and of their columns the sums and the least hash.

    A row's windows are counted where they are made, so that one row a file leaves the task. Only files whose id several rows share have their windows shuffled.
    """
    scratch = scratch or Scratch(files.sparkSession, "totals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = regex.compile(TOKEN)
        for batch in batches:
            rows = []
            for file, content in zip(*batch.columns, strict=True):
                n = tokens = spans = 0
                hashes = set()
                for digest, first, last, unique in _windows(token, content.as_py() or "", None, size, least_distinct, most_share):
                    hashes.add(digest)
                    n, tokens, spans = n + 1, tokens + unique, spans + last - first
                if n:
                    rows.append((file.as_py(), n, len(hashes), tokens, min(hashes), spans))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["file_id", "n", "hashes", "tokens", "least", "spans"])

    kept = _no_licences(files).select(F.col("file_id").cast("string"), F.col(text).alias("text"))
    totals = scratch.keep(kept.mapInArrow(run, "file_id string, n long, hashes long, tokens long, least string, spans long"), "totals")
    shared = totals.groupBy(F.col("file_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if shared.isEmpty():
        return totals
    same = F.col("file_id").eqNullSafe(F.col("_id"))
    each = duplicate_windows(files.join(shared, same, "left_semi"), size, least_distinct, most_share, text)
    whole = each.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("hashes"), F.sum("unique_tokens").alias("tokens"), F.min("hash").alias("least"), F.sum(F.col("end_line") - F.col("start_line")).alias("spans"))
    return totals.join(shared, same, "left_anti").unionByName(whole)


def repeated_windows(files: DataFrame, size: int = 50, least_distinct: int = 15, most_share: float = 0.6, text: str = "text", scratch: Scratch | None = None, least_files: int = 2) -> DataFrame:
    """Of duplicate_windows() those whose tokens occur in several files, `least_files` at least; ids that are null count as no file. What is returned isn't shuffled any more."""
    scratch = scratch or Scratch(files.sparkSession, "windows")
    kept = _numbered(files, text)
    found = _repeated_places(kept, size, least_distinct, most_share, least_files, scratch)
    return _details(_with_places(kept, found), size, least_distinct, most_share)


def repeated_groups(files: DataFrame, size: int = 50, least_distinct: int = 15, most_share: float = 0.6, text: str = "text", scratch: Scratch | None = None, least_files: int = 2, most_members: int = 50, most_groups: int = 200) -> DataFrame:
    """duplicate_groups() of the files' windows: (hash, members, n_files, first_file).

    Groups are ordered by the kept members, then by hash, and only the members of the first ones meet the files' ids.
    """
    scratch = scratch or Scratch(files.sparkSession, "windows")
    kept = _numbered(files, text)
    marked = scratch.keep(_repeated_places(kept, size, least_distinct, most_share, least_files, scratch).withColumn("n", F.least("n", F.lit(most_members))), "marked")
    first = scratch.keep(marked.where("head").orderBy(F.desc("n"), *DIGEST).limit(most_groups).select(*DIGEST, _hex().alias("hash")), "first")
    ids = kept.select("file", F.col("file_id").cast("string").alias("file_id")).distinct()
    each = marked.select("file", "place", *DIGEST).join(F.broadcast(first), DIGEST).join(ids, "file")
    turn = F.row_number().over(Window.partitionBy("hash").orderBy(F.asc_nulls_last("file_id"), "place"))
    groups = each.withColumn("turn", turn).where(F.col("turn") <= most_members).groupBy("hash").agg(F.count("*").alias("members"), F.count_distinct("file_id").alias("n_files"), F.min("file_id").alias("first_file"))
    return groups.orderBy(F.desc("members"), "hash").limit(most_groups)


def _numbered(files: DataFrame, text: str) -> DataFrame:
    """(file, part, file_id, text): the file's number, and one for the text, as several rows may share an id."""
    return _no_licences(files).select(F.xxhash64("file_id").alias("file"), F.hash(text).alias("part"), "file_id", F.col(text).alias("text"))


#: What xxhash64() makes of a null.
NO_FILE = 42
#: A window's SHA-1 as numbers of 64, 64 and 32 bits, the first two less 2**63, so that they sort as the digest does.
DIGEST = ["h1", "h2", "h3"]


def _hex() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), n, F.lit("0")) for c, n in ((F.col("h1").bitwiseXOR(F.lit(-1 << 63)), 16), (F.col("h2").bitwiseXOR(F.lit(-1 << 63)), 16), (F.col("h3"), 8))]))


def _repeated_places(kept: DataFrame, size: int, least_distinct: int, most_share: float, least_files: int, scratch: Scratch) -> DataFrame:
    """(file, part, place, DIGEST, n, head) of the windows in so many files: n is how many windows are equal to it, itself included, and head holds for one of these.

    Each window has an anchor, the least hash of its runs of a third of its tokens. Equal windows have equal anchors, and neighbours mostly the same, so a first pass shuffles one row for
    about eighteen windows. Only windows with an anchor of several files become rows, of numbers alone, and meet once.
    """
    row = F.xxhash64("file", "text").alias("row")
    anchors = scratch.keep(kept.select(row, "text").mapInArrow(lambda b: _anchors(b, size, least_distinct, most_share), "row long, anchor long"), "anchors")
    several = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= least_files).select("anchor")
    shared = anchors.join(several, "anchor", "left_semi").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    rows = kept.select(row, "file", "part", "text").join(shared, "row").drop("row").mapInArrow(lambda b: _anchored(b, size, least_distinct, most_share), f"file long, part int, place int, {', '.join(f'{c} long' for c in DIGEST)}")
    alike = Window.partitionBy(*DIGEST)
    in_order = alike.orderBy("file")
    ranked = rows.withColumn("turn", F.row_number().over(in_order)).withColumn("rank", F.dense_rank().over(in_order))
    n_files = F.max("rank").over(alike) - F.max((F.col("file") == NO_FILE).cast("int")).over(alike)
    counted = ranked.withColumn("n", F.count("*").over(alike)).withColumn("n_files", n_files).where(F.col("n_files") >= least_files)
    return counted.select("file", "part", "place", *DIGEST, "n", (F.col("turn") == 1).alias("head"))


def _with_places(kept: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of files that have some, with their places (at)."""
    places = found.groupBy("file", "part").agg(F.sort_array(F.collect_set("place")).alias("at"))
    return kept.join(places, ["file", "part"])


BASE = 0x9E3779B97F4A7C15


def _rolled(tokens: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of the token hashes of each run of this size, from sums over prefixes."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        power, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * power)))
        return (sums[size:] - sums[:-size]) * inverse[: n - size + 1]


def _hashed(size: int, least_distinct: int, most_share: float):
    """A function of a text to its tokens, its windows' anchors and which windows count; None for a text without such a window."""
    token, known, short = regex.compile(TOKEN), {}, max(1, size // 3)

    def told(text: str) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        found = token.findall(text)
        kept = _mixed(found, size, least_distinct, most_share)[1]
        if not kept.any():
            return None
        if len(known) > 1 << 18:
            known.clear()
        for t in set(found).difference(known):
            known[t] = xxhash.xxh64_digest(t)
        tokens = np.frombuffer(b"".join(map(known.__getitem__, found)), np.uint64)
        anchors = np.lib.stride_tricks.sliding_window_view(_rolled(tokens, short), size - short + 1).min(1)
        return found, anchors.view(np.int64), kept

    return told


def _anchors(batches: Iterator[pa.RecordBatch], size: int, least_distinct: int, most_share: float) -> Iterator[pa.RecordBatch]:
    """Of (row, text): the different anchors of the windows that count."""
    told = _hashed(size, least_distinct, most_share)
    for batch in batches:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = told(text.as_py() or "")
            if found:
                some = np.unique(found[1][found[2]])
                held.append((np.full(len(some), row), some))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["row", "anchor"])


def _anchored(batches: Iterator[pa.RecordBatch], size: int, least_distinct: int, most_share: float) -> Iterator[pa.RecordBatch]:
    """Of (file, part, text, anchors): the windows that count and have one of these anchors, with their hashes."""
    told = _hashed(size, least_distinct, most_share)
    for batch in batches:
        for file, part, text, anchors in zip(*batch.columns, strict=True):
            found = told(text.as_py() or "")
            if not found:
                continue
            words, own, kept = found
            at = np.flatnonzero(kept & np.isin(own, anchors.values.to_numpy()))
            if len(at):
                parts = [w.encode() for w in words]
                joined, begin = b"\0".join(parts), [0, *np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1).tolist()]
                said = np.frombuffer(b"".join(hashlib.sha1(joined[begin[i] : begin[i + size] - 1]).digest() for i in at.tolist()), ">u4").reshape(-1, 5).astype(np.uint64)
                h1, h2 = (((said[:, k] << 32 | said[:, k + 1]) ^ (1 << 63)).view(np.int64) for k in (0, 2))
                columns = [np.full(len(at), file.as_py()), np.full(len(at), part.as_py(), np.int32), at.astype(np.int32), h1, h2, said[:, 4].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["file", "part", "place", *DIGEST])


def duplicate_members(windows: DataFrame, least_files: int = 2, most_members: int = 50) -> DataFrame:
    """The windows of hashes in several files, at most so many members of each hash, in (file_id, start_line) order.

    Of each hash, a task sends no more than `most_members` rows on.
    """
    turn = F.row_number().over(Window.partitionBy("hash").orderBy("file_id", "start_line"))
    return windows.join(_often(windows, least_files), "hash", "left_semi").withColumn("turn", turn).where(F.col("turn") <= most_members)


def _often(windows: DataFrame, least_files: int) -> DataFrame:
    """The hashes in so many files, two at least: by counts that are combined before the shuffle, and where two will do, by a least and a greatest one."""
    if least_files > 2:
        return windows.select("hash", "file_id").distinct().groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_files).select("hash")
    file = F.xxhash64("file_id")
    return windows.groupBy("hash").agg(F.min(file).alias("lo"), F.max(file).alias("hi")).where("lo <> hi").select("hash")


def duplicate_groups(windows: DataFrame, least_files: int = 2, most_members: int = 50, most_groups: int | None = 200) -> DataFrame:
    """(hash, members, n_files) of hashes in several files: members kept in (file_id, start_line) order up to a number, groups by kept members."""
    kept = duplicate_members(windows, least_files, most_members)
    groups = kept.groupBy("hash").agg(F.count("*").alias("members"), F.count_distinct("file_id").alias("n_files"), F.min(F.struct("file_id", "start_line"))["file_id"].alias("first_file"))
    return groups if most_groups is None else groups.orderBy(F.desc("members"), "hash").limit(most_groups)


def extract_candidates(windows: DataFrame, least_files: int = 3) -> DataFrame:
    """(file_id, start_line, end_line, hash): a finding for each member of a group in enough files."""
    return windows.join(_often(windows, least_files), "hash", "left_semi").select("file_id", "start_line", "end_line", "hash")
