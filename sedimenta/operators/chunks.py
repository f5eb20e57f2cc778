"""Chunkers: one row per file in, one row per chunk of whole lines out."""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import chunk_id, lines
from sedimenta.operators import shapes


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """0-based first lines of windows over n >= 1 lines: none starts once a window has reached the end."""
    return F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))


def line_windows(files: DataFrame, size: int = 60, overlap: int = 10, text: str = "text", kind: str = "window") -> DataFrame:
    """Windows of `size` lines, each starting `overlap` lines before the last one's end: the files' columns without the text, and
    start_line and end_line (from 1, inclusive), kind, document. Null and empty texts have none. A narrow plan, without a shuffle."""
    at = files.withColumn("_lines", lines(F.col(text))).drop(text).where(F.size("_lines") > 0)
    at = at.withColumn("_start", F.explode(window_starts(F.size("_lines"), size, overlap)))
    end = F.least(F.col("_start") + size, F.size("_lines"))
    return at.select(
        *[c for c in files.columns if c != text], (F.col("_start") + 1).alias("start_line"), end.alias("end_line"), F.lit(kind).alias("kind"),
        F.array_join(F.slice("_lines", F.col("_start") + 1, end - F.col("_start")), "\n").alias("document"),
    )


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line"), F.col("document")))


def markdown_sections(files: DataFrame, most: int = 200, overlap: int = 8, text: str = "text") -> DataFrame:
    """A chunk per section of an ATX heading outside fences, with the path of headings above it as `symbols`.

    Lines before the first heading belong to its section. A section of more than `most` lines becomes windows that keep the path; a text
    without headings becomes line windows. A text's lines are walked once, in Arrow batches, as a section's path and whether a fence is open hang on all lines before; null
    and empty texts have no rows.
    """
    keep = [c for c in files.columns if c != text]
    whole = files.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, most, overlap)

    shape = whole.drop("_text").withColumns({n: F.lit(None).cast(k) for n, k in (("start_line", "int"), ("end_line", "int"), ("kind", "string"), ("document", "string"), ("symbols", "array<string>"))})
    return whole.mapInArrow(run, shape.schema)


#: Characters of the pieces that a batch of Python's rows may hold.
MOST = 4 << 20

FENCE, HEADING, TITLE = re.compile(r"\s{0,3}(```|~~~)", re.A), re.compile(r"(#{1,6})\s+\S", re.A), re.compile(r"#{1,6}\s+(.*?)\s*#*\s*$", re.A)


def _pieces(batches: Iterator[pa.RecordBatch], most: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The pieces of texts, the last column, in bounded batches with the other columns; texts come out of Arrow one at a time."""
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))

    def made(kept: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
        at, *parts = zip(*got, strict=True) if got else ((),) * 6
        return pa.RecordBatch.from_arrays([*kept.take(pa.array(at, pa.int64())).columns, *map(pa.array, parts, kinds)], names=[*kept.schema.names, "start_line", "end_line", "kind", "document", "symbols"])

    for batch in batches:
        kept, got, size = batch.select(range(batch.num_columns - 1)), [], 0
        for i, content in enumerate(batch.column(batch.num_columns - 1)):
            for piece in sections(content.as_py() or "", most, overlap):
                got.append((i, *piece))
                size += len(piece[3]) + sum(map(len, piece[4])) + 64
                if size > MOST:
                    yield made(kept, got)
                    got, size = [], 0
        yield made(kept, got)


def _lines(content: str) -> list[str]:
    """As lines() cuts a text."""
    cut = re.split(r"\r?\n", content) if "\r" in content else content.split("\n")
    return cut[:-1] if not cut[-1] else cut


def sections(content: str, most: int, overlap: int) -> Iterator[tuple[int, int, str, str, list[str]]]:
    """(first line, last line, kind, text, path) of the pieces of a text's sections, or of its windows where it has no heading."""
    if not content:
        return
    cut = _lines(content)
    heads, fence, path = [], "", []
    fences = "```" in content or "~~~" in content
    for i, line in enumerate(cut, 1):
        if fences and (m := FENCE.match(line)):
            fence = m[1] if not fence else "" if m[1] == fence else fence
        elif line[:1] == "#" and not fence and (m := HEADING.match(line)):
            title = TITLE.match(line)[1] if line[-1] in "# \t\r\f\v" else line[m.end() - 1 :]
            path = [*[h for h in path if h[0] < len(m[1])], (len(m[1]), title)]
            heads.append((i, f"section-h{len(m[1])}", [title for _, title in path]))
    size, back = (most, overlap) if heads else (60, 10)
    parts = heads or [(1, "window", [])]
    for k, (line, kind, titles) in enumerate(parts):
        first, end = line if k else 1, parts[k + 1][0] - 1 if k + 1 < len(parts) else len(cut)
        n = end - first + 1
        for at in range(0, max(n - back - 1, 0) + 1, size - back) if n > size else (0,):
            last = min(first + at + size - 1, end)
            yield first + at, last, kind, "\n".join(cut[first + at - 1 : last]), titles


def windows(content: str, size: int, overlap: int) -> Iterator[tuple[int, int, str, str]]:
    """(first line, last line, kind, text) of the windows of a text, as line_windows() cuts it."""
    cut = _lines(content)
    for at in range(0, max(len(cut) - overlap - 1, 0) + 1, size - overlap) if cut else []:
        yield at + 1, min(at + size, len(cut)), "window", "\n".join(cut[at : at + size])


def coverage_gaps(chunks: DataFrame, files: DataFrame, least: int = 30, file: str = "file_id", n_lines: str = "n_lines") -> DataFrame:
    """Runs of at least `least` lines of a file that no chunk covers: (file, gap_start, gap_end), from 1, inclusive."""
    ends = files.select(file, (F.col(n_lines) + 1).alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    both = chunks.select(file, "start_line", "end_line").unionByName(ends)
    before = Window.partitionBy(file).orderBy("start_line", F.col("end_line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    gap = both.select(file, (F.coalesce(F.max("end_line").over(before), F.lit(0)) + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end"))
    return gap.where(F.col("gap_end") - F.col("gap_start") + 1 >= least)


def fill_gaps(chunks: DataFrame, files: DataFrame, least: int = 30, size: int = 120, overlap: int = 20) -> DataFrame:
    """The lines of coverage_gaps() as windows of kind `window-fill`; those without a word are dropped. Files: file_id, text."""
    cut = files.withColumn("_lines", lines(F.col("text")))
    gaps = coverage_gaps(chunks, cut.select("file_id", F.size("_lines").alias("n_lines")), least)
    text = F.array_join(F.slice("_lines", F.col("gap_start"), F.col("gap_end") - F.col("gap_start") + 1), "\n")
    parts = cut.join(gaps, "file_id").select("file_id", "gap_start", text.alias("text"))
    done = line_windows(parts, size, overlap, kind="window-fill").where(F.trim(F.translate("document", "\n\t", "  ")) != "")
    shift = F.col("gap_start") - 1
    return done.select("file_id", (F.col("start_line") + shift).alias("start_line"), (F.col("end_line") + shift).alias("end_line"), "kind", "document")


def cap_sizes(chunks: DataFrame, most: int = 120, size: int = 60, overlap: int = 10) -> DataFrame:
    """Chunks of more than `most` lines as windows; the first piece keeps the chunk's kind, the others are of kind `window`."""
    n = F.col("end_line") - F.col("start_line") + 1
    starts = F.when(n > most, window_starts(n, size, overlap)).otherwise(F.array(F.lit(0)))
    at = chunks.withColumn("_n", n).withColumn("_at", F.explode(starts))
    length = F.when(F.col("_n") > most, F.least(F.lit(size), F.col("_n") - F.col("_at"))).otherwise(F.col("_n"))
    at = at.withColumn("document", F.array_join(F.slice(F.split("document", "\n"), F.col("_at") + 1, length), "\n"))
    at = at.withColumn("kind", F.when(F.col("_at") > 0, "window").otherwise(F.col("kind")))
    return at.withColumn("end_line", F.col("start_line") + F.col("_at") + length - 1).withColumn("start_line", F.col("start_line") + F.col("_at")).drop("_n", "_at")


FIELDS = {
    "file_id": "string", "start_line": "int", "end_line": "int", "kind": "string", "symbols": "array<string>", "document": "string", "imports": "array<string>", "exports": "array<string>", "calls": "array<string>",
    "max_nesting": "int", "max_loops": "int", "params": "int", "has_async": "boolean", "refs": "array<struct<symbol:string,kind:string,line:int>>",
}


def code_schema(columns: Sequence[str] = tuple(FIELDS)) -> str:
    return ", ".join(f"{c} {FIELDS[c]}" for c in columns)


def python_definitions(files: DataFrame) -> DataFrame:
    """A chunk per top-level definition of Python files (file_id, text), with its metadata and symbol references.

    Texts that don't parse, and those without definitions, have no rows here and belong to line_windows(). Imports of the file count for its first chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return told(batches, lambda file, text: python_chunks(file, text) if text is not None else [])

    return files.select("file_id", "text").mapInArrow(run, code_schema())


def python_chunks(file_id: str, text: str) -> list[tuple]:
    found = _python_shapes().find(file_id, text)
    return found if found is not None else _python_whole(file_id, text)


def _python_whole(file_id: str, text: str) -> list[tuple]:
    try:
        parsed = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return shapes.chunks(file_id, text, *_python_found(parsed), _python_public)


@cache
def _python_shapes() -> shapes.PythonShapes:
    return shapes.PythonShapes(_python_found, _python_public)


def _python_public(name: str) -> bool:
    return not name.startswith("_")


BLOCKS, LOOPS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match), (ast.For, ast.AsyncFor, ast.While)
DEFINITIONS, LEAVES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef), (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)


def _called(node: ast.AST) -> str:
    return f"{_called(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else getattr(node, "id", "")


def _below(node: ast.AST) -> tuple[list[tuple[str, int]], list[tuple[str, str, int]], int, int, bool]:
    """In one walk by levels: calls, inner definitions, how deep blocks and loops are nested, and whether a function is async."""
    calls, inner, nesting, in_loops, has_async = [], [], 0, 0, False
    level = [(node, 0, 0)]
    for x, most, deep in level:
        if isinstance(x, ast.Call):
            if called := _called(x.func):
                calls.append((called, x.lineno))
        elif isinstance(x, DEFINITIONS):
            inner.append((x.name, "def", x.lineno))
            has_async = has_async or isinstance(x, ast.AsyncFunctionDef)
        elif isinstance(x, BLOCKS) and x is not node:
            most, deep = most + 1, deep + isinstance(x, LOOPS)
            nesting, in_loops = max(nesting, most), max(in_loops, deep)
        for field in x._fields:
            held = getattr(x, field, None)
            for y in held if isinstance(held, list) else (held,):
                if isinstance(y, ast.AST) and not isinstance(y, LEAVES):
                    level.append((y, most, deep))
    return calls, inner, nesting, in_loops, has_async


def _python_found(tree: ast.Module) -> tuple[list[shapes.Import], list[shapes.Found]]:
    """What a module imports, and its definitions."""
    found = []
    for node in tree.body:
        if isinstance(node, DEFINITIONS):
            start = min([node.lineno] + [x.lineno for x in node.decorator_list])
            calls, inner, nesting, in_loops, has_async = _below(node)
            args = node.args if not isinstance(node, ast.ClassDef) else None
            found.append(shapes.Found(
                start, node.end_lineno, "class" if args is None else "function", node.name, None, [c for c, _ in calls], nesting, in_loops, len(args.args + args.posonlyargs + args.kwonlyargs) if args else 0,
                has_async, inner + [(c.split(".")[-1], "call", line) for c, line in calls],
            ))
    imports = [shapes.Import(x.name) for n in tree.body if isinstance(n, ast.Import) for x in n.names] + [shapes.Import(n.module or ".", rank=1) for n in tree.body if isinstance(n, ast.ImportFrom)]
    return imports, found


def told(batches: Iterator[pa.RecordBatch], chunks: Callable[..., Iterable[tuple]], columns: Sequence[str] = tuple(FIELDS)) -> Iterator[pa.RecordBatch]:
    """Of the chunks (FIELDS) that a function finds in each row these columns, one text at a time, in batches bounded by their length.

    Trees have no cycles, so that nothing is lost while Python's collector, which goes over all of a tree again and again as it grows, waits for the end of a text.
    """
    held, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            values = [x.as_py() for x in row]
            gc.disable()
            try:
                found = list(chunks(*values))
            finally:
                gc.enable()
            for chunk in found:
                held.append(chunk)
                size += len(chunk[5]) + 64 * len(chunk[13])
                if size > MOST:
                    yield _coded(held, columns)
                    held, size = [], 0
    yield _coded(held, columns)


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _coded(rows: list[tuple], columns: Sequence[str]) -> pa.RecordBatch:
    """Lists become one array of all they hold, and where each ends."""
    made = []
    for name in columns:
        values = list(map(itemgetter(list(FIELDS).index(name)), rows))
        if FIELDS[name] in _ARROW:
            made.append(pa.array(values, _ARROW[FIELDS[name]]))
            continue
        ends, flat = pa.array([0, *accumulate(map(len, values))], pa.int32()), list(chain.from_iterable(values))
        if FIELDS[name] == "array<string>":
            made.append(pa.ListArray.from_arrays(ends, pa.array(flat, pa.string())))
        else:
            parts = [pa.array(c, k) for c, k in zip(zip(*flat, strict=True) if flat else [()] * 3, (pa.string(), pa.string(), pa.int32()), strict=True)]
            made.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["symbol", "kind", "line"])))
    return pa.RecordBatch.from_arrays(made, names=list(columns))
