"""Chunks of code in languages with braces: one for each top-level declaration, with what it holds, out of the text's syntax tree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.chunks import FIELDS, code_schema, python_chunks, sections, told, windows
from sedimenta.operators import shapes
from sedimenta.operators.shapes import BraceShapes, Found, Import
from sedimenta.operators.syntax import Node, below, depth, tree
from sedimenta.sources.scratch import Scratch

# Names of calls that reach the system.
RISKY = ["eval", "exec", "system", "child_process", "subprocess", "shell", "spawn", "execfile", "execsync", "spawnsync", "dangerouslysetinnerhtml"]
#: Of each language the kinds of nodes that are chunks where they stand at the top, and how a chunk of them is called.
_js = {k: k for k in ("function", "class", "declaration", "export")}
_ts = _js | {k: k for k in ("interface", "type", "enum")}
TOP = {
    "javascript": _js | {"var": "declaration"}, "typescript": _ts, "tsx": _ts, "go": {k: k for k in ("function", "method", "type")},
    "rust": {k: k for k in ("function", "struct", "impl", "enum", "trait", "module")}, "java": {k: k for k in ("method", "class", "interface")},
}
NESTING, LOOPS, METHODS = frozenset(["if", "for", "while", "try"]), frozenset(["for", "while", "do", "loop"]), frozenset(["method"])

NOTHING = ([], [], [], 0, 0, 0, False, [])
ROUTED = ("file_id", "start_line", "end_line", "kind", "document")
Source = Callable[[str | None, str | None], str | None]


def _found(nodes: list[Node], text: str, language: str) -> tuple[list[Import], list[Found]]:
    """What a text's tree imports, and the declarations at its top."""
    top, found = TOP[language], []
    inner = METHODS | {"function"} if language == "rust" else METHODS
    for node in nodes:
        if node.kind not in top:
            continue
        inside = list(below(node))
        calls = [n for n in inside if n.kind == "call"]
        refs = [(node.name, "def", node.line + 1)] * bool(node.name) + [(n.name, "def", n.line + 1) for n in inside if n.kind in inner and n.name]
        refs += [(n.name.split(".")[-1], "call", n.line + 1) for n in calls]
        exported = None if language == "go" else node.exported if node.kind not in ("declaration", "var") else []
        found.append(Found(
            node.line + 1, node.last + 1, top[node.kind], node.name, exported, [n.name for n in calls], depth(node.children, NESTING), depth(node.children, LOOPS), _params(node),
            bool(re.search(r"\basync\b", text[node.at : node.end][:200])), refs, node.at, node.end,
        ))
    return [Import(n.name, n.exported, n.line + 1) for n in nodes if n.kind == "import"], found


def _public(name: str) -> bool:
    """Whether Go exports a name."""
    return name[:1].isupper()


@cache
def _shapes(language: str) -> BraceShapes:
    return BraceShapes(language, _found, _public)


def _all(file_id: str, text: str, language: str) -> list[tuple]:
    found = _shapes(language).find(file_id, text)
    return found if found is not None else _whole(file_id, text, language)


def _whole(file_id: str, text: str, language: str) -> list[tuple]:
    try:
        return shapes.chunks(file_id, text, *_found(tree(text, language), text, language), _public)
    except RecursionError:  # blocks without braces may be nested without end
        return []


def _params(node: Node) -> int:
    """A function's parameters; those of what an export wraps count too."""
    return node.params if node.kind != "export" else next((n.params for n in node.children if n.kind == "function"), 0)


def code_definitions(files: DataFrame) -> DataFrame:
    """A chunk per top-level declaration of files (file_id, language, text) in a language with braces, with metadata and references as python_definitions() has them.

    Declarations begin and end wherever the language lets them; chunks are of whole lines. `max_nesting` counts if, for, while and try, an `else if` one more than its if; `calls` are names with
    the objects or paths before them, `refs` only the last name. Texts without a declaration, or with brackets nested deeper than a parser goes, have no rows here and belong to line_windows(). Imports of the file
    count for its first chunk: modules for line 1, and the names a script takes from them for the import's line.
    """
    return definitions(files.where(F.col("language").isin(*TOP)))


def definitions(files: DataFrame, columns: Sequence[str] = tuple(FIELDS), source: Source | None = None) -> DataFrame:
    """The chunks of python_definitions() and code_definitions() of files (file_id, language, text), or some of their columns, in one pass; if told, of what `source` makes of a language and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return told(batches, lambda file, language, text: _declared(file, language, source(language, text) if source else text), columns)

    return files.where(F.col("language").isin("python", *TOP)).select("file_id", "language", "text").mapInArrow(run, code_schema(columns))


def _declared(file_id: str, language: str | None, text: str | None) -> list[tuple]:
    if not text:
        return []
    return python_chunks(file_id, text) if language == "python" else _all(file_id, text, language) if language in TOP else []


def risky_calls(calls: Column) -> Column:
    """Of a list of calls those that are named like, or have a dotted part that is, a name that reaches the system."""
    names = F.array(*map(F.lit, RISKY))
    return F.filter(calls, lambda c: F.arrays_overlap(F.split(F.lower(c), r"\."), names))


def routed_chunks(files: DataFrame, size: int = 60, overlap: int = 10, columns: Sequence[str] = ROUTED, source: Source | None = None) -> DataFrame:
    """(file_id, start_line, end_line, kind, document) of every file (file_id, language, text) by the chunker of its language: Markdown by headings, code by declarations,
    and what has neither by windows of lines; or some of these columns.

    Files are read once, each by its chunker, and the chunks are kept in a scratch table; if told, they are of what `source` makes of a language and a text. Rows of the same file_id are one file, which has windows only if none of its rows has declarations.
    """
    names = list(dict.fromkeys(["file_id", *columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return told(batches, lambda file, language, text: _routed(file, language, source(language, text) if source else text, size, overlap), ("symbols", *names))

    made = files.select("file_id", "language", "text").mapInArrow(run, code_schema(("symbols", *names)))
    kept = Scratch(files.sparkSession, "routed").keep(made.select(F.element_at("symbols", 1).alias("_by"), *names), "chunks")
    cut = kept.where("_by = 'declarations'").select("file_id").distinct()
    rest = kept.where("_by = 'windows'").join(cut, "file_id", "left_anti")
    return kept.where("_by <> 'windows'").select(*columns).unionByName(rest.select(*columns))


def _routed(file_id: str, language: str | None, text: str | None, size: int, overlap: int) -> Iterator[tuple]:
    """The chunks of a file as rows of FIELDS; `symbols` has the chunker's name alone."""
    if not text:
        return
    if language == "markdown":
        for first, last, kind, document, _ in sections(text, 200, 8):
            yield (file_id, first, last, kind, ["sections"], document, *NOTHING)
    elif found := _declared(file_id, language, text):
        for chunk in found:
            yield (file_id, *chunk[1:4], ["declarations"], chunk[5], *NOTHING)
    else:
        for first, last, kind, document in windows(text, size, overlap):
            yield (file_id, first, last, kind, ["windows"], document, *NOTHING)
