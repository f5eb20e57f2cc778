"""Column functions over texts, paths, ids and line numbers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "java": "java", "md": "markdown", "markdown": "markdown",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), for which the value is computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of letters, digits and underscores of at least `least` characters, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= least)


def query_terms(query: str) -> list[str]:
    """The different terms of a query, as tokens() would cut it; none for an empty query."""
    return sorted({t for t in re.split(r"[^\w]+", query.lower()) if len(t) >= 2})


def lines(text: Column) -> Column:
    """Lines without their ends; one trailing blank line is dropped, so an empty text has none."""
    found = F.split(text, "\r?\n")
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def short_sha1(value: Column) -> Column:
    return F.substring(F.sha1(value.cast("binary")), 1, 16)


def chunk_id(file_id: Column, start_line: Column, end_line: Column, document: Column) -> Column:
    return F.concat(file_id, F.lit(":"), F.lpad(start_line.cast("string"), 6, "0"), F.lit("-"), F.lpad(end_line.cast("string"), 6, "0"), F.lit(":"), F.substring(F.sha2(document.cast("binary"), 256), 1, 8))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; '' for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    """The language by extension, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def glob_to_regex(pattern: str) -> str:
    """`*` and `?` over a whole name; every other character stands for itself."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches_glob(name: Column, pattern: str) -> Column:
    return name.rlike(glob_to_regex(pattern))


def round_half_up(value: Column) -> Column:
    """To the next whole number, halves towards plus infinity."""
    return F.floor(value + 0.5).cast("long")


def capped(value: Column, most: int = 256 * 1024) -> Column:
    """A log field cut to `most` characters, with a note of how many there were."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("\n…[truncated "), F.length(value) - most, F.lit(" chars]"))).otherwise(value)


def resolve_path(folder: Column, target: Column) -> Column:
    """A target without its #fragment against a folder, with `.` and `..` worked off; a leading slash starts at the root."""
    bare = F.regexp_replace(target, "#.*$", "")
    parts = F.split(F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, F.lit("/"), bare)), "/+")
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """A unit vector from the bytes of the text's SHA-256, repeated to `dim`; a stand-in for a model that needs none."""
    digest = F.sha2(text.cast("binary"), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
