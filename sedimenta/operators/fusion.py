"""Reciprocal rank fusion of ranked lists, boosts, and reasons of a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the boosts.
PER_REASON, PER_LOG_INBOUND, DEFINITION, DERIVATIVE = 0.004, 0.01, 0.006, -0.008
# From which depth or count on a chunk counts as complex.
DEEP_NESTING, DEEP_LOOPS, MANY_PARAMETERS = 4, 2, 5
# Folders, endings and names of what is made from other documents.
DERIVED_FOLDERS = ["presentation", "presentations", "slide", "slides", "deck", "decks"]
DERIVED_ENDINGS = [".slide.md", ".slides.md", ".deck.md"]
DERIVED_NAMES = ["index.md"]


def ranked(branch: DataFrame, name: str, order: list[Column], key: str = "chunk_id") -> DataFrame:
    """(key, branch, rank) of a branch that is already cut to its top rows, so that one partition ranks a bounded number."""
    return branch.select(key, F.lit(name).alias("branch"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(branches: list[DataFrame], k: int = 60, key: str = "chunk_id") -> DataFrame:
    """(key, rrf, sources, best_rank) of ranked() branches; a key gains 1 / (k + rank) from each."""
    each = reduce(DataFrame.unionByName, branches)
    score = F.round(F.sum(1.0 / (k + F.col("rank"))), 9)
    return each.groupBy(key).agg(score.alias("rrf"), F.array_sort(F.collect_set("branch")).alias("sources"), F.min("rank").alias("best_rank"))


def merged(first: DataFrame, second: DataFrame, fields: list[str], key: str = "chunk_id") -> DataFrame:
    """Both lists' rows by key; a field that both have is the first list's where that isn't null. Each list is a bounded top."""
    a, b = (df.select(key, *[F.col(c).alias(f"{side}{c}") for c in fields if c in df.columns]) for df, side in ((first, "_a_"), (second, "_b_")))
    both = a.join(b, key, "full")
    pick = lambda c: F.coalesce(*[F.col(f"{side}{c}") for side in ("_a_", "_b_") if f"{side}{c}" in both.columns])
    return both.select(key, *[pick(c).alias(c) for c in fields])


def boost(reasons: Column, inbound: Column, is_definition: Column, is_derivative: Column) -> Column:
    return (
        PER_REASON * F.size(reasons) + PER_LOG_INBOUND * F.log1p(F.coalesce(inbound, F.lit(0)).cast("double"))
        + F.when(is_definition, DEFINITION).otherwise(0.0) + F.when(is_derivative, DERIVATIVE).otherwise(0.0)
    )


def is_derivative(rel_path: Column) -> Column:
    """Slides, presentations and index pages, which rank below what they were made from."""
    parts = F.split(F.lower(rel_path), "/")
    name, above = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    ends = reduce(Column.__or__, [name.endswith(e) for e in DERIVED_ENDINGS])
    return F.arrays_overlap(above, F.array(*map(F.lit, DERIVED_FOLDERS))) | ends | name.isin(*DERIVED_NAMES)


def is_definition(kind: Column, symbols: Column, terms: list[str]) -> Column:
    """A section of which a heading holds a term of three characters or more."""
    long = [t for t in terms if len(t) >= 3]
    hit = F.exists(symbols, lambda s: reduce(Column.__or__, [F.lower(s).contains(t) for t in long], F.lit(False)))
    return kind.startswith("section") & F.coalesce(hit, F.lit(False))


def match_reasons(meta: Column, terms: list[str], risky: list[str] = (), complexity: bool = False, wants_async: bool = False) -> Column:
    """Why a chunk with metadata (exports, imports, calls, risky_calls, max_nesting, max_loops, params, has_recursion, has_async) fits a query's terms."""
    words = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    low = lambda c: F.transform(F.coalesce(meta[c], F.array().cast("array<string>")), F.lower)
    part = F.filter(F.flatten(F.transform(low("imports"), lambda i: F.split(i, r"[\\/.]+"))), lambda p: F.length(p) >= 2)
    exported = F.arrays_overlap(low("exports"), words)
    complex_ = (meta["max_nesting"] >= DEEP_NESTING) | (meta["max_loops"] >= DEEP_LOOPS) | (meta["params"] >= MANY_PARAMETERS) | meta["has_recursion"]
    cases = [
        ("symbol_match", exported), ("exported", exported), ("import_match", F.arrays_overlap(low("imports"), words) | F.arrays_overlap(part, words)),
        ("call_match", F.arrays_overlap(low("calls"), words)), ("risky_call_category", F.arrays_overlap(low("risky_calls"), F.array(*[F.lit(r) for r in risky]).cast("array<string>"))),
        ("complexity_signal", F.lit(complexity) & complex_), ("async_match", F.lit(wants_async) & meta["has_async"]),
    ]
    return F.array_compact(F.array(*[F.when(meta.isNotNull() & ok, F.lit(name)) for name, ok in cases]))
