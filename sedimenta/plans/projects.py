"""Registered queries on projects: what belongs to an index, references, definitions, upkeep, evaluation runs; with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import accounts, chunks, code, definitions, evaluation, filtering, fusion, graph, ignoring, inverted, lexical, quality, similarity, store, trigrams, versions
from sedimenta.plans import views as V
from sedimenta.plans.catalogue import SEARCH, query
from sedimenta.sources import formats, runs
from sedimenta.sources.scratch import Scratch

# what is indexed

LAYERS = {"": ["# built files", "*7.py", "!fr/doc_1*", "de/"], "es": ["doc_2*", "!doc_21.go"], "en": ["/doc_?.md", "**/doc_3[0-4].md"]}


@query(f"""WITH {V.FILES} SELECT rel_path, (ends_with(rel_path, '7.py') AND NOT starts_with(rel_path, 'fr/doc_1')) OR starts_with(rel_path, 'de/') OR (starts_with(rel_path, 'es/doc_2') AND rel_path <> 'es/doc_21.go')
    OR regexp_full_match(rel_path, 'en/doc_([0-9]|3[0-4])\\.md') AS is_ignored FROM files""")  # fmt: skip
def layered_ignore(spark, sf):
    return ignoring.ignored(V.files(spark, sf).select("rel_path"), ignoring.ignore_rules(spark, LAYERS))


@query(f"""WITH {V.FILES}, g AS (SELECT *, (ends_with(rel_path, '7.py') AND NOT starts_with(rel_path, 'fr/doc_1')) OR starts_with(rel_path, 'de/') OR (starts_with(rel_path, 'es/doc_2') AND rel_path <> 'es/doc_21.go') OR regexp_full_match(rel_path, 'en/doc_([0-9]|3[0-4])\\.md') AS gone FROM files)
    SELECT rel_path, CASE WHEN doc_id % 17 = 0 THEN 'outside-project' WHEN gone THEN 'gitignore' WHEN language = 'go' THEN 'unsupported-extension' WHEN doc_id % 13 = 0 THEN 'symlink' WHEN size > 4000 THEN 'oversized' ELSE 'ok' END AS reason FROM g""")  # fmt: skip
def filter_reasons(spark, sf):
    """All files, of which some count as outside their project or as links; the others' reasons come from rule files, names and sizes."""
    rules = filtering.Rules(max_bytes=4000).merged({"remove_extensions": ["go"]})
    at = ignoring.ignored(V.files(spark, sf).select("rel_path", "doc_id", "size", "text"), ignoring.ignore_rules(spark, LAYERS))
    d = F.col("doc_id")
    return at.select("rel_path", filtering.decision(F.col("rel_path"), F.col("size"), F.col("text"), rules, d % 17 == 0, F.col("is_ignored"), d % 13 == 0).alias("reason"))


@query(f"""WITH {V.CHUNKS} SELECT chunk_id, NULL AS symbol_def FROM chunks WHERE doc_id % 10 <> 3 UNION ALL SELECT file_id || ':new', CASE WHEN doc_id % 20 = 3 THEN language ELSE project_id END FROM files WHERE doc_id % 10 = 3""")
def replaced_definitions(spark, sf):
    """Chunks of changed files, half of them with a definition of their own and half with symbols alone."""
    fresh = V.files(spark, sf).where("doc_id % 10 = 3")
    delta = fresh.select("file_id", F.concat("file_id", F.lit(":new")).alias("chunk_id"), F.when(F.col("doc_id") % 20 == 3, F.col("language")).alias("symbol_def"), F.array("project_id", "language").alias("symbols"))
    base = V.chunks(spark, sf).select("file_id", "chunk_id", F.lit(None).cast("string").alias("symbol_def"), F.array().cast("array<string>").alias("symbols"))
    return store.replace_chunks(base, delta, fresh).select("chunk_id", "symbol_def")


@query(f"""WITH {V.FILES} SELECT 'src' || k AS project_id, count(file_id) AS n_files, count(error) AS n_errors, coalesce(sum(size), 0)::BIGINT AS bytes, max(indexed_at) AS last FROM (SELECT n_nationkey AS k FROM nation) LEFT JOIN files ON project_id = 'src' || k GROUP BY ALL""")
def project_stats(spark, sf):
    """Of every project that is known, those without files too."""
    known = V.read(spark, sf, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("project_id"))
    return accounts.file_stats(V.files(spark, sf), known)


@query(f"WITH {V.FILES} SELECT file_id, CASE WHEN size > 4000 THEN 'oversized' ELSE 'unsupported-extension' END AS reason FROM files WHERE size > 4000 OR language = 'go'")
def not_indexable(spark, sf):
    rules = filtering.Rules(max_bytes=4000).merged({"remove_extensions": ["go"]})
    found = filtering.not_indexable(V.files(spark, sf).select("file_id", "rel_path", "language", "size", F.substring("text", 1, 8192).alias("head")), rules)
    return found.select("file_id", F.when(F.col("size") > 4000, "oversized").otherwise(F.col("reason")).alias("reason"))


_ROOTS = "SELECT c_custkey AS k, '/ws/n' || (c_custkey % 25) || '/c' || c_custkey AS root FROM customer"


@query(f"WITH r AS ({_ROOTS}) SELECT '/ws' AS prefix UNION ALL SELECT '/ws/n3' UNION ALL SELECT ''")
def common_root(spark, sf):
    k = F.col("c_custkey")
    roots = V.read(spark, sf, "customer").select(k, F.concat(F.lit("/ws/n"), k % 25, F.lit("/c"), k).alias("root"))
    return graph.common_prefix(roots).unionByName(graph.common_prefix(roots.where(k % 25 == 3))).unionByName(graph.common_prefix(roots.where(k == 1)))


@query("""SELECT 'n' || (c_custkey % 25) || '/c' || c_custkey AS rel_path, CASE WHEN c_custkey % 2 = 0 THEN '.git' ELSE 'package.json' END AS marker FROM customer WHERE c_custkey % 25 NOT IN (3, 4) AND c_custkey % 3 <> 0
    UNION ALL SELECT 'n4', 'go.mod'""")  # fmt: skip
def absorbed_projects(spark, sf):
    k = F.col("c_custkey")
    rows = V.read(spark, sf, "customer")
    folder = F.concat(F.lit("/ws/n"), k % 25, F.lit("/c"), k)
    marks = rows.where(k % 3 != 0).select(F.concat(folder, F.when(k % 2 == 0, F.lit("/.git")).otherwise(F.lit("/package.json"))).alias("path"))
    more = rows.limit(1).select(F.explode(F.array(F.lit("/ws/n4/go.mod"), F.lit("/ws/package.json"), F.lit("/ws/.cache/a/go.mod"))).alias("path"))
    skipped = marks.unionByName(rows.where(k % 2 == 0).select(F.concat(folder, F.lit("/x.code-workspace.txt")).alias("path"))).unionByName(more)
    return formats.absorbed_markers(skipped, "/ws", ["n3"]).select("rel_path", "marker")


@query(f"WITH {V.FILES} SELECT language, count(*) FILTER (regexp_matches(rel_path, '[.]md$')) AS n_markdown, count(*) FILTER (regexp_matches(rel_path, '[.](md|txt)$')) AS n_prose FROM files GROUP BY ALL")
def prose_files(spark, sf):
    path = F.col("rel_path")
    return V.files(spark, sf).groupBy("language").agg(F.count_if(definitions.is_markdown_path(path)).alias("n_markdown"), F.count_if(definitions.is_prose_path(path)).alias("n_prose"))


# symbols and references

CHUNK_REFS = V.CHUNKS + r""", crefs AS (SELECT regexp_extract(document, '[a-z]+', 0) AS symbol, project_id, file_id, chunk_id, start_line + 1 AS line, ['def', 'call', 'import'][(start_line % 3 + 1)] AS kind FROM chunks)"""


def _chunk_refs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("def", "call", "import"))), F.col("start_line") % 3 + 1)
    return V.chunks(spark, sf).select(F.regexp_extract("document", "[a-z]+", 0).alias("symbol"), "project_id", "file_id", "chunk_id", (F.col("start_line") + 1).alias("line"), kind.alias("kind"))


@query(f"WITH {CHUNK_REFS} SELECT s.symbol, s.project_id, s.file_id, s.chunk_id, s.line, s.kind, s.kind = 'def' AS is_definition, c.rel_path, c.start_line AS chunk_start, c.end_line AS chunk_end, c.document FROM crefs s JOIN files f USING (file_id) JOIN chunks c ON c.chunk_id = s.chunk_id WHERE s.symbol = 'n'")
def symbol_usages(spark, sf):
    return graph.usage_snippets(_chunk_refs(spark, sf), V.files(spark, sf), V.chunks(spark, sf), "n")


DOC_REFS = V.FILES + r""", drefs AS (SELECT project_id, rel_path, doc_id, (doc_id % 9 + 1)::INTEGER AS line, CASE doc_id % 6 WHEN 0 THEN 'doc_' || (doc_id + 20) || '.md' WHEN 1 THEN '../fr/doc_' || (doc_id // 2) || '.py#top' WHEN 2 THEN '~/doc_1.md' WHEN 3 THEN './en/../en/doc_' || (doc_id // 3) || '.md' WHEN 4 THEN '../../en/doc_1.md' ELSE '/doc_' || doc_id || '.md' END AS target FROM files),
    here AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN [split_part(rel_path, '/', 1) || '/' || target, target] WHEN 1 THEN ['fr/doc_' || (doc_id // 2) || '.py'] WHEN 3 THEN [split_part(rel_path, '/', 1) || '/en/doc_' || (doc_id // 3) || '.md', 'en/doc_' || (doc_id // 3) || '.md'] WHEN 5 THEN [substr(target, 2)] ELSE [] END AS tried FROM drefs WHERE doc_id % 6 <> 2),
    exact AS (SELECT h.doc_id, min(list_position(tried, f.rel_path)) AS at FROM here h JOIN files f ON f.project_id = h.project_id AND list_contains(h.tried, f.rel_path) GROUP BY ALL),
    suf AS (SELECT h.doc_id, min({'n': length(f.rel_path), 'p': f.rel_path}).p AS p FROM here h JOIN files f ON f.project_id = h.project_id AND (f.rel_path = h.target OR ends_with(f.rel_path, '/' || h.target)) GROUP BY ALL),
    done AS (SELECT h.project_id, h.rel_path, h.line, h.target, coalesce(tried[exact.at], suf.p) AS resolved FROM here h LEFT JOIN exact USING (doc_id) LEFT JOIN suf USING (doc_id))"""


def _doc_refs(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    half, third = F.floor(d / 2), F.floor(d / 3)
    target = (
        F.when(d % 6 == 0, F.concat(F.lit("doc_"), d + 20, F.lit(".md"))).when(d % 6 == 1, F.concat(F.lit("../fr/doc_"), half, F.lit(".py#top"))).when(d % 6 == 2, F.lit("~/doc_1.md"))
        .when(d % 6 == 3, F.concat(F.lit("./en/../en/doc_"), third, F.lit(".md"))).when(d % 6 == 4, F.lit("../../en/doc_1.md")).otherwise(F.concat(F.lit("/doc_"), d, F.lit(".md")))
    )
    return V.files(spark, sf).select("project_id", "rel_path", (d % 9 + 1).cast("int").alias("line"), target.alias("target"))


@query(f"WITH {DOC_REFS} SELECT * FROM done")
def path_refs(spark, sf):
    return graph.resolve_refs(_doc_refs(spark, sf), V.files(spark, sf))


@query(f"WITH {DOC_REFS} SELECT project_id, rel_path, 'quality/stale-ref' AS rule_id, 'warning' AS severity, target, line AS line_from, line AS line_to FROM done WHERE resolved IS NULL")
def stale_refs(spark, sf):
    return graph.stale_refs(graph.resolve_refs(_doc_refs(spark, sf), V.files(spark, sf)))


# Markdown assembled from the words of each document: three words for each line or section


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, language, w): the words of a document, A-Z lowered, of three letters or more."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.regexp_extract_all(lower, F.lit("[a-z]{3,}"), F.lit(0)), lambda x: F.concat(F.lit("w_"), x))
    return V.files(spark, sf).select("file_id", "language", words.alias("w"))


WORD_SQL = (
    V.FILES
    + r""", words AS (SELECT file_id, language, list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{3,}'), lambda x: 'w_' || x) AS w FROM files),
    tri AS (SELECT file_id, language, i, w[3 * i + 1] AS a, w[3 * i + 2] AS b, w[3 * i + 3] AS c, len(w[3 * i + 1]) % 3 AS m FROM (SELECT *, unnest(range(len(w) // 3)) AS i FROM words))"""
)


def _by_triples(words: DataFrame, line) -> DataFrame:
    """(file_id, text): a line, or lines, for each three words (i, a, b, c)."""
    n = F.floor(F.size("w") / 3).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: line(i, *(F.element_at("w", 3 * i + k) for k in (1, 2, 3))))
    return words.select("file_id", F.when(n > 0, F.array_join(each, "\n")).otherwise("").alias("text"))


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with an internal link, and by the first word's length an external one, an anchor, a path between back quotes or what only looks like one."""

    def line(i, a, b, c):
        m = F.length(a) % 3
        rest = F.when(m == 0, F.concat(F.lit("(x) [e](http://"), b, F.lit(".org/"), c, F.lit(") `"), b, F.lit(" "), c, F.lit("/x.py`"))).when(m == 1, F.concat(F.lit("[top](#"), c, F.lit(") `"), b, F.lit(" / no`"))).otherwise(F.concat(F.lit("`"), c, F.lit("/"), a, F.lit(".py` `"), c, F.lit(".py`")))
        return F.concat(F.lit("see ["), a, F.lit("]("), b, F.lit("/"), c, F.lit('.md "t") and '), rest)

    return _by_triples(_words(spark, sf), line)


@query(f"""WITH {WORD_SQL}, l AS (SELECT *, (i + 1)::INTEGER AS line FROM tri) SELECT file_id, line, a AS label, b || '/' || c || '.md' AS target, 'internal' AS kind FROM l
    UNION ALL SELECT file_id, line, 'e', 'http://' || b || '.org/' || c, 'external' FROM l WHERE m = 0 UNION ALL SELECT file_id, line, 'top', '#' || c, 'anchor' FROM l WHERE m = 1""")  # fmt: skip
def markdown_links(spark, sf):
    return graph.markdown_links(_linked(spark, sf))


@query(f"WITH {WORD_SQL}, l AS (SELECT *, (i + 1)::INTEGER AS line FROM tri) SELECT file_id, line, b || '/' || c || '.md' AS target FROM l UNION SELECT file_id, line, c || '/' || a || '.py' FROM l WHERE m = 2")
def path_mentions(spark, sf):
    return graph.path_mentions(_linked(spark, sf))


# chunks

def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    """A heading for each three words, as deep as the first one's length says, and as many lines below it as the second one's; a fence with what isn't a heading where the third is long."""

    def section(i, a, b, c):
        fence = F.when(F.length(c) > 9, F.lit("\n```\n# no heading\n```")).otherwise("")
        return F.concat(F.repeat(F.lit("#"), F.length(a) % 3 + 1), F.lit(" "), a, F.repeat(F.concat(F.lit("\n"), c), F.length(b) % 12), fence)

    return _by_triples(_words(spark, sf), section)


@query(f"""WITH {WORD_SQL}, h AS (SELECT file_id, i, a, m + 1 AS d, 1 + len(b) % 12 + CASE WHEN len(c) > 9 THEN 3 ELSE 0 END AS n FROM tri),
    p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(CASE WHEN d = 1 THEN i END) OVER (PARTITION BY file_id ORDER BY i) AS one, max(CASE WHEN d = 2 THEN i END) OVER (PARTITION BY file_id ORDER BY i) AS two FROM h),
    t AS (SELECT p.*, CASE WHEN p.d > 1 THEN x.a END AS of_one, CASE WHEN p.d > 2 AND two > coalesce(one, -1) THEN y.a END AS of_two FROM p LEFT JOIN h x ON x.file_id = p.file_id AND x.i = one LEFT JOIN h y ON y.file_id = p.file_id AND y.i = two),
    w AS (SELECT *, unnest(CASE WHEN n > 6 THEN range(0, n - 2, 4) ELSE [0] END) AS s FROM t)
    SELECT file_id, (before + s + 1)::INTEGER AS start_line, (before + least(s + 6, n))::INTEGER AS end_line, 'section-h' || d AS kind, concat_ws('/', of_one, of_two, a) AS symbols FROM w""")  # fmt: skip
def markdown_sections(spark, sf):
    return chunks.markdown_sections(_sectioned(spark, sf), 6, 2).select("file_id", "start_line", "end_line", "kind", F.array_join("symbols", "/").alias("symbols"))


@query(rf"""WITH {V.CHUNKS}, l AS (SELECT file_id, start_line, end_line FROM chunks WHERE start_line % 4 = 1), e AS (SELECT * FROM l UNION ALL SELECT file_id, len(ls) + 1, NULL FROM cut),
    g AS (SELECT file_id, coalesce(max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a, start_line - 1 AS b FROM e),
    w AS (SELECT file_id, a, b, unnest(range(0, greatest(b - a + 1 - 1, 1)::BIGINT, 3)) AS s FROM g WHERE b - a + 1 >= 3)
    SELECT w.file_id, (a + s)::INTEGER AS start_line, least(a + s + 3, b)::INTEGER AS end_line, 'window-fill' AS kind, array_to_string(ls[a + s:least(a + s + 3, b)], chr(10)) AS document FROM w JOIN cut USING (file_id) WHERE trim(translate(array_to_string(ls[a + s:least(a + s + 3, b)], chr(10)), chr(10) || chr(9), '  ')) <> ''""")  # fmt: skip
def gap_chunks(spark, sf):
    return chunks.fill_gaps(V.chunks(spark, sf).where("start_line % 4 = 1"), V.files(spark, sf).select("file_id", "text"), 3, 4, 1)


@query(rf"""WITH {V.CHUNKS}, n AS (SELECT chunk_id, start_line, end_line, kind, string_split(document, chr(10)) AS l, end_line - start_line + 1 AS n FROM chunks), p AS (SELECT *, unnest(CASE WHEN n > 5 THEN range(0, greatest(n - 1, 1)::BIGINT, 2) ELSE [0] END) AS s FROM n)
    SELECT chunk_id, (start_line + s)::INTEGER AS start_line, (start_line + s + CASE WHEN n > 5 THEN least(3, n - s) ELSE n END - 1)::INTEGER AS end_line, CASE WHEN s > 0 THEN 'window' ELSE kind END AS kind, array_to_string(l[s + 1:s + CASE WHEN n > 5 THEN least(3, n - s) ELSE n END], chr(10)) AS document FROM p""")  # fmt: skip
def capped_chunks(spark, sf):
    return chunks.cap_sizes(V.chunks(spark, sf).select("chunk_id", "start_line", "end_line", "kind", "document"), 5, 3, 1)


# Sources assembled from the words of each document, three words for each declaration; `m` (the first word's length) says what is declared, and {a}, {b}, {c} are the words.
HEADS = {"python": "import {a}", "typescript": "import { {a} } from '{b}'", "go": "package p\nimport \"{a}\"", "markdown": ""}
DECLARED = {
    "python": ["def f{i}(a, b=1):\n    for x in a:\n        if x: {b}.{c}(x)", "class K{i}({a}):\n    async def get(self):\n        return {b}({c}())", "x{i} = {a}({b})\n\n"],
    "typescript": [
        "export async function f{i}(x: Map<string, {a}>, y = '}') { for (const k of x) for (const j of k) if (j) {b}.{c}(j); else if (k) return `${ {c}(k) }` }",
        "class K{i} extends {a} { static n = (v) => {b}(v); get(p: T): { q: string } { while (p) { try { {c}(p) } finally { } } } }",
        "const v{i} = { {a}() { do {b}(); while ({c}()) } }; type T{i} = {a} | string",
    ],
    "go": [
        "func (s *S[T]) F{i}(a, b int, c func(x int) error) (int, error) { if v, ok := m[k]; ok { for i := range v { for { {b}.{c}(i) } } }; return 1, nil }",
        "type T{i} struct { f func(int) string }; func g{i}[K any](x map[K]{a}) interface{} { defer func() { {b}({c}(x)) }(); return nil }",
        "var x{i} = {a}({b})",
    ],
    "markdown": [f"{'#' * k} {{a}}\n{{b}} {{c}}" for k in (1, 2, 3)],
}
#: For each of these the chunks, in their order: kind, name, exported, calls, nesting, loops, parameters, async; then names of inner definitions.
TOLD = [
    ("python", 0, 1, "'function'", "'f' || i", True, "[b || '.' || c]", 2, 1, 2, False, "[]"),
    ("python", 1, 1, "'class'", "'K' || i", True, "CASE WHEN b = c THEN [b] ELSE [b, c] END", 0, 0, 0, True, "['get']"),
    ("typescript", 0, 1, "'export'", "'f' || i", True, "[b || '.' || c, c]", 4, 2, 2, True, "[]"),
    ("typescript", 1, 1, "'class'", "'K' || i", False, "CASE WHEN b = c THEN [b] ELSE [b, c] END", 2, 1, 0, False, "['get']"),
    ("typescript", 2, 1, "'declaration'", "'v' || i", False, "CASE WHEN b = c THEN [b] ELSE [b, c] END", 0, 1, 0, False, "[a]"),
    ("typescript", 2, 2, "'type'", "'T' || i", False, "[]", 0, 0, 0, False, "[]"),
    ("go", 0, 1, "'method'", "'F' || i", True, "[b || '.' || c]", 3, 2, 2, False, "[]"),
    ("go", 1, 1, "'type'", "'T' || i", True, "[]", 0, 0, 0, False, "[]"),
    ("go", 1, 2, "'function'", "'g' || i", False, "CASE WHEN b = c THEN [b] ELSE [b, c] END", 0, 0, 1, False, "[]"),
]
_told = " UNION ALL ".join(
    f"SELECT file_id, language, i, a, b, c, {turn} AS turn, {kind} AS kind, {name} AS name, {exported} AS exported, {calls}::VARCHAR[] AS calls, {nesting} AS max_nesting, {loops} AS max_loops, {params} AS params, {has_async} AS has_async, {inner}::VARCHAR[] AS inner_names FROM tri WHERE language = '{language}' AND m = {m}"
    for language, m, turn, kind, name, exported, calls, nesting, loops, params, has_async, inner in TOLD
)
TOLD_SQL = (
    WORD_SQL
    + f""", told AS ({_told}),
    placed AS (SELECT *, (CASE language WHEN 'python' THEN 3 * i + 2 WHEN 'go' THEN i + 3 ELSE i + 2 END)::INTEGER AS line, row_number() OVER (PARTITION BY file_id ORDER BY i, turn) = 1 AS leads FROM told),
    led AS (SELECT file_id, a AS first_a, b AS first_b FROM tri WHERE i = 0)"""
)
_module = "CASE language WHEN 'typescript' THEN first_b ELSE first_a END"


_PARTS = re.compile(r"(\{[abci]\})")


def _filler(form: str) -> Callable[[tuple[str, str, str, int]], str]:
    """What fills a form with the words a, b and c and the number i of a declaration."""
    parts = _PARTS.split(form)
    names = ["abci".index(x[1]) for x in parts[1::2]]
    parts[1::2], parts[::2] = ["%s"] * len(names), [x.replace("%", "%%") for x in parts[::2]]
    whole = "".join(parts)
    return lambda values: whole % tuple([values[k] for k in names])


FILLED = {language: (_filler(HEADS[language] + "\n" if HEADS[language] else ""), [_filler(form) for form in forms]) for language, forms in DECLARED.items()}


def source(language: str | None, text: str | None) -> str | None:
    """A source in a language from the words of a whole document; one of fewer than three words has none."""
    w = ["w_" + x for x in "\n".join(re.findall("[A-Za-z]{3,}", text or "")).lower().split("\n")]
    if len(w) < 3:
        return ""
    if language not in FILLED:
        return None
    head, forms = FILLED[language]
    turn = zip(w[::3], w[1::3], w[2::3], range(len(w) // 3))  # noqa: B905  the last words may be fewer than three
    return head((w[0], w[1], w[2], 0)) + "\n".join([forms[len(at[0]) % 3](at) for at in turn])


def _definitions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return code.definitions(V.files(spark, sf), columns, source)


@query(f"""WITH {TOLD_SQL} SELECT file_id, line AS start_line, (line + CASE WHEN language = 'python' THEN 2 ELSE 0 END)::INTEGER AS end_line, kind, name AS symbols, CASE WHEN leads THEN {_module} ELSE '' END AS imports, CASE WHEN exported THEN name ELSE '' END AS exports,
    array_to_string(calls, ',') AS calls, max_nesting::INTEGER AS max_nesting, max_loops::INTEGER AS max_loops, params::INTEGER AS params, has_async, '' AS risky FROM placed JOIN led USING (file_id)""")  # fmt: skip
def code_chunks(spark, sf):
    joined = {c: F.array_join(c, ",") for c in ("symbols", "imports", "exports", "calls")}
    found = _definitions(spark, sf, *[c for c in chunks.FIELDS if c not in ("document", "refs")]).withColumn("risky", F.array_join(code.risky_calls(F.col("calls")), ","))
    return found.withColumns(joined)


@query(f"""WITH {TOLD_SQL}, within AS (SELECT *, (CASE WHEN language <> 'python' THEN line WHEN kind = 'class' THEN line + 1 ELSE line + 2 END)::INTEGER AS of_inner, (CASE WHEN language <> 'python' THEN line ELSE line + 2 END)::INTEGER AS of_call FROM placed)
    SELECT file_id, name AS symbol, 'def' AS kind, line FROM placed UNION ALL SELECT file_id, unnest(inner_names), 'def', of_inner FROM within
    UNION ALL SELECT file_id, unnest(list_distinct(list_transform(calls, lambda x: string_split(x, '.')[-1]))), 'call', of_call FROM within
    UNION ALL SELECT file_id, {_module}, 'import', 1 FROM placed JOIN led USING (file_id) WHERE leads UNION ALL SELECT file_id, first_a, 'import', 1 FROM placed JOIN led USING (file_id) WHERE leads AND language = 'typescript' AND first_a <> first_b""")  # fmt: skip
def symbol_refs(spark, sf):
    return _definitions(spark, sf, "file_id", "refs").select("file_id", F.explode("refs").alias("r")).select("file_id", "r.symbol", "r.kind", "r.line")


@query(f"WITH {TOLD_SQL} SELECT file_id, count(DISTINCT name) FILTER (exported)::BIGINT AS n_exports, 1::BIGINT AS n_imports FROM placed GROUP BY file_id")
def metadata_union(spark, sf):
    return quality.metadata_union(_definitions(spark, sf, "file_id", "exports", "imports"))


@query(f"""WITH {TOLD_SQL}, cut_by AS (SELECT file_id, kind FROM placed UNION ALL SELECT file_id, 'section-h' || (m + 1) FROM tri WHERE language = 'markdown'),
    size AS (SELECT file_id, language, CASE WHEN len(w) < 3 THEN 0 WHEN language = 'python' THEN 1 + len(w) // 3 * 3 - (len(w[len(w) // 3 * 3 - 2]) % 3 = 2)::INTEGER WHEN language = 'go' THEN 2 + len(w) // 3 ELSE 1 + len(w) // 3 END AS n FROM words WHERE language <> 'markdown'),
    rest AS (SELECT file_id, 'window' AS kind, unnest(range(0, greatest(n - 10, 1), 50)) AS s FROM size WHERE n > 0 AND file_id NOT IN (SELECT file_id FROM placed))
    SELECT file_id, kind, count(*) AS n FROM (SELECT file_id, kind FROM cut_by UNION ALL SELECT file_id, kind FROM rest) GROUP BY ALL""")  # fmt: skip
def routed_chunks(spark, sf):
    return code.routed_chunks(V.files(spark, sf), columns=("file_id", "kind"), source=source).groupBy("file_id", "kind").agg(F.count("*").alias("n"))


META = V.FILES + """, meta AS (SELECT file_id, doc_id % 5 AS m FROM files)"""


@query(f"WITH {META} SELECT file_id, CASE m WHEN 0 THEN 'symbol_match,exported' WHEN 1 THEN 'import_match,call_match' WHEN 2 THEN 'risky_call_category' WHEN 3 THEN 'complexity_signal,async_match' ELSE '' END AS reasons FROM meta")
def match_reasons(spark, sf):
    m = F.col("doc_id") % 5
    pick = lambda *xs: F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in xs]), (m + 1).cast("int"))
    none = ()
    meta = F.struct(
        pick(("Parse",), none, none, none, none).alias("exports"), pick(none, ("lib/parse",), none, none, none).alias("imports"), pick(none, ("parse",), ("os",), none, none).alias("calls"), pick(none, none, ("exec",), none, none).alias("risky_calls"),
        F.when(m == 3, 4).otherwise(1).alias("max_nesting"), F.lit(0).alias("max_loops"), F.lit(1).alias("params"), F.lit(False).alias("has_recursion"), (m == 3).alias("has_async"),
    )
    rows = V.files(spark, sf).select("file_id", meta.alias("meta"))
    return rows.select("file_id", F.array_join(fusion.match_reasons(F.col("meta"), ["parse"], ["exec"], True, True), ",").alias("reasons"))


# search


def _with_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return V.chunks(spark, sf).withColumn("symbols", F.array(F.lit("The"), F.col("language")))


@query(rf"""WITH {V.CHUNKS}, w AS (SELECT *, list_concat(list_filter(regexp_split_to_array(lower(document), '[^\p{{L}}\p{{N}}_]+'), lambda t: len(t) >= 1), CASE WHEN language IS NULL THEN ['the'] ELSE ['the', language] END) AS w FROM chunks), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
    t AS (SELECT unnest([{", ".join(f"'{t}'" for t in lexical.query_terms(SEARCH))}]) AS t), tf AS (SELECT chunk_id, t, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS dl FROM w, t), df AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY t)
    SELECT chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS bm25 FROM tf JOIN df USING (t), st GROUP BY chunk_id HAVING sum(tf) > 0 ORDER BY bm25 DESC, chunk_id LIMIT 20""")  # fmt: skip
def bm25_postings(spark, sf):
    scratch = Scratch(spark, "postings")
    rows = _with_symbols(spark, sf)
    index = scratch.keep(lexical.postings(rows, symbols="symbols"), "index")
    lengths = rows.select("chunk_id", F.size(lexical.words_of("document", "symbols")).alias("len"))
    return lexical.bm25_of_postings(index, lengths, SEARCH, 20)


@query()
def bm25_stemmed(spark, sf):
    return inverted.search_index(V.index(spark, sf, stem=True), SEARCH, 20).select(F.col("key").alias("chunk_id"), "bm25")


@query(f"""WITH {V.FILES}, a AS (SELECT file_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN language END AS kind, rel_path FROM files WHERE doc_id % 2 = 0 AND doc_id < 100), b AS (SELECT file_id AS chunk_id, 'vector' AS kind, size FROM files WHERE doc_id % 5 = 0 AND doc_id < 100)
    SELECT chunk_id, coalesce(a.kind, b.kind) AS kind, rel_path, size FROM a FULL JOIN b USING (chunk_id)""")  # fmt: skip
def merged_fields(spark, sf):
    d = F.col("doc_id")
    top = V.files(spark, sf).where(d < 100).withColumnRenamed("file_id", "chunk_id")
    a = top.where(d % 2 == 0).select("chunk_id", F.when(d % 3 == 0, F.col("language")).alias("kind"), "rel_path")
    b = top.where(d % 5 == 0).select("chunk_id", F.lit("vector").alias("kind"), "size")
    return fusion.merged(a, b, ["kind", "rel_path", "size"])


@query(f"WITH {V.VECTORS} SELECT chunk_id, file_id FROM vectors WHERE project_id = 1 ORDER BY chunk_id LIMIT 30")
def vector_scan(spark, sf):
    return similarity.vector_scan(V.vectors(spark, sf), 30, "project_id = 1")


@query(f"WITH {V.FILES} SELECT rel_path, regexp_matches(lower(rel_path), '(^|/)(slide|slides|deck|decks|presentation|presentations)/|[.](slide|slides|deck)[.]md$|(^|/)index[.]md$') AS derived FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'Slides/' WHEN 1 THEN 'my_slides/' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN 'a/Index.md' WHEN 1 THEN 'x.deck.md' WHEN 2 THEN 'myindex.md' ELSE rel_path END AS rel_path FROM files)")
def derived_sources(spark, sf):
    d = F.col("doc_id")
    path = F.concat(F.when(d % 5 == 0, "Slides/").when(d % 5 == 1, "my_slides/").otherwise(""), F.when(d % 7 == 0, "a/Index.md").when(d % 7 == 1, "x.deck.md").when(d % 7 == 2, "myindex.md").otherwise(F.col("rel_path")))
    return V.files(spark, sf).select(path.alias("rel_path")).withColumn("derived", fusion.is_derivative(F.col("rel_path")))


# findings on results

ATTACH = V.CHUNKS + V.FINDINGS.removeprefix(V.FILES) + """, two AS (SELECT file_id, rule_id, severity, line_from, line_to FROM findings UNION ALL SELECT file_id, 'extra/rule', 'info', 3, 4 FROM files),
    top AS (SELECT chunk_id, file_id, start_line, end_line FROM chunks ORDER BY chunk_id LIMIT 60), sp AS (SELECT file_id, s AS ordinal, 1 + s * 3 AS line_from, 4 + s * 5 AS line_to FROM files, (SELECT unnest(range(3))::INTEGER AS s)),
    ov AS (SELECT t.chunk_id, rule_id, severity, line_from, line_to FROM top t JOIN two f ON f.file_id = t.file_id AND start_line <= line_to AND end_line >= line_from),
    l AS (SELECT chunk_id, count(*) AS n, string_agg(rule_id || '@' || line_from, ',' ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, line_from, rule_id) AS findings FROM ov GROUP BY ALL),
    fn AS (SELECT chunk_id, ordinal AS function FROM (SELECT t.chunk_id, ordinal, least(end_line, line_to) - greatest(start_line, line_from) + 1 AS shared FROM top t JOIN sp ON sp.file_id = t.file_id AND start_line <= line_to AND end_line >= line_from) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY shared DESC, ordinal) = 1)"""


@query(f"WITH {ATTACH} SELECT t.chunk_id, coalesce(n, 0) AS n_findings, coalesce(findings, '') AS findings, function FROM top t LEFT JOIN l USING (chunk_id) LEFT JOIN fn USING (chunk_id)")
def attached_findings(spark, sf):
    files = V.files(spark, sf)
    top = V.chunks(spark, sf).select("chunk_id", "file_id", "start_line", "end_line").orderBy("chunk_id").limit(60)
    more = files.select("file_id", F.lit("extra/rule").alias("rule_id"), F.lit("info").alias("severity"), F.lit(3).alias("line_from"), F.lit(4).alias("line_to"))
    found = V.findings(spark, sf).select("file_id", "rule_id", "severity", "line_from", "line_to").unionByName(more)
    s = F.col("ordinal")
    spans = files.select("file_id", F.explode(F.array(*map(F.lit, range(3)))).alias("ordinal")).select("file_id", "ordinal", (1 + s * 3).alias("line_from"), (4 + s * 5).alias("line_to"))
    names = F.array_join(F.transform(F.coalesce("findings", F.array().cast("array<struct<rule_id:string,severity:string,line_from:int,line_to:int>>")), lambda f: F.concat(f["rule_id"], F.lit("@"), f["line_from"])), ",")
    return quality.attached(top, found, spans).select("chunk_id", "n_findings", names.alias("findings"), "function")


REPORT = V.FINDINGS + """, fi AS (SELECT file_id, 'quality/high-fan-in' AS rule_id, 'info' AS severity, rel_path, doc_id FROM files WHERE doc_id % 40 > 25), al AS (SELECT file_id, rule_id, severity, rel_path, doc_id FROM findings UNION ALL SELECT * FROM fi),
    sup AS (SELECT * FROM al WHERE NOT ((rule_id = 'label/toxic' AND rel_path LIKE 'fr/%') OR rel_path LIKE '%7.md') AND NOT (rule_id = 'label/seen' AND doc_id % 11 = 0))"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    files, found = V.files(spark, sf), V.findings(spark, sf)
    fan_in = quality.fan_in_findings(files.select("file_id", (F.col("doc_id") % 40).alias("fan_in")))
    base = found.where("doc_id % 11 = 0 AND rule_id = 'label/seen'").select("rule_id", "rel_path")
    return quality.report(found, [fan_in], files, [("label/toxic", "fr/*"), ("*", "*7.md")], base).where("suppressed_by IS NULL")


@query(f"WITH {REPORT} SELECT rule_id, count(*) AS n, count(DISTINCT file_id) AS n_files, ['error', 'warning', 'info'][min(CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END)] AS worst FROM sup GROUP BY rule_id")
def report_rules(spark, sf):
    return quality.rule_rollup(_report(spark, sf))


@query(f"WITH {REPORT} SELECT file_id, rel_path, sum(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)::BIGINT AS weight, count(*) AS n FROM sup GROUP BY ALL ORDER BY weight DESC, rel_path LIMIT 20")
def report_files(spark, sf):
    return quality.file_ranking(_report(spark, sf), 20)


# definitions

_KINDS = "SELECT file_id, doc_id, doc_id % 6 AS m FROM files"


def _defined(spark: SparkSession, sf: str) -> DataFrame:
    m, d = F.col("doc_id") % 6, F.col("doc_id")
    text = (
        F.when(m == 0, F.lit("plain text\n---\n")).when(m == 1, F.concat(F.lit("---\ntype: guide\ntitle: T"), d, F.lit("\nsize: 3\n---\nbody"))).when(m == 2, F.lit("---\ntitle: 'x'\nsize: big\n---"))
        .when(m == 3, F.lit("---\ntype: 3\ntags: [a, 4]\nresource: here\n---\n")).when(m == 4, F.lit("---\ntype: open\n")).otherwise(F.lit("---\ntype: a\nthis is no map\n---\n"))
    )
    return V.files(spark, sf).select("file_id", text.alias("text"))


@query(f"""WITH {V.FILES}, k AS ({_KINDS}) SELECT file_id, m IN (1, 2, 3, 5) AS present, CASE m WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 5 THEN 4 ELSE 0 END AS end_line, m IN (4, 5) AS failed,
    CASE m WHEN 1 THEN 'type=string,title=string,size=integer' WHEN 2 THEN 'title=string,size=string' WHEN 3 THEN 'type=integer,tags=array,resource=string' ELSE '' END AS fields FROM k""")  # fmt: skip
def front_matter(spark, sf):
    found = definitions.entries(_defined(spark, sf))
    return found.select("file_id", "present", "end_line", F.col("error").isNotNull().alias("failed"), F.array_join(F.transform("entries", lambda e: F.concat(e["key"], F.lit("="), e["type"])), ",").alias("fields"))


@query("SELECT * FROM (VALUES ('resource', 'string', false), ('size', NULL, false), ('tags', 'array', false), ('title', 'string', false), ('type', NULL, false)) t(key, type, required)")
def inferred_schema(spark, sf):
    return definitions.infer_schema(definitions.entries(_defined(spark, sf))).select("key", "type", "required")


@query(f"""WITH {V.FILES}, k AS ({_KINDS}), r AS (SELECT * FROM (VALUES (1, 'recommended:description', 'warning'), (1, 'recommended:resource', 'warning'), (1, 'recommended:tags', 'warning'), (1, 'recommended:timestamp', 'warning'),
    (2, 'required:type', 'error'), (2, 'recommended:description', 'warning'), (2, 'recommended:resource', 'warning'), (2, 'recommended:tags', 'warning'), (2, 'recommended:timestamp', 'warning'),
    (3, 'type:type', 'error'), (3, 'type:tags/1', 'error'), (3, 'format:resource', 'error'), (3, 'recommended:title', 'warning'), (3, 'recommended:description', 'warning'), (3, 'recommended:timestamp', 'warning')) t(m, rule, severity))
    SELECT file_id, 'okf/v0.1/' || rule AS rule_id, severity, 1 AS line_from, CASE m WHEN 2 THEN 4 ELSE 5 END AS line_to FROM k JOIN r USING (m) UNION ALL SELECT file_id, 'definitions/missing-frontmatter', 'error', 1, 1 FROM k WHERE m IN (0, 4) UNION ALL SELECT file_id, 'definitions/invalid-yaml', 'error', 1, 4 FROM k WHERE m = 5""")  # fmt: skip
def definition_findings(spark, sf):
    return definitions.definition_findings(definitions.entries(_defined(spark, sf)), must_exist=True)


# upkeep

COUNTERS = V.RESULTS + ", b AS (SELECT query_id, count(*) AS n, max(file_id) AS last FROM results GROUP BY ALL)"


@query(f"WITH {COUNTERS} SELECT query_id, n + CASE WHEN query_id % 2 = 0 THEN 5 ELSE 0 END AS n, CASE WHEN query_id % 2 = 0 THEN 99 ELSE last END AS last FROM b WHERE query_id % 3 <> 0 UNION ALL SELECT query_id, 5, 99 FROM b WHERE query_id % 3 = 0 AND query_id % 2 = 0")
def add_counters(spark, sf):
    base = V.results(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.max("file_id").cast("int").alias("last"))
    delta = base.where("query_id % 2 = 0").select("query_id", F.lit(5).cast("long").alias("n"), F.lit(99).alias("last"))
    return store.add_counters(base.where("query_id % 3 <> 0"), delta, ["query_id"], ["n"], "last")


@query(f"WITH {V.CHUNKS} SELECT chunk_id, 'old' AS state FROM chunks WHERE start_line < 20 UNION ALL SELECT chunk_id, 'new' FROM chunks WHERE start_line >= 20")
def insert_ignore(spark, sf):
    rows = V.chunks(spark, sf).select("chunk_id", "start_line")
    old = rows.where("start_line < 20").select("chunk_id", F.lit("old").alias("state"))
    new = rows.select("chunk_id", F.lit("new").alias("state"))
    return store.insert_ignore(old, new.unionByName(new), ["chunk_id"])


@query(f"WITH {V.CHUNKS}, {V.VECTORS} SELECT 'chunks' AS name, count(*) AS n FROM chunks WHERE project_id <> 'src1' UNION ALL SELECT 'files', count(*) FROM files WHERE project_id <> 'src1' UNION ALL SELECT 'labels', count(*) FROM labels")
def delete_project(spark, sf):
    tables = {"chunks": V.chunks(spark, sf).select("chunk_id", "project_id"), "files": V.files(spark, sf).select("file_id", "project_id"), "labels": V.read(spark, sf, "labels")}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in store.delete_where(tables, project_id="src1").items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


RECONCILE = V.FILES + """, rec AS (SELECT file_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE content_sha END AS sha, error, doc_id FROM files WHERE doc_id % 7 <> 0), li AS (SELECT file_id, content_sha, doc_id % 13 <> 0 AS eligible FROM files WHERE doc_id % 11 <> 0),
    s AS (SELECT coalesce(li.file_id, rec.file_id) AS file_id, CASE WHEN li.file_id IS NULL THEN 'prune' WHEN NOT eligible AND rec.file_id IS NOT NULL THEN 'prune' WHEN NOT eligible THEN 'ignored' WHEN rec.file_id IS NULL THEN 'index' WHEN error IS NULL AND content_sha = sha THEN 'kept' ELSE 'index' END AS action FROM li FULL JOIN rec ON li.file_id = rec.file_id)"""


@query(f"WITH {RECONCILE} SELECT action, file_id FROM s WHERE action <> 'ignored'")
def reconcile_actions(spark, sf):
    d = F.col("doc_id")
    files = V.files(spark, sf)
    listing = files.where(d % 11 != 0).select("file_id", "content_sha", (d % 13 != 0).alias("eligible"))
    recorded = files.where(d % 7 != 0).select("file_id", F.when(d % 5 == 0, "old").otherwise(F.col("content_sha")).alias("content_sha"), F.lit("hash-16").alias("embedding_identity"), "error")
    done = [df.select(F.lit(name).alias("action"), "file_id") for name, df in store.reconciled(recorded, listing, "hash-16", "file_id").items()]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query(f"WITH {V.FILES}, t AS (SELECT file_id, content_sha, unnest(CASE WHEN doc_id % 3 = 0 THEN ['lizard', 'quality'] WHEN doc_id % 3 = 1 THEN ['quality'] ELSE [] END) AS analyzer FROM files) SELECT * FROM t")
def enrichment_backfill(spark, sf):
    d = F.col("doc_id")
    files = V.files(spark, sf)
    have = F.explode(F.when(d % 3 == 0, F.array(F.lit("quality"))).when(d % 3 == 1, F.array(F.lit("lizard"))).otherwise(F.array(F.lit("lizard"), F.lit("quality"))))
    done = files.select("file_id", "content_sha", have.alias("analyzer")).select("*", F.lit("1").alias("analyzer_version"), F.lit("complete").alias("status"))
    return store.backfill(files.select("file_id", "content_sha"), done, {"lizard": "1", "quality": "1"}, {"quality": ["lizard"]})


@query(f"""WITH {V.CHUNKS} SELECT file_id, chunk_id FROM chunks WHERE doc_id % 100 NOT IN (7, 11) UNION ALL SELECT file_id, file_id || ':new' FROM files WHERE doc_id % 100 = 7""")
def bucketed_versions(spark, sf):
    """A second version, in which one file of a hundred has changed and another is gone, out of the buckets of both."""
    path = Scratch(spark, "versions").path("index")
    files, rows = V.files(spark, sf), V.chunks(spark, sf).select("file_id", "chunk_id")
    versions.first_version({"chunks": rows}, path, "v1", buckets=64)
    fresh = files.where("doc_id % 100 = 7").select("file_id", F.concat("file_id", F.lit(":new")).alias("chunk_id"))
    versions.next_version(spark, path, "v2", {"chunks": fresh}, files.where("doc_id % 100 = 11").select("file_id"), buckets=64)
    return versions.read_version(spark, path)["chunks"].select("file_id", "chunk_id")


@query(f"WITH {V.CHUNKS} SELECT 'chunks' AS name, count(*) AS n FROM chunks WHERE doc_id % 9 <> 2 UNION ALL SELECT 'files', count(*) FROM files WHERE doc_id % 9 <> 2")
def incremental_index(spark, sf):
    """Two committed versions and a third whose marker is missing: the second is what readers see."""
    path = Scratch(spark, "index").path("versions")
    d = F.col("doc_id")
    both = {"files": V.files(spark, sf).select("file_id", "doc_id"), "chunks": V.chunks(spark, sf).select("file_id", "doc_id", "chunk_id")}
    store.commit_index({n: df.where(d % 9 != 1) for n, df in both.items()}, path, "v1")
    old = store.committed_index(spark, path)
    fresh = {n: df.where((d % 9 == 1) | (d % 9 == 3)) for n, df in both.items()}
    store.commit_index(store.next_version(old, fresh, both["files"].where(d % 9 == 2)), path, "v2")
    both["files"].limit(0).write.parquet(f"{path}/v3/files")
    now = store.committed_index(spark, path)
    counts = [now[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("chunks", "files")]
    return counts[0].unionByName(counts[1])


@query(f"WITH {V.CHUNKS} SELECT f.project_id, count(c.chunk_id) AS n_chunks FROM (SELECT DISTINCT project_id FROM files) f LEFT JOIN chunks c USING (project_id) GROUP BY ALL")
def project_chunks(spark, sf):
    return accounts.project_chunk_counts(V.files(spark, sf), V.chunks(spark, sf))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || chr(10) || '…[truncated ' || (length(text) - 60) || ' chars]' ELSE text END AS text FROM conversations")
def capped_log(spark, sf):
    return accounts.capped_fields(V.read(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"], 60)


USAGE_ROWS = V.RESULTS + """, u AS (SELECT project_id, count(*) AS queries, sum(octet_length(encode(snippet)))::BIGINT AS r, coalesce(sum(file_bytes), 0)::BIGINT AS b, count(*) FILTER (query_id % 4 = 0) AS z, sum(query_id)::BIGINT AS e FROM results GROUP BY ALL), t AS (SELECT *, floor(r / 4 + 0.5)::BIGINT AS back, floor(b / 4 + 0.5)::BIGINT AS base FROM u)"""


@query(f"WITH {USAGE_ROWS} SELECT project_id, queries, back AS tokens_returned, greatest(base - back, 0)::BIGINT AS tokens_saved, CASE WHEN base > 0 THEN floor(100 * greatest(base - back, 0) / base + 0.5)::BIGINT ELSE 0 END AS reduction, floor(100 * z / queries + 0.5)::BIGINT AS zero_hit_pct, floor(e / queries + 0.5)::BIGINT AS mean_ms FROM t")
def usage_report(spark, sf):
    q = F.col("query_id")
    usage = V.results(spark, sf).groupBy("project_id").agg(
        F.count("*").alias("queries"), F.sum(F.octet_length("snippet")).alias("returned_bytes"), F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("baseline_bytes"), F.count_if(q % 4 == 0).alias("zero_hits"), F.sum(q).alias("elapsed_ms")
    )
    return accounts.usage_report(usage)


@query("""SELECT event_id, unnest([event_id % 3, event_id % 5, 7])::BIGINT AS item FROM events""")
def json_array_rows(spark, sf):
    e = F.col("event_id")
    rows = V.read(spark, sf, "events").select("event_id", F.concat(F.lit("["), e % 3, F.lit(","), e % 5, F.lit(",7]")).alias("items_json"))
    return rows.select("event_id", F.explode(F.from_json("items_json", "array<long>")).alias("item"))


# evaluation

GATE = V.FILES + """, r AS (SELECT doc_id % 40 AS query_id, rel_path, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY (doc_id * 7919) % 1009 DESC, rel_path) AS rank FROM files),
    j AS (SELECT DISTINCT query_id FROM r JOIN (SELECT rel_path, doc_id, quality FROM labels JOIN files USING (doc_id)) USING (rel_path) WHERE rank <= 5 AND quality = 1), q AS (SELECT DISTINCT doc_id % 40 AS query_id FROM labels)"""


@query(f"WITH {GATE} SELECT count(*) AS n, round(count(j.query_id) / count(*), 6) AS share, round(count(j.query_id) / count(*), 6) >= 0.8 AS passed FROM q LEFT JOIN j USING (query_id)")
def hit_gate(spark, sf):
    d = F.col("doc_id")
    scored = V.files(spark, sf).select((d % 40).alias("query_id"), "rel_path", F.lit(1).alias("start_line"), F.lit(8).alias("end_line"), ((d * 7919) % 1009).alias("score"))
    at = V.read(spark, sf, "labels").join(V.files(spark, sf).select("doc_id", "rel_path"), "doc_id")
    qrels = at.select((d % 40).alias("query_id"), "rel_path", F.lit(1).alias("start_line"), F.lit(8).alias("end_line"), F.col("quality").alias("relevance"))
    return evaluation.gate(evaluation.run_of(scored), qrels)


def _run(spark: SparkSession, sf: str, shift: int, name: str) -> DataFrame:
    e = F.col("vec_id")
    kinds = F.array(*map(F.lit, runs.QUERY_TYPES[: 4 + shift]))
    value = lambda k: ((e * (k + 1) + shift) % 7 / 7).alias(list(runs.METRICS)[k])
    each = V.read(spark, sf, "embeddings").where(e < 40).select(F.concat(F.lit("q"), e).alias("queryId"), F.element_at(kinds, (e % (4 + shift) + 1).cast("int")).alias("queryType"), *map(value, range(7)))
    path = Scratch(spark, "run").path(name)
    runs.write_run(runs.run_rows({f: name for f in runs.RUN_FIELDS}, each), path)
    return runs.read_runs(spark, path)


def _run_sql(shift: int) -> str:
    means = ", ".join(f"avg((vec_id * {k + 1} + {shift}) % 7 / 7) AS m{k}" for k in range(7))
    rows = " UNION ALL ".join(f"SELECT t, {k} AS k, '{n}' AS metric, m{k} AS v FROM g" for k, n in enumerate(runs.METRICS.values()))
    kinds = str(runs.QUERY_TYPES[: 4 + shift])
    return f"(WITH g AS (SELECT {kinds}[(vec_id % {4 + shift} + 1)] AS t, {means} FROM embeddings WHERE vec_id < 40 GROUP BY ALL UNION ALL SELECT '', {means} FROM embeddings WHERE vec_id < 40) {rows})"


@query(f"""WITH a AS {_run_sql(0)}, b AS {_run_sql(1)} SELECT coalesce(a.t, b.t) AS query_type, coalesce(a.metric, b.metric) AS metric, coalesce(printf('%.3f', a.v), 'n/a') AS a, coalesce(printf('%.3f', b.v), 'n/a') AS b,
    CASE WHEN b.v - a.v IS NULL THEN '—' WHEN b.v = a.v THEN '·' ELSE printf('%+.3f', b.v - a.v) END AS delta FROM a FULL JOIN b ON a.t = b.t AND a.k = b.k""")  # fmt: skip
def run_comparison(spark, sf):
    return runs.compared(_run(spark, sf, 0, "first"), _run(spark, sf, 1, "second"))


@query(f"""WITH {V.FILES} SELECT file_id FROM files WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'men') AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ent')""")
def literal_candidates(spark, sf):
    """The files that hold both trigrams of a pattern, in whatever case."""
    rows = V.files(spark, sf).select("file_id", "text")
    index = trigrams.build_trigrams(rows, Scratch(spark, "trigrams").path("index"), buckets=16, parts=16)
    return trigrams.candidates(index, "MENT").select(F.col("key").alias("file_id"))


@query(f"WITH {V.FILES} SELECT file_id, len(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x) <> ''))::INTEGER AS n FROM files")
def nonblank_lines(spark, sf):
    return V.files(spark, sf).select("file_id", definitions.nonblank_lines(F.col("text")).alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' || page_id ELSE 'b/c/' || page_id END AS path FROM pages")
def resolved_links(spark, sf):
    p = F.col("page_id")
    target = F.when(p % 2 == 0, F.concat(F.lit("../a/./"), p, F.lit("#x"))).otherwise(F.concat(F.lit("c//"), p))
    return V.read(spark, sf, "pages").select("page_id", T.resolve_path(F.when(p % 2 == 0, "x").otherwise("b"), target).alias("path"))
