"""Declarations told by the shapes of pieces against those of whole texts, in all languages."""

import ast
import keyword
import random
import re
import warnings

import pytest
from test_syntax import TREES

from sedimenta.operators import chunks, code, shapes, syntax

LINES = """export async function f1(x: Map<string, w_a>, y = '}') { for (const k of x) for (const j of k) if (j) w_b.w_c(j); else if (k) return `${ w_c(k) }` }|class K1 extends w_a { static n = (v) => w_b(v); get(p: T): { q: string } { while (p) { try { w_c(p) } finally { } } } }
const v1 = { w_a() { do w_b(); while (w_c()) } }; type T1 = w_a | string|import { w_a } from 'w_b'|import "w_a"|import w_c from './w_a/w_b'|func (s *S[T]) F1(a, b int) (int, error) { if v, ok := m[k]; ok { for { w_b.w_c(i) } }; return 1, nil }|type T1 struct { f func(int) string }; func g1[K any](x map[K]w_a) interface{} { return nil }
var x1 = w_a(w_b)|@Ann|@Ann(x)|export|export default|class A extends B|if (a)|else {}|x < y|const z = q > (3)|func f()|fn f()|foo.|bar()|pub|impl X for|{ y() }|function f() {~  a(b)~}|class Q {~  m(a) {~    return `x~${ f(1) }`~  }~}|// comment|/* a~ b */|/re/.test(x)|x = 'abc|#[derive(Debug)]|'ab'|'a'|r#"abc"#
import { a,~ b } from 'q'|public static void m(int a) { go(); }|int q(int a);|new a.b~(c)|let|a ? (b) : c => d|do|try|func|import (~ "a"~ b "c"~)|x!|(a)|let q: A<B|var a, b = 1,~ c = f(2)|macro!{ f(x) }|a /b/ c|impl<T> A for B { fn m(&self) -> T { loop { self.x.go() } } }|pub struct S<'a> { x: &'a str }|mod m { pub fn i() {} }|public class J { int f(int a) { for (;;) { a.b(c); } } }|\\""".replace("\n", "|").split("|")
PYTHON = """def f(a, b=1):~    for x in a:~        if x: g.h(x)|class K(foo):~    async def get(self):~        return q(z())|x = a(b)|import os, sys|from . import q|from a.b import c|@dec~def f():~    pass|@dec(1)~@e.f~class Z:~  @p~  def _m(self, *, a): return f"{a!r:>10} {b()}"|if x:~  y()~else:~  z()|try:~  f()~except E as e:~  pass|s = '''a~def no(): pass~'''|x = (1,~ 2)
x = [~a,~]|x = 1 \\~ + 2|match x:~  case Foo(a): f(a)|async def _p(): await q|# comment|def g(): return b"abc" + rb'\\x' + "\\N{BULLET}"|x = "\\xZZ"|x = (|    indented()|class _A: x: int = f(1); y = lambda: g()|elif y: pass|x = 1 \\""".replace("\n", "|").split("|")
NAMES = "foo Bar baz_q _x async1 asyncThing longwordwithmanyletters T v K9 f1".split()
KEPT = shapes.compared(syntax) | frozenset(keyword.kwlist)


def both(language, file_id, text):
    """What the shapes tell, or None, and what the whole text holds."""
    if language == "python":
        return chunks._python_shapes().find(file_id, text), chunks._python_whole(file_id, text)
    return code._shapes(language).find(file_id, text), code._whole(file_id, text, language)


@pytest.mark.parametrize("language", ["python", *code.TOP])
def test_shapes_tell_what_whole_texts_hold(language, monkeypatch):
    monkeypatch.setattr(shapes, "PATIENCE", 10**9)
    warnings.simplefilter("ignore")
    dice, told, found = random.Random(language), 0, 0
    like = [t for of, t, _ in TREES if of == language or of in syntax.SCRIPTS and language in syntax.SCRIPTS]
    lines = [x.replace("~", "\n") for x in (PYTHON if language == "python" else LINES)] + like + [x for t in like for x in re.split(r"(?<=[};])\s+|\n", t)]
    lines += [f"function {'verylongname' * k}(a) {{ return async () => b }}" for k in range(10, 18)] + [f"class {'q' * k} {{ async m() {{ }} }}" for k in range(174, 184)] + ["x = /[a-z]{2}word" + "longword " * 80 + "/"]
    for _ in range(2500):
        text = "\n".join(dice.choice(lines) for _ in range(dice.randint(1, 4))) + dice.choice(["", "\n"])
        text = re.sub(r"\b[a-zA-Z]{1,3}\d?\b", lambda m: m[0] if m[0] in KEPT or dice.random() < 0.6 else dice.choice(NAMES), text)
        by_shape, whole = both(language, "f", text)
        assert by_shape is None or by_shape == whole, text
        told, found = told + (by_shape is not None), found + bool(by_shape)
    assert told > 250 and found > 100


def test_a_shape_is_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(code, "tree", lambda *_: pytest.fail("a whole text was parsed"))
    monkeypatch.setattr(ast, "parse", lambda text, parse=ast.parse: parsed.append(text) or parse(text))
    for cached in (code._shapes, chunks._python_shapes):
        cached.cache_clear()
    typescript = "\n".join(f"export function f{i}(a: w{i}) {{ if (a) {{ w{i}.go{i}(a) }}\n}}" for i in range(500))
    python = "\n".join(f"def f{i}(a):\n    return w{i}.go{i}(a)" for i in range(500))
    for got in (code._all("t", typescript, "typescript"), chunks.python_chunks("p", python)):
        assert [(c[1], c[4], c[8]) for c in got] == [(2 * i + 1, [f"f{i}"], [f"w{i}.go{i}"]) for i in range(500)]
    assert len(parsed) == 1 and len(code._shapes("typescript").made) < 10


def test_shapes_that_do_not_repeat_are_given_up_and_forgotten(monkeypatch):
    monkeypatch.setattr(shapes, "PATIENCE", 50)
    code._shapes.cache_clear()
    texts = [f"func f{i}() {{ g({', '.join('a' * (i + 1))}) }}" for i in range(200)]
    assert [code._all("f", t, "go") for t in texts] == [code._whole("f", t, "go") for t in texts]
    at = code._shapes("go")
    assert at.rest and at.find("f", "func f() {}") is None
    at.rest = 0  # and tried again later
    assert at.find("f", "func f() {}")
    monkeypatch.setattr(shapes, "MOST_SIZE", 5_000)
    code._shapes.cache_clear()
    monkeypatch.setattr(shapes, "PATIENCE", 10**9)
    for t in texts:
        assert code._all("f", t, "go") == code._whole("f", t, "go")
    assert code._shapes("go").size <= 10_000
    code._shapes.cache_clear()


def test_an_annotation_at_the_end_of_an_export():
    for language in syntax.SCRIPTS:
        for text in ("export @", "export async @", "export @a @"):
            assert [n.kind for n in syntax.tree(text, language)] == ["export"]


SOURCES = [("t", "typescript", "export function f() { g() }\nclass K {}"), ("p", "python", "import os\ndef f():\n    return g()"), ("m", "markdown", "# a\nx\n## b\ny"), ("w", "go", "just words\n" * 130), ("n", None, "x\n\n"), ("e", "rust", ""), ("u", "java", None), ("t", "typescript", "no code here")]


def test_routed_chunks_read_each_file_once(spark):
    files = spark.createDataFrame(SOURCES, "file_id string, language string, text string")
    plan = code.routed_chunks(files)
    assert "MapIn" not in plan._jdf.queryExecution().executedPlan().toString()  # all chunks come from the table that one pass wrote
    got = sorted((r.file_id, r.start_line, r.end_line, r.kind, r.document) for r in plan.collect())
    rest = "just words\n" * 130
    assert got == sorted([
        ("t", 1, 1, "export", "export function f() { g() }"), ("t", 2, 2, "class", "class K {}"), ("p", 2, 3, "function", "def f():\n    return g()"), ("m", 1, 2, "section-h1", "# a\nx"), ("m", 3, 4, "section-h2", "## b\ny"),
        *[("w", k + 1, min(k + 60, 130), "window", "\n".join(rest.split("\n")[k : min(k + 60, 130)])) for k in (0, 50, 100)], ("n", 1, 2, "window", "x\n"),
    ])
    by_plan = chunks.line_windows(files.where("file_id IN ('w', 'n')")).select(*code.ROUTED).collect()
    assert sorted(map(tuple, by_plan)) == [x for x in got if x[0] in "wn"]
    kinds = code.routed_chunks(files, columns=("file_id", "kind"))
    assert kinds.columns == ["file_id", "kind"] and sorted(map(tuple, kinds.collect())) == sorted((x[0], x[3]) for x in got)


def test_definitions_leave_the_worker_as_the_columns_asked_for(spark):
    from sedimenta.plans import catalogue, projects  # noqa: F401

    found = code.definitions(spark.createDataFrame(SOURCES, "file_id string, language string, text string"), ("file_id", "exports"))
    assert found.columns == ["file_id", "exports"] and sorted(map(tuple, found.collect())) == [("p", ["f"]), ("t", []), ("t", ["f"])]
    plan = catalogue.QUERIES["symbol_refs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    passes = [x for x in plan.split("\n") if "MapInArrow" in x]
    assert len(passes) == 1 and "refs" in passes[0] and not any(c in passes[0].rpartition("[")[2] for c in ("document", "calls", "symbols"))


def test_metadata_is_united_in_one_pass(spark):
    from sedimenta.operators import quality

    files = spark.createDataFrame([*SOURCES, ("x", "go", "func f() {}")], "file_id string, language string, text string")
    united = quality.metadata_union(code.definitions(files, ("file_id", "exports", "imports")))
    assert united._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, united.collect())) == [("p", 1, 1), ("t", 1, 0), ("x", 0, 0)]
