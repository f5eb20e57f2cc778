"""Syntax trees against trees made by hand, for each language with braces, and what chunks tell of them."""

import time

import pytest

from sedimenta.operators import chunks, code
from sedimenta.operators.syntax import tree


def shape(node):
    own = f"{node.kind} {node.name}".strip()
    return (own, *map(shape, node.children)) if node.children else own


TREES = [
    ("typescript", "export default class Foo<T extends Bar<U>> extends Base { private x: Map<string, number> = new Map(); static async load<T>(a: string, b?: { c: number }): Promise<{ r: string }> { go(a) } get y() { return 1 } abstract q(): void; h = async (e: E) => { try { risky(e) } catch (x) { log(x) } } }",
     [("export Foo", ("class Foo", ("method load", "call go"), "method y", ("arrow", ("try", "call risky", "call log"))))]),
    ("typescript", "function over(a: string): void\nfunction over(a: any, cb: (x: number) => void = () => {}) { do { w() } while (t()); new Thing(z()); a?.b?.(2) } interface I { m(): void } type A = | 'x' | B<C>\n  | { z: (q: number) => void }\nenum E { A = f(1) }",
     [("function over", "arrow", ("do", "call w", "call t"), "call z", "call a.b"), "interface I", "type A", ("enum E", "call f")]),
    ("javascript", "for (const k of a) for (const z of b) if (k) { go(k) } else if (z) stop.all(`t ${inner(z)} } \"`); else fail()\nconst o = { run(a) { return h(a) }, if: 1, async *gen() { k() } }, re = /a\"[/]'b/.test(s)",
     [("for", "declaration k", ("for", "declaration z", ("if", "call go", ("if", "call stop.all", "call inner", "call fail")))), ("declaration o", ("method run", "call h"), ("method gen", "call k"), "call test")]),
    ("tsx", "export const View = (p: Props): JSX.Element => <div onClick={() => go(p)}>Don't stop</div>\nexport { a as b }; export * from 'q'", [("export View", ("declaration View", ("arrow", ("arrow", "call go")))), "export a", "export"]),
    ("go", "package p\nimport ( \"fmt\"; x \"net/http\" )\nfunc (s *Server[T]) Handle(a, b int, c func(x int) error) (int, error) { if v, ok := m[k]; ok { for i := range v { for { go run(i) } } } else if z { fmt.Println(\"}\") }\n defer func() { if r := recover(); r != nil { log.Print(r) } }()\n return 1, nil }\ntype ( A int\n B struct { f func(int) string } )\nfunc Map[K comparable](m map[K]int, n string) interface{} { return struct{}{} }; var q = f()",
     ["import fmt", "import net/http", ("method Handle", ("if", ("for", ("for", "call run")), ("if", "call fmt.Println")), ("if", "call recover", "call log.Print")), "type A", "function Map", "call f"]),
    ("rust", "use std::{io, fmt};\n#[derive(Debug)] pub struct P<'a> { x: &'a str } struct T(i32);\nimpl<'a, T: Into<S>> fmt::Display for P<'a> where T: Copy { fn fmt(&self, f: &mut F) -> R { if let Some(x) = self.x.get(0) { loop { while y() { write!(f, \"{}\", g())?; a::b::c(1) } } } else { r#\"}\"#.len() } match z { Some(q) if q > 1 => h(q), _ => '}' } } pub fn k<const N: usize>(a: [u8; 4]) {} }\ntrait Tr { fn need(&self); fn has(&self) -> bool { true } } /* a /* b */ fn c() } */ mod m { pub fn inner() {} } pub async fn z(x: impl Fn(i32) -> i32) { x.map(|v| { v.foo() }).collect::<Vec<_>>() }",
     ["import std", "struct P", "struct T", ("impl P", ("function fmt", ("if", "call self.x.get", ("loop", ("while", "call y", "call a.b.c")), "call len"), "call h"), "function k"), ("trait Tr", "function has"), ("module m", "function inner"), ("function z", "call x.map", "call v.foo", "call collect")]),
    ("java", "package a.b; import java.util.*;\n  @Ann(value = \"}\") public final class K<T extends Comparable<T>> extends B { static int n = init(); K(int a) { super(a); this.x = make(a); }\n @Override public <R> List<R> map(Function<T, R> f, int... rest) throws E { for (int i = 0; i < 3; i++) for (T t : ts) if (t == null) do { f.apply(t).go(); } while (more()); return new ArrayList<>(seed()); }\n abstract void none(); int[] arr(int[] a) { return a; } class Inner { void deep() { Runnable r = new Runnable() { public void run() { act(); } }; try (X x = open()) { use(x); } catch (E e) { } } }\n enum Q { A(1), B { void w() { v(); } }; int f() { return \"\"\" } \"\"\".length(); } } } interface J { void a(); default int b() { return c(); } }",
     ["import java.util", ("class K", "call init", "call make", ("method map", ("for", ("for", ("if", ("do", "call f.apply", "call go", "call more")))), "call seed"), "method none", "method arr", ("class Inner", ("method deep", ("method run", "call act"), ("try", "call open", "call use"))), ("enum Q", ("method w", "call v"), ("method f", "call length"))), ("interface J", "method a", ("method b", "call c"))]),
]


@pytest.mark.parametrize("language, text, want", TREES)
def test_trees(language, text, want):
    assert [shape(n) for n in tree(text, language)] == want


def test_lines_and_ends():
    nodes = tree("\n\n  @Dec({ a: 1 })\n  export abstract class A {\n  }  function b() {\n }\nconst c = 1,\n  d = f(\n2)\nlet e\nlet g = {}", "typescript")
    assert [(n.kind, n.name, n.line + 1, n.last + 1) for n in nodes] == [("export", "A", 3, 5), ("function", "b", 5, 6), ("declaration", "c", 7, 9), ("declaration", "e", 10, 10), ("declaration", "g", 11, 11)]
    assert [n.exported for n in nodes if n.kind == "declaration"] == [["c", "d"], ["e"], ["g"]]
    params = [tree(t, lang)[0].params for lang, t in [("go", "func f(a, b int, c string) {}"), ("go", "func f(int, string)"), ("rust", "fn f(&self, x: HashMap<u8, u8>,) {}"), ("java", "void f(Map<A, B> a, int... b) {}"), ("typescript", "function f({ a, b }: T, ...c: Map<K, V>[]) {}"), ("javascript", "function f() {}")]]
    assert params == [2, 2, 2, 2, 2, 0]


@pytest.mark.parametrize("language", code.TOP)
def test_odd_texts(language):
    for text in ("", "}", ")]}", "{", "((((", "'", '"', "`${", "`", "/*", "//", "class", "fn", "func (", "export", "import", "if", "for", "type X", "enum {", "r#\"", "@", "@a.", "x =>", "a ? (b) : c => d", "const", "impl", "use", "\\", "é = λ(1)", "class A {", "\u0000", "function f(", "let x: "):
        tree(text, language)
        tree(text * 3 + "\n", language)


def test_time_follows_length():
    began = time.perf_counter()
    for unit in ("f(", "{a(b){", "x => (", "`${", "if (a) ", "'", "a.b", "r#\"", "/*", "\"\"\"", "else if (x) y()\n", "/[", "b'"):
        for language in code.TOP:
            tree(unit * 20_000, language)
    assert time.perf_counter() - began < 90


def test_chunks_of_code(spark):
    text = "import def, { a as b, type C } from 'lib'; import * as ns from './ns'\nexport async function go(a, b) { if (a) { os.exec(a) } } const v = { m() { while (1) w() } }\nlet x = 1; var y = 2\n"
    rows = [("t", "typescript", text), ("d", "typescript", "if (a) " * 5000), ("n", "rust", None), ("e", "java", ""), ("w", "java", "just words"), ("u", None, "x")]
    files = spark.createDataFrame(rows, "file_id string, language string, text string")
    got = code.code_definitions(files).collect()
    assert [(r.file_id, r.start_line, r.end_line, r.kind, r.symbols, r.imports, r.exports, r.calls, r.max_nesting, r.max_loops, r.params, r.has_async) for r in got] == [
        ("t", 2, 2, "export", ["go"], ["lib", "./ns"], ["go"], ["os.exec"], 1, 0, 2, True), ("t", 2, 2, "declaration", ["v"], [], [], ["w"], 1, 1, 0, False), ("t", 3, 3, "declaration", ["x"], [], [], [], 0, 0, 0, False),
    ]
    assert {tuple(x) for x in got[0].refs} == {("go", "def", 2), ("exec", "call", 2), ("lib", "import", 1), ("./ns", "import", 1), ("def", "import", 1), ("a", "import", 1), ("C", "import", 1), ("ns", "import", 1)}
    assert {tuple(x) for x in got[1].refs} == {("v", "def", 2), ("m", "def", 2), ("w", "call", 2)}
    routed = {(r.file_id, r.kind) for r in code.routed_chunks(files).collect()}
    assert ("d", "window") in routed and ("w", "window") in routed


def test_pieces_and_chunks_in_bounded_batches():
    import gc

    import pyarrow as pa

    text = pa.array(["".join(f"# h{k}\n{'x' * 1000}\n" for k in range(2000))] * 6)
    got = list(chunks._pieces(iter([pa.RecordBatch.from_arrays([pa.array(list("abcdef")), text], ["file_id", "text"])]), 6, 2))
    assert sum(b.num_rows for b in got) == 12_000 and max(b.nbytes for b in got) < 2 * chunks.MOST
    assert all(b.schema == got[0].schema for b in got) and got[0].column(5)[1].as_py() == ["h1"]

    def found(file):
        assert not gc.isenabled()
        return [(file, 1, 2, "k", ["s"], "y" * 1_000_000, [], [], ["c"], 1, 0, 2, False, [("s", "def", 1), ("c", "call", 2)])] * 3

    told = list(chunks.told(iter([pa.RecordBatch.from_arrays([pa.array(list("abcdef"))], ["file_id"])]), found))
    assert gc.isenabled() and sum(b.num_rows for b in told) == 18 and max(b.nbytes for b in told) < 2 * chunks.MOST
    assert told[0].column(13)[0].as_py() == [{"symbol": "s", "kind": "def", "line": 1}, {"symbol": "c", "kind": "call", "line": 2}]
