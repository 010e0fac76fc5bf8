import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import handwritten as H
from codeloom.llm import lexers as X
from codeloom.llm import syntax as S

FILE = "file_id long, repo string, file_path string, content string, reason string, n long"
HAND = "import { store } from './store';\n\nexport class Thing {\n  load(items, limit = 5) {\n    let count = 0;\n    // auto generated keys start at one\n    for (const it of items) {\n      store.put(it.key, it);\n    }\n    return count;\n  }\n\n  save(other) {\n    if (other.size > 3) {\n      throw new Error(`bad ${other.name}`);\n    }\n    return other.map((x) => x.id);\n  }\n}\n"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, r, p, c, "clash", 0) for i, (r, p, c) in enumerate(rows)], FILE)
    return {x["file_id"]: x["reason"] for x in H.classify_files(df).collect()}


def test_reasons(spark):
    mini = "!function(e,t){var n={};" + "".join(f"e.a{i}=function(t){{return t&&t.length?t(e[{i}]):null}};" for i in range(60)) + "}(this);"
    table = "var t = [\n" + ",\n".join(str(1000 + i * 7) for i in range(200)) + "\n];\n"
    blob = 'const pack = "' + "QUJDRGVm09+/" * 60 + '";\n'
    getters = "class M {\n" + "".join(f"  get F{i}() {{ return this.f{i}; }}\n  set F{i}(v) {{ this.f{i} = v; }}\n" for i in range(40)) + "}\n"
    lib = "// @license tiny 1.2.3\n// @preserve\n" + HAND.replace("Thing", "Tiny")
    rows = [
        ("a", "src/x.js", HAND), ("a", "src/m.js", mini), ("a", "src/t.js", table), ("a", "src/b.js", blob), ("a", "src/g.js", getters), ("a", "src/h.js", "// Code generated by stubs v1. DO NOT EDIT.\n" + HAND.replace("Thing", "Stub")), ("a", "src/l.js", lib),
        ("a", "node_modules/y/i.js", HAND + "x;"), ("a", "src/vendor_portal/x.js", HAND), ("a", "src/copy.js", HAND.replace("Thing", "Tiny")), ("vendored-libs", "src/x.js", HAND + "\n"), ("codegen-tools", "src/generate_x.js", HAND + "\n\n"),
        ("a", "src/n.js", "// Replaces the auto-generated client we used before.\n" + HAND), ("a", "src/e.js", ""), ("a", "src/null.js", None), (None, None, None), ("a", "obj/Debug/A.g.cs", "class A { }"), ("a", "lib/tiny-1.2.3/src/a.js", HAND.replace("Thing", "Lib")),
        ("a", "src/str.js", HAND + 'const BANNER = "Code generated by this tool. DO NOT EDIT.";\n'), ("a", "src/crlf.js", "\ufeff" + HAND.replace("\n", "\r\n")), ("a", "src/x.js", HAND),
    ]
    r = reasons(spark, rows)
    want = {0: None, 1: "minified", 2: "data", 3: "data", 4: "generated", 5: "generated", 6: "vendored", 7: "vendored", 8: None, 9: "copy", 10: "repository", 11: None, 12: None, 13: None, 14: None, 15: None, 16: "generated", 17: "vendored", 18: None, 19: None, 20: None}
    assert r == want


def test_hand_written_stays(spark):
    assert set(reasons(spark, [("a", f"src/{n}.js", HAND.replace("Thing", n)) for n in ("A", "generated_b", "VendorList")]).values()) == {None}
    assert reasons(spark, []) == {}


def test_heads_of_any_length(spark):
    many, block = "// a line of the licence\n" * 100_000, "/*\n" + " * words of a licence\n" * 60_000 + " */\n"
    rows = [("a", "x.js", many + "// Code generated by stubs v1. DO NOT EDIT.\n" + HAND), ("b", "y.js", block + "// @license tiny 1.2.3\n" + HAND), ("c", "z.js", many + HAND + "// Code generated by x. DO NOT EDIT.\n"), ("d", "w.js", "/* open " + "x\n" * 1000)]
    r = reasons(spark, rows)
    assert (r[0], r[1], r[3]) == ("generated", "vendored", "generated")
    head = H.layout(spark.createDataFrame([(many + block + "#include <x>\n",)], "content string")).first()["head"]
    assert head == many + block


def test_short_copies(spark):
    assert reasons(spark, [("a", "vendor/t/i.js", "export default tiny;\n"), ("b", "src/i.js", "// mine\nexport default  tiny;"), ("b", "src/j.js", "\n"), ("a", "vendor/t/e.js", "")]) == {0: "vendored", 1: "copy", 2: None, 3: "vendored"}


GOOD = {
    "python": ["", "# c\n", "x = {'a': [1, 2]}\n", "def f(a, *, b=1):\n    return f\"{a!r}\"\n", "match x:\n    case 1:\n        pass\n", "async def g():\n    await h()\n"],
    "javascript": ["", HAND, "const a = /[{(]/.test(x) ? `b ${c ? `d ${e}` : 1}` : null\nlet y = a / 2 / b\n", "#!/usr/bin/env node\nfor await (const x of y) {}\n", "var r = a++ + ++b\nif (x) y()\nelse z()\n", "label: for (;;) { break label }\n", "export default async () => { }\nclass A { static #p = 1; get x() { return this.#p } }\n"],
    "typescript": ["interface A<T> extends B { x?: string; f(a: number): void }\nenum E { A = 1, B }\ntype U = 'a' | 'b';\nexport abstract class C<T extends object> implements D { private readonly x: Map<string, number[]> = new Map(); constructor(public y?: number) {} }\ndeclare const q: unique symbol;\nfunction is(x: unknown): x is string { return typeof x === 'string' }\nlet v = <any>x as unknown as T;\n"],
    "java": ["package a.b;\nimport java.util.*;\n@Deprecated(since = \"1\")\npublic final class A<T extends B & C> implements D {\n  enum E { X, Y(1) { void f() {} }; E(int... i) {} }\n  private int[] a = {1, 2}, b[] = new int[3][];\n  public <R> R f(List<? super T> x) throws Ex { for (int i = 0; i < 3; i++) { if (x instanceof String s && i > 0) continue; } return switch (a.length) { case 0 -> null; default -> { yield g(y -> y + 1, () -> { h(); }); } }; }\n  static { init(); }\n}\n", 'class T { String s = """\n  "text" { \n  """; char c = \'{\'; long l = 0x1FL; }'],
    "csharp": ["using System;\nusing X = Y.Z;\nnamespace A.B {\n  [Attr(1)] public class C<T> : D where T : new() {\n    public int P { get; set; } = 5;\n    public int Q => _q;\n    string s = $\"{a}: {b:0.0}\", v = @\"c:\\\"\"x\"; char c = '\\'';\n    void F(ref int? x) { var o = new D { A = 1, B = { 2 } }; var y = x switch { 1 => \"a\", _ => null }; foreach (var i in l) { if (i == 0) continue; } Func<int, int> f = z => { return z; }; switch (x) { case 1: break; default: return; } }\n    enum E { A = 1, B }\n  }\n#region x\n#endregion\n}\n"],
    "go": ['package main\n\nimport (\n\t"fmt"\n\tl "log"\n)\n\ntype T struct {\n\tA string `json:"a"`\n\tB map[string][]int\n}\n\nfunc (t *T) F(x ...int) (n int, err error) {\n\tdefer func() { recover() }()\n\tfor i := range x {\n\t\tch <- i\n\t}\n\tswitch v := y.(type) {\n\tcase int:\n\t}\n\tr := \'{\'\n\treturn\n}\n'],
    "rust": ["#![allow(x)]\nuse a::{b, c};\n/* a /* b */ c */\npub struct S<'a, T: 'a> { x: &'a T }\nimpl<'a> S<'a> {\n  fn f(&mut self) -> Option<u8> { let c = '{'; let r = r#\"a \"b\" {\"#; match x { Some(y) if y > 1 => {} _ => println!(\"{}\", z), } for i in 0..=9 { v.push(i)?; } None }\n}\nmacro_rules! m { ($x:expr) => { $x } }\nstatic A: &str = \"multi\nline\";\n"],
    "php": ["<?php\nnamespace A\\B;\nuse C;\n/** doc */\nfinal class X extends Y implements Z {\n  private ?int $a = 1; const B = 'x';\n  public function f(array $x, int ...$y): ?string { foreach ($x as $k => $v) { $this->a[] = \"v: {$v}\"; } return match(true) { $a > 1 => 'a', default => 'b', }; }\n}\n$f = fn($x) => $x + 1;\n?>\n<b>{ ( text</b>\n<?= $x ?>\n", "plain text { ( without code"],
    "c": ["#include <stdio.h>\n#define M(x) \\\n  ((x) + 1)\nstatic const char *s[] = {\"a\" \"b\", \"{\"};\ntypedef struct { int a; } T;\nunsigned long f(const T *t, int n)\n{\n  for (int i = 0; i < n; i++) { if (t->a) goto out; }\n  do { n--; } while (n);\nout:\n  return (T){1}.a + (int)sizeof(x);\n}\n"],
    "ruby": ["# c\nrequire 'a'\nmodule A\n  class B < C\n    attr_reader :x, :if\n    def f(a, b: 1, *c)\n      return unless a\n      x = if a then 1 else 2 end\n      items.each do |i| puts \"#{i}: {\" end\n      while x do x -= 1 end\n      y = %w[end do]\n      z = /end(/ =~ s ? 1 : 2\n      { a: 1, end: 2 }.map { |k, v| k }\n      s = <<~EOS\n        end { (\n      EOS\n    rescue E => e\n      raise\n    ensure\n      g\n    end\n    def sq(x) = x * x\n  end\nend\n=begin\nend end\n=end\n"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid_files(lang):
    for text in GOOD[lang]:
        assert S.judge(text, lang) is None, (lang, text, S.judge(text, lang))
        assert S.judge("\ufeff" + text.replace("\n", "\r\n"), lang) is None


BAD = {
    "python": ["def f(:\n", "print 'x'\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", "class A:\n"],
    "javascript": [HAND[:150], HAND.replace("}\n", "}}\n", 1), "<<<<<<< a\nx()\n=======\ny()\n>>>>>>> b\n", 'const a = "open;\n', "let x = “a”;\n", "name: build\nsteps:\n  - run: make all\n", '{\n  "a": {"b": 1}\n}\n', "<!DOCTYPE html>\n<html></html>\n", "def f(x):\n    return x\n", "count += \n", "#!/bin/sh\nset -e\nfor f in *.csv; do\n  echo $f\ndone\n"],
    "typescript": ["package a;\nimport java.util.List;\n", "type SessionRow struct {\n\tstore *X\n}\n", "let a: number = ;\n"],
    "java": ["public class A { int x = 1 }", "import logging\n\nclass A:\n    pass\n", "public class A { void f() { return 1 2; } }", "id;label;rate\n0;Asset 1;0.5 EUR\n", "class A { String s = \"open; }", "class A { void f() { /* open } }"],
    "csharp": ["package io.example;\nimport java.util.List;\npublic class A { }", "class A { void F() { x = 1 return; } }", "class A { { }", "from a import b\nx = 1\n"],
    "go": ["package {{ base }}_x\n", "use a::b;\n", "package a\nfunc f( {\n}\n", "package a\nimport (\n\t\"log\n)\n"],
    "rust": ["package a\nimport (\n\t\"log\"\n)\nfunc f() {}\n", "fn f() { let s = \"open; }\n", "impl A \n fn f() {} }", "fn f() { /* /* */ }"],
    "php": ["<?php\nclass A { function f() { return 1 } }", "<?php $a = [1, 2;", "<?php $x = 'open;\n"],
    "c": ["package a\nimport (\n\"x\"\n)\nfunc f() { }\n", "int f() { return 1 }", "int f(int a { return a; }", "#nope\nint x;", "int f() { /* open"],
    "ruby": ["def f\n  x\n", "class A\n  def f\n  end\n", "x = (1\nend\n", "class A:\n    def f(self):\n        pass\n", "puts 'a\n"],
}


@pytest.mark.parametrize("lang", BAD)
def test_broken_files(lang):
    for text in BAD[lang]:
        assert S.judge(text, lang) is not None, (lang, text)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(X.SPECS)), st.integers(8, 90), st.integers(0, 10_000))
def test_pieces_agree_with_the_whole(lang, size, seed):
    r = random.Random(seed)
    lines = ["f(x[1])", "{ a;", "}", "b", "(", ")", "", "c = 1", "// c }", "# d )", "/* open", "close */ y", "s = 'a'", 'x = "q"', '"""', 'r#"raw', '"#', "`", "${", "y = <<~EOS", "EOS", "<<<TXT", "TXT;", '@"verb', "=begin", "=end", "def f", "end", "'" * 3, "%w[a", "]"]
    text = S.prepare(("<?php " if lang == "php" else "") + "\n".join(r.choice(lines) for _ in range(r.randrange(3, 30))), lang)
    whole = S.follow([text], lang)
    parts = X.pieces(text, size)
    assert "".join(parts) == text
    cut = S.follow(parts, lang)
    assert (X.verdict(cut["whole"]) is None) == (X.verdict(whole["whole"]) is None)
    maps = [X.summary(p, lang, X.states(lang, text)) for p in parts]
    left = maps[0]
    for m in maps[1:]:
        left = X.combine(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = X.combine(m, right)
    a, b = left[X.CODE], right[X.CODE]
    assert (X.verdict(a) is None) == (X.verdict(b) is None)
    if not a["unsure"]:
        assert (X.verdict(a) is None) == (X.verdict(whole["whole"]) is None)


EXTENSION = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "csharp": "cs", "go": "go", "rust": "rs", "php": "php", "c": "c", "ruby": "rb"}
MORE = {
    "javascript": ["const a = `x\n${items.map((i) => {\n  return `- ${i}\n`;\n}).join('')}\n`;\nf(a);\n"],
    "python": ['@d\n@e(\n 1)\ndef f():\n    return """\n(\n"""\n\nx = \'a\\\nb\'\nif x:\n    pass\nelse:\n    pass\n', "def f():\n    pass\n\nelse:\n    pass\n"],
    "go": ["// a comment\n// of some lines\n\npackage a\n\nfunc f() {\n}\n"],
}


def test_stretches_agree_with_the_whole(spark):
    """Every file cut to pieces of a few lines that meet in the shuffle gives what it gives in one task."""
    cases = [(g, t) for part in (GOOD, BAD, MORE) for g, ts in part.items() for t in ts]
    df = spark.createDataFrame([(i, "r", f"a.{EXTENSION[g]}", t, "clash", 0) for i, (g, t) in enumerate(cases)], FILE)
    want = {i for i, (g, t) in enumerate(cases) if S.judge(t, g) is not None}
    for piece, stretch in ((40, 1), (25, 3)):
        got = {x["file_id"] for x in S.parse_errors(df, piece, stretch).collect()}
        assert got == want, [(cases[i], S.judge(cases[i][1], cases[i][0])) for i in got ^ want]


def test_operator_with_long_file_and_nulls(spark):
    long_ok = "class A {\n" + "".join(f"  int f{i}(int a) {{ return g(a, \"}}\") + {i}; }}\n" for i in range(12000)) + "}\n"
    rows = [(1, "r", "a.java", long_ok), (2, "r", "b.java", long_ok + "}"), (3, "r", "c.java", None), (4, None, "d.java", ""), (5, "r", None, "x"), (6, "r", "e.txt", "{{"), (7, "r", "f.py", "def f(:\n"), (8, "r", "g.java", long_ok.replace("int f9(int a) {", "int f9(int a) { 1 2;")), (9, "r", "h.java", long_ok[:-2] + "/* open")]
    df = spark.createDataFrame([(i, r, p, c, "clash", 0) for i, r, p, c in rows], FILE)
    assert len(long_ok) > 2 * S.PIECE
    e = S.parse_errors(df)
    assert sorted(x["file_id"] for x in e.collect()) == [2, 7, 8, 9]
    rates = {(x["repo"], x["language"]): (x["n_files"], x["n_errors"]) for x in S.error_rates(df, e).collect()}
    assert rates[("r", "python")] == (1, 1) and rates[(None, "java")] == (1, 0)
    assert S.parse_errors(df.limit(0)).count() == 0


def test_long_literal_across_pieces(spark):
    java = 'class A {\n  String s = """\n' + "    it's # half { of (\n" * 30000 + '    """;\n}\n'
    sharp = 'class A {\n  string s = @"\n' + "    it's # half { of (\n" * 30000 + '    ";\n}\n'
    assert len(java) > 2 * S.PIECE and S.judge(java, "java") is None and S.judge(sharp, "csharp") is None
    rows = [(1, "r", "a.java", java), (2, "r", "b.java", java + "}"), (3, "r", "c.cs", sharp), (4, "r", "d.cs", sharp + "}")]
    df = spark.createDataFrame([(i, r, p, c, "clash", 0) for i, r, p, c in rows], FILE)
    assert sorted(x["file_id"] for x in S.parse_errors(df).collect()) == [2, 4]
