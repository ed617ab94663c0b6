from __future__ import annotations

import ast

import pytest

from codestrata.llm.peg.documentation import documentation_of, informative
from codestrata.llm.peg.engine import Grammar
from codestrata.llm.peg.languages import EXTENSIONS, normalise, parse_file
from codestrata.llm.source_text import checked_files, documented_functions, parse_rates

GOOD = {
    "go": """package p

import ("fmt"; x "a/b")

type T[K comparable, V any] struct { a, b int `json:"a"`; *E }
type I interface { M(a int) (int, error); ~int | string }
const ( A = iota; B )
func (t *T[K, V]) M(xs ...int) (n int, err error) {
	if v, ok := m[K{1}.x]; ok && v > 0 { return } else if x := 1; x < 2 { goto L }
	switch y := z.(type) { case int, []string: fallthrough; default: }
L:
	for i, v := range xs { go func() { ch <- v }() ; _ = i }
	select { case x := <-ch: f(x...) ; default: }
	a := map[string][]int{"a": {1, 2}, `b`: nil}
	defer f(struct{}{}, [...]int{1}, func(int) {}, a[1:2:3], <-ch, 'x', '\\n', 0x1p-2, 1_000i)
	return n << 2 &^ 1, nil
}
""",
    "python": "@d\nasync def f(a, /, b: int = 1, *c, d=2, **e) -> 'x':\n    async with a as b, c: pass\n    return [x async for x in y if x]\n"
    "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case P(a=1) | None: pass\ntry:\n    raise X from e\nexcept* E as e: ...\n"
    "x: int = (yield)\na, *b = c = lambda *a, k=1: a[1:2, ::3]\nprint(f'{x!r:>{w}}' 'y', end='')\nif (n := 1) > 0 < 3 is not None: del a[0], b.c\ntype A[T] = list[T]\n",
    "javascript": "import a, { b as c } from './x.js';\nexport default class extends B { #p = 1; static { f(); } get x() { return this.#p } async *g() { yield* h; } }\n"
    "const { a: [d = 1, ...e], ...r } = o ?? {};\nlabel: for (const k of m) { if (!k) continue label; else break }\nlet q = a ? b : c => ({ [k]: 1, m() {}, get z() { return 1 } });\n"
    "const t = tag`a${`b${1}`}c`, re = /[/\\]]+/giu, n = 1_0n ** 2n;\nawait f?.(x)?.[0]\ndo x++; while (x < 1)\ntry { throw e } catch { } finally { }\nvar v = a / b / c, w = new X, y = new.target\nexport * as ns from 'y'\n",
    "typescript": "import type { T } from './t';\nenum E { A = 1, B }\nabstract class C<T extends object = {}> extends D<T> implements I { private readonly x?: number = 1; constructor(public a: string) { super() } abstract f(): void; get y(): T { return this.z! as T } [k: string]: any }\n"
    "type M = { readonly [K in keyof T]?: T[K] } & (A | B)[] | `a${string}`;\ninterface I { (x: number): string; new (): I; m?(): void }\nfunction over(x: string): void;\nfunction over<T>(this: W, x: T, ...r: any[]): asserts x is T { const f = <U,>(u: U): u is U => true; g<string>(x satisfies T) }\n"
    "declare module 'm' { export const c: typeof import('q').d }\nnamespace N.M { export let z: [a: string, b?: number] }\nlet u = <any>v;\n",
    "shell": "#!/bin/bash\nset -e\nf() { local a=(1 2) b=${x:-$(ls | wc -l)}; }\nfunction g { cat <<'EOT' | tr a b\nit's ( {\nEOT\n}\nif [[ $a =~ ^(x|y)+$ && ! -f $b ]]; then :; elif ((i++ < 3)); then f; else g; fi\n"
    "for i in {1..3} \"$@\"; do echo $i; done > out 2>&1 &\nfor ((i=0;i<3;i++)); do :; done\nwhile read -r l; do case $l in a|b) f ;; (*) g ;& esac; done < <(ls)\nx=$'a\\'b' y=`date` z=\"it's ${q#'} $((1+2))\"; [ a = b ] || { f; }\n",
    "rust": "//! doc\n#![allow(x)]\nuse a::{self, b::*, c as d};\npub(crate) struct S<'a, T: 'a + ?Sized>(&'a T) where T: Fn(u8) -> u8;\nimpl<'a, T> Tr<T> for S<'a, T> where T: Clone { const N: usize = 1; type O = Vec<T>; fn f(&mut self, (a, _): (u8, u8)) -> impl Iterator<Item = u8> + '_ { (0..=9).map(move |x| x as u8) } }\n"
    "fn main() { let Some(x) = y else { return }; let s = S { a: 1, ..z }; match x { 1..=5 | 7 if a => {} Foo::B { c, .. } => return, ref r @ _ => loop { break 'l 1 } } if let Ok(v) = f::<u8>(b'x', r#\"raw \" {\"#) && v > 1 { } 'l: for i in 0..n { s.0[i]? .await; } vec![1, 2]; unsafe { *p = !1 } let c = |a: u8| -> u8 { a }; /* a /* b */ c */ }\nmacro_rules! m { ($x:expr) => { $x }; }\n",
    "ruby": "require 'x'\nmodule A; class B < C::D\n  attr_reader :a, :b?\n  CONST = %w[a b].freeze\n  def self.f(a, b = 1, *c, d:, e: 2, **g, &h) = a + b\n  def m(x)\n    return if x.nil? && y\n    s = <<~EOS\n      it's #{x\n    EOS\n    h = { a: 1, 'b' => 2, **z }\n    xs.map { |a, (b, c)| a }.each_with_index do |v, i|\n      puts \"#{v} #{h['k']}\" unless v =~ /a#{i}[\\/]/i\n    end\n"
    "    case x when 1, 2 then a else b end\n    begin; f x, y: 1; rescue E => e then retry ensure g end\n    a, *b = *c\n    while true do break end\n    x ? y : z\n    @a ||= ->(q) { q ** 2 }\n    case v in {n: Integer => k, t: [*, 1]} if k then k end\n    yield x, *y if block_given?\n  end\nend; end\n",
}
BAD = {
    "go": ["package p\nfunc f( {\n}\n", "package p\nvar x = \n", "", "package p\n<<<<<<< HEAD\n", "package p\nfunc f() { /* open\n}\n", "package p\nfunc f() { x := `a\n}\n"],
    "python": ["def f(:\n pass", "x = = 1", "if x:\npass", "  x = 1", "f(1 = 2)", "'''open", "print 'x'", "a = 1\n  b = 2\n", "x = (1\n", "for x in\n  y: pass", "f() = 1", 'def f():\n    """open\n    a "\n', "x = \n"],
    "javascript": ["function (", "let x: number = 1;", "{ \"a\": 1, \"b\": 2 }", "const = 1", "if (x { }", "x = `a${`", "a b", "export { a", "class A { f( { } }", "import a from", "/* open"],
    "typescript": ["let x: = 1;", "interface {", "class A { f(): { }", "type A =", "enum E { A"],
    "shell": ["if x; then", "f() {", "case x in a) b", "echo 'x", "echo \"$(ls\"", "<<<<<<< a", "for i in a; do", "x=(1", "fi", "{ }"],
    "rust": ["fn f( {}", "let x = 1;", "struct S { a u8 }", "fn f() { let x = ; }", "fn f() { \"open }", "impl {", "fn f() { a b }", "/* open /* */"],
    "ruby": ["def f(", "class a\nend", "if x\n", "x = [1, 2", "puts \"#{x", "def f\n", "end", "x = <<~E\n a\n", "def f(a:\nend"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_text(lang):
    got = parse_file(lang, GOOD[lang])
    assert got.ok, (got.line, got.column, got.cause)
    assert parse_file(lang, "\ufeff" + GOOD[lang].replace("\n", "\r\n")).ok


@pytest.mark.parametrize("lang", sorted(BAD))
def test_invalid_text(lang):
    assert [b for b in BAD[lang] if parse_file(lang, b).ok] == []


def test_every_cut_of_a_python_file_agrees_with_the_interpreter():
    text = GOOD["python"]
    for k in range(0, len(text), 7):
        try:
            ast.parse(text[:k])
            good = True
        except SyntaxError:
            good = False
        assert parse_file("python", text[:k], explain=False).ok == good, text[:k][-40:]


def test_engine_reports_the_furthest_failure_and_takes_back_captures():
    g = Grammar('File <- A "x" | A "y" "z"\nA{a} <- `a+`\n', r"\s*")
    assert g.parse("aa y z").captures == (("a", 0, 3),)
    assert not g.parse("aa y w").ok and g.furthest("aa y w") == 5


def test_deep_nesting_and_long_texts_do_not_crash():
    assert parse_file("python", "x = " + "(" * 200 + "1" + ")" * 200 + "\n").ok
    parse_file("javascript", "[" * 50_000, explain=False)
    assert parse_file("go", "package p\n" + "var x = 1\n" * 20_000).ok


FILES = "source_id long, repo_id long, path string, content string, lang string, ok string"


def test_causes_rates_and_nulls(spark):
    rows = [
        (1, 1, "a.go", "package p\nfunc f() {\n<<<<<<< HEAD\n}\n"), (2, 1, "b.go", "package p\nfunc f() {\n"), (3, 1, "c.go", "def f(x):\n    return x\n"),
        (4, 1, "d.go", "package p\n"), (5, 2, "e.py", ""), (6, 2, "f.md", "# {"), (7, 2, "g.py", None), (8, None, "h.rb", "end end"), (9, 2, None, "x"), (10, 9, "i.PY", "("),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FILES)
    got = {r.source_id: (r.ok, r.cause) for r in checked_files(df).collect()}
    assert got == {
        1: (False, "conflict"), 2: (False, "truncated"), 3: (False, "extension"), 4: (True, ""), 5: (True, ""), 8: (False, "syntax"),
    }
    repos = spark.createDataFrame([(1, 7, 10, "x"), (1, 7, 10, "x")], "repo_id long, parse_errors int, supported_seen int, lang string")
    rates = {(r.repo_id, r.lang): (r.files, r.unparsable, r.conflicts, r.parse_errors) for r in parse_rates(df, repos).collect()}
    assert rates[1, "go"] == (4, 3, 1, 7) and rates[None, "ruby"] == (1, 1, 0, None)
    empty = spark.createDataFrame([], FILES)
    assert checked_files(empty).count() == 0 and documented_functions(empty).count() == 0


def pairs(lang, text):
    norm = normalise(text)
    out = []
    for d in parse_file(lang, text).definitions:
        raw = documentation_of(lang, norm, d)
        if raw and informative(lang, d.name, raw):
            out.append(d.path)
    return out


def test_pairs_by_language():
    assert pairs("go", "package p\n\n// Adds two numbers.\nfunc Add(a, b int) int { return a }\n\n// far away\n\nfunc Gone() {}\n\n/* Sums it\nup. */\n//go:noinline\nfunc (t *T[K]) Sum() {}\n// Sum.\nfunc sum() {}\n// says much\nfunc Body()\n") == ["Add", "T.Sum"]
    assert pairs("python", "class A:\n    def f(self):\n        r'''Reads it.'''\n        def g():\n            'inner words'\n    async def h(self): 'one line'; x = 1\n# not a docstring\ndef i():\n    x = 1\n    'late'\ndef j():\n    f'no'\ndef k():\n    '''TODO: later\n    @param x y\n    the k.'''\n") == ["A.f", "A.f.g", "A.h"]
    assert pairs("javascript", "/** Opens it. */\nexport default function open2() {}\n/** lost */\nconst x = 1;\nfunction bare() {}\nclass C {\n  /** Closes the thing. */\n  static async close(a) { /** no */ }\n}\n/** An arrow does. */\nexport const go = (a) => { return a; };\n/** expression */\nconst no = (a) => a;\n/* plain */\nfunction p() {}\nif (x) { /** inner words */ const q = () => { }; }\nconst s = '/** text */ function z() {}';\n") == ["open2", "C.close", "go"]
    assert pairs("typescript", "/**\n * Sends `x` out.\n * @param x it\n */\nasync function send(x: string): Promise<void> {}\n/** only a signature */\nfunction sig(): void;\n/**\n * @returns x\n */\nfunction tags() {}\n") == ["send"]
    assert pairs("rust", "/// Saves bytes.\n#[inline]\npub(crate) fn save() {}\nimpl<'a> Tr for Foo<'a> {\n    #[x]\n    /// Loads bytes.\n    fn load(&self) {}\n    // plain\n    fn plain(&self) {}\n    /// declared\n    fn decl(&self);\n}\n//// four\nfn four() {}\n") == ["save", "Foo.load"]
    assert pairs("ruby", "# Walks every node.\nclass A\n  # Finds a thing\n  # fast.\n  def self.find(x)\n  end\n  # no\n\n  def gone; end\n  # FIXME soon\n  def fix?; end\nend\n") == ["A.find"]
    assert pairs("shell", "#!/bin/bash\nf() { :; }\n# Packs it up.\nfunction pack_up {\n  # inner words\n  inner() { :; }\n}\n# pack up the\npack_up() { :; }\n") == ["pack_up", "pack_up.inner"]


def test_documentation_behind_decorators_and_modifiers():
    many = "class A {\n  /** Sends it off. */\n  @Post({\n    path: ')',\n  })\n  @Log()\n  public async send() {}\n  @Log() /** Reads one row. */\n  read() {}\n}\n"
    assert pairs("typescript", many) == ["A.send", "A.read"]
    assert pairs("javascript", "/** Far words. */\n" + " " * 2_000 + "export  \n async function f() {}\n") == ["f"]


def test_order_of_parameters_and_arguments():
    for bad in ("def f(a=1, b): pass", "def f(*): pass", "def f(**k, a): pass", "def f(/, a): pass", "g(x=1, y)", "g(**k, *a)", "g(**k, a)", "g(x for x in y, 1)", "f = lambda a=1, b: 0", "def f(*a, *b): pass"):
        assert not parse_file("python", bad + "\n").ok, bad
    for good in ("def f(a, b=1, /, c=2, *, d, e=3, **k): pass", "def f(a, /, b, *c: int, d, **k,): pass", "def f(*, a): pass", "g(*a, b, *c, k=1, *d, **e, z=2)", "g(x for x in y)", "g(a, **k, b=1,)",
                 "f = lambda a, b=1, *c, d, **e: 0", "f = lambda *, a: a", "class A(B, metaclass=M, **k): pass", "g(a == b, c := 1)", "def f(a, b=1, *, c, d=2, e): pass"):
        assert parse_file("python", good + "\n").ok, good


GOOD_FORMATS = r"""
f'{x:=10}'
f'{x!r:>{w}}'
f'{x = }'
f'{{}}'
f'{x:{y:{z}}}'
f'{a["b"]}'
f'{a['b']}'
f'{"\n".join(x)}'
f'{x:%H:%M}'
f'{*a, b}'
f'{a!=b}'
rf'\d{x}'
fr'{x}' 'plain' f"{y}"
f'\N{DASH} {x}'
f''
f"" ""
f"{(lambda x: 1)}"
F'{ {1: 2}[1] }'
f'{x:}'
"""
BAD_FORMATS = r"""
f'{a b}'
f'{}'
f'{x!z}'
f'}'
f'{x'
f'{x:{y}'
f'{1 +}'
f'{x:}}'
f'{for}'
"""


def test_fields_of_format_strings():
    for good in GOOD_FORMATS.strip().split("\n"):
        assert parse_file("python", f"v = {good}\n").ok, good
    assert parse_file("python", 'v = f"""{\nx\n} "q" \\n""" f\'\'\'{x:%Y\n}\'\'\'\n').ok
    for bad in BAD_FORMATS.strip().split("\n"):
        assert not parse_file("python", f"v = {bad}\n").ok, bad


def test_short_expressions_do_not_hide_errors():
    for bad in ("f(a.class)", "x = a b", "f(a.)", "f(1.x)", "f(if)", "x = y = 1 = z"):
        assert not parse_file("python", bad + "\n").ok, bad
    for good in ("f(a.b, None, 1)", "x = {a: b, **c}", "x: int = y", "f(x=y, z=w.v)", "x[a:b]", "a = b == c", "lambda: x"):
        assert parse_file("python", good + "\n").ok, good
    for bad in ("f(a..b);", "f(class);", "let x = 01;", "f('a\n');"):
        assert not parse_file("javascript", bad).ok, bad


def test_informative():
    assert not informative("go", "parseHTTPBody", "// ParseHTTPBody: parse the HTTP body.")
    assert informative("go", "parseBody", "// parses it")
    assert not informative("python", "x", " \n - ===\n")
    assert informative("ruby", "x", "# 古い")


def test_all_extensions_have_a_grammar():
    for lang in set(EXTENSIONS.values()):
        parse_file(lang, "")
