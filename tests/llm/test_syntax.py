"""Grammars against the parsers of the standard library, and hand-made files of the other languages."""

import ast
import json
import random
import tomllib
import warnings

import pytest

from repolith.llm import syntax
from repolith.llm.peg import Grammar

PY = '''"""Doc."""
from __future__ import annotations
import os, re as r
from . import (a, b as c,)

@decorate(x=1)
class K(Base, metaclass=M):
    field: int = 0
    def __init__(self, a, /, b: int = 1, *args, k=None, **kw) -> None:
        self.x, *rest = a if b else c, [i for i in range(9) if i % 2]
        with open(a) as f, b:
            pass
        try:
            async_value = await_it(lambda q, *w: q[1:2, ::3])
        except (A, B) as e:
            raise X from e
        else:
            yield from {**a, "k": {1, 2}}
        finally:
            del a[0], b.c
async def main():
    async for x in y:
        await x
    return not a in b or -1 ** 2 is not None
if (n := 10) > 5: print(f"{n!r:>{w}} {{}}", end="")
elif n: pass
else:
    while True: break
'''
TOML = 'a = 1\n[t."x y".z]\nb = [1, 2,\n 3]\nc = {d = "e", f = 2020-01-02T03:04:05Z}\n[[arr]]\n"q" = \'\'\'m\nn\'\'\'\n'


def truth(parse, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize(("language", "parse", "text"), [("python", ast.parse, PY), ("json", json.loads, json.dumps({"a": [1, -2.5e3, None, {"b": "é\n"}], "c": {}}, indent=1)), ("toml", tomllib.loads, TOML)])
def test_damaged_texts_match_the_library(language, parse, text):
    assert syntax.check(language, text) is None
    random.seed(3)
    wrong = []
    for _ in range(250):
        k = random.randrange(len(text))
        damaged = random.choice([text[:k], text[:k] + text[k + 1 :], text[:k] + random.choice("()[]{}\"':,= \n@") + text[k:]])
        if truth(parse, damaged) != (syntax.check(language, damaged) is None):
            wrong.append(damaged)
    assert len(wrong) <= (10 if language == "python" else 3), wrong[:2]


JS = """#!/usr/bin/env node
import def, { a as b } from './a.js';
import * as ns from "b";
export { x, y as z };
export default class K extends Base { #p = 1; static m() { return this.#p; } get v() { return 1 } async *gen() { yield 1 } constructor(a, ...r) { super(a) } }
const f = async (x = 1, { y, ...z }) => ({ y, [k]: x, m() {}, 'q': 2 });
let t = `a ${b ? `c ${d}` : e} f`, re = /[/"{]+\\/x/g.test(s) / 2
for (const [k, v] of Object.entries(o)) { if (!k) continue; else break }
label: while (i-- > 0) do { x ??= y?.z?.[0] ?? -w } while (false)
switch (n) { case 1: foo(); break; default: bar() }
try { throw new Error(`x`) } catch { } finally { delete a.b, void 0 }
var g = function* () {}, h = a ? b : c ? d : e;
if (a) b()
else if (c) d(); else { e }
"""
TS = """interface A<T extends B = C> extends D, E<F> { a?: string; readonly b: number[]; m(x: T): Promise<Map<string, Array<number>>>; [k: string]: any }
type U = string | { a: number } | ((x: number) => void);
enum Color { Red = 1, Green }
export abstract class S<T> implements A<T> { private readonly x: number = 1; constructor(public y?: string) { super() } get z(): T { return this.y as unknown as T } }
export async function f<T>(a: T, b: number = 2, ...c: string[]): Promise<T> { const d = <T,>(x: T): T => x; return a!; }
declare const q: typeof window;
let n: Record<string, (a: number) => void> = { }
"""
GO = """package main

import (
	"fmt"
	m "math"
)

type T struct {
	A, B int `json:"a"`
	*Embedded
	F func(int) (string, error)
}

type I interface { M(x int) error }

const ( X = iota; Y )

func (t *T) Do(a, b string, rest ...int) (n int, err error) {
	defer func() { recover() }()
	for i := 0; i < 3; i++ { n += i }
	for k, v := range map[string][]int{"a": {1, 2}} { fmt.Println(k, v[1:]) }
	for { break }
	switch x := a.(type) { case int, string: return 1, nil; default: }
	if v, ok := m[k]; ok && !t.z { go f(<-ch) } else if n > 1 { ch <- T{A: 1} } else { select { case <-ch: } }
	var z = []byte("x")
	_ = struct{ a int }{1}
	return
}
"""
RS = """#![allow(x)]
use std::{collections::HashMap, io::{self, Read as R}};
#[derive(Debug)]
pub struct P<'a, T: Clone + 'a> where T: Copy { pub a: &'a T, b: Vec<Option<u8>> }
enum E { A, B(i32, String), C { x: f64 } }
impl<'a, T> P<'a, T> { pub const fn new(a: &'a T) -> Self { Self { a, b: vec![1; 3] } } }
fn f(mut x: i32, (a, b): (u8, u8)) -> Result<(), Box<dyn std::error::Error>> {
    let v: Vec<_> = (0..10).map(|i| i * 2).filter(|&i| i > 1).collect::<Vec<i32>>();
    if let Some(y) = v.get(0) { println!("{} {:?}", y, 'a'); } else { return Err("x".into()); }
    match x { 1 | 2 => {} 3..=5 if a > b => x += 1, E::B(n, _) => (), _ => loop { break } }
    'outer: for i in 0..3 { while i < 2 && b != 0 { continue 'outer; } }
    let s = S { a: 1, ..Default::default() };
    let r = r#"raw "q" "#;
    unsafe { *ptr = x as u8 as char; }
    Ok(())?;
    -x.abs()
}
"""


@pytest.mark.parametrize(("language", "text"), [("javascript", JS), ("typescript", TS), ("typescript", JS), ("go", GO), ("rust", RS)])
def test_valid_files_are_accepted_and_cut_ones_are_not(language, text):
    assert syntax.check(language, text) is None
    cut = text.rstrip()[:-1]
    assert syntax.check(language, cut) is not None


@pytest.mark.parametrize(
    ("language", "text", "cause"),
    [
        ("javascript", "<<<<<<< HEAD\nconst a = 1;\n=======\nconst a = 2;\n>>>>>>> x\n", "conflict"),
        ("javascript", "const a: number = 1;", "other"),
        ("python", "def f(:\n  pass", "truncated"),
        ("python", "def f():\n", "truncated"),
        ("go", 'package main\nfunc f() {\n\tx := g(“a”)\n}\n', "other"),
        ("rust", "fn f() { let x = 1; }\nfn g() {", "truncated"),
        ("typescript", "import os\nimport re\n", "other"),
        ("json", '{"a": 1,}', "other"),
        ("toml", "a = \n", "truncated"), ("toml", "a = b c\n", "other"),
    ],
)
def test_causes(language, text, cause):
    failure = syntax.check(language, text)
    assert failure is not None and failure.cause == cause


def test_ordered_choice_does_not_go_back():
    grammar = Grammar("a <- ('x' / 'x' 'y') 'z'")
    assert grammar.failure("a", "xz") is None and grammar.failure("a", "xyz") == 1


def test_table_keeps_nested_choices_linear():
    grammar = Grammar("a <- '(' a ')' 'x' / '(' a ')' 'y' / '(' a ')' 'z' / 'n'\nfile <- a eof")
    text = "(" * 400 + "n" + ")z" * 400
    assert grammar.failure("file", text) is None
    assert grammar.failure("file", text[:-1]) == len(text) - 1


def test_table_and_rates(spark):
    rows = [("r", "a.py", "x = 1"), ("r", "a.py", "x = 1"), ("r", "b.py", "x = ("), ("r", "c.json", None), ("s", "d.json", ""), ("s", "e.md", "# x"), ("s", "f.json", "[" * 3000), ("s", "g.py", "x = [" + "1, " * 50_000 + "]")]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string")
    found = syntax.failures(df)
    assert {(r.repo_id, r.path) for r in found.where("position is not null").collect()} == {("r", "b.py"), ("s", "f.json")}
    rates = {(r.repo_id, r.language): (r.files, r.invalid) for r in syntax.rates(found).collect()}
    assert rates[("r", "python")] == (2, 1) and rates[(None, None)] == (4, 2)
    assert syntax.failures(df.limit(0)).count() == 0


_UNION = " | ".join(f"{{ kind: 'k{i}'; size: number; }}" for i in range(40))
_BOUNDS = ", ".join(f"T{i} extends Base<T{i}>" for i in range(30))
_STEPS = ".".join(f"step{i}" for i in range(80))


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("typescript", "function pick<T extends object, K extends keyof T, V>(o: T) { return o; }\n"),
        ("typescript", f"export type Event = {_UNION};\n"),
        ("typescript", f"export class Store<{_BOUNDS}> extends Base<T1> {{\n  take(key: string): T1 {{ return this.all[key]; }}\n}}\n"),
        ("typescript", f"function all<{_BOUNDS}>(first: T1, rest: T2): T1 {{ return first; }}\n"),
        ("typescript", f"function made(first: number): Pair<{', '.join(f'A{i}' for i in range(40))}> {{ return first; }}\n"),
        ("rust", f"fn go(x: A) -> u8 {{ match x.{_STEPS} {{ 1 => 2, _ => 3, }} }}\n"),
        ("rust", f"fn go(x: A) {{ if x.{_STEPS} {{ run(); }} }}\n"),
        ("go", f"package a\n\nfunc f() {{\n\tg(func(x int) {'[]' * 14}*b.C {{\n\t\treturn nil\n\t}})\n}}\n"),
    ],
)
def test_long_heads_keep_their_role(language, text):
    assert syntax.check(language, text) is None
    assert syntax.check(language, text.rstrip()[:-1] + "}}") is not None


FSTRINGS = """f"{a b}"|f"{x +}"|f"{foo(}"|f"{a}"|f"{}"|f"{ }"|f"{a!r}"|f"{a!x}"|f"{a=}"|f"{a = !s:>10}"|f"{a:{w}.{p}}"|f"{a:{w +}}"|f"{{a b}}"|f"}"|f"{"|f"{d["k"]}"|f"{', '.join(x for x in y)}"
f"{a if b else c}"|f"{a if b}"|f"{(lambda x: 1)(2)}"|f"{lambda x: 1}"|f"{a != b}"|f"{a == b}"|f"{*a, b}"|f"{x:=5}"|f"{(x:=5)}"|rf"\\d{a}\\{b}"|f"\\N{EM DASH}{a}"|f"{f'{a b}'}"|f"{f'{a}'}"|f"a{b}c" "d" f'{e f}'
f"{[1, 2,,]}"|f"{{1: 2}[1]}"|f"{ {1: 2}[1] }"|f"{a:%H:%M}"|f"{a,}"|f"{,}"|f"{yield}"|f"{x for x in y}"|f"{not}"|f"{a!r:^{w}}"|F"{a)}"|f"{a:}}"|f"{a]}"|f'{a["b"]:x}'|f"{a!r b}\"""".replace("\n", "|").split("|")


@pytest.mark.parametrize("literal", FSTRINGS)
def test_holes_of_fstrings_like_the_standard_parser(literal):
    for text in (f"def f(a):\n    return {literal}\n", f"x = [{literal}, 1]\n"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
                want = True
            except SyntaxError:
                want = False
        assert (syntax.check("python", text) is None) == want, text


@pytest.mark.parametrize("language", ["javascript", "typescript"])
@pytest.mark.parametrize(
    ("hole", "valid"),
    [("a b", False), ("f(", False), ("", False), ("a +", False), ("a", True), ("f({a: {b: {c: {d: 1}}}})", True), ("`x${y}z`", True), ("`x${y z}`", False), ("xs.map((x) => { return `<${x}>`; }).join('')", True), ("a ? '}' : \"`\"", True), ("f(]", False)],
)
def test_holes_of_templates(language, hole, valid):
    assert (syntax.check(language, f"const s = `a${{{hole}}}b`;\nconst t = tag`${{1}}${{{hole}}}`;\n") is None) == valid


def test_template_types_and_plain_templates():
    assert syntax.check("typescript", "type A = `${Uppercase<B>}-${string}`;\nconst a = `$ {x} \\` $`;\n") is None
    assert syntax.check("javascript", "const a = `${b;\n") is not None and syntax.check("javascript", "const a = `b\n") is not None


@pytest.mark.parametrize("text", ["let a = [1 2 3,,];", "v[i +];", "let a = [,];", "let a = [1; 2; 3];", "let a = [x y];"])
def test_rust_brackets_are_read(text):
    assert syntax.check("rust", "fn f() { " + text + " }\n") is not None


def test_rust_brackets_of_all_kinds():
    lines = ["let a = [];", "let a = [1, 2, 3,];", "let a: [u8; 4] = [0; N];", "let b: &[&'static str] = &x[1..];", "let [x, .., y] = z;", "if let [first, rest @ ..] = v { f(); }", "let c: [Box<dyn Fn()>; 3] = d;", "match v { [Some(a), None] => 1, [1..=5, _] => 2, [] => 3, _ => 4, };", "let e = m[&k][i + 1];", "let g = [[0u8; 2]; 3];", "let h = [|x| x + 1, f];"]
    text = '#![allow(dead_code)]\nuse a::b;\n#[derive(Debug, Clone)]\n#[cfg(any(unix, feature = "x"))]\nstruct A { #[serde(rename = "b")] b: Vec<[u8; 2]> }\nfn f() {\n' + "\n".join(lines) + "\n}\n"
    assert syntax.check("rust", text) is None


VALID = {
    'typescript': [
        'function f(): void { }',
        'class A { foo(): void { } }',
        "function f(): { a: string } { return {a: ''}; }",
        'function g(x: any): x is string { return true; }',
        'function h(this: Foo, a?: number): asserts a is number { }',
        "@Injectable() export class A { @Input() x: string; constructor(@Inject(T) private readonly y: T) {} @Get('a') m() {} }",
        "declare module 'x' { export const a: number; }",
        'namespace A.B { export type C = 1; }',
        "type T = 's0' | 's1' | 's2' | 's3' | { a: string; b?: number }",
        'let x = <any>y;',
        'const f = async <T,>(x: T): Promise<T> => x;',
        'abstract class A { abstract m(): void; protected abstract readonly x: string; static #p = 1; }',
        'export default interface Foo { a: string }',
        'type M<T> = { readonly [K in keyof T]?: T[K] };',
        'type M<T> = { -readonly [K in keyof T]-?: T[K] };',
        'type C = A extends (infer U)[] ? U : never;',
        'let v = a as const satisfies B;',
        "enum E { A = 1 << 2, B = 'x', C }",
        'declare global { interface Window { a: string } }',
        "import type { A, type B } from './a';",
        "export type { A } from './b';",
        "export * as ns from 'x';",
        "import fs = require('fs');",
        'let t: [a: string, b?: number, ...rest: string[]] = x;',
        'for (const [k, v] of Object.entries(x) as [string, number][]) { }',
        'const x = y!.z![0]!;',
        'type F = new (...args: any[]) => object;',
        'function o(a: string): string;\nfunction o(a: any) { return a; }',
        'let a = b ? (c) : d;',
        'let a = b ? (c, d) : e => f;',
        'type G = Array<Array<number>>;',
        'let u: unique symbol;',
        'class A<T = {}> extends B<T> implements C, D<E> {}',
        'const a = { get x() { return 1 }, set x(v) {}, async *[k]() {}, get: 1, set, async };',
        'label: for (;;) { continue label }',
        "type A = typeof import('./x');",
        "let x: import('y').Z<string>;",
        'if (a < b && c > d) {}',
        'f<number>(1); new Map<string, number[]>();',
        'type X = `${A}-b`;',
        'export abstract class Q { }',
        'export declare const z: number;',
        'type Fn = { (a: number): string; new (b: string): Fn; readonly [k: string]: any; m?(): void };',
        'let x = a < b ? 1 : 2;',
        'const fn = function* <T>(this: Window, x: T): Generator<T> { yield* x; };',
        'class A { declare x: string; override m(): void {} static { init(); } get(): number { return 1 } static async *gen() {} }',
        'try { } catch (e: unknown) { }',
        'x ??= y; a ||= b; c **= 2;',
        'let big = 1_000n, o = 0b11;',
        'export const enum E { A }',
        'type A = abstract new () => void;',
        'let f = (a: number, ...r: string[]): a is 3 => true;',
        "import x, * as y from 'z';",
        "import a from 'a' with { type: 'json' };",
        'var a = function() {}\n(function(){})()',
        "let n = { ...a, b, 'c-d': 1, [e]: 2, 3: 4 };",
        'const {a, b: {c = 1} = {}, ...d} = e, [f,, g = 2] = h;',
    ],
    'go': [
        'package a\nfunc f() {\nL:\n\tfor { break L }\n}',
        'package a\ntype S[T any, K comparable] struct { A T; b map[K]*T `json:"x"` }',
        'package a\nfunc (s *S[T]) M(a ...int) (<-chan int, error) { return nil, nil }',
        'package a\ntype I interface { ~int | ~string; M() }',
        'package a\nfunc f() { if x := (T{1}); x.a { } ; if v == (T{}) {} ; for _, x := range []int{1,2} { _ = x } ; switch x := y.(type) { case nil, []int: default: } }',
        'package a\nvar x = map[string][]T{"a": {{1}, {2}}}',
        'package a\nvar f = func(a, b int) int { return a + b }',
        'package a\nfunc f[T any](x T) { g[int, string](x); y := []T{x}[0:1:2]; go func() {}(); defer a.b() }',
        'package a\nconst (\n\tA = iota\n\tB\n)\n',
        'package a\nfunc f() { select { case x := <-c: case c <- 1: default: }; goto L; L: }',
        'package a\nfunc f() { for i, j := 0, 1; i < j; i, j = i+1, j-1 {} }',
        'package a\nimport (\n\t_ "a"\n\t. "b"\n\tc "d"\n)\n',
        'package a\nfunc f() { if err := g(); err != nil { return } else if x { } else { } }',
        "package a\nvar a, b = 1, 'x'",
        'package a\nvar c chan<- int',
        'package a\nfunc f() { x := struct{ a int }{1}; y := &T{}; z := [...]int{1: 2}; _ = x; a[i], b.c = 1, 2; *p = 3; p++ }',
        'package a\nfunc f() { switch { case a > b: x() ; fallthrough; case c: } }',
        'package a\nfunc f() { for range ch {} ; for k := range m {} }',
        'package a\ntype T = map[string]interface{}',
        'package a\ntype F func(int, ...string) (a, b error)',
        'package a\nfunc f() { v, ok := <-ch; v, ok = m[k]; _ = x.(int) }',
        'package a\nfunc f() { if _, ok := x.(interface{ Y() }); ok { } }',
    ],
    'rust': [
        'fn f() { let c = |x: i32| -> i32 { x + 1 }; }',
        'macro_rules! m { ($x:expr) => { $x + 1 }; }',
        "fn f<T: ?Sized + 'static, const N: usize>(x: &mut [T; N]) -> impl Fn(u8) -> bool + '_ where T: Clone, for<'a> F: Fn(&'a T) { todo!() }",
        'async fn f() { x.await?; async move { 1 }.await; }',
        'pub(crate) struct A(pub u8, String);',
        'impl<T> From<T> for A<T> where T: X { type Y = Z; const C: u8 = 1; fn f(self: Box<Self>) {} }',
        'extern "C" { fn a(x: *const u8); }',
        'fn f() { if let Some(x) = y && z > 1 { } while let Ok(Some(v)) = it.next() {} let Some(q) = w else { return; }; }',
        'fn f() { let a = if b { 1 } else { 2 }; match x { A | B if c => {} D { a, .. } => 1, (1, _) => { 2 } ref r @ 1..=3 => (), &[a, ..] => (), _ => unreachable!(), } }',
        'fn f() { a.b::<C>().d; <T as X>::y(); Vec::<u8>::new(); x as usize < 3; }',
        'use a::{self, b::{c as d, *}}; pub use ::e;',
        "fn f() { loop { break 'a 1; } 'a: { break 'a; } }",
        '#[derive(A)] enum E { #[x] A = 1, B { a: u8 }, C(u8) }',
        'fn f() -> Result<(), Box<dyn Error + Send>> { Ok(()) }',
        'trait T: A + B { type X: C; fn f(&self) -> u8 { 1 } fn g(); }',
        'const X: &[&str] = &["a"]; static mut Y: u8 = 1;',
        'fn f() { let x = S { a, b: 1, ..s }; x.0.1 = 2; x[..3]; y[1..]; (a, b) = c; &mut *x; !a; -1i32; }',
        'unsafe impl Send for A {} unsafe fn g() { unsafe { h() } }',
        'fn f() { return; }',
        'mod a { //! doc\n use super::*; #[test] fn t() { assert_eq!(1, 1, "x"); } }',
        "fn f() { let f: fn(u8) -> u8 = g; let b: Box<dyn FnMut() + 'a>; let t: (u8,) = (1,); }",
        'fn f() { vec![1, 2].iter().map(|&(a, ref b)| a).collect::<Vec<_>>() }',
        'fn f() { if x == (S { a: 1 }) {} }',
        'fn f() { match self { Self::A => 1, } }',
        '/* a /* b */ c */ fn f() {}',
        'fn f() { x.iter().filter(|x| **x > 1 && x.len() >= 2 || y).count(); }',
        'fn f() { let v = vec![0u8; 3]; println!("{}", v[0]); return Err(anyhow!("x")); }',
    ],
    'python': [
        "match x:\n  case [1, *r] if r: pass\n  case {'a': 1, **k}: pass\n  case A.B(x, y=2) | None as z: pass\n  case -1+2j: pass\n  case (1, 2), 'a' 'b': pass\n  case _: pass\n",
        'type X = int\n',
        'type X[T: int, *U, **P] = list[T]\n',
        'with (open(a) as f, open(b) as g):\n  pass\n',
        'with (open(a)) as f: pass\n',
        'with (a, b): pass\n',
        'def f[T](a: T, /, b=1, *, c, d=2, **k) -> T: ...\n',
        'class A[T](B, metaclass=C): pass\n',
        'match = 1; case = 2; type = 3; print(match, type(x))\n',
        'try: pass\nexcept* A as e: pass\n',
        'async def f():\n  async with a as b, c: pass\n  return [x async for x in y if await z]\n',
        'x: int = 1; a.b: str; (c): int = 2\n',
        'lambda a, /, b=1, *c, d, **e: (yield)\n',
        'f(a, *b, c=1, *d, **e)\n',
        'f(x for x in y)\n',
        'f(x, (y for y in z), k=1,)\n',
        'a, *b = c = d\n',
        'del a, (b, c), d[0]\n',
        "print(*a, sep='')\n",
        'a[1:2, ::3, *b]\n',
        'x = yield\n',
        'for x, in y: pass\nelse: pass\n',
        '@a.b(c)\n@d\nclass E: pass\n',
        'a = b if c else d if e else f\n',
        'assert a, b\n',
        'raise A from B\n',
        'from . import (a as b, c,)\n',
        'from .a.b import *\n',
        "{**a, 'b': 1}; {*a, b}; {k: v for k, v in x}; {x for x in y}\n",
        'if (n := f()) > 1: pass\n',
        'f(a := 1)\n',
        'x = not a == b\n',
        'global a, b\n',
        "b'a' b'b'\n",
        'match(x)\nmatch[0]\nmatch.a = 1\n',
        'nonlocal_ = 1;\n',
        'a = (yield x)\n',
        'return\n',
        'while True: break\n',
        'x = [*a, *b]\n',
        'def f(*, a): pass\n',
        "def f(a, *args: int, b: str = 'x'): pass\n",
        'f(**a, b=1)\n',
        'print(x, file=y)\n',
        'with a: pass\n',
        'pass\n',
        'x = 1 if a else lambda: 2\n',
        'not_ = a is not b not in c\n',
    ],
}
INVALID = {
    'python': [
        'f(a=1, b)\n',
        '1 = x\n',
        'f() = 1\n',
        'del f()\n',
        'def f(a=1, b): pass\n',
        'def f(*): pass\n',
        'a := 1\n',
        "'a' b'c'\n",
        'f(**a, *b)\n',
        '(*a)\n',
        'x = (a for b)\n',
        'lambda *: 1\n',
        'for f() in x: pass\n',
        'a + 1 += 2\n',
        'def f(a, **k, b): pass\n',
        'match x:\n  pass\n',
        'with a as f(): pass\n',
        'a b\n',
        'import a.b as c.d\n',
        'from a import b, \n',
        'class A(x for x in y:\n',
        'x = {1: 2, 3}\n',
        'a, b += 1\n',
        '[*a for a in b]\n',
        'f(a for a in b, c)\n',
        'not = 1\n',
        '1 + = 2\n',
        'if x = 1: pass\n',
        'else: pass\n',
        'try: pass\n',
        'def f():\npass\n',
        '  x = 1\n',
        'if a:\n    b\n  c\n',
        'x = [1, 2\n',
        '@a\nx = 1\n',
        'a = yield = b\n',
        "print 'x'\n",
        'except: pass\n',
        "f'{a b}'\n",
    ],
    'javascript': [
        'return 1;',
        'a?.b ?? c || d',
        'const f = () => {} foo',
        'const a = 1; const b = 2; const c = 3;\nconst f = () => {} foo',
        'let d = function () {} let e = 4;',
        'const a = 1; const b = 2; const c = 3; let d = function () {} let e = 4;',
        'a + b = c',
        'f() = 1',
        'const a;',
        'if (a) b() else c',
        'let x = ;',
        '{ a: 1, b: 2 }',
        'for (let i = 0; i < 3) {}',
        'class A { x y }',
        "import { a from 'b'",
        'a => { return } b',
        'x y',
        'new',
        'switch (a) { foo() }',
        'try { }',
        '`a ${ b',
        '-a ** b ** c d',
        'const a: number = 1;',
        'interface A { }',
        'function (a) { }',
        'if (x) { return 1 }',
        'function f() { return 1 }}',
    ],
    'typescript': [
        'return 1;',
        'let x: = 1;',
        'type A = ;',
        'interface { a: string }',
        'class A { foo(): { }',
        'function f(a: string: number) {}',
        'enum A { B: 1 }',
    ],
    'go': [
        'package a\nfunc f() { x := }',
        'package a\nfunc f( { }',
        'package a\nfunc f() { if x { } else y }',
        'package a\nvar x int = ',
        'package a\nfunc f() { a.b := 1 }',
        'package a\nimport "a" "b"',
        'package a\nx := 1',
        'package a\nfunc f() { for i := 0; i < 1 { } }',
        'package a\ntype T struct { a int, b int }',
        'package a\nfunc f() { x = [3]int{1, 2\n} }',
    ],
    'rust': [
        'fn f() { let x = 1 }',
        'fn f( { }',
        'struct A { a u8 }',
        'fn f() { if x { } else y }',
        'fn f() { match x { 1 => } }',
        'let x = 1;',
        'fn f() -> { }',
        'fn f() { x y }',
        'impl A for { }',
        'use a::;',
    ],
}

# statements of each language that change nothing in front of others
BEFORE = {"python": "import os\nx = [1, 2]\n", "javascript": "const q1 = 1; const q2 = (a) => { a(); };\n", "typescript": "const q1: number = 1;\ntype Q = { a: string };\n", "go": "package a\nvar q1 = 1\nfunc q2() { q1++ }\n", "rust": "fn q1() { let a = 1; }\nstruct Q { a: u8 }\n"}


@pytest.mark.parametrize("language", VALID)
def test_valid_texts(language):
    assert [t for t in VALID[language] if syntax.check(language, t) is not None] == []


@pytest.mark.parametrize("language", INVALID)
def test_invalid_texts(language):
    assert [t for t in INVALID[language] if syntax.check(language, t) is None] == []


@pytest.mark.parametrize("language", BEFORE)
def test_verdicts_do_not_depend_on_what_stands_before(language):
    for known, texts in ((True, VALID.get(language, [])), (False, INVALID[language])):
        for text in texts:
            body = text.removeprefix("package a\n") if language == "go" else text
            if language == "go" and body.startswith("import"):
                continue
            for times in (1, 7):
                before = BEFORE[language]
                longer = before + before.removeprefix("package a\n") * (times - 1) + body
                assert (syntax.check(language, longer) is None) == known, longer


def test_python_texts_like_the_standard_parser():
    for text in VALID["python"] + INVALID["python"]:
        assert truth(ast.parse, text) == (syntax.check("python", text) is None), text
