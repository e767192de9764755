"""Imports of JavaScript and TypeScript sources, JSX included."""

import pytest

from auditlake.functions.imports import imports
from auditlake.functions.javascript import Unparsed, tokens, unquoted


def found(source, path="a.tsx"):
    return [(k, s) for k, s, _ in imports(source, path)[0]]


@pytest.mark.parametrize(
    "element",
    [
        "<p>don't</p>", '<p>"half</p>', "<p>`tick ${no}</p>".replace("{no}", "(no)"), "<p>/* no comment // none</p>", "<p>it's <b>bob's</b> isn't</p>", "<>fragment's</>", "<main />",
        "<a href='x\"y' title=\"it's\ntwo lines\">text</a>", "<a b={'}'} {...rest} c=<i>it's</i> d>{/* it's */}</a>", "<a.b.c x:y='1' data-z={a < b}>{list.map(x => <li key={x}>{x}'s</li>)}</a.b.c>",
        "<p>{cond ? <b>it's</b> : <i>'</i>}</p>", "<p>{`a ${<b>it's</b>} c`}</p>", "<p>{{a: 1}.a}</p>", "<p>{}</p>", "<p>import z from './z'</p>", "<p>{/it's/.test(x)}</p>", "< p >it's</ p >",
        "<x-y aria-label='q'>&gt; it's</x-y>", "<A b={<C d={<E>'</E>}>'</C>}>'</A>",
    ],
)
@pytest.mark.parametrize("path", ["a.tsx", "a.jsx"])
def test_elements(element, path):
    source = f"import a from './a';\nconst v = {element};\nfunction f() {{ return {element} }}\nimport b from './b'"
    assert found(source, path) == [("static", "./a"), ("static", "./b")]
    with pytest.raises(Unparsed):
        imports(source, "a.js")


def test_imports_in_containers():
    source = "const v = <p a={require('./a')} {...require('./b')}>it's {lazy(() => import('./c'))} isn't {x && <q>{require(d)}</q>}</p>; import e from './e'"
    assert found(source) == [("require", "./a"), ("require", "./b"), ("dynamic-literal", "./c"), ("static", "./e")]
    assert imports(source, "a.jsx")[1] == 1


@pytest.mark.parametrize("broken", ["<p>", "<p></q>", "<p>}</p>", "<p>></p>", "<p a=b/>", "<>it's", "<p {a>", "<p a='x>", "<a.b></a.c>"])
def test_broken_elements(broken):
    with pytest.raises(Unparsed):
        imports(f"import a from './a'; const v = {broken};", "a.tsx")


@pytest.mark.parametrize(
    "source",
    [
        "const f = <T,>(x: T) => x", "const f = <T extends object>(x: T) => x", "const f = <const T,>(x: T) => x", "type F = <T>(x: T) => T", "interface I { <T>(x: T): T; new <T>(x: T): T }",
        "const f = async <T,>(x: T) => x", "const m = new Map<string, Array<number>>()", "function g<T>(x: T): x is T { return a < b && c > d }", "const v = <Foo<string> a='b'>it's</Foo>", "const n = x!; const y = a! / 2 / 3",
        "let a: <T>(x: T) => T = b, c = <p>(it's)</p>",
    ],
)
def test_types_in_tsx(source):
    assert found(f"{source};\nimport z from './z'") == [("static", "./z")]


def test_type_assertions():
    assert found("const a = <T>b; const c = <T>(x: T) => x; const d = <any>window;\nimport z from './z'", "a.ts") == [("static", "./z")]
    with pytest.raises(Unparsed):
        imports("const a = <T>b;", "a.js")


@pytest.mark.parametrize(
    "source", ["a = b / c / d", "a++ / b / c", "if (x) /'/.test(y)", "for (;;) {} /'/.test(y)", "a = {} / 2 / 3", "f(x) / 2 / '/'", "x = y ? /'/ : /\"/", "return /[/']/", "a[0] / 2 / b", "z = `${`'`}${'`'}` / 2", "x => { } \n/'/.test(z)", "a.if(b) / c / d", "1 / 2 / 3", "#!/bin/env it's\nx"]
)
def test_signs_that_divide_and_signs_that_begin_a_pattern(source):
    if source.startswith("#!"):
        assert found(f"{source}\nimport z from './z'", "a.js") == [("static", "./z")]
    else:
        assert found(f"{source};\nimport z from './z'", "a.js") == [("static", "./z")]


def test_kinds():
    assert found("import value from './value.js'; import type { Model } from './model.js'; import { type Shape } from './shape.js'; export { helper } from './helper.js'; export type { C } from './c'; export * from './all'; export type * from './t'; export * as n from './n'", "a.ts") == [
        ("static", "./value.js"), ("type-only", "./model.js"), ("type-only", "./shape.js"), ("re-export", "./helper.js"), ("type-only", "./c"), ("re-export", "./all"), ("type-only", "./t"), ("re-export", "./n"),
    ]
    assert found("import d, { type T } from 'a'; import type from 'b'; import type, { x } from 'c'; import type from from 'd'; import {} from 'e'; import { type as x } from 'f'; import { type as } from 'g'; import { 'a b' as q } from 'h'; import k from 'i' with { type: 'json' }", "a.ts") == [
        ("static", "a"), ("static", "b"), ("static", "c"), ("type-only", "d"), ("static", "e"), ("static", "f"), ("type-only", "g"), ("static", "h"), ("static", "i"),
    ]


def test_no_references():
    for source in (
        "const text = \"require('./s')\"; const o = { import: './p', require: './q' }; function requirement() { return './n' }", "a.require('x'); a?.require('y'); this.import('z'); require?.('w'); new require('v')",
        "class A { require(x) { return 1 } import(y) { return 2 } }; function require(z) { }", "import.meta.url; export const a = 1; export function f() { return g }; export default x; export { y }",
        "let a: import('./t').T; type B = typeof import('./u') | import('./v')".replace("let a: import('./t').T; ", ""), "import fs = require('fs'); export import q = require('q')",
    ):
        assert imports(source, "a.ts") == ([], 0), source
    assert imports("require(name); import(get()); require(); require('a' + b); require(`t`); import(`u`)", "a.mjs") == ([], 6)


@pytest.mark.parametrize("source", ["import a from 'b';\nfunction {", "f(", "f)", "{(}", "[}", "'a\nb'", "`a", "/* a", "a = /b", "${"])
def test_broken_sources(source):
    with pytest.raises(Unparsed):
        imports(source, "a.ts")


@pytest.mark.parametrize("source", ["import type { T } from 't'", "import { type T } from 't'", "export type { T } from 't'", "import a = require('a')"])
def test_types_belong_to_typescript(source):
    imports(source, "a.mts")
    with pytest.raises(Unparsed):
        imports(source, "a.mjs")


def test_literals_and_size():
    assert unquoted(r"'\x41\u0042\u{1F600}\n\'\q\
z'") == "AB😀\n'qz"
    long = "".join(f"import a{i} from './m{i}';\nconst v{i} = <p>it's {{n{i}}} of <b>bob's</b></p>;\n" for i in range(20_000))
    assert len(imports(long, "a.tsx")[0]) == 20_000
    deep = "<a>" * 30_000 + "it's" + "</a>" * 30_000
    assert found(f"const v = {deep};\nimport z from 'z'", "a.jsx") == [("static", "z")]
    assert [t.kind for t in tokens("a<b", "x.ts")] == ["name", "<", "name"]
