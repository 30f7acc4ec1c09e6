import pytest
from pyspark.sql import functions as F

from sparkloom.functions import jsread
from sparkloom.functions import parse as P
from sparkloom.functions import text as T
from sparkloom.operators import resolve as S
from sparkloom.sources import scan

JS = """import def, { a as b, c } from './x';
import * as ns from "pkg";
import type { T } from "../types";
import 'side';
const fs = require('fs'), y = 1;
const lazy = () => import('./lazy');
export default async function useThing(a, b) {}
export class Box {}
export { p as q, r };
const Card = (x) => x;
export interface Shape {}
app.get('/users', h); // TODO later
let plain = async function () {};
"""
PY = """import os, sys as system
from . import sib
from ..pkg.mod import name as other

class A(Base):
    def m(self):
        return helper(1)

async def f(x):
    pass
"""


@pytest.fixture(scope="module")
def lines(spark):
    return P.numbered(spark.createDataFrame([("src/a.ts", JS)], "path string, content string"))


def test_javascript(lines):
    got = {(r.line, r.kind, r.source, tuple(r.specifiers), r.confidence) for r in P.js_imports(lines).collect()}
    assert got == {(1, "static", "./x", ("def", "b", "c"), 1.0), (2, "static", "pkg", ("ns",), 0.9), (3, "static", "../types", ("T",), 1.0), (4, "static", "side", (), 0.9), (5, "commonjs", "fs", ("fs",), 0.9), (6, "dynamic", "./lazy", (), 0.8)}
    exports = {(r.line, r.name, r.kind) for r in P.js_exports(lines).collect()}
    assert exports == {(7, "useThing", "function"), (8, "Box", "class"), (9, "q", "unknown"), (9, "r", "unknown"), (11, "Shape", "interface")}
    symbols = {(r.line, r.name, r.kind, r.exported) for r in P.js_symbols(lines).collect()}
    assert symbols == {(6, "lazy", "function", False), (8, "Box", "class", True), (10, "Card", "component", False), (11, "Shape", "interface", True), (13, "plain", "function", False)}
    assert [(r.line, r.method, r.route) for r in P.routes(lines).collect()] == [(12, "GET", "/users")]
    assert [r.line for r in P.todo_warnings(lines).collect()] == [12]
    merged = {(r.name, r.kind, r.exported) for r in S.merge_symbols(P.js_symbols(lines), P.js_exports(lines)).collect()}
    assert ("q", "unknown", True) in merged and ("useThing", "function", True) in merged and ("plain", "function", False) in merged


def test_python_engines(spark):
    files = spark.createDataFrame([("a/b.py", PY), ("bad.py", PY + "\ndef broken(:\n"), ("null.py", None)], "path string, content string")
    tree = {(r.path, r.line, r.kind, r.name) for r in P.python_facts(files).collect()}
    plain = {(r.path, r.line, r.kind, r.name) for r in P.python_facts(files, "lines").collect()}
    shared = {(1, "import", "os"), (1, "import", "sys"), (2, "import", "."), (3, "import", "..pkg.mod"), (5, "class", "A"), (6, "method", "m"), (9, "function", "f")}
    assert {x[1:] for x in plain if x[0] == "a/b.py"} == shared
    assert {x[1:] for x in tree if x[0] == "a/b.py"} == shared | {(5, "inheritance", "Base"), (7, "call", "helper")}
    assert {x[1:] for x in tree if x[0] == "bad.py"} == {x[1:] for x in plain if x[0] == "bad.py"} >= shared
    assert not [x for x in tree if x[0] == "null.py"]


JS_LONG = """// import no from 'no'
import {
  a,
  b as c,
} from './multi';
const s = "class Not {}"; /* function neither() {} */
export class Box extends Base {
  constructor(x) { super(x); this.y = make(x); }
  async read(key) {
    if (key) { return store.get(key); }
  }
}
const run = async (q) => { helper(q); };
export const pick = x => x;
function plain(a, b) { return new Box(a); }
const lib = require("lib");
"""


def test_javascript_by_descent(spark):
    files = spark.createDataFrame([("a.js", JS_LONG), ("broken.js", "class { ((( function"), ("n.js", None)], "path string, content string")
    got = {(r.line, r.kind, r.name, r.scope) for r in P.js_facts(files).collect() if r.path == "a.js"}
    assert got == {
        (2, "import", "./multi", ""), (6, "variable", "s", ""), (7, "class", "Box", ""), (7, "export", "Box", ""), (7, "inheritance", "Base", "Box"), (8, "method", "constructor", "Box"), (8, "call", "make", "Box.constructor"),
        (9, "method", "read", "Box"), (10, "call", "store.get", "Box.read"), (13, "function", "run", ""), (13, "call", "helper", "run"), (14, "function", "pick", ""), (14, "export", "pick", ""),
        (15, "function", "plain", ""), (15, "call", "Box", "plain"), (16, "import", "lib", ""),
    }


def js(path, content):
    return [dict(zip("path line kind name signature form end exported scope names".split(), r, strict=True)) for r in jsread.facts(path, content)]


def of(rows, *kinds):
    return [r for r in rows if r["kind"] in kinds]


def test_imports_exports_and_names():
    rows = js("src/App.jsx", """
import React, { useMemo as memo } from "react";
import * as utils from "./utils";
import "./styles.css";
const helper = require("../helper");
const lazy = import("./lazy");
export function useThing() { return memo(() => 1, []); }
export class Widget {}
function plain() {}
const Dashboard = () => null;
export { Dashboard };
""")
    assert [(r["name"], r["form"], r["names"]) for r in of(rows, "import")] == [
        ("react", "static", ["React", "memo"]), ("./utils", "static", ["utils"]), ("./styles.css", "static", []), ("../helper", "commonjs", ["helper"]), ("./lazy", "dynamic", [])]
    assert sorted(r["name"] for r in of(rows, "export")) == ["Dashboard", "Widget", "useThing"]
    symbols = {r["name"]: (r["kind"], r["exported"], r["line"], r["end"]) for r in of(rows, "function", "hook", "component", "class")}
    assert symbols == {"useThing": ("hook", True, 7, 7), "Widget": ("class", True, 8, 8), "plain": ("function", False, 9, 9), "Dashboard": ("component", False, 10, 10)}
    assert [(r["name"], r["names"]) for r in of(js("m.js", "import {\n  alpha,\n  beta as gamma,\n} from './wide';\n"), "import")] == [("./wide", ["alpha", "gamma"])]
    assert [r["name"] for r in of(js("q.js", "// import('./commented-out');\nimport real from './real';\n"), "import")] == ["./real"]
    names = [f"n{i} as m{i}" for i in range(500)]
    assert of(js("w.js", "import { " + ", ".join(names) + " } from './very-wide'\nrun()"), "import")[0]["names"] == [f"m{i}" for i in range(500)]


def test_types_classes_and_legacy_forms():
    rows = js("src/domain/user.ts", """
import type { UserId } from "./ids";
export interface User { id: UserId }
export type UserName = string;
export enum Role { Admin }
export async function loadUser() { return null; }
export class UserService extends BaseService {
  load(id: UserId) { return id; }
  private cache = new Map();
}
const internal = 42;
""")
    by = {r["name"]: r for r in of(rows, "interface", "type", "enum", "class", "method", "variable", "function")}
    assert [by[n]["signature"] for n in ("User", "UserName", "Role")] == ["export interface User { id: UserId }", "export type UserName = string;", "export enum Role { Admin }"]
    assert all(by[n]["exported"] for n in ("User", "UserName", "Role", "loadUser", "UserService")) and not by["internal"]["exported"]
    assert (by["load"]["kind"], by["load"]["scope"]) == ("method", "UserService") and (by["UserService"]["line"], by["UserService"]["end"]) == (7, 10)
    assert of(rows, "import")[0]["names"] == ["UserId"] and by["internal"]["kind"] == "variable" and "cache" not in by
    rows = js("src/legacy.ts", 'import legacy = require("./legacy-impl");\nexport { thing } from "./other";\nexport * from "./all";\n')
    assert [(r["name"], r["form"], r["names"]) for r in of(rows, "import")] == [("./legacy-impl", "commonjs", ["legacy"])]
    assert [r["name"] for r in of(rows, "export")] == ["thing"] and [r["name"] for r in of(rows, "reexport")] == ["./other", "./all"]


def test_states_of_templates_elements_and_regular_expressions():
    rows = js("p.tsx", """
export const ProfileCard = () => <section />;
const useProfile = () => ({});
const half = a / b / c; const re = /[/"'`]{2}/g.test(x);
const view = <div title="no(1)" onClick={() => act("}")}>don't no(2) {items.map(i => <Row key={i} v={`t${fmt(i)}`} />)} `q</div>;
const s = `import no from 'no' ${yes("a")} ${`nested ${inner()}`}`;
const less = a < b && c > d(1);
app.get("/x/:id", (req, res) => { send(res) });
""")
    assert {(r["kind"], r["name"]) for r in of(rows, "component", "hook", "function")} == {("component", "ProfileCard"), ("hook", "useProfile")}
    assert [r["name"] for r in of(rows, "call")] == ["test", "act", "items.map", "fmt", "yes", "inner", "d", "app.get", "send"]
    assert [r["name"] for r in of(rows, "route")] == ["GET /x/:id"] and not of(rows, "import")
    generic = js("g.ts", "function pick<T extends object>(x: T): T { return <T>find(x); }\nconst f = <T,>(x: T) => use(x);\nclass A<T> implements B { m<U>(x: U): U { return x } }\n")
    assert [(r["kind"], r["name"]) for r in of(generic, "function", "class", "method", "call", "inheritance")] == [("function", "pick"), ("call", "find"), ("function", "f"), ("call", "use"), ("class", "A"), ("inheritance", "B"), ("method", "m")]
    for odd in ("", "`", "<a", "class", "import", "export", "export default", "const", "{", "}", "/", "`${", "<a>{", "function (", "import {", "type X =", "class A { x"):
        js("odd.jsx", odd)


def test_a_file_that_takes_too_long_is_named(spark):
    files = spark.createDataFrame([("big.py", "x = 1\n" * 300_000), ("ok.py", "import os\n")], "path string, content string").coalesce(1)
    got = {(r.path, r.kind) for r in P.python_facts(files, "lines", seconds=0.05).collect()}
    assert got == {("big.py", "unparsed"), ("ok.py", "import")}


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/x.ts", "src/x.js", "src/lib/index.js", "types.d.ts", "pkg/mod.py", "pkg/__init__.py", "pkg/sub/a.py", "docs/Guide.md", "docs/b/Note.md")], "path string")
    js = spark.createDataFrame([("src/a.ts", 1, "./x"), ("src/a.ts", 2, "./lib"), ("src/a.ts", 3, "../types.d"), ("src/a.ts", 4, "react"), ("src/a.ts", 5, "./none"), ("src/a.ts", 6, "../../../src/x.js")], "from string, line int, source string")
    assert {r.line: r.target for r in S.resolve_js(js, files).collect()} == {1: "src/x.ts", 2: "src/lib/index.js", 3: "types.d.ts", 4: None, 5: None, 6: "src/x.js"}
    py = spark.createDataFrame([("pkg/sub/a.py", 1, "..mod"), ("pkg/sub/a.py", 2, ".."), ("pkg/x.py", 3, "mod"), ("pkg/x.py", 4, "os")], "from string, line int, source string")
    assert {r.line: r.target for r in S.resolve_python(py, files).collect()} == {1: "pkg/mod.py", 2: "pkg/__init__.py", 3: "pkg/mod.py", 4: None}
    links = spark.createDataFrame([("docs/index.md", "Guide"), ("docs/index.md", "b/Note.md"), ("x.md", "note"), ("x.md", "nowhere")], "from string, link string")
    assert {r.link: r.target for r in S.resolve_links(links, files).collect()} == {"Guide": "docs/Guide.md", "b/Note.md": "docs/b/Note.md", "note": "docs/b/Note.md", "nowhere": None}
    text = "[a](Guide.md#top) ![i](Guide.md) `[c](Guide)` [[note#h|see]] [[ Guide ]] [w](https://x/y) [q](#here) [t [u] v](./b/note \"title\") [r](/docs/guide?x)\n```\n[no](Guide)\n```\n~~~\n[[no]]\n~~~\n[s](../docs/none.md)"
    found = S.markdown_links(spark.createDataFrame([("docs/index.md", text), ("empty.md", ""), ("null.md", None)], "path string, content string"))
    want = [("mdlink", "../docs/none.md", None), ("mdlink", "./b/note", "docs/b/Note.md"), ("mdlink", "/docs/guide?x", "docs/Guide.md"), ("mdlink", "Guide.md#top", "docs/Guide.md"), ("wikilink", "Guide", "docs/Guide.md"), ("wikilink", "note", "docs/b/Note.md")]
    assert sorted((r.kind, r.link, r.target) for r in S.resolve_links(found, files).collect()) == want
    names = spark.createDataFrame([("x.ts",), ("a.py",), ("zzz",)], "name string")
    assert {r.name: r.path for r in S.unique_suffix(names, files).collect()} == {"x.ts": "src/x.ts", "a.py": "pkg/sub/a.py", "zzz": None}


def test_scalars(spark):
    rows = spark.createDataFrame([("parseHTTPResponse2 foo_bar x", "src/my.Component.test.ts", "a/./b/../../../c//d", "/** hi **/")], "t string, p string, j string, c string")
    r = rows.select(
        T.tokenize_code(F.col("t")).alias("t"), T.extension(F.col("p")).alias("e"), T.role(F.col("p")).alias("r"), T.join_posix(F.col("j")).alias("j"), T.strip_comment(F.col("c")).alias("c"),
        T.path_words(F.col("p")).alias("w"), T.fnv1a(F.lit("abc")).alias("h"), T.fnv1a(F.lit("")).alias("h0"), T.half_up(F.lit(-2.5)).alias("u"), P.json_object(F.lit('x {"a": "}"} y')).alias("o"), P.json_object(F.lit("{ no")).alias("n"),
    ).first()
    assert r.t == ["parsehttpresponse2", "parse", "http", "response", "foo", "bar"] or r.t[:4] == ["parsehttpresponse2", "parse", "http", "response"]
    assert (r.e, r.r, r.j, r.c, r.w) == (".ts", "test", "c/d", "hi", "src my component test") and (r.h, r.h0, r.u, r.o, r.n) == (440920331, 2166136261, -2, '{"a": "}"}', None)
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], ["a"], [])], "a array<double>, b array<double>, x array<string>, y array<string>")
    assert zero.select(T.cosine(F.col("a"), F.col("b")), T.jaccard(F.col("x"), F.col("y")), T.overlap(F.col("y"), F.col("x"))).first() == (0.0, 0.0, 0.0)


def test_scan(spark, tmp_path):
    for p, text in {"src/a.ts": "const a = 1;\n\nexport { a };\n", "src/gen/b.ts": "x", "node_modules/m/i.js": "x", "docs/r.md": "# r", "keep/gen/c.py": "pass", "x.log": "l", "important.log": "l", "package-lock.json": "{}"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    rules = scan.ignore_rules("# c\n\n*.log\n!important.log\nsrc/gen/\n/keep/**/nothing\n")
    files = scan.read_files(spark, str(tmp_path), rules)
    assert {r.path for r in files.collect()} == {"src/a.ts", "docs/r.md", "keep/gen/c.py", "important.log", "package-lock.json"}
    d = {r.path: r for r in scan.describe(files).collect()}
    assert (d["src/a.ts"].language, d["src/a.ts"].role, d["src/a.ts"].loc) == ("TypeScript", "source", 2) and d["docs/r.md"].role == "docs" and d["package-lock.json"].role == "config"
    assert scan.measure(files).first().accepted and scan.layout(files).first().layout == "src-rooted"
    assert "package-lock.json" not in {r.path for r in scan.parseable(files).collect()}
