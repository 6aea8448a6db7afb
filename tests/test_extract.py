import pytest

from symgraph.extract import resolvers, run
from symgraph.extract.frameworks import api_calls
from symgraph.extract.run import extract_one
from symgraph.operators import matching
from tests.conftest import rows


def found(path, text, language):
    f = extract_one(path, text, language)
    return {(n["kind"], n["name"]) for n in f.nodes}, {(e["kind"], e["target_id"].rsplit(":", 1)[-1]) for e in f.edges}, {(r["kind"], r["name"]) for r in f.refs}, f


def test_python():
    text = "import os.path as p\nfrom abc import ABC\nfrom enum import Enum\nLIMIT = 3\nclass Base(ABC):\n    '''Doc.'''\n    @property\n    def x(self) -> int: return 1\n    def _y(self, a: Foo): return p.join(Bar(), a)\nclass Color(Enum):\n    RED = 1\nasync def go():\n    helper()\n"
    nodes, _, refs, f = found("m/a.py", text, "python")
    assert {("interface", "Base"), ("property", "x"), ("method", "_y"), ("enum", "Color"), ("constant", "RED"), ("constant", "LIMIT"), ("function", "go"), ("import", "p")} <= nodes
    assert {("implements", "abc.ABC"), ("extends", "enum.Enum"), ("calls", "os.path.join"), ("instantiates", "Bar"), ("calls", "helper"), ("has_type", "Foo"), ("returns_type", "int"), ("imports", "abc.ABC")} <= refs
    assert next(n for n in f.nodes if n["name"] == "_y")["metadata"]["visibility"] == "protected"
    assert extract_one("a.py", "def (", "python").errors[0]["node_type"] == "module"


@pytest.mark.parametrize(
    "language, text, nodes, refs",
    [
        ("javascript", "import { a } from './b';\nconst q = require('q');\nexport class A extends B {\n  run(x) { return go(new C()); }\n}\nfunction f() {}\nconst g = async (x) => x;\nconst K = 1;\n", {("class", "A"), ("method", "run"), ("function", "f"), ("function", "g"), ("constant", "K")}, {("imports", "./b"), ("imports", "q"), ("extends", "B"), ("calls", "go"), ("instantiates", "C")}),
        ("typescript", "import type { T } from './t';\nexport interface I { id: number; }\nenum E { A }\ntype U = string;\nclass C implements I { private x: number = 1; get(k: string): T { return k; } }\n", {("interface", "I"), ("enum", "E"), ("type_alias", "U"), ("class", "C")}, {("imports_type", "./t"), ("implements", "I")}),
        ("php", "<?php\nnamespace App\\X;\nuse App\\Y\\Z;\nabstract class A extends B implements C\n{\n    const K = 1;\n    private ?int $p;\n    public function run() { return Z::make(new Q()); }\n}\nfunction f() {}\n", {("namespace", "App\\X"), ("class", "A"), ("constant", "K"), ("property", "p"), ("method", "run"), ("function", "f")}, {("imports", "App\\Y\\Z"), ("extends", "B"), ("implements", "C"), ("calls", "Z::make"), ("instantiates", "Q")}),
        ("go", "package p\n\nimport \"fmt\"\n\ntype T struct {\n\tname string\n}\n\nfunc (t *T) Run() int { return go1(2) }\n\nfunc F() {}\n\nconst K = 1\n", {("package", "p"), ("class", "T"), ("property", "name"), ("method", "Run"), ("function", "F"), ("constant", "K")}, {("imports", "fmt"), ("calls", "go1")}),
        ("rust", "use std::io;\npub struct S {\n    a: i32,\n}\nimpl Show for S {\n    pub fn run(&self) { println!(\"{}\", f2(1)); }\n}\nfn f() {}\n", {("class", "S"), ("property", "a"), ("method", "run"), ("function", "f")}, {("imports", "std::io"), ("implements", "Show"), ("calls", "f2"), ("calls", "println")}),
        ("css", ":root { --c: 1; }\n.a .b, #d { color: var(--c); color: var(--e); }\n@keyframes k { from { top: 0 } }\n@media (x) { .m { a: b } }\n", {("css_variable", "--c"), ("css_class", "a"), ("css_class", "b"), ("css_id", "d"), ("css_keyframes", "k"), ("css_class", "m")}, {("css_uses_variable", "--e")}),
        ("scss", "@use 'x';\n$v: 1px;\n@mixin m { a: $v; }\n@function f() { @return 1; }\n.a { @include m; @include n; @extend %p; }\n", {("scss_variable", "$v"), ("scss_mixin", "m"), ("scss_function", "f"), ("css_class", "a")}, {("scss_includes_mixin", "n"), ("imports", "x"), ("scss_extends", "%p")}),
    ],
)
def test_languages(language, text, nodes, refs):
    n, _, r, f = found("d/a." + language, text, language)
    assert nodes <= n and refs <= r, (nodes - n, refs - r)
    assert not f.errors and len({x["id"] for x in f.nodes}) == len(f.nodes)


@pytest.mark.parametrize(
    "path, text, language, want",
    [
        ("a.js", "const express = require('express');\nfunction h(q, s) {}\napp.get('/u/:id', h);\napp.use(auth);\n", "javascript", {("route", "GET /u/:id"), ("middleware", "auth")}),
        ("web/app/(x)/u/[id]/route.ts", "export async function GET() {}\n", "typescript", {("route", "GET /u/[id]")}),
        ("a.jsx", "function Card() { const x = useThing(); return <Panel a={x} />; }\nconst Ctx = createContext(null);\n", "javascript", {("component", "Card"), ("provider", "Ctx")}),
        ("a.ts", "import { defineStore } from 'pinia';\nconst s = defineStore('cart', {});\n", "typescript", {("module", "cart")}),
        ("a.ts", "import { Component } from '@angular/core';\n@Component({ selector: 'x-y' })\nexport class Xy { constructor(private a: Api) {} }\nconst r = [{ path: 'home', component: Xy }];\n", "typescript", {("component", "Xy"), ("route", "GET /home")}),
        ("a.py", "from flask import Flask\nbp = Blueprint('b', __name__)\n@bp.route('/x', methods=['GET', 'POST'])\ndef x():\n    return render_template('t.html')\n", "python", {("route", "GET /x"), ("route", "POST /x"), ("module", "bp")}),
        ("a.py", "from fastapi import APIRouter\nrouter = APIRouter()\nclass M(BaseModel):\n    a: int\n@router.get('/i/{id}')\nasync def i(id, d=Depends(dep)):\n    pass\n", "python", {("route", "GET /i/{id}"), ("module", "router"), ("model", "M")}),
        ("urls.py", "from django.urls import path\nurlpatterns = [path('a/', views.A.as_view()), path('b/', include('b.urls'))]\n", "python", {("route", "ANY a/"), ("route", "ANY b/")}),
        ("routes/api.php", "<?php\nuse Illuminate\\X;\nRoute::get('/u', [UserController::class, 'index']);\nRoute::apiResource('p', PController::class);\n", "php", {("route", "GET /api/u"), ("route", "DELETE /api/p/{id}")}),
        ("a.php", "<?php\nuse Symfony\\X;\n#[Route('/s', methods: ['POST'])]\nfunction s() {}\n", "php", {("route", "POST /s")}),
        ("a.css", "@theme { --color-x: red; }\n@utility tab { a: b }\n.c { @apply p-2 bg-x; }\n", "css", {("tailwind_theme_token", "--color-x"), ("tailwind_utility", "tab")}),
    ],
)
def test_frameworks(path, text, language, want):
    n = found(path, text, language)[0]
    assert want <= n, want - n


def test_api_calls():
    text = "fetch(`/a/${id}`, { method: 'PUT' });\naxios.post('/b');\n$.ajax({ url: '/c', type: 'GET' });\nuserClient.get<T>('/d');\nx.open('GET', '/e');\nother.get('/f');\n"
    assert [c[:2] for c in sorted(api_calls(text), key=lambda c: c[2])] == [("/a/{param}", "PUT"), ("/b", "POST"), ("/c", "GET"), ("/d", "GET"), ("/e", "GET")]


def test_extraction_over_a_table(spark):
    df = spark.createDataFrame([("r/a.py", "def f():\n    g()\n", "Python"), ("r/b.x", "?", "cobol"), ("r/c.py", None, "python"), ("r/d.py", "", "python")], "file_path string, text string, language string")
    x = run.extract(df)
    assert rows(run.nodes_of(x), "file_path", "kind", "name") == [("r/a.py", "file", "a.py"), ("r/a.py", "function", "f"), ("r/d.py", "file", "d.py")]
    assert rows(run.references_of(x), "kind", "name") == [("calls", "g")] and run.errors(x).count() == 1
    assert run.nodes_of(run.extract(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    "language, files, imports, want",
    [
        ("javascript", ["r/src/a.js", "r/src/lib/index.js", "r/node_modules/q/index.js"], [("r/src/b.js", "./a"), ("r/src/b.js", "./lib"), ("r/src/b.js", "q"), ("r/src/b.js", "fs"), ("r/src/b.js", "zz"), ("r/x/b.js", "@/a")], {"./a": "relative", "./lib": "relative", "q": "package", "fs": "builtin", "zz": "external", "@/a": "alias"}),
        ("python", ["r/p/a.py", "r/p/__init__.py", "r/q.py"], [("r/p/b.py", ".a"), ("r/p/b.py", "..q"), ("r/p/b.py", "p"), ("r/p/b.py", "os.path")], {".a": "relative", "..q": "relative", "p": "package", "os.path": "builtin"}),
        ("php", ["r/app/X/Y.php"], [("r/app/a.php", "App\\X\\Y"), ("r/app/a.php", "Z\\W")], {"App\\X\\Y": "psr4", "Z\\W": "external"}),
        ("rust", ["r/src/a/mod.rs", "r/src/b.rs"], [("r/src/main.rs", "crate::a"), ("r/src/main.rs", "self::b"), ("r/src/main.rs", "std::io")], {"crate::a": "crate", "self::b": "self", "std::io": "builtin"}),
    ],
)
def test_modules(spark, language, files, imports, want):
    f = spark.createDataFrame([(x,) for x in files], "file_path string")
    i = spark.createDataFrame(imports, "from_file string, module string")
    assert {r.module: r.strategy for r in resolvers.resolve_modules(i, f, language).collect()} == want


def test_style_modules(spark):
    f = spark.createDataFrame([("r/s/_part.scss",), ("r/t/deep.scss",)], "file_path string")
    i = spark.createDataFrame([("r/s/a.scss", "part"), ("r/s/a.scss", "x/deep"), ("r/s/a.scss", "none")], "from_file string, module string")
    assert {r.module: (r.path, r.strategy) for r in resolvers.resolve_styles(i, f, "scss").collect()} == {"part": ("r/s/_part.scss", "partial"), "x/deep": ("r/t/deep.scss", "basename"), "none": (None, "external")}


def test_links_to_other_files(spark):
    nodes = spark.createDataFrame([("c1", "component", "Panel"), ("c2", "class", "Panel"), ("m", "class", "User")], "id string, kind string, name string")
    edges = spark.createDataFrame([("a", "__unresolved__:component:Panel", "renders"), ("a", "__unresolved__:model:User", "depends_on"), ("a", "__unresolved__:hook:useX", "uses_hook"), ("a", "m", "calls")], "source_id string, target_id string, kind string")
    assert rows(matching.link_far(edges, nodes), "target_id") == [("__unresolved__:hook:useX",), ("c1",), ("m",), ("m",)]


def test_styles_in_scripts(spark):
    src = spark.createDataFrame([("a.jsx", '<p className="card wide">\n<q class="card">\nel.style.setProperty("--c", 1)')], "file_path string, text string")
    classes = spark.createDataFrame([("k", ".card"), ("l", "other")], "id string, name string")
    assert rows(matching.class_uses(src, classes), "class_id", "line") == [("k", 1)]
    v = spark.createDataFrame([("v", "--c")], "id string, name string")
    assert rows(matching.variable_bridge(src, v)) == [("a.jsx", "v", "js_sets_css_variable")]
