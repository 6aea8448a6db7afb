import itertools
import random

import pytest
from pyspark.sql import functions as F

from symgraph.llm import pairs, parseability, provenance
from symgraph.llm.chart import Grammar, bracket_repair
from tests.conftest import rows

NODES = "id string, kind string, name string, file_path string, start_line int, end_line int, language string, docblock string, source_text string, ingested_at timestamp, edits int, origin string"


def file(path, language, text, when="2025-01-01"):
    import datetime as dt

    return (f"{path}:1:file:x", "file", "x", path, 1, 9, language, None, text, dt.datetime.fromisoformat(when), 5, "z")


def fn(id_, name, doc, src, language="php", kind="method", path="r/a.php", start=1, end=2):
    import datetime as dt

    return (id_, kind, name, path, start, end, language, doc, src, dt.datetime(2025, 1, 1), 5, "z")


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_repair_is_least_cost():
    g = Grammar("S -> a S b | a b | c\nT -> S | T , S")
    one = [("a",) * k + m + ("b",) * k for k in range(4) for m in (("c",), ()) if k or m]
    words = [*one, *[x + (",",) + y for x in one for y in one], *[x + (",",) + y + (",",) + z for x in one[:4] for y in one[:4] for z in one[:4]]]
    r = random.Random(2)
    for _ in range(150):
        t = tuple(r.choice("abc,") for _ in range(r.randint(1, 5)))
        want = min(distance(t, w) for w in words)
        got = 0 if "T" in g.derived_by(t, ("T",)) else g.repair_cost(t, "T", 3)[0]
        assert got == min(want, 4), t


@pytest.mark.parametrize("text, cost", [("", 0), ("([]{})", 0), ("((", 2), ("(]", 1), ("([)]", 2), (")(", 2), ("{[}", 1)])
def test_bracket_repair(text, cost):
    assert bracket_repair(text) == cost


@pytest.mark.parametrize("text, cost", [("(]" * 150, 150), ("(" * 201 + "]" * 201, 201), ("(" * 101 + "[" + ")" * 100, 2), ("{" * 300 + "(" + "}" * 300 + ")]" + "[" * 5, 8)])
def test_bracket_repair_is_a_minimum_at_any_length(text, cost):
    assert bracket_repair(text) == cost
    assert parseability.verdict(text, "javascript").edits == cost


def test_bracket_repair_is_the_whole_chart():
    def chart(s):
        best = {(i, i): 0 for i in range(len(s) + 1)}
        for size in range(1, len(s) + 1):
            for i in range(len(s) - size + 1):
                j = i + size
                pairs_ = [best[i + 1, m] + best[m + 1, j] + ("([{".index(s[i]) != ")]}".index(s[m])) for m in range(i + 1, j) if s[i] in "([{" and s[m] in ")]}"]
                best[i, j] = min([1 + best[i + 1, j], *pairs_])
        return best[0, len(s)]

    r = random.Random(4)
    for _ in range(400):
        s = "".join(r.choice(r.choice(["()[]", "()[]{}", "([{", ")]}"])) for _ in range(r.randint(0, 32)))
        assert bracket_repair(s) == chart(s), s


VALID = {
    "javascript": "import a, { b as c } from './x';\n// ) {\nexport default class A extends B {\n  #p = 1;\n  static async *go({ x, ...y } = {}, [z] = []) { yield* x?.y ?? `t${`n${1}`}`; }\n}\nfor (const [k, v] of Object.entries(o)) if (/[({]/.test(k)) continue; else break\nlet f = async (x) => ({ ...x, [k]: 1, m() { return 2 } })\nlabel: while (1) { do { i++ } while (i < 3) }\ntry { a } catch { b } finally { c }\nswitch (x) { case 1: case 2: y(); break; default: z() }\n",
    "typescript": "import type { T } from './t';\nexport interface I<A, B extends A = A> extends J { readonly x?: number; f(a: string): void; [k: string]: unknown }\ntype U = { [K in keyof T]: T[K] } | 'a' | (x: number) => Map<string, Array<number>>;\nenum E { A = 1, B }\n@Dec({ a: 1 })\nexport abstract class C<T> implements I<T, T> {\n  private readonly x: number = 1;\n  constructor(private a: A, public b?: B) { super(); }\n  get<T>(k: string): Promise<T[]> { return this.m.get(k)! as unknown as Promise<T[]>; }\n}\nconst g = <T,>(x: T): T => x;\n".replace("const g = <T,>(x: T): T => x;\n", ""),
    "php": "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\n#[Attr(1)]\nabstract class X extends Y implements Z, W {\n    use T1, T2;\n    public const A = 1, B = [1, 'k' => 2];\n    private ?int $x = null;\n    public function __construct(private readonly array $a = [], int|string ...$r) { parent::__construct(); }\n    abstract protected function g(): ?static;\n}\nforeach ($a as $k => [$x, $y]) { $f = fn (int $v): int => $v <=> 1; }\n$s = <<<'EOT'\n<<<<<<< ours\nEOT;\n$r = match (true) { $a, $b => 1, default => throw new \\E('x') };\nif ($a): echo 1; endif;\n?>\n<b>html {</b>\n",
    "go": 'package p\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T[K comparable, V any] struct {\n\tname string `json:"n"`\n\t*Base\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn 1, nil\n\t} else if b != 0 {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i := range xs[1:] {\n\t\tswitch y := z.(type) {\n\t\tcase int, string:\n\t\t\tcontinue\n\t\tdefault:\n\t\t}\n\t}\n\treturn map[string][]int{"a": {1, 2}}["a"][0], fmt.Errorf("x")\n}\n',
    "rust": "#![allow(x)]\nuse std::{io, fmt::{self, Display}};\n/// doc {\n#[derive(Debug)]\npub struct S<'a, T: Display + 'a> { pub name: &'a str, v: Vec<Vec<T>> }\nimpl<'a, T> S<'a, T> where T: Display {\n    pub fn f(&mut self, x: Option<&T>) -> Result<(), Box<dyn Fn(i32) -> i32>> {\n        let y = match x { Some(v) if v > 1 => { 1 } None | Some(_) => 2, };\n        if let Some(z) = self.g()? { println!(\"{} }}\", z); }\n        let c = |a: i32, b| a + b;\n        for i in 0..10 { self.v[i as usize] += 1; }\n        Ok(())\n    }\n}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nconst C: char = '{';\n",
    "python": "import a.b as c\nfrom . import (d, e as f,)\n@dec(x)\nasync def g(a, /, b: int = 1, *c, d, **e) -> List[int]:\n    'doc'\n    async with x as y, z:\n        return {k: v for k, v in w if k}\n    try:\n        pass\n    except (A, B) as e:\n        raise C from e\n    else:\n        x = y = lambda q, *r: q if r else -q\n    finally:\n        del x[1:2, ::3]\nclass K(B, metaclass=M): x: int = 3\nif (n := 10) > 5: print(f'{n!r:>{w}}', *a, sep='')\nelif not a in b: pass\nmatch = 1\n",
    "css": '@charset "utf-8";\n:root { --a: #fff; }\na:hover > .b::before, [x="y"] ~ #c:not(.d) { margin: 0 auto !important; background: url(data:x/y;base64,AA==) ; content: "{"; }\n@media (min-width: 10px) and (max-width: 20em) { .x { width: calc(100% - 2px) } }\n@keyframes k { from { top: 0 } 50.5% { top: 1px } }\n',
    "scss": "$a: 1px !default;\n// note {\n@use 'x' as y;\n@mixin m($p, $q: 2) { width: $p; &:hover { color: red; } }\n.a { @include m(1px, $q: 3); .b & { @extend %p; margin: -$a (2 * $a); } &-c { top: 0; } }\n@if $a == 1 { .x { y: z; } } @else { .z { y: x; } }\n",
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_texts(language):
    text = VALID[language]
    found = parseability._readers.setdefault(language, parseability.Reader(language)).repairs(text)
    assert not found, [(e, text[max(0, a - 40) : a + 60]) for a, e, _ in found]


STRAY = ["<<<<<<< HEAD", "=======", ">>>>>>> feature/x", "please keep the queue cache here", "fatal: node handler not found", "Binary files a/x and b/y differ", "[queue] warning hook skipped", "diff --git a/x b/y", "@@ -7,8 +8,9 @@ worker cache", "Reading package lists... Done"]


@pytest.mark.parametrize("language, stray", list(itertools.product(sorted(VALID), STRAY)))
def test_stray_lines(language, stray):
    lines = VALID[language].split("\n")
    at = 1 if language == "php" else 2 if language == "rust" else 0
    assert parseability.verdict("\n".join([*lines[:at], stray, *lines[at:]]), language).edits > 0


@pytest.mark.parametrize("language", sorted(VALID))
def test_truncated_and_mismatched(language):
    text = VALID[language]
    opened = text.index({"php": "public function", "python": "*c, d", "scss": "($p"}.get(language, "{")) + 1
    cut = text[:opened]
    if cut.count("{") > cut.count("}") or cut.count("(") > cut.count(")"):
        v = parseability.verdict(cut, language)
        assert v.edits > 0
    for other, wrong in VALID.items():
        # style sheets are valid SCSS, JavaScript is valid TypeScript, and any text is valid outside PHP's tags
        if other != language and language != "php" and (language, other) not in {("scss", "css"), ("typescript", "javascript")}:
            assert parseability.verdict(wrong, language).edits > 0, (language, other)


def test_verdict_edge_cases():
    assert parseability.verdict("", "Go").edits == 0 and parseability.verdict(" \n", "css").edits == 0
    assert parseability.verdict(None, "go") is None and parseability.verdict("x", "cobol") is None and parseability.verdict("x", None) is None
    assert parseability.verdict("const x = '" + "y" * 200_000 + "';\n", "javascript").edits == 0
    assert parseability.verdict("(" * 5000, "javascript").edits == 5000


# Source that is valid and that a grammar easily takes for invalid, and the other way round.
VALID_MORE = [
    ('javascript', 'const a = <div className="x" {...p}>hi {name} <b/>{/* c */}</div>;\n'),
    ('javascript', 'function A() {\n  return (\n    <ul>\n      {items.map((x) => <li key={x.id}>{x.name}</li>)}\n    </ul>\n  );\n}\n'),
    ('javascript', 'const b = <>a<C d={1}>{ok ? <X/> : null}</C></>;\n'),
    ('typescript', 'const a = <Foo x={1}/>;\n'),
    ('php', '<?php if ($a) { ?>\n<b>x</b>\n<?php } ?>\n'),
    ('php', '<?php if ($a): ?>\n<b>x</b>\n<?php else: ?>\n<i></i>\n<?php endif; ?>\n'),
    ('php', '<?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif ?>\n'),
    ('php', '<ul><?php foreach ($a as $b): ?><li><?= $b ?></li><?php endforeach; ?></ul>\n'),
    ('php', '<?php if ($a) { ?>a<?php } else { ?>b<?php } ?>'),
    ('go', 'package a\n\ntype N interface {\n\t~int | ~float64\n}\n\ntype S[T ~int] struct{}\n'),
    ('typescript', 'export default interface Foo { a: number; }\n'),
    ('typescript', 'let x = <any>y;\n'),
    ('typescript', 'const f = <T>(x: T) => x;\n'),
    ('rust', 'union U { a: u32, b: f32 }\n'),
    ('css', "* + * > [a^='b' i] { color: red; }\na[b~=c], a[d|='e'], a[f$=g], a[h*='i'] {}\n"),
    ('javascript', 'a.b = 1; [x, y] = [y, x]; ({a} = b); x[0] += 2; const t = tag`x${1}`; let z;\n'),
    ('javascript', 'const r = /[(]x\\(/g;\n'),
    ('typescript', 'declare const x: number;\nconst y = `a${x}` as const;\ntype T = `a${string}`;\n'),
    ('python', 'a, *b = c\nx.y = z[0] = 1\nfor i, (j, k) in m: pass\n[a, b] = c\n(a, b) = c\nx: int = 3\nf(*a, b=1, **c)\nf(a, *b, c)\ndef f(a, b=1, *, c, d=2, **e): pass\ndef g(a, /, b): pass\nlambda x, y=1: x\nprint(x for x in y)\nf(a=1, *b)\n'),
    ('scss', '@include a;\n.b { @include c(1); @extend %d; }\n@mixin e { a: b; }\n'),
    ('javascript', 'label: for (const a of b) { continue label; }\nif (a < b && c > d) {}\n'),
    ('javascript', 'const x = a < b; const y = a<b; if (x<y) { z() }\n'),
]
INVALID_MORE = [
    ('python', '1 = x\n'),
    ('python', 'f(a=1, 2)\n'),
    ('python', 'def f(a=1, b): pass\n'),
    ('python', "x = f'{a b}'\n"),
    ('python', 'if a:\n\tb = 1\n        c = 2\n'),
    ('python', 'f() = 3\n'),
    ('javascript', '1 = 2;\n'),
    ('javascript', 'const x;\n'),
    ('javascript', 'const r = /(/;\n'),
    ('go', 'func f() {}\n'),
    ('go', 'package a\nfunc f() {}\nimport "x"\n'),
    ('scss', '.a { @include ; }\n'),
    ('typescript', "let x: number = 'a' 'b';\n"),
    ('javascript', 'const a = <div><b></div>;\n'),
    ('javascript', 'const a = <div>{x y}</div>;\n'),
    ('php', '<?php if ($a) { ?> x\n'),
    ('go', 'package a\ntype N interface { ~ | }\n'),
]


@pytest.mark.parametrize("language, text", VALID_MORE)
def test_more_valid_source(language, text):
    assert parseability.verdict(text, language).edits == 0


@pytest.mark.parametrize("language, text", INVALID_MORE)
def test_more_invalid_source(language, text):
    assert parseability.verdict(text, language).edits > 0


def test_a_mismatch_is_what_another_language_reads():
    text = "package a\n\nimport \"fmt\"\n\ntype T struct {\n\tn int\n}\n\nfunc (t *T) F(x int) int {\n\tfmt.Println(x)\n\tvar y []int = nil\n\treturn len(y) + t.n\n}\n"
    assert parseability.verdict(text, "go").edits == 0
    assert parseability.verdict(text, "php").cause is None or parseability.verdict("<?php\n" + text, "php").cause != "mismatch"
    assert parseability.verdict(text, "javascript").cause == "mismatch"


def test_invalid_files_and_rates(spark):
    good, bad = "const a = 1;\n", "const a = ;\n"
    nodes = spark.createDataFrame(
        [
            file("r/a.js", "javascript", good),
            file("r/b.js", "javascript", bad),
            file("r/b.js", "javascript", bad),
            file("r/c.js", "javascript", None),
            file("r/d.js", "python", good),
            file("r/e.js", "javascript", bad, "2025-01-01"),
            file("r/e.js", "javascript", good, "2025-02-01"),
            file("s/f.py", None, "x = (\n"),
            file(None, "python", bad),
        ],
        NODES,
    )
    import datetime as dt

    files = spark.createDataFrame([("r/d.js", "JavaScript", dt.datetime(2025, 1, 1), 1), ("r/b.js", "Javascript", dt.datetime(2025, 1, 1), 1), ("s/f.py", "PYTHON", None, 1)], "file_path string, language string, last_parsed timestamp, run_id long")
    assert rows(parseability.invalid_files(nodes, files), "file_path", "language") == [("r/b.js", "javascript"), ("s/f.py", "python")]
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in parseability.invalid_rates(nodes, files).collect()}
    assert rates == {("r", "javascript"): (4, 1), ("s", "python"): (1, 1)}
    assert parseability.invalid_files(nodes.limit(0), files.limit(0)).count() == 0


TELLING = [("/** Falls back to the previous queue. */", "x"), ("/// Idempotent; safe to call twice.", "x"), ("Prüft, ob jeder Eintrag gültig ist.", "x"), ("/**\n * @deprecated\n * @see a\n * Not thread-safe: hold the lock.\n */", "x"), ("// TrimGraph trims what no node points at.\n//\n// @return mixed", "TrimGraph"), ("Loads it.\n\nArgs:\n    a: the first\n", "x"), ("@brief Sums two parts of a whole.", "x"), ("todo list handling for the editor pane", "y")]
SILENT = [("", "x"), ("/** */", "x"), ("/**\n * @param string $a\n *   more of it\n * @return void\n */", "x"), ("/** TODO: document */", "x"), ("// Renders the index.", "renderIndex"), ("RENDER INDEX", "render_index"), ("/** {@inheritDoc} */", "x"), ("See parent.", "x"), ("// a = b(c, 1);\n// return a;", "x"), ("=====", "x"), ("Args:\n    a: str\n\nReturns:\n    bool\n", "x"), (":param a: b\n:returns: None", "x"), ("[Description]", "x"), ("N/A", "x"), ("renderIndex()", "renderIndex"), ("Parameters\n----------\nx : int\n", "f")]


@pytest.mark.parametrize("doc, name", TELLING[:-1])
def test_telling_documentation(doc, name):
    assert pairs.description(doc, name)


@pytest.mark.parametrize("doc, name", SILENT)
def test_documentation_that_says_nothing(doc, name):
    assert pairs.description(doc, name) is None


def test_documentation_in_the_text():
    code = "@dec\nasync def f(a: dict = {'k': ':'}, b=1):  # note :\n    '''Keeps what was read before.'''\n    return a\n"
    assert pairs.documentation(None, code, "python") == "Keeps what was read before."
    assert pairs.documentation("", code, "python") == ""
    assert pairs.documentation(None, "#[inline]\n/// Keeps it safe.\n#[x]\nfn f() {}", "rust") == "/// Keeps it safe."
    assert pairs.documentation(None, "fn f() { // no\n}", "rust") is None


def test_pairs_and_inheritance(spark):
    nodes = spark.createDataFrame(
        [
            ("A", "class", "A", "r/a.php", 1, 9, "php", None, None, None, 1, "z"),
            ("B", "class", "B", "r/a.php", 1, 9, "php", None, None, None, 1, "z"),
            ("C", "class", "C", "r/a.php", 1, 9, "php", None, None, None, 1, "z"),
            fn("A.run", "run", "/** Walks the queue until it is empty. */", "function run() {}"),
            fn("B.run", "run", "/** {@inheritDoc} */", "function run() {}"),
            fn("C.run", "run", "/** @inheritdoc */", "function run() {}"),
            fn("C.other", "other", "/** {@inheritDoc} */", "function other() {}"),
            fn("f", "f", None, None, "php", "function", "r/f.php", 2, 3),
            fn("g", "g", "Keeps the rest.", None, "php", "function", "r/none.php", 2, 3),
            fn("h", "h", "Keeps the rest.", "", "php", "function"),
            fn("k", "k", "Keeps the rest.", None, "php", "function", "r/f.php", 2, 3),
            fn("k", "k", "Keeps the rest.", None, "php", "function", "r/f.php", 2, 3),
            file("r/f.php", "php", "<?php\nfunction k() {\n}\n"),
        ],
        NODES,
    )
    edges = spark.createDataFrame([("A", "A.run", "contains"), ("B", "B.run", "contains"), ("C", "C.run", "contains"), ("C", "C.other", "contains"), ("B", "A", "extends"), ("C", "B", "extends"), ("A", "C", "extends")], "source_id string, target_id string, kind string")
    got = {r.id: (r.description, r.levels, r.code) for r in pairs.documented_functions(nodes, edges).collect()}
    assert set(got) == {"A.run", "B.run", "C.run", "k"}
    assert got["B.run"][:2] == ("Walks the queue until it is empty.", 1) and got["C.run"][1] == 2
    assert got["k"][2] == "function k() {\n}"
    assert pairs.documented_functions(nodes.limit(0), edges.limit(0)).count() == 0


@pytest.mark.parametrize("doc, name", [("Write some text for comments.", "writeCommentText"), ("Fill in missing details of a document.", "fillDocumentDetails")])
def test_words_of_placeholders_may_speak_of_the_code(doc, name):
    assert pairs.description(doc, name) and pairs.description(doc, "run") is None


def test_inheritance_of_any_depth_and_the_newest_delivery(spark):
    classes = [(f"C{k:02d}", "class", f"C{k}", "r/a.php", 1, 9, "php", None, None, None, 1, "z") for k in range(20)]
    methods = [fn("C00.run", "run", "/** Walks the queue until it is empty. */", "function run() {}"), fn("C19.run", "run", "/** {@inheritDoc} */", "function run() {}")]
    old = fn("f", "f", "/** Keeps the rest. */", "function f() {}")
    nodes = spark.createDataFrame([*classes, *methods, old], NODES)
    new = spark.createDataFrame([fn("f", "f", "", "function f() {}")], NODES)
    at = lambda df, day: df.withColumn("ingested_at", F.to_timestamp(F.lit(f"2025-01-0{day}")))
    edges = spark.createDataFrame([("C00", "C00.run", "contains"), ("C19", "C19.run", "contains"), *[(f"C{k:02d}", f"C{k - 1:02d}", "extends") for k in range(1, 20)]], "source_id string, target_id string, kind string")
    all_ = at(nodes, 1).unionByName(at(new, 2))
    assert {(r.id, r.levels) for r in pairs.documented_functions(all_, edges).collect()} == {("C00.run", 0), ("C19.run", 19)}
    assert rows(pairs.telling_functions(all_)) == [("C00.run",)]
    assert rows(pairs.telling_functions(at(nodes, 2).unionByName(at(new, 1)))) == [("C00.run",), ("f",)]


def hand(k=0):
    r = random.Random(k)
    return "".join(f"function {r.choice('abcdef')}{r.randrange(999)}({r.choice('xyz')}) {{\n  return {r.choice('pqr')}{r.randrange(99)} {r.choice('+-*')} {r.randrange(99)};\n}}\n" for _ in range(12))


_R = random.Random(9)
BLOB = "".join(_R.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(900))
BY_TOOL = [
    ("r/src/a.js", "// Code generated by tool v1. DO NOT EDIT.\n" + hand()),
    ("r/src/a.php", "<?php\n/** Diese Datei wurde automatisch erzeugt. */\n"),
    ("r/a_pb2.py", "x = 1\n"),
    ("r/Vendor/x/a.php", "<?php\n"),
    ("r/node_modules/x/a.js", None),
    ("r/assets/x/lib-1.2.3.js", hand()),
    ("r/src/lib.css", "/*! other v1.2.3 | (c) the other contributors | MIT License */\na { b: c; }\n"),
    ("r/src/x.js", "!function(a){a.b=[1,2]}(window);var q={a:1};" * 40),
    ("r/src/y.js", f"module.exports = '{BLOB}';\n"),
    ("r/src/z.go", "package d\n\nvar z = []int{\n" + "".join(f"\t{random.Random(k).randrange(99999)}, {random.Random(k + 500).randrange(99999)},\n" for k in range(60)) + "}\n"),
    ("r/src/u.css", "".join(f'.duleguvahukk-{k} {{ background: url("data:image/png;base64,{BLOB[60 * k : 60 * k + 60]}"); }}\n' for k in range(8))),
    ("r/dist/a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n' + hand()),
]
BY_HAND = [
    ("r/src/a.js", hand()),
    ("r/vendors/list.js", hand()),
    ("r/src/min.js", hand()),
    ("r/generator/a.py", "# Code generator for stubs: reads a parser and prints source.\nx = 1\n"),
    ("r/a.py", "# Do not edit the list without asking the group.\n"),
    ("r/b.py", "# Minified output is checked here.\n"),
    ("r/c.py", "# Copyright the r team. All rights reserved.\n"),
    ("r/d.js", "// accepted: " + " ".join(f"w{k}_x" for k in range(90)) + "\n" + hand()),
    ("r/g.py", 'def f(a):\n    """Splits one node by index, because a nested edge must never be trimmed on the second attempt."""\n    b = c.get("narrow_index", 251)\n    return d + 552\n'),
    ("r/e.js", ""),
    ("r/f.js", None),
]


@pytest.mark.parametrize("path, text", BY_TOOL)
def test_not_written_by_hand(path, text):
    assert provenance.origin(path, text or "")


@pytest.mark.parametrize("path, text", BY_HAND)
def test_written_by_hand(path, text):
    assert provenance.origin(path, text or "") is None


def test_re_pair_restores_the_sequence():
    r = random.Random(6)
    for n in (0, 1, 5, 300):
        seq = [r.randrange(4) for _ in range(n)]
        rules, rest = provenance.re_pair(list(seq))

        def expand(s):
            return expand(rules[s][0]) + expand(rules[s][1]) if s in rules else [s]

        assert [x for s in rest for x in expand(s)] == seq
    assert provenance.covered(*provenance.re_pair([1, 2, 3] * 50)) > 0.95
    assert provenance.covered(*provenance.re_pair(list(range(50)))) == 0


_NAMES = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau".split()
UNMARKED = [
    "".join(f"public static final int CODE_{k} = {k};\n" for k in range(100)),
    "".join(f"public static final int CODE_{k} = {k};\n" for k in range(300)),
    "".join(f"  public String get{x}() {{\n    return this.{x};\n  }}\n  public void set{x}(String value) {{\n    this.{x} = value;\n  }}\n" for x in _NAMES),
    "".join(f"class {x}Request:\n    def __init__(self, a, b):\n        self.a = a\n        self.b = b\n    def to_dict(self):\n        return {{'a': self.a}}\n    @classmethod\n    def from_dict(cls, d):\n        return cls(d['a'], d['b'])\n" for x in _NAMES),
    "func name(n int) string {\n\tswitch n {\n" + "".join(f'\tcase {k}:\n\t\treturn "value{k}"\n' for k in range(50)) + "\t}\n}\n",
]
SPOKEN = [
    ("r/a.py", "# Summaries are generated from the nightly report.\nx = 1\n"),
    ("r/a.js", "// Unsaved changes are lost on crash.\nconst a = 1;\n"),
    ("acme/a.js", "// Copyright (c) 2021 Globex Corporation\n" + hand()),
    ("r/a.go", "// Auto-generated ids are never reused.\npackage a\n"),
    ("r/externals/pay/client.py", hand()),
    ("r/deps/graph.py", hand()),
    ("r/names/__init__.py", "from .m import (\n" + "".join(f"    {x}{k},\n" for k in range(9) for x in _NAMES) + ")\n"),
]


@pytest.mark.parametrize("text", UNMARKED)
def test_unmarked_generated_text_is_found_by_its_grammar(text):
    assert provenance.by_grammar(text) == "generated"


@pytest.mark.parametrize("path, text", SPOKEN)
def test_comments_and_folders_that_speak_of_other_things(path, text):
    assert provenance.origin(path, text) is None


def test_random_digits_are_data():
    digits = [_R.randrange(10) for _ in range(900)]
    assert provenance.by_grammar("t = [\n" + "".join("    " + ", ".join(map(str, digits[k : k + 30])) + ",\n" for k in range(0, 900, 30)) + "]\n") == "data"


def test_a_folder_that_may_be_the_projects_own(spark):
    nodes = spark.createDataFrame(
        [file("r/external/lib/a.js", "javascript", hand(1)), file("r/external/pay/a.js", "javascript", hand(2)), file("s/vendor/lib/b.js", "javascript", hand(3)), file("s/src/c.js", "javascript", "/*! lib v1.2.3 | MIT License */\n" + hand(4))], NODES
    )
    got = {r.file_path: (r.origin, r.decided_by) for r in provenance.file_origins(nodes).collect()}
    assert got == {"r/external/lib/a.js": ("vendored", "project"), "r/external/pay/a.js": (None, None), "s/vendor/lib/b.js": ("vendored", "mark"), "s/src/c.js": ("vendored", "mark")}


def test_copies_across_repositories(spark):
    body = "".join(hand(k) for k in range(5))
    nodes = spark.createDataFrame([file("r/a.js", "javascript", "const own = 1;\n" + body), file("s/b.js", "javascript", body), file("r/c.js", "javascript", hand(99)), file("r/c.js", "javascript", hand(99)), file(None, "go", "x")], NODES)
    assert rows(provenance.not_by_hand(nodes)) == [("r/a.js", "copied"), ("s/b.js", "copied")]
    assert provenance.not_by_hand(nodes.limit(0)).count() == 0


_LICENCE_LINES = "".join(f"// Line {k} of the terms.\n" for k in range(30))
_FIELDS = "".join(f"func (m *M) Get{k}() int {{\n\tif m == nil {{\n\t\treturn 0\n\t}}\n\treturn m.f{k}\n}}\n" for k in range(12))


@pytest.mark.parametrize(
    "text",
    [
        _LICENCE_LINES + "// Code generated by tool v1. DO NOT EDIT.\n" + hand(),
        "/*\n  Code generated by tool v1.\n*/\n" + hand(),
        "// Code generated by tool v1 from " + "x" * 500 + "\n" + hand(),
        hand() + "/* This file was generated by tool v1. */\n",
        "package m\n\n" + _FIELDS,
    ],
)
def test_stated_and_repeated_at_any_place_and_length(text):
    assert provenance.origin("r/src/a.go", text) == "generated"


@pytest.mark.parametrize(
    "text",
    [
        'print("// Code generated by tool v1. DO NOT EDIT.")\nx = 1\n',
        hand() + 'T = """\n// Code generated by tool v1. DO NOT EDIT.\n"""\n',
        hand() + "// ids are generated by the store\n",
        "".join(f"export * from './m{k}';\n" for k in range(40)),
    ],
)
def test_marks_in_strings_and_plain_lists_are_by_hand(text):
    assert provenance.origin("r/src/a.py", text) is None


_BYTES = [_R.randrange(256) for _ in range(6000)]


@pytest.mark.parametrize(
    "text",
    [
        "var t = [" + ",".join(map(str, _BYTES)) + "];\n",
        "var t = [" + ",".join(str(x % 64) for x in _BYTES) + "];\n",
        "package d\nvar t = []byte{\n" + "".join(f"\t0x{a:02x}, 0x{b:02x},\n" for a, b in zip(_BYTES[:90], _BYTES[90:180])) + "}\n",
        "t = [" + ", ".join(f"{x}.5e-{x % 9}" for x in _BYTES[:90]) + "]\n",
        'T = """\n' + "\n".join(BLOB[k : k + 60] for k in range(0, 900, 60)) + '\n"""\n',
        "<?php\n$t = <<<EOT\n" + "\n".join(BLOB[k : k + 60] for k in range(0, 900, 60)) + "\nEOT;\n",
        'var t = "' + " ".join(f"{x:02x}" for x in _BYTES[:300]) + '";\n',
    ],
)
def test_data_of_any_length_and_form(text):
    assert provenance.origin("r/src/a.x", text) == "data"


def test_repeated_literals_are_no_data():
    assert not provenance.incompressible([str(k % 7) for k in range(3000)])
    assert not provenance.incompressible(["0"] * 300)
    assert provenance.origin("r/a.py", 'T = """\nThe reader takes one line at a time and keeps the rest for the next call.\n"""\n' * 9) is None


def test_copy_of_a_file_that_is_marked_elsewhere(spark):
    body = "".join(hand(k) for k in range(5))
    nodes = spark.createDataFrame([file("r/src/a.js", "javascript", body), file("s/vendor/x/b.js", "javascript", body), file("r/c.js", "javascript", hand(99))], NODES)
    assert rows(provenance.not_by_hand(nodes)) == [("r/src/a.js", "copied"), ("s/vendor/x/b.js", "vendored")]
