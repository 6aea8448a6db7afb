import random

import pytest

from symgraph.llm import canonical, contamination, tokens
from tests.conftest import rows

DOCS = "doc_id long, text string, same string, id int"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)


SAME = [
    ("nested field", "ｎｅｓｔｅｄ ﬁeld"),
    ("café Größe", "cafe\u0301 Gro\u0308ße"),
    ("ledger", "led\u200cger\ufeff"),
    ("The cat", "Τhe сat"),
    ("a b", "a\u00a0b"),
    ("でdata", "て\u3099data"),
    ("x\ny", "x\r\ny"),
    ("ガード", "ｶﾞｰﾄﾞ"),
]
OTHER = [("x2", "x²"), ("cafe", "café"), ("Case", "case"), ("a  b", "a b"), ("a-b", "a b"), ("½", "1/2"), ("👩\u200d💻", "👩💻")]


@pytest.mark.parametrize("a, b", SAME)
def test_what_looks_the_same_is_the_same(spark, a, b):
    assert rows(canonical.look_alike_pairs(docs(spark, [a, b]))) == [(0, 1)]


def test_what_differs_to_a_reader_stays_apart(spark):
    texts = [t for p in OTHER for t in p]
    forms = [r.canonical for r in canonical.canonical_texts(docs(spark, texts)).orderBy("doc_id").collect()]
    for k in range(0, len(texts), 2):
        assert forms[k] != forms[k + 1], texts[k]


def test_more_scripts():
    import duckdb

    sql = f"SELECT {canonical.canonical_sql()} FROM part"
    for a, b in [("Ӏ", "I"), ("Ү", "Y"), ("Ѵ", "V"), ("Ԍ", "G"), ("Ϲ", "C"), ("Ⅻ", "XII"), ("ⅳ", "iv"), ("ɡ", "g"), ("ɑ", "a"), ("ℓ", "l"), ("հո", "hn"), ("ᎪᏴ", "AB"), ("ꓐꓮ", "BA"), ("a\u2010b\u2011c\u2212d", "a-b-c-d")]:
        con = duckdb.connect()
        con.execute("CREATE TABLE part AS SELECT ? AS text", [a])
        assert con.execute(sql).fetchall() == [(b,)]


def test_classes_say_what_the_pairs_say(spark, monkeypatch):
    r = random.Random(3)
    forms = ["ledger", "led\u200cger", "ｌedger", "café", "cafe\u0301", "alone", "alone", "", None]
    texts = [r.choice(forms[:3] if k % 2 else forms) for k in range(120)]
    df = docs(spark, texts)
    pairs = rows(canonical.look_alike_pairs(df))
    classes = {x.doc_id: x for x in canonical.look_alike_classes(df).collect()}
    same = lambda a, b: a in classes and b in classes and classes[a]["class"] == classes[b]["class"]
    assert pairs == sorted(((a, b) for a in range(120) for b in range(a + 1, 120) if same(a, b) and texts[a] != texts[b]), key=repr)
    assert all(texts[k] not in (None, "", "alone") for k in classes)
    first = [k for k in range(120) if texts[k] in forms[:3]]
    assert {(classes[k]["class"], classes[k]["size"], classes[k]["forms"]) for k in first} == {(min(first), len(first), 3)}
    # a form that most documents have is dealt out to many tasks, and gives the same pairs
    monkeypatch.setattr("symgraph.core.SKEW_ROWS", 10)
    assert rows(canonical.look_alike_pairs(df, small=0)) == pairs


def test_canonical_edge_cases(spark):
    df = docs(spark, [None, "", " \n\t", "\u200b", "abc", "abc", "ａbc", "long " * 50_000])
    assert [r.canonical for r in canonical.canonical_texts(df).orderBy("doc_id").collect()][:2] == [None, ""]
    assert rows(canonical.look_alike_pairs(df)) == [(4, 6), (5, 6)]
    assert canonical.look_alike_pairs(df.limit(0)).count() == 0
    form = canonical.canonical_texts(docs(spark, [b for _, b in SAME]))
    again = canonical.canonical_texts(form.withColumnRenamed("canonical", "text"))
    assert rows(form) == rows(again)


def test_tokens_match_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokens.default_tokenizer()
    ranks = tokens.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["", "a", "def f(x):\n    return x  # why\n", "naïve Größe — 日本語", "🏳️‍🌈" * 9, "z" * 4000, "ab" * 300, "<|endoftext|>", "".join(r.choice("abcé \n\t9") for _ in range(20_000))]
    got = {x.doc_id: x.ids for x in tokens.encode_corpus(docs(spark, [None, *texts])).collect()}
    assert got[0] == [] and all(got[k + 1] == own.encode_ordinary(t) for k, t in enumerate(texts))
    for _ in range(200):
        w = bytes(r.randrange(256) for _ in range(r.randrange(1, 40)))
        back = {v: k for k, v in ranks.items()}
        assert tokens._encode_long(w, ranks) == tokens.encode_word(w, ranks)
        assert b"".join(back[i] for i in tokens.encode_word(w, ranks)) == w
    assert tokens.encode_corpus(docs(spark, ["a"]).limit(0)).count() == 0


ITEM = "Given that the frozen queue was pruned by some worker before every dangling ledger may scan the nested basket twice while a route resolves quietly and no hook is left behind"


def leaks(spark, *texts):
    items = spark.createDataFrame([(7, "s", ITEM), (7, "s", ITEM), (8, "s", "too short to count"), (9, "s", None)], "item_id long, suite string, text string")
    return {r.doc_id for r in contamination.leaked_passages(docs(spark, texts), items).collect()}


def test_passages_however_written(spark):
    w = ITEM.split()
    part = w[3:23]
    changed = [*part[:7], "altered", *part[8:]]
    wrapped = "/**\n * " + "\n * ".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4)) + "\n */"
    found = [
        ITEM,
        "before " + " ".join(part) + " after",
        ITEM.upper(),
        wrapped,
        " ".join(changed),
        "**" + "** **".join(part) + "**",
        "  ".join(part).replace(" ", "\u00a0"),
        ITEM.replace("o", "о").replace("a", "а"),
        ITEM.replace(" ", "\\n"),
        "&quot;".join([" ".join(part), ""]),
        " ".join(w[:10] + ["put", "in"] + w[10:]),
        "filler " * 20_000 + " ".join(part),
    ]
    assert leaks(spark, *found) == set(range(len(found)))


def test_what_holds_no_passage(spark):
    w = ITEM.split()
    every = [x if k % 5 else "altered" for k, x in enumerate(w)]
    clean = [None, "", " ".join(w[:14]), " ".join(every), "Given that the frozen queue is new", " ".join(reversed(w))]
    assert leaks(spark, *clean) == set()


def test_blocks_give_the_same(spark):
    items = spark.createDataFrame([(k, f"item number {k} " + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(30)], "item_id long, text string")
    d = docs(spark, [r.text for r in items.collect()[:10]])
    one = rows(contamination.leaked_passages(d, items), "doc_id", "item_id")
    assert one == rows(contamination.leaked_passages(d, items, block_chars=500), "doc_id", "item_id") == [(k, k) for k in range(10)]
    assert contamination.without_leaks(d, items.limit(0)).count() == 10 and contamination.without_leaks(d, items).count() == 0


@pytest.mark.parametrize("mode", ["replace", "insert", "delete", "mixed"])
def test_recall_of_edited_passages(mode):
    r = random.Random(mode)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = {k: [word() for _ in range(r.randrange(20, 90))] for k in range(60)}
    index = contamination.EvalIndex([(k, " ".join(w)) for k, w in items.items()])
    missed, n = 0, 300
    for _ in range(n):
        k, w = r.choice(list(items.items()))
        size = r.randrange(20, min(40, len(w)) + 1)
        at = r.randrange(len(w) - size + 1)
        p = w[at : at + size]
        for q in sorted(r.sample(range(1, size - 1), size // 10), reverse=True):
            how = r.choice(["replace", "insert", "delete"]) if mode == "mixed" else mode
            p[q : q + (how != "insert")] = [] if how == "delete" else ["edited"]
        text = " ".join([word() for _ in range(r.randrange(40))] + p + [word() for _ in range(r.randrange(40))])
        missed += k not in {x[0] for x in index.leaks(text)}
    assert missed <= n * 0.02


def test_too_many_edits_are_no_passage():
    r = random.Random(2)
    w = [f"w{k}" for k in range(60)]
    index = contamination.EvalIndex([(1, " ".join(w))])
    for how in ("insert", "delete"):
        for _ in range(50):
            p = w[10:30]
            for q in range(18, 0, -6):  # three edits in twenty words
                p[q : q + (how != "insert")] = [] if how == "delete" else ["edited"]
            assert index.leaks(" ".join(["x"] * 9 + p + ["y"] * 9)) == []


def test_spans_are_cut_from_the_raw_text(spark):
    w = ITEM.split()
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    wrapped = "keep  this\n/*\n * " + "\n * ".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4)) + "\n */ and this"
    twice = "one " + " ".join(w[:20]) + " two " + " ".join(w[:20]) + " three"
    texts = [wrapped, twice, ITEM, "nothing here", None, "", '<b title="a b">x</b> ' + " ".join(w[5:25])]
    got = {r.doc_id: (r.text, r.same) for r in contamination.without_spans(docs(spark, texts), items).collect()}
    assert got[0][0].startswith("keep  this") and got[0][0].endswith("*/ and this") and "frozen" not in got[0][0]
    assert got[1][0].split() == ["one", "two", "three"] and got[2][0] == ""
    assert [got[k] for k in (3, 4, 5)] == [("nothing here", "x"), (None, "x"), ("", "x")]
    assert got[6][0].strip() == '<b title="a b">x</b>'
    for t in texts:
        assert [x[0] for x in contamination.words_at(t or "")] == contamination.words(t or "")


@pytest.mark.parametrize("wrong, good", [([False] * 14, False), ([False] * 15, True), ([False] * 7 + [True] + [False] * 7, True), (([False] * 4 + [True]) * 6, False), ([True] * 9 + [False] * 15, True)])
def test_window(wrong, good):
    assert (contamination._window(wrong) is not None) == good
