import datetime as dt
import random

from pyspark.sql import functions as F

from symgraph import core, schemas
from symgraph.functions import scalars as S
from symgraph.operators import context, history, matching, search, store
from tests.conftest import rows


def test_vocabulary():
    assert len(schemas.NODE_KINDS) == 41 and len(schemas.EDGE_KINDS) == 50


def test_resolution_tiers(spark):
    nodes = spark.createDataFrame([("1", "App\\User"), ("2", "App\\User::getName"), ("3", "Lib\\Deep\\Tool"), ("4", "A\\Same"), ("5", "B\\Same"), ("6", "App\\User"), ("7", None)], "id string, qualified_name string")
    refs = spark.createDataFrame([("s", "calls", x) for x in ("App\\User", "\\App\\User", "Deep\\Tool", "getName", "Same", "Nope", "\\", None)], "source_id string, kind string, name string")
    got = {r.name: (r.target_id, r.tier, r.confidence) for r in matching.resolve(refs, nodes).collect()}
    assert got["App\\User"] == ("6", "exact", 1.0)
    assert got["Deep\\Tool"] == ("3", "suffix", 0.85)
    assert got["getName"] == ("2", "short", 0.7)
    assert got["Same"][1:] == ("placeholder", 0.3) and got["Nope"][0].startswith("ext:")
    assert set(got) == {"App\\User", "Deep\\Tool", "getName", "Same", "Nope"}


def test_near_texts_loses_nothing(spark):
    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
        return d[-1]

    xs = ["/api/users", "/api/user", "/apj/usres", "", "a", "ab", "/v1/items/list", "/v1/itemslist"]
    ys = ["/api/users", "/api/uxers/", "abc", "b", "", "/v1/items/lost", "/v2/item/list"]
    df = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {(r.x, r.y): r.dist for r in matching.near_texts(df(xs, "x"), df(ys, "y"), 3).collect()}
    assert got == {(x, y): lev(x, y) for x in xs for y in ys if lev(x, y) <= 3}


def _edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_near_texts_of_any_length_and_distance(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(15)))
    df = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    xs, ys = [*{word() for _ in range(90)}, None], [*{word() for _ in range(90)}, None]
    for d in (0, 1, 2, 3):
        got = [tuple(x) for x in matching.near_texts(df(xs, "x"), df(ys, "y"), d).collect()]
        assert len(got) == len(set(got)) and set(got) == {(x, y, _edits(x, y)) for x in xs[:-1] for y in ys[:-1] if _edits(x, y) <= d}


def test_near_texts_broadcasts_no_pieces(spark, tmp_path):
    """The planner counts the texts, not their pieces, and sent the pieces of few texts to the driver to broadcast them."""
    for c, k in (("x", 7), ("y", 11)):
        spark.range(100).select(F.md5((F.col("id") * k).cast("string")).alias(c)).write.parquet(str(tmp_path / c))
    near = matching.near_texts(*(spark.read.parquet(str(tmp_path / c)) for c in "xy"), 3)
    near.write.parquet(str(tmp_path / "out"))
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan.split("Initial Plan")[0] and "BroadcastExchange" not in plan.split("Initial Plan")[0]


def test_match_calls(spark):
    e = spark.createDataFrame([("e1", "GET", "/users/{id}"), ("e2", "POST", "/users"), ("e3", "ANY", "/a/b/c/d"), ("e4", "GET", "/orders/list/all")], "endpoint_id string, method string, path string")
    c = spark.createDataFrame([("exact", "POST", "/users?x=1", 1.0), ("param", "GET", "/users/${id}", 0.8), ("prefix", "GET", "https://h/a/b/c", 1.0), ("fuzzy", "UNKNOWN", "/orders/lists/all", 1.0), ("verb", "PUT", "/users", 1.0), ("none", "GET", "/zzz", 1.0)], "call_id string, method string, url string, confidence double")
    got = {r.call_id: (r.endpoint_id, r.strategy) for r in matching.match_calls(c, e).collect()}
    assert got == {"exact": ("e2", "exact"), "param": ("e1", "parameterized"), "prefix": ("e3", "prefix"), "fuzzy": ("e4", "fuzzy")}


def test_interval_nearest_and_as_of(spark):
    iv = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("g", 1, 5, "g")], "file string, start int, end int, owner string")
    p = spark.createDataFrame([("f", 15), ("f", 50), ("f", 200), ("h", 1)], "file string, line int")
    assert rows(matching.enclosing(p, iv, "file", width=8)) == [("f", 15, "inner"), ("f", 200, None), ("f", 50, "outer"), ("h", 1, None)]
    assert matching.all_enclosing(p, iv, "file").count() == 3
    m = spark.createDataFrame([("f", 13, "a"), ("f", 17, "b"), ("f", 60, "c")], "file string, at int, owner string")
    assert rows(matching.nearest(p, m, "file", "line", "at", 2, 2)) == [("f", 15, "a"), ("f", 200, None), ("f", 50, None), ("h", 1, None)]
    assert rows(matching.as_of(p, m, "file", "line", "at", "owner")) == [("f", 15, "a"), ("f", 200, "c"), ("f", 50, "b"), ("h", 1, None)]


def test_store_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq int")
    assert rows(store.upsert(old, new, ["id"])) == [("a", 1), ("b", 4), ("c", 5)]
    nodes = spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, file_path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "b")], "source_id string, target_id string")
    n, e = store.delete_file(nodes, edges, spark.createDataFrame([("f1",)], "file_path string"))
    assert rows(n, "id") == [("b",)] and rows(e) == [("b", "b")]


def test_group_limit_and_keep_last(spark):
    df = spark.createDataFrame([("g", k % 3, k) for k in range(30)] + [(None, None, None)], "g string, s int, id int")
    got = core.group_limit(df, ["g"], [F.col("s").desc_nulls_last(), F.col("id")], 4, 5)
    assert rows(got.filter("g is not null"), "id") == [(11,), (2,), (5,), (8,)]
    assert rows(core.keep_last(df, ["g"], [F.col("id")]), "g", "id") == [("g", 29), (None, None)]


def test_history(spark):
    d = lambda n: dt.datetime(2025, 1, n)
    c = [(f"h{k}", "ann" if k < 2 else "bob", d(k + 1), p, 1, 0) for k in range(4) for p in ("x", "y")] + [(f"big{k}", "ann", d(9), f"p{k}", 1, 1) for k in range(3)] + [("huge", "ann", d(9), f"q{k}", 1, 1) for k in range(51)]
    commits = spark.createDataFrame(c, "hash string, author string, date timestamp, path string, added int, deleted int")
    m = {r.path: r for r in history.file_metrics(commits, dt.date(2025, 2, 1)).collect()}
    assert (m["x"].commits, m["x"].authors, m["x"].main_author, m["x"].share, m["x"].churn) == (4, 2, "ann", 0.5, 4)
    pairs = rows(history.co_changes(commits), "a", "b", "together", "confidence", "jaccard")
    assert pairs == [("x", "y", 4, 1.0, 1.0)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "queue of frozen items"), (2, "frozen"), (3, "nothing"), (4, None), (5, "")], "id long, text string").filter("text is not null")
    got = [r.id for r in search.search(docs, "id", F.col("text"), ["froz", "queue"]).collect()]
    assert got == [1, 2]
    assert search.search(docs.limit(0), "id", F.col("text"), ["x"]).count() == 0
    t = spark.createDataFrame([(1, "a\nb Panic\nc"), (2, "x"), (3, None)], "id long, text string")
    assert rows(search.grep(t, "id", "text", "panic", context=1), "id", "line", "code") == [(1, 2, "b Panic")]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.vector_search(v, [1.0, 0.1], 5).collect()] == [1, 2]


def test_budget_fold_passes_over_what_is_too_large(spark):
    df = spark.createDataFrame([("g", k, t, f"i{k}") for k, t in enumerate([40, 80, 30, 30, 5])], "g string, o int, t int, i string")
    assert [r.i for r in context.fold_budget(df, ["g"], [F.col("o")], "t", "i", 100).orderBy("place").collect()] == ["i0", "i2", "i3"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(S.query_expression(F.lit("HttpKernel (x)"))) == "Http* OR Kernel* OR HttpKernel* OR x*"
    assert one(S.route_of_file(F.lit("web/app/(shop)/items/[id]/page.tsx"))) == "/items/[id]"
    assert one(S.route_of_file(F.lit("web/pages/blog/index.js"))) == "/blog"
    assert one(S.common_prefix(F.array(F.lit("a/b/c"), F.lit("a/b/d")))) == "a/b"
    assert one(S.component_name(F.lit("src/user-card/index.vue"))) == "UserCard"
    assert one(S.language_of(F.lit("x/y.blade.php"))) == "php" and one(S.language_of(F.lit("README"))) is None
    ignored = S.glob_to_regex(["**/node_modules/**", "**/*.min.js"])
    assert [one(F.lit(p).rlike(ignored)) for p in ("a/node_modules/x.js", "node_modules/x.js", "b/c.min.js", "src/minor.js")] == [True, True, True, False]


def test_budget_takes_every_item_that_fits(spark):
    items = [("a", k, 3, f"i{k}") for k in range(300)] + [("a", 400, 200, "large"), ("a", 401, 100, "last"), (None, 1, 7, "x"), ("b", 1, None, "y")]
    df = spark.createDataFrame(items, "g string, o int, t int, i string")
    got = context.fold_budget(df, ["g"], [F.col("o")], "t", "i", 1000).orderBy("g", "place").collect()
    assert [r.i for r in got] == ["x"] + [f"i{k}" for k in range(300)] + ["last"] and got[-1].place == 300


def test_many_vector_searches_equal_single_ones(spark):
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(45)] + [(45, None)], "vec_id int, embedding array<double>")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = search.vector_search_many(v, q, 4, block=2).collect()
    for r in q.collect():
        want = [(x.vec_id, x.similarity) for x in search.vector_search(v, list(r["query"]), 4).collect()]
        assert [(x.vec_id, x.similarity) for x in sorted((x for x in got if x.query_id == r.query_id), key=lambda x: (-x.similarity, x.vec_id))] == want
