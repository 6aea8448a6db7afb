import json

import pytest
from pyspark.sql import functions as F

from symgraph import config
from symgraph.operators import matching, search, serve
from tests.conftest import rows

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, docblock string, start_line int, end_line int, pagerank double, community_id int"


def node(id_, kind, name, rank=0.1, doc=None, path="r/a.php"):
    return (id_, kind, name, "App\\" + name, path, "php", doc, 1, 9, rank, 1)


@pytest.fixture(scope="module")
def graph_of(spark):
    nodes = [node("q", "class", "Queue", 0.5, "/** Walks the frozen items. */"), node("m", "method", "pop", 0.4), node("n", "method", "push", float("nan")), node("b", "class", "Batch", 0.3), node("f", "function", "queueAll", 0.2, None, "r/b.php"), node("x", "class", "Queue_2", None)]
    edges = [("q", "m", "contains", 1.0, 1), ("q", "n", "contains", 1.0, 1), ("b", "q", "calls", 0.9, 4), ("f", "b", "calls", 0.8, 2), ("q", "q", "calls", 0.9, 4)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "source_id string, target_id string, kind string, confidence double, line_number int")


def test_node_search(graph_of):
    n, _ = graph_of
    assert {r.id for r in search.search_nodes(n, "queue").collect()} == {"q", "f", "x"}
    assert rows(search.search_nodes(n, "queue", kind="function"), "id") == [("f",)]
    assert [r.id for r in search.search_nodes(n, "ueue").orderBy("tier").collect()] == ["f", "q", "x"] or {r.tier for r in search.search_nodes(n, "ueue").collect()} == {3}
    assert rows(search.search_nodes(n, "e_2"), "id", "tier") == [("x", 3)]  # the sign is no wildcard
    for q in ("", "  ", "%", "a.b"):
        assert search.search_nodes(n, q).count() == 0
    assert search.search_nodes(n.limit(0), "queue").count() == 0


def test_symbols(graph_of):
    n, _ = graph_of
    assert [r.id for r in search.resolve_symbol(n, "App\\Queue").orderBy("place").collect()][0] == "q"
    assert [r.id for r in search.resolve_symbol(n, "queue").orderBy("place").collect()][0] == "q"
    assert search.resolve_symbol(n, "nothing_at_all").count() == 0


def test_symbol_context_keeps_its_budget(graph_of):
    n, e = graph_of
    got = serve.symbol_context(n, e, "App\\Queue").orderBy("place").collect()
    assert [(r.part, r.id) for r in got] == [("definition", "q"), ("relation", "b"), ("near", "m"), ("near", "n"), ("far", "f")]
    assert got[0].text == "- **class** `Queue` (r/a.php:1-9) - Walks the frozen items."
    assert serve.symbol_context(n, e, "no such thing").count() == 0
    wide = n.withColumn("docblock", F.when(F.col("id") == "b", F.repeat(F.lit("word "), 900)).otherwise(F.col("docblock")))
    assert "b" not in {r.id for r in serve.symbol_context(wide, e, "App\\Queue", 500).collect()}


def test_routes(spark):
    r = spark.createDataFrame([("r1", "GET /users/{id}", None, "GET"), ("r2", "x", "/api/users", "POST"), ("r3", "y", "/other", "GET")], "id string, name string, url string, method string")
    assert rows(serve.find_routes(r, "users"), "id") == [("r1",), ("r2",)]
    assert rows(serve.find_routes(r, "/api/*"), "id") == [("r2",)] and rows(serve.find_routes(r, "users", "post"), "id") == [("r2",)]
    e = spark.createDataFrame([("r2", "h9", "routes_to", 1.0, 7), ("r2", "h1", "routes_to", 1.0, 3), ("c", "h1", "api_calls", 0.5, 1), ("c", "r2", "api_calls", 0.9, 1)], "source_id string, target_id string, kind string, confidence double, line_number int")
    assert rows(serve.route_handlers(r, e)) == [("r1", "r1"), ("r2", "h1"), ("r3", "r3")]
    assert rows(serve.route_callers(r, e)) == [("r2", "c", 0.9)]


def test_stored_index_follows_changes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "frozen queue"), (2, "frozen"), (3, "nothing"), (4, None), (5, "")], "id long, text string")
    index = search.TextIndex(spark, str(tmp_path / "index"))
    index.build(docs, "id", F.col("text"))
    assert {r.id for r in index.search(["froz"]).collect()} == {1, 2}
    change = spark.createDataFrame([(2, "other"), (6, "frozen again"), (1, None)], "id long, text string")
    index.update(change, "id", F.col("text"), spark.createDataFrame([(3,), (99,)], "id long"))
    want = search.postings(spark.createDataFrame([(2, "other"), (6, "frozen again"), (5, "")], "id long, text string"), "id", F.col("text"))
    assert rows(index.postings(), "term", "id", "tf", "doc_len") == rows(want, "term", "id", "tf", "doc_len")
    assert [r.id for r in index.search(["frozen"]).collect()] == [6] and index.search(["frozen"], among=docs.select("id")).count() == 0


def test_hybrid_and_vectors(spark):
    docs = spark.createDataFrame([(1, "frozen", "a"), (2, "frozen queue", "b"), (3, "none", "a")], "id long, text string, source string")
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0])], "id long, embedding array<double>")
    find = lambda alpha, **k: [r.id for r in search.hybrid_search(docs, "id", F.col("text"), v, ["frozen"], [1.0, 0.0], 2, alpha, **k).orderBy(F.col("score").desc(), "id").collect()]
    assert find(1.0) == [3, 2] and find(0.0) == [1, 2]
    assert find(1.0, keep=F.col("source") == "b") == [2] and find(1.0, keep=F.col("source") == "a", before=True) == [3, 1]
    assert search.checked_vectors(v, "id").count() == 3 and search.checked_vectors(v.limit(0), "id").count() == 0
    for bad in ([(4, [1.0])], [(1, [0.0, 1.0])], [(5, None)]):
        with pytest.raises(ValueError):
            search.checked_vectors(v.unionByName(spark.createDataFrame(bad, v.schema)), "id")


def test_links_keep_known_edges(spark):
    n = spark.createDataFrame([("m1", "class", "User"), ("h1", "hook", "useX")], "id string, kind string, name string")
    e = spark.createDataFrame([("a", "b"), ("a", "__unresolved__:model:User"), ("__unresolved__:hook:useX", "__unresolved__:model:None"), (None, "b")], "source_id string, target_id string")
    assert rows(matching.link_far(e, n)) == sorted([("a", "b"), ("a", "m1"), ("h1", "__unresolved__:model:None"), (None, "b")], key=repr)


def test_markdown_export(graph_of):
    n, _ = graph_of
    full = {r.file_path: r.text for r in serve.export_markdown(n).collect()}
    assert set(full) == {"r/a.php", "r/b.php"} and full["r/b.php"] == "## r/b.php\n- **function** `queueAll` (r/b.php:1-9)"
    assert rows(serve.export_markdown(n, "symbol", "pop"), "file_path") == [("r/a.php",)]
    assert rows(serve.export_markdown(n, budget=20), "file_path") == [("r/b.php",)] and serve.export_markdown(n, budget=0).count() == 0
    with pytest.raises(ValueError):
        serve.export_markdown(n, "none")


def test_settings(tmp_path):
    assert config.load()["search"] == {"limit": 20, "alpha": 0.5}
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"search": {"alpha": 0.9, "limit": None}, "languages": ["go"]}))
    got = config.load(str(p), context={"budget": 9})
    assert got["search"] == {"limit": 20, "alpha": 0.9} and got["languages"] == ["go"] and got["context"] == {"budget": 9}
    for bad in ({"search": {"alpha": 2}}, {"languages": ["cobol"]}, {"nothing": 1}, {"languages": "go"}, {"context": {"budget": 0}}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(str(p))
