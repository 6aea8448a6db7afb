import random

from symgraph.llm import fusion, topn
from tests.conftest import rows

RES = "query_id long, node_id string, score double, fts_rank int, vector_similarity double, value string"


def brute(items, k=60):
    out = {}
    for q in {r[0] for r in items if r[0] is not None}:
        best = {}
        for r in items:
            if r[0] == q and r[1] is not None:
                vals = (r[2] if r[2] == r[2] else None, -r[3] if r[3] else None, r[4] if r[4] and r[4] == r[4] else None)
                old = best.get(r[1], (None, None, None))
                best[r[1]] = tuple(b if a is None else a if b is None else max(a, b) for a, b in zip(old, vals))
        for n, vals in best.items():
            s = 0
            for m, v in enumerate(vals):
                if v is not None:
                    s += 1 / (k + 1 + sum(o[m] is not None and o[m] > v for o in best.values()))
            out[q, n] = round(s, 12)
    return out


def test_fusion_matches_brute_force(spark):
    r = random.Random(4)
    items = [(q, f"n{r.randrange(12):02d}", r.choice([1.0, -5.0, 900.0, r.random(), None, float("nan")]), r.choice([0, 0, 1, 2, 7, None]), r.choice([None, 0.0, 0.5, 0.9]), "x") for q in (1, 2, None) for _ in range(30)]
    items += items[:5] + [(1, None, 1.0, 1, 1.0, "x")]
    df = spark.createDataFrame(items, RES)
    got = {(x.query_id, x.node_id): x.fused for x in fusion.fuse_search_results(df).collect()}
    want = brute(items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = {}
    for (q, n), s in want.items():
        top.setdefault(q, []).append((-s, n))
    assert rows(fusion.best_of_each_query(df)) == sorted((q, n) for q, v in top.items() for _, n in sorted(v)[:3])


def test_hot_groups_are_ranked_the_same(spark, monkeypatch):
    r = random.Random(6)
    items = [(1 if r.random() < 0.6 else r.randrange(2, 40), f"n{r.randrange(500):03d}", r.choice([1.0, 2.0, r.random(), None]), r.choice([0, 1, 2, 7]), r.choice([0.0, 0.5, 0.9]), "x") for _ in range(2000)]
    df = spark.createDataFrame(items, RES)
    want = rows(fusion.reciprocal_rank_fusion(df, "query_id", "node_id", fusion.search_measures()))
    best = rows(fusion.best_of_each_query(df))
    monkeypatch.setattr("symgraph.core.SKEW_ROWS", 20)
    usual, hot = fusion._parts(df, "query_id", "node_id", fusion.search_measures(), 60, 0)
    assert hot is not None and hot.filter("query_id = 1").count() > 100 and usual.filter("query_id = 1").isEmpty()
    assert rows(fusion.reciprocal_rank_fusion(df, "query_id", "node_id", fusion.search_measures(), small=0)) == want
    assert rows(fusion.best_of_groups(df, "query_id", "node_id", fusion.search_measures(), 3, small=0), "query_id", "node_id") == best


def test_fusion_of_nothing(spark):
    assert fusion.best_of_each_query(spark.createDataFrame([], RES)).count() == 0


def test_a_hot_tie_is_one_rank(spark):
    df = spark.createDataFrame([(1, f"n{k:03d}", 5.0, 0, None, "x") for k in range(200)], RES)
    assert rows(fusion.best_of_each_query(df)) == [(1, "n000"), (1, "n001"), (1, "n002")]


def test_top_n_matches_brute_force(spark):
    r = random.Random(5)
    data = [(r.choice([0, 0, 0, 1, None]), r.choice(["f", "m", None]), f"id{r.randrange(300)}", r.choice([0.0, 0.0, 1.0, r.random(), None, float("nan")]), k) for k in range(3000)]
    data += data[:50]
    df = spark.createDataFrame(data, "community_id int, kind string, id string, pagerank double, is_bound int").repartition(5)
    best = {}
    for c, k, i, p, _ in data:
        if c is not None and k is not None and p is not None and p == p:
            best.setdefault((c, k), {})
            best[c, k][i] = max(p, best[c, k].get(i, -1))
    want = sorted((c, k, i) for (c, k), v in best.items() for i, _ in sorted(v.items(), key=lambda x: (-x[1], x[0].encode()))[:3])
    assert rows(topn.top_n(df, ["community_id", "kind"], "pagerank", "id", 3, part_rows=100).select("community_id", "kind", "id")) == want
    assert topn.top_nodes(df.limit(0)).count() == 0
