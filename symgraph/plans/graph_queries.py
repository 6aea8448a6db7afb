"""Queries of the graph operators over the whole graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.core import cut_lineage, table
from symgraph.operators import graph, store
from symgraph.plans.registry import E, G, N, Registry

R = Registry()
QUERIES, ORACLE = R.QUERIES, R.ORACLE
_SEED = "seed AS (SELECT min(dst) AS id FROM (SELECT dst, count(*) AS c FROM g GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM g GROUP BY dst)))"


def _graph(s, d):
    return store.current_nodes(table(s, d, "nodes"), ["id"]), store.graph_edges(table(s, d, "nodes"), table(s, d, "edges"))


def _seed(g):
    """The node with the most incoming pairs, the least of equals: one row."""
    return g.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "id").limit(1).select("id")


@R.query(f"WITH RECURSIVE {G}, {_SEED}, w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT src, depth + 1 FROM w JOIN g ON dst = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def gr03_blast_nofilter(s, d):
    _, g = _graph(s, d)
    return graph.blast_radius(_seed(g), g, 3)


@R.query(f"""WITH RECURSIVE {N}, {E}, g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM e WHERE confidence >= 0.7 AND kind IN ('calls', 'imports') AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)),
    {_SEED}, w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT src, depth + 1 FROM w JOIN g ON dst = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def gr02_blast_radius(s, d):
    e = store.current_edges(table(s, d, "edges")).filter("confidence >= 0.7 and kind in ('calls', 'imports')")
    ids = store.current_nodes(table(s, d, "nodes"), ["id"])
    g = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    g = g.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return graph.blast_radius(_seed(g), g, 3)


@R.query(f"""WITH RECURSIVE {G}, {_SEED}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 2)
    SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def gr01_neighbours_both(s, d):
    _, g = _graph(s, d)
    return graph.neighbours(_seed(g), g, 2, "both")


_FAN = "seed AS (SELECT min(src) AS id FROM (SELECT src, count(*) AS c FROM g GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM g GROUP BY src)))"


@R.query(f"WITH RECURSIVE {G}, {_FAN}, w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT dst, depth + 1 FROM w JOIN g ON src = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def gr17_dependencies(s, d):
    _, g = _graph(s, d)
    fan = g.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "id").limit(1).select("id")
    return graph.neighbours(fan, g, 3, "outgoing")


@R.query(f"""WITH {N}, {E}, x AS (SELECT source_id, target_id, kind FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)),
    g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM x), {_SEED},
    l AS (SELECT target_id AS id, 0 AS way, kind, source_id AS near FROM x UNION ALL SELECT source_id, 1, kind, target_id FROM x)
    SELECT id, 1 AS depth, arg_min(kind, o) AS kind, arg_min(way = 0, o) AS outgoing FROM (SELECT *, {{'w': way, 'k': kind, 'n': near}} AS o FROM l WHERE near = (SELECT id FROM seed) AND id <> near) GROUP BY 1""")
def jn01_first_edge(s, d):
    ids, g = _graph(s, d)
    found = graph.reach(_seed(g), g, 1, True)
    return graph.connecting_edges(found, store.current_edges(table(s, d, "edges"))).select("id", "depth", "kind", "outgoing")


def _pagerank_sql(rounds: int) -> str:
    r = [f"WITH {G}, c AS (SELECT count(*)::DOUBLE AS c FROM n), o AS (SELECT src, count(*) AS deg FROM g GROUP BY 1), b AS (SELECT id, coalesce(deg, 0) AS deg FROM n LEFT JOIN o ON src = id), r0 AS (SELECT id, deg, 1.0 / c AS rank FROM b, c)"]
    for k in range(1, rounds + 1):
        r.append(f"""r{k} AS MATERIALIZED (SELECT b.id, b.deg, 0.15 / c + 0.85 * (coalesce(got, 0) + lost / c) AS rank FROM b CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) AS lost FROM r{k - 1})
            LEFT JOIN (SELECT dst AS id, sum(rank / deg) AS got FROM g JOIN r{k - 1} p ON p.id = src GROUP BY 1) x USING (id))""")
    return ", ".join(r) + f" SELECT id, round(rank, 10) AS rank FROM r{rounds}"


@R.query(_pagerank_sql(10))
def gr04_pagerank_k10(s, d):
    n, g = _graph(s, d)
    return graph.pagerank(n, g, max_iter=10, tol=0).select("id", F.round("rank", 10).alias("rank"))


@R.query(f"""WITH RECURSIVE {G}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
    c(id, component) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT b.dst, min(w.component) FROM c w JOIN b ON b.src = w.id JOIN recurring.c o ON o.id = b.dst WHERE w.component < o.component GROUP BY 1)
    SELECT id, component FROM c""")
def gr12_components(s, d):
    return graph.components(*_graph(s, d))


_STRONG = f"""WITH RECURSIVE {G}, r(a, b) AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b),
    m AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""


@R.query(_STRONG + " SELECT n.id, least(n.id, coalesce(m.component, n.id)) AS component FROM n LEFT JOIN m USING (id)")
def gr13_strong_components(s, d):
    return graph.strong_components(*_graph(s, d))


@R.query(f"""WITH RECURSIVE {G}, r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b) SELECT count(*) = 0 AS is_dag FROM r WHERE a = b""")
def gr14_is_dag(s, d):
    return s.createDataFrame([(graph.is_dag(*_graph(s, d)),)], "is_dag boolean")


@R.query(f"""WITH {G}, i AS (SELECT dst AS id, count(*) AS c FROM g GROUP BY 1), o AS (SELECT src AS id, count(*) AS c FROM g GROUP BY 1)
    SELECT count(*) AS n, sum(coalesce(o.c, 0))::BIGINT AS m, round(sum(coalesce(o.c, 0)) / (count(*)::DOUBLE * (count(*) - 1)), 9) AS density, round(avg(coalesce(i.c, 0)), 6) AS avg_degree,
      max(coalesce(i.c, 0)) AS max_in, max(coalesce(o.c, 0)) AS max_out, count(*) FILTER (coalesce(i.c, 0) = 0 AND coalesce(o.c, 0) = 0) AS isolates FROM n LEFT JOIN i USING (id) LEFT JOIN o ON o.id = n.id""")
def gr15_statistics(s, d):
    return graph.statistics(*_graph(s, d))


@R.query(f"WITH {G} SELECT id FROM n WHERE id NOT IN (SELECT src FROM g) AND id NOT IN (SELECT dst FROM g)")
def gr15_isolates(s, d):
    return graph.degrees(*_graph(s, d)).filter("in_degree = 0 and out_degree = 0").select("id")


@R.query(f"""WITH RECURSIVE {G}, {_SEED}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 1)
    SELECT src, dst FROM g WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)""")
def gr10_ego_edges(s, d):
    _, g = _graph(s, d)
    return graph.induced(graph.reach(_seed(g), g, 1, True), g)


@R.query(f"WITH {G} SELECT a.src AS a, a.dst AS b FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def gr09_two_cycles(s, d):
    _, g = _graph(s, d)
    c = graph.simple_cycles(g, 2, None).filter("length = 2")
    return c.select(F.col("cycle")[0].alias("a"), F.col("cycle")[1].alias("b"))


@R.query(f"""WITH RECURSIVE {G}, x AS (SELECT DISTINCT src, dst FROM g WHERE least(src, dst) IN (SELECT id FROM n)), w(path, src, dst) AS (SELECT [src], src, dst FROM x WHERE dst >= src
      UNION ALL SELECT list_append(w.path, x.src), x.src, x.dst FROM w JOIN x ON x.src = w.dst WHERE w.dst > w.path[1] AND NOT list_contains(w.path, w.dst) AND x.dst >= w.path[1] AND len(w.path) < 4)
    SELECT path[1] AS root, len(path)::INT AS length, array_to_string(path, ' > ') AS cycle FROM w WHERE dst = path[1]""")
def gr09_cycles(s, d):
    """All simple cycles of up to four nodes."""
    _, g = _graph(s, d)
    return graph.simple_cycles(g, 4, None).select(F.col("cycle")[0].alias("root"), "length", F.array_join("cycle", " > ").alias("cycle"))


@R.query()
def gr09_first_cycles(s, d):
    """The hundred shortest simple cycles of up to ten nodes."""
    _, g = _graph(s, d)
    return graph.simple_cycles(g, 10, 100).select("length", F.array_join("cycle", " > ").alias("cycle"))


@R.query()
def gr06_communities(s, d):
    return graph.communities(*_graph(s, d))


@R.query()
def gr06_label_propagation(s, d):
    _, g = _graph(s, d)
    e = g.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return graph.label_propagation(e)


@R.query()
def gr06_modularity(s, d):
    ids, g = store.numbered_graph(table(s, d, "nodes"), table(s, d, "edges"))
    return graph.modularity(g, graph.communities(ids.select(F.col("number").alias("id")), g))


@R.query(f"""WITH {G}, {_SEED}, c AS (SELECT count(*)::DOUBLE AS c FROM n), o AS (SELECT src, count(*) AS deg FROM g GROUP BY 1), b AS (SELECT id, coalesce(deg, 0) AS deg, CASE WHEN id = (SELECT id FROM seed) THEN 1.0 ELSE 0.0 END::DOUBLE AS j FROM n LEFT JOIN o ON src = id),
    r0 AS (SELECT id, 1.0 / c AS rank FROM b, c), """ + ", ".join(f"""r{k} AS MATERIALIZED (SELECT b.id, 0.15 * j + 0.85 * (coalesce(got, 0) + lost * j) AS rank FROM b CROSS JOIN (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) AS lost FROM r{k - 1} JOIN b USING (id))
        LEFT JOIN (SELECT dst AS id, sum(rank / deg) AS got FROM g JOIN r{k - 1} p ON p.id = src JOIN b ON b.id = src GROUP BY 1) x USING (id))""" for k in range(1, 6)) + " SELECT id, round(rank, 10) AS rank FROM r5")
def gr04_personalised(s, d):
    """Five rounds with all jumps to the node of the highest in-degree."""
    n, g = _graph(s, d)
    return graph.pagerank(n, g, max_iter=5, tol=0, personal=_seed(g).withColumn("weight", F.lit(1.0))).select("id", F.round("rank", 10).alias("rank"))


def _betweenness(n, g, exact: int = 10_000, k: int = 500):
    """(id, betweenness) from all sources up to ``exact`` nodes, from ``k`` seeded ones above; normalised.

    Scores are divided by the (n - 1)(n - 2) ordered pairs of other nodes; those of a sample are
    multiplied by n / k, which estimates the scores from all sources.
    """
    n = cut_lineage(n.select("id").distinct())
    count = n.count()
    sources = n if count <= exact else n.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(k)
    scale = count / min(count, k) if count > exact else 1.0
    if count > 2:
        scale /= (count - 1) * (count - 2)
    return graph.betweenness(n, g, sources).select("id", (F.col("betweenness") * scale).alias("betweenness"))


@R.query()
def gr05_betweenness(s, d):
    return _betweenness(*_graph(s, d))


@R.query(f"""WITH RECURSIVE {G}, {_SEED}, far AS (SELECT max(src) AS id FROM g),
    w(id, depth) USING KEY (id) AS (SELECT id, 0 FROM far UNION SELECT dst, min(w.depth) + 1 FROM w JOIN g ON src = w.id WHERE NOT EXISTS (SELECT 1 FROM recurring.w o WHERE o.id = dst) GROUP BY 1)
    SELECT coalesce((SELECT depth FROM w WHERE id = (SELECT id FROM seed)), -1)::INT AS steps""")
def gr08_shortest_path(s, d):
    _, g = _graph(s, d)
    ends = g.agg(F.max("src")).first()[0], (_seed(g).first() or [None])[0]
    path = graph.shortest_path(g, *ends) if None not in ends else None
    return s.createDataFrame([(len(path) - 1 if path else -1,)], "steps int")
