"""Queries of search as users run it and of assembled answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.core import cut_lineage, table
from symgraph.operators import graph, history, search, serve, store
from symgraph.plans.match_queries import _TOK
from symgraph.plans.registry import E, G, N, Registry
from symgraph.schemas import ENTRY_WEIGHTS

R = Registry()
QUERIES, ORACLE = R.QUERIES, R.ORACLE
_LIGHT = ["id", "kind", "name", "qualified_name", "file_path", "language", "docblock", "start_line", "end_line", "pagerank", "community_id"]
_RANK = "CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END"


def _nodes(s, d):
    return store.current_nodes(table(s, d, "nodes"), _LIGHT)


def _edges(s, d):
    return store.current_edges(table(s, d, "edges"))


def _search_sql(terms, where="true"):
    """BM25 over name, qualified name and docblock of the current nodes, in SQL; scores count all nodes."""
    text = "concat_ws(' ', name, regexp_replace(qualified_name, '[\\\\:./]+', ' ', 'g'), docblock)"
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""t AS (SELECT id, kind, language, {_TOK.replace('lower(text)', f'lower({text})')} AS t FROM n), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
        p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM t WHERE {where}), h AS (SELECT id, l, q, count(*) AS tf FROM p, (VALUES {values}) v(q) WHERE starts_with(term, q) GROUP BY ALL), df AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
        s AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN df USING (q), st GROUP BY 1)"""


@R.query(f"WITH {N}, {_search_sql(['queue', 'walks'], where='''kind = 'class' ''')} SELECT id, score, 0 AS tier FROM s ORDER BY score DESC, id LIMIT 20")
def se01_kind(s, d):
    return search.search_nodes(_nodes(s, d), "queue walks", 20, "class")


@R.query(f"WITH {N}, {_search_sql(['queue', 'walks'])} SELECT id, kind, score FROM n JOIN (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) s USING (id)")
def jn04_hits_with_nodes(s, d):
    n = _nodes(s, d)
    return search.search_nodes(n, "queue walks", 20).join(n.select("id", "kind"), "id").select("id", "kind", "score")


@R.query(f"""WITH {N} SELECT id, 0.0::DOUBLE AS score, CASE WHEN lower(name) = 'a.php' THEN 1 WHEN name ILIKE 'a.php%' THEN 2 ELSE 3 END::INT AS tier FROM n WHERE name ILIKE '%a.php%'
    ORDER BY tier, {_RANK} DESC NULLS LAST, id LIMIT 20""")
def se01_signs_go_to_like(s, d):
    return search.search_nodes(_nodes(s, d), "a.php", 20)


@R.query(f"""WITH {N}, f AS (SELECT * FROM n WHERE name ILIKE '%ankqueu%')
    SELECT id, 0.0::DOUBLE AS score, CASE WHEN lower(name) = 'ankqueu' THEN 1 WHEN name ILIKE 'ankqueu%' THEN 2 ELSE 3 END::INT AS tier FROM f ORDER BY tier, {_RANK} DESC NULLS LAST, id LIMIT 20""")
def se01_like_fallback(s, d):
    """No term begins so: names that hold it."""
    return search.search_nodes(_nodes(s, d), "ankQueu", 20)


@R.query(f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN text || ' frozenmark' ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 7),
    t AS (SELECT id, {_TOK} AS t FROM d), p AS (SELECT id, len(t)::INT AS doc_len, unnest(t) AS term FROM t) SELECT term, count(DISTINCT id) AS docs, count(*) AS n FROM p GROUP BY 1""")
def se02_delta(s, d):
    """A stored index after a change of every tenth and a deletion of every tenth document: the postings of the documents as they then are."""
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", "text")
    at = _folder(s, "se02_delta")
    index = search.TextIndex(s, at)
    index.build(docs, "doc_id", F.col("text"))
    changed = docs.filter("doc_id % 10 = 3").select("doc_id", F.concat("text", F.lit(" frozenmark")).alias("text"))
    index.update(changed, "doc_id", F.col("text"), docs.filter("doc_id % 10 = 7"))
    return index.postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


def _folder(s, name):
    import uuid

    from symgraph.core import checkpoint_dir

    return f"{checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


@R.query("SELECT vec_id, len(embedding)::INT AS size FROM embeddings")
def se03_checked_vectors(s, d):
    """Vectors checked, stored as a version and read again."""
    from symgraph.sources.tables import VersionedTables

    t = VersionedTables(s, _folder(s, "se03"))
    t.commit(vectors=search.checked_vectors(table(s, d, "embeddings")))
    return t.read("vectors").select("vec_id", F.size("embedding").alias("size"))


_HYBRID = f"""t AS (SELECT doc_id AS id, source, {_TOK} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
    p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM t), h AS (SELECT id, l, q, count(*) AS tf FROM p, (VALUES ('frozen'), ('queue')) v(q) WHERE starts_with(term, q) GROUP BY ALL), df AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
    s AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN df USING (q), st GROUP BY 1),
    fr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 100),
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS x FROM embeddings, q),
    vr AS (SELECT id, row_number() OVER (ORDER BY x DESC, id) AS r FROM v WHERE x IS NOT NULL QUALIFY r <= 100)"""


def _hybrid(s, d, alpha, keep=None):
    docs = table(s, d, "documents").filter("text is not null")
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = list(v.filter("id = 0").first()["embedding"])
    return search.hybrid_search(docs, "doc_id", F.col("text"), v, ["frozen", "queue"], q, 20, alpha, keep)


@R.query(f"""WITH {_HYBRID}, b AS (SELECT coalesce(fr.id, vr.id) AS id, round(coalesce(0.5 / (fr.r + 60), 0) + coalesce(0.5 / (vr.r + 60), 0), 9) AS score FROM fr FULL JOIN vr ON fr.id = vr.id ORDER BY score DESC, 1 LIMIT 20)
    SELECT id, score FROM b WHERE id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL AND source <> 'review')""")
def se08_both_sides(s, d):
    """Both sides searched, fused, and filtered after the best were chosen."""
    return _hybrid(s, d, 0.5, F.col("source") != "review")


@R.query(f"WITH {_HYBRID} SELECT id, round(1.0 / (r + 60), 9) AS score FROM vr ORDER BY score DESC, id LIMIT 20")
def se09_semantic(s, d):
    return _hybrid(s, d, 1.0)


@R.query(f"WITH {_HYBRID} SELECT id, round(1.0 / (r + 60), 9) AS score FROM fr ORDER BY score DESC, id LIMIT 20")
def se09_full_text(s, d):
    return _hybrid(s, d, 0.0)


@R.query(f"WITH {N}, {_search_sql(['queue'], where='''kind IN ('method') AND lower(language) = 'php' ''')} SELECT id, score, 0 AS tier FROM s ORDER BY score DESC, id LIMIT 15")
def se10_kind_and_language(s, d):
    return search.search_nodes(_nodes(s, d), "queue", 15, "method", "PHP")


@R.query(f"""WITH RECURSIVE {G}, {_search_sql(['queue', 'walks'], where='''kind = 'class' ''')}, seed AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 5),
    x AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM e), b AS (SELECT src, dst FROM x UNION SELECT dst, src FROM x), w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 2)
    SELECT id, min(depth)::INT AS depth FROM w GROUP BY 1""")
def se13_query_expanded(s, d):
    return serve.query(_nodes(s, d), _edges(s, d), "queue walks", 5, 2, "class")


_NAMED = "(SELECT min(name) FROM n WHERE kind = 'class' AND regexp_full_match(name, '[A-Za-z]+'))"


@R.query(f"WITH {N} SELECT id FROM n WHERE qualified_name = (SELECT max(qualified_name) FROM n WHERE kind = 'class') ORDER BY coalesce({_RANK}, -1) DESC, id LIMIT 1")
def flt08_resolve_symbol(s, d):
    n = cut_lineage(_nodes(s, d))
    symbol = n.filter("kind = 'class'").agg(F.max("qualified_name")).first()[0] or ""
    return search.resolve_symbol(n, symbol).filter("place = 0").select("id")


_ROUTES = """r AS (SELECT 'r' || n_nationkey AS id, 'GET /api/' || lower(replace(n_name, ' ', '-')) || '/{id}' AS name, CASE WHEN n_nationkey % 3 > 0 THEN '/api/' || lower(replace(n_name, ' ', '-')) || '/{id}' END AS url,
    CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, n_nationkey FROM nation), 
    x AS (SELECT 'r' || n_nationkey AS source_id, 'h' || n_nationkey AS target_id, 'routes_to' AS kind, n_nationkey AS line_number, 1.0 AS confidence FROM nation WHERE n_nationkey % 4 <> 1
      UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'h' ELSE 'r' END || c_nationkey, 'api_calls', 1, round(0.5 + (c_custkey % 5) / 10.0, 3) FROM customer)"""


def _routes(s, d):
    t = table(s, d, "nation")
    path = F.concat(F.lit("/api/"), F.lower(F.regexp_replace("n_name", " ", "-")), F.lit("/{id}"))
    rid = F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))
    r = t.select(rid.alias("id"), F.concat(F.lit("GET "), path).alias("name"), F.when(F.col("n_nationkey") % 3 > 0, path).alias("url"), F.when(F.col("n_nationkey") % 2 == 0, "GET").otherwise("POST").alias("method"))
    to = t.filter("n_nationkey % 4 <> 1").select(rid.alias("source_id"), F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("target_id"), F.lit("routes_to").alias("kind"), F.col("n_nationkey").alias("line_number"), F.lit(1.0).alias("confidence"))
    c = table(s, d, "customer")
    target = F.concat(F.when(F.col("c_custkey") % 2 == 0, "h").otherwise("r"), F.col("c_nationkey").cast("string"))
    calls = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), target.alias("target_id"), F.lit("api_calls").alias("kind"), F.lit(1).alias("line_number"), F.round(0.5 + (F.col("c_custkey") % 5) / 10.0, 3).alias("confidence"))
    return r, to.unionByName(calls)


@R.query(f"WITH {_ROUTES} SELECT id, coalesce(url, name) AS url FROM r WHERE (coalesce(url, name) LIKE '/api/%2/{{id}}' OR contains(coalesce(url, name), '/api/*2/{{id}}')) AND method = 'GET'")
def flt09_routes(s, d):
    return serve.find_routes(_routes(s, d)[0], "/api/*2/{id}", "get").select("id", "url")


@R.query(f"WITH {_ROUTES} SELECT r.id AS route_id, coalesce(x.target_id, r.id) AS handler_id FROM r LEFT JOIN x ON x.source_id = r.id AND x.kind = 'routes_to'")
def jn08_handlers(s, d):
    return serve.route_handlers(*_routes(s, d))


@R.query(f"""WITH {_ROUTES}, h AS (SELECT r.id AS route_id, coalesce(x.target_id, r.id) AS handler_id FROM r LEFT JOIN x ON x.source_id = r.id AND x.kind = 'routes_to'), e AS (SELECT route_id, route_id AS t FROM h UNION SELECT route_id, handler_id FROM h)
    SELECT route_id, x.source_id AS caller_id, max(confidence)::DOUBLE AS confidence FROM x JOIN e ON x.target_id = e.t WHERE x.kind = 'api_calls' GROUP BY ALL""")
def sv05_route_callers(s, d):
    return serve.route_callers(*_routes(s, d))


@R.query(f"""WITH {N}, {E}, x AS (SELECT source_id AS a, target_id AS b FROM e), seed AS (SELECT min(target_id) AS id FROM e WHERE kind = 'extends' AND target_id IN (SELECT id FROM n)),
    m AS (SELECT b AS id, 1 AS depth FROM x WHERE a = (SELECT id FROM seed) UNION SELECT a, 1 FROM x WHERE b = (SELECT id FROM seed))
    SELECT id, depth::INT AS depth, row_number() OVER (ORDER BY depth, coalesce({_RANK}, -1) DESC, id) AS place FROM m JOIN n USING (id) WHERE id <> (SELECT id FROM seed)""")
def tk07_neighbours_in_order(s, d):
    e = _edges(s, d)
    n = _nodes(s, d)
    seed = e.filter("kind = 'extends'").join(n.select(F.col("id").alias("target_id")), "target_id", "left_semi").agg(F.min("target_id").alias("id"))
    found = graph.neighbours(seed, e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), 1, "both")
    return search.ranks(n.join(found, "id").select("id", "depth", F.coalesce(F.when(~F.isnan("pagerank"), F.col("pagerank")), F.lit(-1.0)).alias("r")).withColumn("all", F.lit(1)), ["all"], [F.col("depth"), F.col("r").desc(), F.col("id")], "place").select("id", "depth", "place")


@R.query("""WITH c AS (SELECT DISTINCT l_orderkey AS hash, 's/' || l_suppkey AS path FROM lineitem), k AS (SELECT hash FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), s AS (SELECT * FROM c WHERE hash IN (SELECT hash FROM k)),
    t AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM s x JOIN s y ON x.hash = y.hash AND x.path < y.path GROUP BY ALL HAVING count(*) >= 3), e AS (SELECT path, count(*) AS c FROM c GROUP BY 1),
    p AS (SELECT a, b, together, round(together / least(ea.c, eb.c), 3) AS confidence FROM t JOIN e ea ON ea.path = a JOIN e eb ON eb.path = b WHERE together / least(ea.c, eb.c) >= 0.01 ORDER BY confidence DESC, a, b LIMIT 100)
    SELECT count(*) AS pairs, min(a) AS least, max(b) AS most, sum(together)::BIGINT AS together FROM p""")
def tk10_top_co_changes(s, d):
    """The hundred surest pairs as one JSON text, read again."""
    c = table(s, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    top = history.co_changes(c, min_confidence=0.01).orderBy(F.col("confidence").desc(), "a", "b").limit(100)
    text = top.agg(F.to_json(F.collect_list(F.struct("a", "b", "together", "confidence"))).alias("json"))  # a hundred rows
    back = text.select(F.explode(F.from_json("json", "array<struct<a: string, b: string, together: bigint, confidence: double>>")).alias("x")).select("x.*")
    return back.agg(F.count("*").alias("pairs"), F.min("a").alias("least"), F.max("b").alias("most"), F.sum("together").alias("together"))


@R.query("SELECT repo, list_distinct(list(lang ORDER BY doc_id)).len()::INT AS n, list(lang ORDER BY doc_id)[1] AS first FROM documents WHERE repo IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def so05_distinct_in_order(s, d):
    docs = table(s, d, "documents").filter("repo is not null and lang is not null")
    seen = docs.groupBy("repo", "lang").agg(F.min("doc_id").alias("at")).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("at", "lang"))).alias("l"))  # one entry a language
    names = F.array_distinct(F.transform("l", lambda x: x["lang"]))
    return seen.select("repo", F.size(names).alias("n"), names[0].alias("first"))


@R.query("""SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 3) AS mean, round(sum(CASE WHEN event_type = 'view' THEN value / 2 ELSE 0 END), 3) AS cached,
    round(CASE WHEN round(sum(value), 3) > 0 THEN round(sum(CASE WHEN event_type = 'view' THEN value / 2 ELSE 0 END), 3) / round(sum(value), 3) ELSE 0 END, 6) AS cached_share FROM events GROUP BY 1""")
def ag16_token_stats(s, d):
    return serve.token_stats(table(s, d, "events"), "event_type", F.col("value"), F.when(F.col("event_type") == "view", F.col("value") / 2).otherwise(0.0))


@R.query(f"""WITH RECURSIVE {G}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
    c(id, component) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT b.dst, min(w.component) FROM c w JOIN b ON b.src = w.id JOIN recurring.c o ON o.id = b.dst WHERE w.component < o.component GROUP BY 1),
    r(a, b) AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b), m AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
    SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM g) AS m, (SELECT count(DISTINCT component) FROM c) AS weak, (SELECT count(DISTINCT least(n.id, coalesce(m.component, n.id))) FROM n LEFT JOIN m USING (id)) AS strong,
      (SELECT count(*) = 0 FROM m) AND (SELECT count(*) = 0 FROM g WHERE src = dst) AS is_dag, (SELECT count(DISTINCT kind) FROM n) AS kinds""")
def ag06_statistics(s, d):
    """The whole row: size, weak and strong components, acyclicity, kinds."""
    n = cut_lineage(store.current_nodes(table(s, d, "nodes"), ["id", "kind"]))
    g = cut_lineage(store.graph_edges(table(s, d, "nodes"), table(s, d, "edges")))
    weak = graph.components(n, g).agg(F.countDistinct("component").alias("weak"))
    strong = graph.strong_components(n, g).agg(F.countDistinct("component").alias("strong"))
    size = n.agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds")).crossJoin(g.agg(F.count("*").alias("m")))  # one row each
    return size.crossJoin(weak).crossJoin(strong).select("n", "m", "weak", "strong", F.lit(graph.is_dag(n, g)).alias("is_dag"), "kinds")


@R.query(f"""WITH {G}, i AS (SELECT dst AS id, count(*) AS v FROM g GROUP BY 1), o AS (SELECT src AS id, count(*) AS v FROM g GROUP BY 1),
    a AS (SELECT 'in_degree' AS metric, id, v::DOUBLE AS v FROM i ORDER BY v DESC, id LIMIT 20), b AS (SELECT 'out_degree', id, v::DOUBLE AS v FROM o ORDER BY v DESC, id LIMIT 20),
    c AS (SELECT 'pagerank', id, pagerank AS v FROM n WHERE pagerank IS NOT NULL AND NOT isnan(pagerank) ORDER BY v DESC, id LIMIT 20) FROM a UNION ALL FROM b UNION ALL FROM c""")
def tk02_top_by_metric(s, d):
    n = store.current_nodes(table(s, d, "nodes"), ["id", "pagerank"])
    deg = graph.degrees(n, store.graph_edges(table(s, d, "nodes"), table(s, d, "edges"))).filter("in_degree + out_degree > 0")
    out = n.filter("pagerank is not null and not isnan(pagerank)").select(F.lit("pagerank").alias("metric"), "id", F.col("pagerank").alias("v")).orderBy(F.col("v").desc(), "id").limit(20)
    for m in ("in_degree", "out_degree"):
        out = out.unionByName(deg.select(F.lit(m).alias("metric"), "id", F.col(m).cast("double").alias("v")).orderBy(F.col("v").desc(), "id").limit(20))
    return out


@R.query("""WITH x AS (SELECT file_path, content_hash, 1 AS seq, last_parsed AS t, run_id FROM files WHERE content_hash IS NOT NULL UNION ALL SELECT file_path, content_hash, 2, seen_at, scan_id FROM file_scans WHERE content_hash IS NOT NULL)
    SELECT file_path, max_by(content_hash, {'s': seq, 't': coalesce(t, TIMESTAMP '1900-01-01'), 'r': run_id, 'h': content_hash}) AS content_hash FROM x WHERE file_path IS NOT NULL GROUP BY 1""")
def snk04_set_file_hash(s, d):
    f = table(s, d, "files").filter("content_hash is not null and file_path is not null").groupBy("file_path").agg(F.max_by("content_hash", F.struct(F.coalesce("last_parsed", F.to_timestamp(F.lit("1900-01-01"))), "run_id", "content_hash")).alias("content_hash"))
    new = table(s, d, "file_scans").filter("content_hash is not null and file_path is not null")
    return store.upsert(f, new.select("file_path", "content_hash", F.struct(F.coalesce("seen_at", F.to_timestamp(F.lit("1900-01-01"))), "scan_id", "content_hash").alias("seq")), ["file_path"])


@R.query("SELECT 'rows' AS key, count(*)::VARCHAR AS value FROM nation UNION ALL SELECT 'name', 'new'")
def snk05_metadata(s, d):
    from symgraph.sources.tables import get_metadata, set_metadata

    m = set_metadata(s.createDataFrame([("name", "old")], "key string, value string"), rows=table(s, d, "nation").count(), name="new")
    assert get_metadata(m, "name") == "new" and get_metadata(m, "none") is None
    return m


_ENTRY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ENTRY_WEIGHTS.items()) + " ELSE 0.5 END"


@R.query(f"""WITH {N}, {E}, k AS (SELECT '1 kinds' AS section, kind AS item, count(*)::DOUBLE AS n FROM n GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10), l AS (SELECT '2 languages', language, count(*)::DOUBLE FROM n WHERE language IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10),
    c AS (SELECT '3 communities', x, v FROM (SELECT community_id::VARCHAR AS x, count(*)::DOUBLE AS v, community_id FROM n WHERE community_id IS NOT NULL GROUP BY community_id) ORDER BY v DESC, community_id LIMIT 10),
    p AS (SELECT '4 key nodes', id, round(pagerank, 9) FROM n WHERE pagerank > 0 AND NOT isnan(pagerank) ORDER BY 3 DESC, 2 LIMIT 10),
    i AS (SELECT target_id AS id, count(*) AS c FROM e GROUP BY 1), t AS (SELECT '5 entry points', id, round(c * {_ENTRY}, 6)::DOUBLE AS v FROM n JOIN i USING (id) WHERE pagerank > 0 AND NOT isnan(pagerank) ORDER BY v DESC, id LIMIT 10),
    u AS (FROM k UNION ALL FROM l UNION ALL FROM c UNION ALL FROM p UNION ALL FROM t) SELECT section, item, n FROM u""")
def sv06_architecture(s, d):
    return serve.architecture(_nodes(s, d), _edges(s, d), 32_000).select("section", "item", "n")


@R.query()
def sv01_symbol(s, d):
    """The context of the class with the greatest qualified name."""
    n = cut_lineage(_nodes(s, d))
    return serve.symbol_context(n, _edges(s, d), n.filter("kind = 'class'").agg(F.max("qualified_name")).first()[0] or "", 1000)


@R.query()
def sv08_preload(s, d):
    return serve.preload(_nodes(s, d), _edges(s, d), "queue walks")


@R.query()
def sv07_notes_in_budget(s, d):
    events = table(s, d, "events").filter("event_type in ('view', 'click')").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("target"))
    notes = table(s, d, "documents").filter("source in ('session_note', 'commit_message') and created_at is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text", "created_at", F.lit(True).alias("active"))
    return serve.session_context(events, notes)


@R.query()
def snk08_markdown(s, d):
    return serve.export_markdown(_nodes(s, d), "architecture", budget=5000)


@R.query()
def snk09_neighbourhood(s, d):
    """The edges between the hundred nodes around the hits of a search."""
    return serve.neighbourhood(_nodes(s, d), _edges(s, d), "queue walks", 2, 100)[1].select("source_id", "target_id", "kind")
