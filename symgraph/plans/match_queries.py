"""Queries of prioritised joins, search and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.core import table
from symgraph.operators import history, matching, search, store
from symgraph.plans.registry import E, N, Registry

R = Registry()
QUERIES, ORACLE = R.QUERIES, R.ORACLE

_PARTS = "list_filter(str_split(replace(q, '::', '\\'), '\\'), lambda x: x <> '')"
_REFS = """r AS (SELECT source_id, kind, trim(name, '\\') AS key FROM (
    SELECT e.source_id, e.kind, CASE hash_k WHEN 0 THEN n.qualified_name WHEN 1 THEN '\\' || n.qualified_name WHEN 2 THEN n.name ELSE 'gone_' || n.name END AS name
    FROM (SELECT *, line_number % 4 AS hash_k FROM e WHERE kind = 'calls' AND line_number IS NOT NULL) e JOIN n ON e.target_id = n.id) WHERE trim(name, '\\') <> '')"""


def _nodes(s, d, *cols):
    return store.current_nodes(table(s, d, "nodes"), list(cols))


def _edges(s, d):
    return store.current_edges(table(s, d, "edges"))


def _refs(s, d):
    e = _edges(s, d).filter("kind = 'calls' and line_number is not null").select("source_id", "kind", F.col("target_id").alias("id"), (F.col("line_number") % 4).alias("k"))
    n = _nodes(s, d, "id", "name", "qualified_name")
    name = F.when(F.col("k") == 0, F.col("qualified_name")).when(F.col("k") == 1, F.concat(F.lit("\\"), "qualified_name")).when(F.col("k") == 2, F.col("name")).otherwise(F.concat(F.lit("gone_"), "name"))
    return e.join(n, "id").select("source_id", "kind", name.alias("name"))


_RESOLVE = f"""WITH {N}, {E}, {_REFS},
    q AS (SELECT id, ltrim(qualified_name, '\\') AS q FROM n WHERE qualified_name <> ''), p AS (SELECT id, q, {_PARTS} AS p FROM q),
    ex AS (SELECT q AS key, max(id) AS exact_id FROM q GROUP BY 1),
    su AS (SELECT key, min(id) AS suffix_id FROM (SELECT id, unnest(CASE WHEN len(p) > 2 THEN [array_to_string(p[k:], '\\') FOR k IN range(2, len(p))] ELSE [] END) AS key FROM p) GROUP BY 1 HAVING min(id) = max(id)),
    sh AS (SELECT p[-1] AS key, min(id) AS short_id FROM p GROUP BY 1 HAVING min(id) = max(id)),
    x AS (SELECT r.source_id, r.key AS name, r.kind, exact_id, suffix_id, short_id FROM (SELECT *, list_filter(str_split(replace(key, '::', '\\'), '\\'), lambda x: x <> '')[-1] AS last FROM r) r
      LEFT JOIN ex ON ex.key = r.key LEFT JOIN su ON su.key = r.key LEFT JOIN sh ON sh.key = r.last)
    SELECT source_id, name, kind, coalesce(exact_id, suffix_id, short_id, 'ext:' || left(sha256(name), 16)) AS target_id,
      CASE WHEN exact_id IS NOT NULL THEN 1.0 WHEN suffix_id IS NOT NULL THEN 0.85 WHEN short_id IS NOT NULL THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence,
      CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN suffix_id IS NOT NULL THEN 'suffix' WHEN short_id IS NOT NULL THEN 'short' ELSE 'placeholder' END AS tier FROM x"""


@R.query(_RESOLVE)
def jn05_resolve(s, d):
    return matching.resolve(_refs(s, d), _nodes(s, d, "id", "qualified_name"))


@R.query(f"SELECT tier, count(*) AS n FROM ({_RESOLVE}) GROUP BY 1")
def jn05_tiers(s, d):
    return matching.resolve(_refs(s, d), _nodes(s, d, "id", "qualified_name")).groupBy("tier").agg(F.count("*").alias("n"))


@R.query(f"SELECT DISTINCT target_id AS id, name FROM ({_RESOLVE}) WHERE tier = 'placeholder'")
def jn05_placeholders(s, d):
    return matching.placeholders(matching.resolve(_refs(s, d), _nodes(s, d, "id", "qualified_name")))


@R.query("""WITH a AS (SELECT DISTINCT lower(p_name) AS x FROM part), b AS (SELECT DISTINCT c_name AS y FROM customer), k AS (SELECT DISTINCT name AS x FROM nodes WHERE kind = 'class'), l AS (SELECT DISTINCT name AS y FROM nodes WHERE kind = 'interface')
    SELECT x, y, levenshtein(x, y) AS dist FROM k JOIN l ON abs(length(x) - length(y)) <= 3 WHERE levenshtein(x, y) <= 3""")
def jn07_near_names(s, d):
    n = table(s, d, "nodes")
    return matching.near_texts(n.filter("kind = 'class'").select(F.col("name").alias("x")), n.filter("kind = 'interface'").select(F.col("name").alias("y")), 3)


@R.query(f"""WITH {N}, i AS (SELECT file_path, id, start_line, end_line FROM n WHERE kind IN ('function', 'method')), p AS (SELECT DISTINCT file_path, line_number AS line FROM extraction_errors WHERE line_number IS NOT NULL)
    SELECT p.file_path, p.line, arg_min(i.id, {{'s': end_line - start_line, 'a': start_line, 'i': i.id}}) AS owner FROM p LEFT JOIN i ON i.file_path = p.file_path AND line BETWEEN start_line AND end_line GROUP BY ALL""")
def jn09_enclosing(s, d):
    i = _nodes(s, d, "id", "kind", "file_path", "start_line", "end_line").filter("kind in ('function', 'method')").select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("owner"))
    p = table(s, d, "extraction_errors").filter("line_number is not null").select("file_path", F.col("line_number").alias("line")).distinct()
    return matching.enclosing(p, i, "file_path")


@R.query(f"""WITH {N}, i AS (SELECT file_path, id, start_line, end_line FROM n WHERE kind <> 'file'), p AS (SELECT DISTINCT file_path, line_number AS line FROM extraction_errors WHERE line_number IS NOT NULL)
    SELECT p.file_path, p.line, i.id AS owner FROM p JOIN i ON i.file_path = p.file_path AND line BETWEEN start_line AND end_line""")
def jn11_all_enclosing(s, d):
    i = _nodes(s, d, "id", "kind", "file_path", "start_line", "end_line").filter("kind <> 'file'").select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("owner"))
    p = table(s, d, "extraction_errors").filter("line_number is not null").select("file_path", F.col("line_number").alias("line")).distinct()
    return matching.all_enclosing(p, i, "file_path").select("file_path", "line", "owner")


@R.query(f"""WITH {N}, f AS (SELECT file_path, start_line, id FROM n WHERE kind = 'function'), c AS (SELECT DISTINCT file_path, start_line AS line FROM n WHERE kind = 'class')
    SELECT c.file_path, c.line, arg_min(f.id, {{'g': abs(f.start_line - line), 's': f.start_line, 'i': f.id}}) AS owner FROM c LEFT JOIN f ON f.file_path = c.file_path AND f.start_line BETWEEN line - 10 AND line + 40 GROUP BY ALL""")
def jn10_nearest(s, d):
    n = _nodes(s, d, "id", "kind", "file_path", "start_line")
    c = n.filter("kind = 'class'").select("file_path", F.col("start_line").alias("line")).distinct()
    f = n.filter("kind = 'function'").select("file_path", F.col("start_line").alias("at_line"), F.col("id").alias("owner"))
    return matching.nearest(c, f, "file_path", "line", "at_line", 10, 40)


@R.query("""SELECT p.event_id, arg_max(v.event_id, {'t': v.ts, 'e': v.event_id}) AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1""")
def jn25_as_of(s, d):
    e = table(s, d, "events")
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), F.col("event_id").alias("view_id"))
    return matching.as_of(p, v, "user_id", "ts", "v_ts", "view_id").select("event_id", "view_id")


@R.query(f"""WITH {N}, {E}, s AS (SELECT id FROM n WHERE kind = 'file' AND language IN ('css', 'scss'))
    SELECT source_id, target_id, CASE WHEN contains(target_id, '.module.') THEN 'css_module_import' ELSE 'imports_stylesheet' END AS kind FROM e WHERE kind = 'imports' AND target_id IN (SELECT id FROM s)""")
def jn12_stylesheet_imports(s, d):
    files = _nodes(s, d, "id", "kind", "language").filter("kind = 'file' and language in ('css', 'scss')").select(F.col("id").alias("target_id"))
    e = _edges(s, d).filter("kind = 'imports'").join(files, "target_id", "left_semi")
    return e.select("source_id", "target_id", F.when(F.col("target_id").contains(".module."), "css_module_import").otherwise("imports_stylesheet").alias("kind"))


@R.query(f"""WITH {N}, best AS (SELECT name, arg_min(id, {{'p': CASE kind WHEN 'class' THEN 0 WHEN 'method' THEN 1 ELSE 2 END, 'i': id}}) AS owner FROM n WHERE kind IN ('class', 'method', 'function') GROUP BY 1)
    SELECT DISTINCT query_id, name, owner FROM search_results JOIN best USING (name)""")
def jn26_by_name(s, d):
    owners = _nodes(s, d, "id", "kind", "name").filter("kind in ('class', 'method', 'function')")
    order = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "method", 1).otherwise(2)
    return matching.by_name(table(s, d, "search_results").select("query_id", "name").distinct(), owners, "name", order).select("query_id", "name", "owner")


@R.query("""WITH f AS (SELECT DISTINCT query_id, node_id, fts_rank AS a FROM search_results WHERE fts_rank > 0), v AS (SELECT DISTINCT query_id, node_id, vector_rank AS b FROM search_results WHERE vector_rank > 0)
    SELECT query_id, node_id, round(coalesce(0.5 / (a + 60), 0) + coalesce(0.5 / (b + 60), 0), 9) AS score FROM f FULL JOIN v USING (query_id, node_id)""")
def se08_hybrid_rrf(s, d):
    r = table(s, d, "search_results")
    f = r.filter("fts_rank > 0").select("query_id", "node_id", "fts_rank").distinct()
    v = r.filter("vector_rank > 0").select("query_id", "node_id", "vector_rank").distinct()
    return search.hybrid(f, v, ["query_id"], "node_id")


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@R.query(f"""WITH t AS (SELECT doc_id AS id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
    p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM t), h AS (SELECT id, l, q, count(*) AS tf FROM p, (VALUES ('frozen'), ('queue')) v(q) WHERE starts_with(term, q) GROUP BY ALL), df AS (SELECT q, count(*) AS df FROM h GROUP BY 1)
    SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN df USING (q), s GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")
def se01_bm25(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    return search.search(docs, "doc_id", F.col("text"), ["frozen", "queue"])


@R.query(f"""WITH t AS (SELECT doc_id AS id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT id, len(t)::INT AS doc_len, unnest(t) AS term FROM t) SELECT term, count(DISTINCT id) AS docs, count(*) AS n FROM p GROUP BY 1""")
def se02_postings(s, d):
    p = search.postings(table(s, d, "documents").filter("text is not null"), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


@R.query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10""")
def se04_vector_topk(s, d):
    v = table(s, d, "embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()[0]
    return search.vector_search(v, list(q), 10)


@R.query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
    SELECT query_id, vec_id, similarity FROM s WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")
def se04_vector_topk_many(s, d):
    v = table(s, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.vector_search_many(v, q, 10)


@R.query("SELECT vec_id, label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, 99 FROM embeddings WHERE label = 3")
def se05_upsert_vectors(s, d):
    v = table(s, d, "embeddings").select("vec_id", "label")
    return search.upsert_vectors(v, v.filter("label = 3").withColumn("label", F.lit(99)))


@R.query("SELECT vec_id FROM embeddings WHERE label NOT IN (1, 2)")
def se06_remove_vectors(s, d):
    v = table(s, d, "embeddings")
    return v.join(v.filter("label in (1, 2)").select("vec_id"), "vec_id", "left_anti").select("vec_id")


@R.query(f"""WITH {N}, t AS (SELECT id, str_split(source_text, chr(10)) AS l FROM n WHERE kind = 'file' AND contains(lower(source_text), 'panic')),
    x AS (SELECT id, l, list_position(list_transform(l, lambda y: contains(lower(y), 'panic')), true)::INT AS line FROM t)
    SELECT id, line, l[line] AS code, array_to_string(l[greatest(line - 3, 1):line + 3], chr(10)) AS around FROM x WHERE line > 0""")
def se11_grep(s, d):
    return search.grep(store.current_texts(table(s, d, "nodes"), columns=("id",)), "id", "text", "panic")


@R.query(f"""WITH {N}, t AS (SELECT id, str_split(source_text, chr(10)) AS l FROM n WHERE kind = 'file' AND regexp_matches(source_text, 'return \\[\\$?\\w+, \\d+')),
    x AS (SELECT id, l, list_position(list_transform(l, lambda y: regexp_matches(y, 'return \\[\\$?\\w+, \\d+')), true)::INT AS line FROM t) SELECT id, line, l[line] AS code FROM x WHERE line > 0""")
def se12_grep_regex(s, d):
    return search.grep(store.current_texts(table(s, d, "nodes"), columns=("id",)), "id", "text", r"return \[\$?\w+, \d+", regex=True).select("id", "line", "code")


_COMMITS = """c AS (SELECT l_orderkey AS hash, 'a' || (o_custkey % 40) AS author, o_orderdate AS date, 'part/' || l_partkey AS path, l_quantity AS added, l_linenumber AS deleted
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_linenumber FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey)"""


def _commits(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber").distinct()
    return li.join(o, "l_orderkey").select(
        F.col("l_orderkey").alias("hash"), F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string")).alias("author"), F.col("o_orderdate").alias("date"),
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_quantity").alias("added"), F.col("l_linenumber").alias("deleted"),
    )


@R.query(f"""WITH {_COMMITS}, p AS (SELECT path, author, count(DISTINCT hash) AS k, min(date) AS first, max(date) AS last, sum(added) AS a, sum(deleted) AS d FROM c GROUP BY ALL)
    SELECT path, sum(k)::BIGINT AS commits, count(*) AS authors, arg_min(author, {{'k': -k, 'a': author}}) AS main_author, round(max(k) / sum(k), 3) AS share, sum(a) + sum(d) AS churn,
      round(sum(k) / greatest(date_diff('day', min(first), max(last)) / 30.0, 1.0), 3) AS per_month, round(exp(-0.693 * date_diff('day', max(last)::DATE, DATE '2026-01-01') / 90.0), 3) AS recency FROM p GROUP BY 1""")
def ag12_file_metrics(s, d):
    import datetime

    return history.file_metrics(_commits(s, d), datetime.date(2026, 1, 1)).drop("first", "last")


@R.query(f"""WITH {_COMMITS}, m AS (SELECT path, sum(k)::BIGINT AS commits FROM (SELECT path, author, count(DISTINCT hash) AS k FROM c GROUP BY ALL) GROUP BY 1),
    t AS (SELECT list_sort(list(commits), 'DESC') AS l, count(*) AS n FROM m) SELECT path, commits FROM m WHERE commits >= (SELECT l[least(greatest(n // 10, 1), n - 1) + 1] FROM t)""")
def ag13_hot_files(s, d):
    import datetime

    return history.hot_files(history.file_metrics(_commits(s, d), datetime.date(2026, 1, 1)))


@R.query("""WITH c AS (SELECT DISTINCT l_orderkey AS hash, 's/' || l_suppkey AS path FROM lineitem), k AS (SELECT hash FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), s AS (SELECT * FROM c WHERE hash IN (SELECT hash FROM k)),
    t AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM s x JOIN s y ON x.hash = y.hash AND x.path < y.path GROUP BY ALL HAVING count(*) >= 3),
    e AS (SELECT path, count(*) AS c FROM c GROUP BY 1), f AS (SELECT path, count(*) AS c FROM s GROUP BY 1)
    SELECT a, b, together, round(together / least(ea.c, eb.c), 3) AS confidence, round(together / (fa.c + fb.c - together), 3) AS jaccard FROM t JOIN e ea ON ea.path = a JOIN e eb ON eb.path = b JOIN f fa ON fa.path = a JOIN f fb ON fb.path = b
    WHERE together / least(ea.c, eb.c) >= 0.01""")
def ag14_co_changes(s, d):
    c = table(s, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    return history.co_changes(c, min_confidence=0.01)


@R.query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def ext_tumbling(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k""")
def ext_session_window(s, d):
    e = table(s, d, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")
