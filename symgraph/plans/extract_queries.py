"""Queries of extraction, module resolution, framework detection and assembly, over all files."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.core import table
from symgraph.extract import resolvers, run
from symgraph.functions.scalars import estimate_tokens
from symgraph.operators import context, matching, store
from symgraph.plans.registry import E, G, N, Registry

R = Registry()
QUERIES, ORACLE = R.QUERIES, R.ORACLE


def _texts(s, d, *languages):
    n = table(s, d, "nodes")
    n = n.filter(F.col("language").isin(*languages)) if languages else n
    return store.current_texts(n, columns=("file_path", "language"))


def _known(s, d, *languages):
    """Extracted nodes with their spans whose ids the store holds; stored nodes that extraction misses are missed rows.

    The store leaves out about one symbol in forty that the texts hold, so what it does not name
    is no error of extraction; tests compare both ways on texts of their own.
    """
    found = run.nodes_of(run.extract(_texts(s, d, *languages))).select("id", "kind", "start_line", "end_line").filter("kind <> 'file'").distinct()
    return found.join(store.current_nodes(table(s, d, "nodes"), ["id"]), "id", "left_semi")


def _sql(*languages):
    names = ", ".join(f"'{x}'" for x in languages)
    return f"""WITH {N}, f AS (SELECT file_path FROM n WHERE kind = 'file' AND source_text IS NOT NULL AND language IN ({names}))
        SELECT id, kind, start_line, end_line FROM n WHERE kind <> 'file' AND file_path IN (SELECT file_path FROM f)"""


_PARSED = ("php", "javascript", "typescript", "go", "rust", "css", "scss")


@R.query(f"""WITH {N}, {E}, f AS (SELECT file_path FROM n WHERE kind = 'file' AND source_text IS NOT NULL AND language IN {_PARSED})
    SELECT e.source_id, e.target_id FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE e.kind = 'contains' AND b.file_path IN (SELECT file_path FROM f)""")
def ex_contains(s, d):
    """Extracted containments whose ends the store links; links that extraction misses are missed rows.

    The store hangs a method whose class it does not hold on the file.
    """
    e = store.current_edges(table(s, d, "edges")).filter("kind = 'contains'").select("source_id", "target_id")
    ids = store.current_nodes(table(s, d, "nodes"), ["id"])
    e = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    found = run.edges_of(run.extract(_texts(s, d, *_PARSED))).filter("kind = 'contains'").select("source_id", "target_id").distinct()
    path = F.regexp_extract("target_id", r"^([^:]+)", 1)
    on_file = F.concat(path, F.lit(":1:file:"), F.substring_index(path, "/", -1))
    found = found.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("held")), "source_id", "left").select(F.when(F.col("held"), F.col("source_id")).otherwise(on_file).alias("source_id"), "target_id").distinct()
    return found.join(e, ["source_id", "target_id"], "left_semi")


@R.query(_sql("php"))
def ex01_php(s, d):
    return _known(s, d, "php")


@R.query(_sql("javascript"))
def ex02_javascript(s, d):
    return _known(s, d, "javascript")


@R.query(_sql("typescript"))
def ex03_typescript(s, d):
    return _known(s, d, "typescript")


@R.query()
def ex04_python(s, d):
    return run.nodes_of(run.extract(_texts(s, d, "python"))).select("id", "kind", "name", "qualified_name", "start_line", "end_line")


@R.query()
def ex05_css(s, d):
    return run.nodes_of(run.extract(_texts(s, d, "css"))).select("id", "kind", "name")


@R.query()
def ex06_scss(s, d):
    return run.nodes_of(run.extract(_texts(s, d, "scss"))).select("id", "kind", "name")


@R.query(_sql("go"))
def ex07_go(s, d):
    return _known(s, d, "go")


@R.query(_sql("rust"))
def ex08_rust(s, d):
    return _known(s, d, "rust")


@R.query()
def ex_references(s, d):
    """Unresolved references of all files per language and kind."""
    return run.references_of(run.extract(_texts(s, d))).groupBy("language", "kind").agg(F.count("*").alias("n"))


@R.query()
def ex_errors(s, d):
    return run.errors(run.extract(_texts(s, d)))


@R.query()
def ex_resolved(s, d):
    """Extracted calls and instantiations through the four tiers of resolution, per tier."""
    refs = run.references_of(run.extract(_texts(s, d))).filter("kind in ('calls', 'instantiates', 'extends')").select("source_id", "kind", "name")
    n = store.current_nodes(table(s, d, "nodes"), ["id", "qualified_name"])
    return matching.resolve(refs, n).groupBy("tier", "kind").agg(F.count("*").alias("n"))


def _imports(s, d, *languages):
    r = run.references_of(run.extract(_texts(s, d, *languages))).filter("kind = 'imports'")
    return r.select(F.regexp_extract("source_id", r"^([^:]+)", 1).alias("from_file"), F.col("name").alias("module"))


@R.query()
def rs01_php_modules(s, d):
    return resolvers.resolve_modules(_imports(s, d, "php"), table(s, d, "files"), "php")


@R.query()
def rs02_javascript_modules(s, d):
    return resolvers.resolve_modules(_imports(s, d, "javascript"), table(s, d, "files"), "javascript")


@R.query()
def rs03_typescript_modules(s, d):
    return resolvers.resolve_modules(_imports(s, d, "typescript"), table(s, d, "files"), "typescript")


@R.query()
def rs04_python_modules(s, d):
    return resolvers.resolve_modules(_imports(s, d, "python"), table(s, d, "files"), "python")


@R.query()
def rs05_css_modules(s, d):
    return resolvers.resolve_styles(_imports(s, d, "css"), table(s, d, "files"), "css")


@R.query()
def rs06_scss_modules(s, d):
    return resolvers.resolve_styles(_imports(s, d, "scss"), table(s, d, "files"), "scss")


@R.query()
def rs07_go_modules(s, d):
    return resolvers.resolve_modules(_imports(s, d, "go"), table(s, d, "files"), "go")


@R.query()
def rs08_rust_modules(s, d):
    return resolvers.resolve_modules(_imports(s, d, "rust"), table(s, d, "files"), "rust")


@R.query()
def fw_patterns(s, d):
    """Nodes that detectors add, per framework and kind, over all files."""
    n = run.nodes_of(run.extract(_texts(s, d)))
    fw = F.get_json_object("metadata", "$.framework")
    return n.select(fw.alias("framework"), "kind").filter("framework is not null").groupBy("framework", "kind").agg(F.count("*").alias("n"))


@R.query()
def jn07_match_calls(s, d):
    """HTTP calls found in scripts matched with the routes found in all files."""
    texts = _texts(s, d)
    c = run.calls_of(texts.filter("language in ('javascript', 'typescript')")).select(F.concat_ws(":", "file_path", F.col("line").cast("string"), "url").alias("call_id"), "url", "method", "confidence")
    routes = run.nodes_of(run.extract(texts)).filter("kind = 'route'")
    e = routes.select(F.col("id").alias("endpoint_id"), F.get_json_object("metadata", "$.http_method").alias("method"), F.get_json_object("metadata", "$.url_pattern").alias("path"))
    return matching.match_calls(c, e)


@R.query("SELECT o_orderkey AS call_id, 'e' || (o_orderkey % 50) AS endpoint_id, 0.95::DOUBLE AS confidence, 'exact' AS strategy FROM orders")
def jn07_exact(s, d):
    """Calls of which a third goes to few paths: paths are matched once, not per call."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("/very/long/path/of/endpoint/"), F.md5((F.col("o_orderkey") % 50).cast("string"))).alias("url"), F.lit("GET").alias("method"), F.lit(1.0).alias("confidence"))
    e = s.range(50).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("endpoint_id"), F.lit("GET").alias("method"), F.concat(F.lit("/very/long/path/of/endpoint/"), F.md5(F.col("id").cast("string"))).alias("path"))
    return matching.match_calls(o, e)


@R.query()
def jn13_class_uses(s, d):
    n = store.current_nodes(table(s, d, "nodes"), ["id", "kind", "name"]).filter("kind = 'css_class'")
    return matching.class_uses(_texts(s, d, "javascript", "typescript", "php"), n)


@R.query()
def jn14_variable_bridge(s, d):
    n = store.current_nodes(table(s, d, "nodes"), ["id", "kind", "name"]).filter("kind in ('css_variable', 'tailwind_theme_token')")
    return matching.variable_bridge(_texts(s, d, "javascript", "typescript"), n)


@R.query("""WITH t AS (SELECT 'color-' || lower(r_name) AS key, r_regionkey AS k FROM region), u AS (SELECT n_nationkey, 'bg-' || lower(r_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT DISTINCT u.name, 't' || t.k AS token_id FROM u JOIN t ON 'color-' || substr(u.name, 4) = t.key""")
def jn15_utility_tokens(s, d):
    r = table(s, d, "region")
    tokens = r.select(F.concat(F.lit("--color-"), F.lower("r_name")).alias("name"), F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("id"))
    names = table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("bg-"), F.lower("r_name")).alias("name")).distinct()
    return matching.utility_tokens(names, tokens)


@R.query(f"""WITH {N}, t AS (SELECT community_id, id, CASE WHEN pagerank IS NULL OR isnan(pagerank) THEN 0.0 ELSE -pagerank END AS r, greatest(1, length(coalesce(source_text, name)) // 4)::BIGINT AS t FROM n WHERE community_id IS NOT NULL AND kind <> 'file'),
    a AS (SELECT community_id, list({{'t': t, 'i': id}} ORDER BY r, id) AS a FROM t GROUP BY 1),
    k AS (SELECT community_id, list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': []::VARCHAR[], 't': 0::BIGINT, 'i': ''}}, list_transform(a, lambda x: {{'used': 0::BIGINT, 'kept': []::VARCHAR[], 't': x.t, 'i': x.i}})),
      lambda s, x: CASE WHEN s.used + x.t <= 500 THEN {{'used': s.used + x.t, 'kept': list_append(s.kept, x.i), 't': 0::BIGINT, 'i': ''}} ELSE s END).kept AS kept FROM a)
    SELECT community_id, unnest(kept) AS id FROM k""")
def wn06_budget_fold(s, d):
    rank = F.when(F.col("pagerank").isNull() | F.isnan("pagerank"), 0.0).otherwise(-F.col("pagerank"))
    sized = table(s, d, "nodes").filter("kind <> 'file'").withColumn("rank", rank).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length(F.coalesce("source_text", "name")) / 4)))
    n = store.current_nodes(sized, ["id", "community_id", "rank", "tokens"]).filter("community_id is not null")
    return context.fold_budget(n, ["community_id"], [F.col("rank"), F.col("id")], "tokens", "id", 500).select("community_id", "id")


def _hub(g):
    return g.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "id").limit(1).select("id")


_SEED = "seed AS (SELECT min(dst) AS id FROM (SELECT dst, count(*) AS c FROM g GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM g GROUP BY dst)))"


@R.query(f"""WITH RECURSIVE {G}, {_SEED}, w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT src, depth + 1 FROM w JOIN g ON dst = id WHERE depth < 2), m AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0),
    x AS (SELECT depth, kind, id, row_number() OVER (PARTITION BY depth, kind ORDER BY id) AS rn, count(*) OVER (PARTITION BY depth, kind) AS n FROM m JOIN n USING (id))
    SELECT depth, kind, n, string_agg(id, ',' ORDER BY id) AS some FROM x WHERE rn <= 10 GROUP BY ALL""")
def wn08_by_depth(s, d):
    g = store.graph_edges(table(s, d, "nodes"), table(s, d, "edges"))
    n = store.current_nodes(table(s, d, "nodes"), ["id", "kind", "pagerank"])
    return context.by_depth(context.impact(n, g, _hub(g), 2))


@R.query()
def sv02_file_context(s, d):
    sized = table(s, d, "nodes").withColumn("tokens", estimate_tokens(F.coalesce("source_text", "name")))
    return context.file_context(store.current_nodes(sized, ["id", "kind", "file_path", "pagerank", "tokens"]))


@R.query()
def sv03_impact(s, d):
    g = store.graph_edges(table(s, d, "nodes"), table(s, d, "edges"))
    return context.impact(store.current_nodes(table(s, d, "nodes"), ["id", "kind", "pagerank"]), g, _hub(g))


@R.query(f"""WITH RECURSIVE {N}, {E}, g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM e WHERE kind = 'calls'), {_SEED}, w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT src, depth + 1 FROM w JOIN g ON dst = id WHERE depth < 2)
    SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def gr18_usages(s, d):
    e = store.current_edges(table(s, d, "edges"))
    g = e.filter("kind = 'calls'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    return context.usages(e, _hub(g), "calls", 2)


@R.query()
def sv07_session_context(s, d):
    events = table(s, d, "events").filter("event_type in ('view', 'click')").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("target"))
    notes = table(s, d, "documents").filter("source = 'session_note' and created_at is not null and text is not null").select(F.col("doc_id").alias("id"), "text", "created_at")
    return context.session_context(events, notes)


@R.query()
def snk08_export_tree(s, d):
    from symgraph.sources.tables import export_tree

    return export_tree(store.current_nodes(table(s, d, "nodes"), ["id", "kind", "name", "file_path", "start_line"]))


@R.query(f"WITH {N} SELECT id FROM n WHERE kind = 'class'")
def snk08_export_json(s, d):
    from symgraph.sources.tables import export_json

    n = store.current_nodes(table(s, d, "nodes"), ["id", "kind", "name"]).filter("kind = 'class'")
    return export_json(n).select(F.get_json_object("json", "$.id").alias("id"))


@R.query()
def jn16_link_far(s, d):
    """Links that detectors made to other files' components, models and hooks, resolved by name."""
    x = run.extract(_texts(s, d))
    nodes = run.nodes_of(x).select("id", "kind", "name")
    return matching.link_far(run.edges_of(x).select("source_id", "target_id", "kind", "confidence"), nodes).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("target_id").startswith("__unresolved__:")).alias("open"))


@R.query()
def st02_normalised_events(s, d):
    """The scanner's log as watch events: moves delete and change; the last event of each path."""
    from symgraph.streaming import changes

    e = table(s, d, "file_scans").select(F.col("file_path").alias("path"), "op", F.col("seen_at").alias("ts"), F.when(F.col("op") == "moved", F.col("file_path")).alias("dest"))
    return changes.last_per_path(changes.accepted(changes.normalise_events(e)).filter("ts is not null")).groupBy("op").agg(F.count("*").alias("n"))


@R.query("""WITH g AS (SELECT *, CASE WHEN seen_at - lag(seen_at) OVER (PARTITION BY file_path ORDER BY seen_at) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM file_scans WHERE seen_at IS NOT NULL),
    i AS (SELECT *, sum(new) OVER (PARTITION BY file_path ORDER BY seen_at RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT file_path, count(*) AS changes, min(seen_at) AS first FROM i GROUP BY file_path, k""")
def st01_debounced(s, d):
    from symgraph.streaming import changes

    e = table(s, d, "file_scans").filter("seen_at is not null").select("file_path", F.col("seen_at").alias("ts"))
    return changes.debounced(e, "1 day").select("file_path", "changes", "first")
