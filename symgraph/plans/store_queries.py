"""Queries of the graph store: filters, aggregates, rankings, set operations, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symgraph.core import group_limit, table
from symgraph.operators import store
from symgraph.plans.registry import E, N, Registry
from symgraph.schemas import ENTRY_WEIGHTS, RELEVANCE_WEIGHTS, STYLE_KINDS, weight

R = Registry()
QUERIES, ORACLE = R.QUERIES, R.ORACLE


def nodes(s, d, *cols):
    return store.current_nodes(table(s, d, "nodes"), list(cols) or None)


def edges(s, d):
    return store.current_edges(table(s, d, "edges"))


def _cases(weights):
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 0.5 END"


_META = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"


@R.query(f"WITH {N} SELECT id, kind, name FROM n WHERE id = (SELECT min(id) FROM n WHERE kind = 'class')")
def flt01_get_node(s, d):
    n = nodes(s, d, "id", "kind", "name")
    first = n.filter("kind = 'class'").agg(F.min("id").alias("id"))
    return n.join(F.broadcast(first), "id", "left_semi")  # one row


@R.query(f"""WITH {N} SELECT qualified_name, arg_max(id, pr) AS id FROM (SELECT qualified_name, id,
    -row_number() OVER (PARTITION BY qualified_name ORDER BY CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END DESC NULLS LAST, id) AS pr FROM n WHERE qualified_name IS NOT NULL) GROUP BY 1""")
def flt02_by_qualified_name(s, d):
    n = nodes(s, d, "id", "qualified_name", "pagerank").filter("qualified_name is not null")
    rank = F.when(~F.isnan("pagerank"), F.col("pagerank"))
    return group_limit(n.withColumn("pagerank", rank), ["qualified_name"], [F.col("pagerank").desc_nulls_last(), F.col("id")], 1, 4).select("qualified_name", "id")


@R.query(f"""WITH {N} SELECT id, name FROM n WHERE kind = 'function' AND language = 'python' AND name ILIKE '%RANK%'
    AND NOT isnan(coalesce(pagerank, 0)) ORDER BY pagerank DESC NULLS LAST, id LIMIT 20 OFFSET 5""")
def flt03_find_nodes(s, d):
    n = nodes(s, d, "id", "kind", "language", "file_path", "name", "pagerank").filter("not isnan(coalesce(pagerank, 0))")
    return store.find_nodes(n, kind="function", language="python", name_like="%RANK%", limit=20, offset=5).select("id", "name")


@R.query(f"WITH {E} SELECT source_id, target_id, confidence FROM e WHERE kind = 'imports' AND confidence >= 0.8")
def flt04_get_edges(s, d):
    return store.get_edges(edges(s, d), kind="imports", min_confidence=0.8).select("source_id", "target_id", "confidence")


@R.query("""SELECT file_path, arg_max(content_hash, last_parsed) FILTER (content_hash IS NOT NULL) AS content_hash FROM files WHERE file_path LIKE '%/node_modules/%' GROUP BY 1""")
def flt05_file_hash(s, d):
    f = table(s, d, "files").filter(F.col("file_path").contains("/node_modules/"))
    return f.groupBy("file_path").agg(F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), F.col("last_parsed"))).alias("content_hash"))


@R.query("SELECT min(file_path) AS file_path FROM files WHERE ends_with(file_path, (SELECT split_part(min(file_path), '/', -1) FROM files))")
def flt06_normalise_path(s, d):
    f = table(s, d, "files")
    base = F.broadcast(f.agg(F.substring_index(F.min("file_path"), "/", -1).alias("base")))  # one row
    return f.crossJoin(base).filter(F.col("file_path").endswith(F.col("base"))).agg(F.min("file_path").alias("file_path"))


@R.query("SELECT DISTINCT file_path FROM files WHERE file_path ILIKE '%QUEUE%' ORDER BY 1 LIMIT 10")
def flt07_similar_files(s, d):
    return table(s, d, "files").filter(F.col("file_path").ilike("%QUEUE%")).select("file_path").distinct().orderBy("file_path").limit(10)


@R.query(f"WITH {N} SELECT id, kind FROM n WHERE lower(language) IN ('go', 'rust') AND lower(kind) IN ('class', 'method') AND contains(file_path, '/core/')")
def flt10_viz_filter(s, d):
    n = nodes(s, d, "id", "kind", "language", "file_path")
    return n.filter(F.lower("language").isin("go", "rust") & F.lower("kind").isin("class", "method") & F.col("file_path").contains("/core/")).select("id", "kind")


@R.query(f"WITH {N} SELECT DISTINCT file_path FROM n WHERE ({_META.format('visibility')}) = 'private'")
def flt11_json_predicate(s, d):
    return nodes(s, d, "id", "file_path", "metadata").filter(F.get_json_object("metadata", "$.visibility") == "private").select("file_path").distinct()


@R.query(f"""WITH {N} SELECT kind, language, id FROM (SELECT kind, language, id, row_number() OVER (PARTITION BY kind, language ORDER BY id) AS rn FROM n) WHERE rn <= 50""")
def flt12_first_per_kind(s, d):
    return group_limit(nodes(s, d, "id", "kind", "language"), ["kind", "language"], [F.col("id")], 50)


@R.query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def flt13_events(s, d):
    return table(s, d, "events").filter("event_type = 'purchase'").orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "user_id")


@R.query("SELECT doc_id, source FROM documents WHERE source IN ('session_note', 'commit_message') AND created_at IS NOT NULL ORDER BY created_at DESC, doc_id LIMIT 50")
def flt14_context(s, d):
    return table(s, d, "documents").filter("source in ('session_note', 'commit_message') and created_at is not null").orderBy(F.col("created_at").desc(), "doc_id").limit(50).select("doc_id", "source")


@R.query("SELECT doc_id, doc_id <> (SELECT max(doc_id) FROM documents WHERE source = 'session_note') AS active FROM documents WHERE source = 'session_note'")
def flt15_deactivate(s, d):
    n = table(s, d, "documents").filter("source = 'session_note'").select("doc_id")
    last = F.broadcast(n.agg(F.max("doc_id").alias("last")))  # one row
    return n.crossJoin(last).select("doc_id", (F.col("doc_id") != F.col("last")).alias("active"))


@R.query(f"""WITH {N} SELECT focus, count(*) AS n FROM (SELECT unnest(list_filter([
    CASE WHEN language IN ('php', 'python', 'go', 'rust') THEN 'backend' END, CASE WHEN language IN ('javascript', 'typescript') THEN 'frontend' END,
    CASE WHEN kind = 'interface' THEN 'types' END, 'full'], lambda x: x IS NOT NULL)) AS focus FROM n) GROUP BY 1""")
def flt16_focus(s, d):
    n = nodes(s, d, "id", "kind", "language")
    focus = F.array(
        F.when(F.col("language").isin("php", "python", "go", "rust"), F.lit("backend")),
        F.when(F.col("language").isin("javascript", "typescript"), F.lit("frontend")),
        F.when(F.col("kind") == "interface", F.lit("types")),
        F.lit("full"),
    )
    return n.select(F.explode(F.array_compact(focus)).alias("focus")).groupBy("focus").agg(F.count("*").alias("n"))


@R.query(f"WITH {E} SELECT kind, count(*) AS n, count(*) FILTER (confidence < 0.5) AS low FROM e GROUP BY 1")
def flt17_low_confidence(s, d):
    return edges(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("low"))


@R.query(f"WITH {N} SELECT id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.lines')::INT END AS lines, ({_META.format('visibility')}) AS visibility FROM n")
def prj01_metadata_codec(s, d):
    n = nodes(s, d, "id", "metadata")
    m = F.from_json("metadata", "visibility string, lines int")
    return n.select("id", m["lines"].alias("lines"), m["visibility"].alias("visibility"))


@R.query(f"WITH {N} SELECT id, round(pagerank, 6) AS pagerank, community_id AS community FROM n WHERE pagerank IS NOT NULL AND NOT isnan(pagerank)")
def prj02_viz_projection(s, d):
    n = nodes(s, d, "id", "pagerank", "community_id").filter("pagerank is not null and not isnan(pagerank)")
    return n.select("id", F.round("pagerank", 6).alias("pagerank"), F.col("community_id").alias("community"))


@R.query(f"WITH {N}, {E} SELECT n.id, count(e.source_id) AS in_degree FROM n LEFT JOIN e ON e.target_id = n.id GROUP BY 1")
def jn02_in_degree(s, d):
    return nodes(s, d, "id").join(store.in_degrees(edges(s, d)), "id", "left").fillna(0, ["in_degree"])


@R.query("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def jn03_left_join_count(s, d):
    per = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(s, d, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["n"])


@R.query(f"WITH {N}, {E} SELECT e.source_id, e.target_id, e.kind FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def jn21_both_ends(s, d):
    ids = nodes(s, d, "id")
    e = edges(s, d).select("source_id", "target_id", "kind")
    return e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind")


@R.query("SELECT DISTINCT file_path FROM files WHERE file_path NOT IN (SELECT file_path FROM file_scans WHERE op <> 'deleted' AND file_path IS NOT NULL)")
def jn22_stale_files(s, d):
    seen = table(s, d, "file_scans").filter("op <> 'deleted'").select("file_path").distinct()
    return table(s, d, "files").select("file_path").distinct().join(seen, "file_path", "left_anti")


@R.query(f"WITH {N}, {E} SELECT n.language, e.kind, count(*) AS n FROM e JOIN n ON e.source_id = n.id GROUP BY ALL")
def jn24_language_edges(s, d):
    e = edges(s, d).select(F.col("source_id").alias("id"), F.col("kind").alias("edge_kind"))
    return nodes(s, d, "id", "language").join(e, "id").groupBy("language", F.col("edge_kind").alias("kind")).agg(F.count("*").alias("n"))


@R.query(f"WITH {N} SELECT kind, language, n, (sum(n) OVER (PARTITION BY kind))::BIGINT AS n_kind FROM (SELECT kind, language, count(*) AS n FROM n GROUP BY ALL)")
def ag01_summary_nodes(s, d):
    n = nodes(s, d, "id", "kind", "language").groupBy("kind", "language").agg(F.count("*").alias("n"))
    return n.withColumn("n_kind", F.sum("n").over(W.partitionBy("kind")))


@R.query(f"""WITH {N}, {E} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT community_id) FROM n) AS communities, (SELECT count(DISTINCT file_path) FROM n) AS files,
    count(*) AS edges, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence FROM e""")
def ag01_summary(s, d):
    return store.summary(nodes(s, d, "id", "community_id", "file_path"), edges(s, d))


@R.query("""SELECT 'nodes' AS t, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM files""")
def ag02_stats(s, d):
    one = [table(s, d, t).agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in ("nodes", "edges", "files")]
    return one[0].unionAll(one[1]).unionAll(one[2])


@R.query(f"""WITH {N}, sizes AS (SELECT community_id, count(*) AS size FROM n WHERE community_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
    SELECT community_id, size, id FROM (SELECT community_id, size, id, row_number() OVER (PARTITION BY community_id
      ORDER BY CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END DESC NULLS LAST, id) AS rn FROM n JOIN sizes USING (community_id)) WHERE rn <= 50""")
def ag03_communities_topn(s, d):
    return store.communities(nodes(s, d, "id", "community_id", "pagerank")).select("community_id", "size", "id")


@R.query(f"""WITH {N}, {E}, deg AS (SELECT target_id AS id, count(*) AS in_degree FROM e GROUP BY 1)
    SELECT id, kind, in_degree, round((in_degree * {_cases(ENTRY_WEIGHTS)})::DOUBLE, 6) AS score FROM n JOIN deg USING (id) WHERE pagerank > 0 AND NOT isnan(pagerank)
    ORDER BY score DESC, id LIMIT 15""")
def ag04_entry_points(s, d):
    return store.entry_points(nodes(s, d, "id", "kind", "language", "pagerank"), edges(s, d))


@R.query(f"""WITH {N}, {E}, deg AS (SELECT target_id AS id, count(DISTINCT source_id) AS in_degree FROM e WHERE source_id IN (SELECT id FROM n) GROUP BY 1)
    SELECT id, round((in_degree * {_cases(RELEVANCE_WEIGHTS)})::DOUBLE, 6) AS score FROM n JOIN deg USING (id) ORDER BY score DESC, id LIMIT 20""")
def ag05_entry_points_graph(s, d):
    g = store.graph_edges(table(s, d, "nodes"), table(s, d, "edges"))
    deg = g.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    n = nodes(s, d, "id", "kind").join(deg, "id").select("id", F.round(F.col("in_degree") * weight(F.col("kind"), RELEVANCE_WEIGHTS), 6).alias("score"))
    return n.orderBy(F.col("score").desc(), "id").limit(20)


@R.query(f"WITH {N} SELECT file_path, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM n WHERE kind <> 'file' GROUP BY 1")
def ag07_file_map(s, d):
    return store.file_map(nodes(s, d, "id", "kind", "file_path"))


@R.query(f"""WITH {N}, f AS (SELECT str_split(file_path, '/') AS p, count(*) AS n FROM n WHERE kind <> 'file' GROUP BY 1)
    SELECT directory, sum(n)::BIGINT AS n FROM (SELECT unnest([array_to_string(p[1:k], '/') FOR k IN range(1, len(p))]) AS directory, n FROM f) GROUP BY 1""")
def ag08_directory_counts(s, d):
    return store.directory_counts(nodes(s, d, "id", "kind", "file_path"))


@R.query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def ag09_hot_targets(s, d):
    return table(s, d, "events").filter("event_type in ('view', 'click')").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(20)


@R.query("""SELECT user_id, count(*) AS n, count(DISTINCT ts::DATE) AS days, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1""")
def ag10_session_summary(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@R.query("SELECT user_id, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'click') AS edits, round(sum(value), 4) AS total FROM events GROUP BY 1")
def ag11_conditional_counts(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "click").alias("edits"), F.round(F.sum("value"), 4).alias("total"))


@R.query(f"""WITH {N}, first AS (SELECT split_part(file_path, '/', 2) AS prefix, count(DISTINCT file_path) AS n FROM n WHERE len(str_split(file_path, '/')) > 2 GROUP BY 1)
    SELECT prefix, n FROM first WHERE n >= 0.1 * (SELECT count(DISTINCT file_path) FROM n) ORDER BY n DESC, prefix LIMIT 5""")
def ag15_common_prefixes(s, d):
    f = nodes(s, d, "id", "file_path").select("file_path").distinct()
    total = F.broadcast(f.agg(F.count("*").alias("all")))  # one row
    parts = F.split("file_path", "/")
    first = f.filter(F.size(parts) > 2).groupBy(F.element_at(parts, 2).alias("prefix")).agg(F.count("*").alias("n"))
    return first.crossJoin(total).filter(F.col("n") >= 0.1 * F.col("all")).orderBy(F.col("n").desc(), "prefix").limit(5).select("prefix", "n")


@R.query(f"""WITH {N} SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY pagerank DESC, id) AS rn FROM n
    WHERE pagerank IS NOT NULL AND NOT isnan(pagerank) AND kind IN ('class', 'function', 'file')) WHERE rn <= 10""")
def ag17_architecture(s, d):
    n = nodes(s, d, "id", "kind", "pagerank").filter("pagerank is not null and not isnan(pagerank) and kind in ('class', 'function', 'file')")
    return group_limit(n, ["kind"], [F.col("pagerank").desc(), F.col("id")], 10).select("kind", "id")


@R.query(f"WITH {N} SELECT kind, count(*) AS n, count(DISTINCT file_path) AS files, count(DISTINCT language) AS languages FROM n GROUP BY 1")
def ag18_export_counters(s, d):
    return nodes(s, d, "id", "kind", "file_path", "language").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.countDistinct("language").alias("languages"))


@R.query(f"WITH {N} SELECT file_path, kind, count(*) AS n FROM n GROUP BY ALL")
def ag19_file_kinds(s, d):
    return nodes(s, d, "id", "kind", "file_path").groupBy("file_path", "kind").agg(F.count("*").alias("n"))


@R.query("SELECT lower(language) AS language, count(DISTINCT file_path) AS files, round(sum(parse_time_ms), 2) AS parse_ms, sum(node_count)::BIGINT AS nodes FROM files GROUP BY 1")
def ag20_language_breakdown(s, d):
    return table(s, d, "files").groupBy(F.lower("language").alias("language")).agg(F.countDistinct("file_path").alias("files"), F.round(F.sum("parse_time_ms"), 2).alias("parse_ms"), F.sum("node_count").alias("nodes"))


@R.query("SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS mean, (sum(length(text)) // 4)::BIGINT AS tokens FROM documents GROUP BY 1")
def ag21_corpus_stats(s, d):
    x = table(s, d, "documents").groupBy("source")
    return x.agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean"), F.expr("sum(length(text)) div 4").alias("tokens"))


@R.query(f"WITH {E} SELECT kind, count(*) AS n FROM e WHERE kind IN ('calls', 'extends', 'uses_trait') GROUP BY 1")
def ag23_kinds_in(s, d):
    return edges(s, d).filter("kind in ('calls', 'extends', 'uses_trait')").groupBy("kind").agg(F.count("*").alias("n"))


@R.query("""WITH e AS (SELECT CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.strategy') END AS strategy FROM edges)
    SELECT strategy, CASE strategy WHEN 'exact' THEN 0 WHEN 'suffix' THEN 1 ELSE 2 END AS place, count(*) AS n FROM e WHERE strategy IS NOT NULL GROUP BY ALL""")
def ag24_by_strategy(s, d):
    e = table(s, d, "edges").select(F.get_json_object("metadata", "$.strategy").alias("strategy")).filter("strategy is not null")
    return e.groupBy("strategy").agg(F.count("*").alias("n")).withColumn("place", F.when(F.col("strategy") == "exact", 0).when(F.col("strategy") == "suffix", 1).otherwise(2))


@R.query("SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT DISTINCT query_id, node_id, score FROM search_results WHERE fts_rank > 0)")
def wn01_rank(s, d):
    r = table(s, d, "search_results").filter("fts_rank > 0").select("query_id", "node_id", "score").distinct()
    return r.select("query_id", "node_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")).alias("rank"))


@R.query("SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY vector_similarity DESC, node_id) AS rank FROM (SELECT DISTINCT query_id, node_id, vector_similarity FROM search_results WHERE vector_similarity > 0)")
def wn02_vector_rank(s, d):
    r = table(s, d, "search_results").filter("vector_similarity > 0").select("query_id", "node_id", "vector_similarity").distinct()
    return r.select("query_id", "node_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("vector_similarity").desc(), "node_id")).alias("rank"))


@R.query("""SELECT event_id, prev FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL""")
def wn09_lag_chain(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev")).filter("prev is not null")


@R.query(f"WITH {N} SELECT id, pagerank FROM n WHERE pagerank > 0 AND NOT isnan(pagerank) AND lower(language) = 'php' ORDER BY pagerank DESC, id LIMIT 25")
def tk01_top_pagerank(s, d):
    return store.top_by_pagerank(nodes(s, d, "id", "kind", "language", "pagerank"), 25, language="PHP").select("id", "pagerank")


@R.query(f"""WITH {N}, {E}, o AS (SELECT source_id AS id, count(DISTINCT target_id) AS out_degree FROM e WHERE target_id IN (SELECT id FROM n) GROUP BY 1)
    SELECT id, out_degree FROM n JOIN o USING (id) ORDER BY out_degree DESC, id LIMIT 20""")
def tk02_top_out_degree(s, d):
    g = store.graph_edges(table(s, d, "nodes"), table(s, d, "edges"))
    return g.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")).orderBy(F.col("out_degree").desc(), "id").limit(20)


@R.query(f"""WITH {N} SELECT id FROM n WHERE pagerank > 0 AND NOT isnan(pagerank) AND kind NOT IN ({', '.join(repr(k) for k in STYLE_KINDS)}) AND file_path <> '<external>'
    ORDER BY pagerank DESC, id LIMIT 10""")
def tk03_summary_top(s, d):
    return store.top_by_pagerank(nodes(s, d, "id", "kind", "language", "file_path", "pagerank"), 10, summary=True).select("id")


@R.query(f"""WITH {N} SELECT id, CASE WHEN lower(name) = 'rankqueue' THEN 0 WHEN name ILIKE 'rank%' THEN 1 ELSE 2 END AS tier FROM n WHERE name ILIKE '%rank%'
    ORDER BY tier, CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END DESC NULLS LAST, id LIMIT 30""")
def tk04_like_fallback(s, d):
    n = nodes(s, d, "id", "name", "pagerank").filter(F.col("name").ilike("%rank%"))
    tier = F.when(F.lower("name") == "rankqueue", 0).when(F.col("name").ilike("rank%"), 1).otherwise(2)
    rank = F.when(~F.isnan("pagerank"), F.col("pagerank"))
    return n.select("id", tier.alias("tier"), rank.alias("r")).orderBy("tier", F.col("r").desc_nulls_last(), "id").limit(30).select("id", "tier")


@R.query("SELECT id, x FROM (SELECT id, false AS x FROM nodes UNION SELECT id, true FROM external_symbols) ORDER BY x, id LIMIT 40 OFFSET 10")
def tk05_externals_last(s, d):
    n = table(s, d, "nodes").select("id", F.lit(False).alias("x")).union(table(s, d, "external_symbols").select("id", F.lit(True).alias("x"))).distinct()
    return n.orderBy("x", "id").offset(10).limit(40)


@R.query("SELECT repo, started_at FROM parse_runs ORDER BY started_at DESC, run_id LIMIT 5")
def tk09_recent_runs(s, d):
    return table(s, d, "parse_runs").orderBy(F.col("started_at").desc(), "run_id").limit(5).select("repo", "started_at")


@R.query("SELECT DISTINCT file_path FROM files EXCEPT SELECT file_path FROM file_scans")
def so01_difference(s, d):
    return table(s, d, "files").select("file_path").subtract(table(s, d, "file_scans").select("file_path"))


@R.query("SELECT source_id AS id FROM edges WHERE source_id IS NOT NULL UNION SELECT target_id FROM edges WHERE target_id IS NOT NULL")
def so02_union_ids(s, d):
    e = table(s, d, "edges")
    return e.select(F.col("source_id").alias("id")).union(e.select("target_id")).filter("id is not null").distinct()


@R.query(f"""WITH {N}, l AS (SELECT id, 0 AS place FROM n WHERE kind = 'class' UNION ALL SELECT id, 1 FROM n WHERE name ILIKE 'a%' UNION ALL SELECT id, 2 FROM n WHERE language = 'go')
    SELECT id, min(place) AS place FROM l GROUP BY 1 ORDER BY 2, 1 LIMIT 60""")
def so03_keep_first(s, d):
    n = nodes(s, d, "id", "kind", "name", "language")
    lists = [n.filter("kind = 'class'"), n.filter(F.col("name").ilike("a%")), n.filter("language = 'go'")]
    tagged = [x.select("id", F.lit(k).alias("place")) for k, x in enumerate(lists)]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).groupBy("id").agg(F.min("place").alias("place")).orderBy("place", "id").limit(60)


@R.query(f"WITH {N} SELECT name, min(id) AS id FROM n WHERE kind IN ('css_variable', 'scss_variable', 'scss_mixin') GROUP BY 1")
def so04_union_lookup(s, d):
    n = nodes(s, d, "id", "kind", "name")
    return n.filter("kind = 'css_variable'").unionByName(n.filter("kind in ('scss_variable', 'scss_mixin')")).groupBy("name").agg(F.min("id").alias("id"))


@R.query("SELECT file_path, max_by(op, {'t': seen_at, 's': scan_id}) AS op FROM file_scans GROUP BY 1")
def so07_last_event(s, d):
    return table(s, d, "file_scans").groupBy("file_path").agg(F.max_by("op", F.struct("seen_at", "scan_id")).alias("op"))


@R.query(f"""WITH x AS (SELECT id, name, 1 AS seq FROM nodes WHERE kind = 'class' UNION ALL SELECT id, upper(name), 2 FROM nodes WHERE kind = 'class' AND language = 'php' UNION ALL SELECT id, name, 1 FROM nodes WHERE kind = 'interface')
    SELECT id, max_by(name, seq) AS name FROM x GROUP BY 1""")
def snk01_upsert_nodes(s, d):
    n = table(s, d, "nodes").select("id", "name", "kind", "language").distinct()
    old = n.filter("kind in ('class', 'interface')").select("id", "name")
    new = n.filter("kind = 'class' and language = 'php'").select("id", F.upper("name").alias("name"), F.lit(2).alias("seq"))
    return store.upsert(old, new, ["id"])


@R.query(f"WITH {E} SELECT source_id, target_id, kind, confidence, line_number FROM e")
def snk02_upsert_edges(s, d):
    return edges(s, d).select("source_id", "target_id", "kind", "confidence", "line_number")


@R.query(f"""WITH {N}, {E}, gone AS (SELECT id FROM n WHERE file_path LIKE 'harborline/%')
    SELECT source_id, target_id, kind FROM e WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)""")
def snk03_delete_files(s, d):
    n = nodes(s, d, "id", "file_path")
    _, left = store.delete_file(n, edges(s, d), n.filter(F.col("file_path").startswith("harborline/")))
    return left.select("source_id", "target_id", "kind")


@R.query(f"""WITH {N}, s AS (SELECT target_id AS id, count(*) AS c FROM edges GROUP BY 1) SELECT n.id, coalesce(c, 0)::DOUBLE AS pagerank, (c % 10)::INT AS community_id FROM n LEFT JOIN s USING (id)""")
def snk07_scores(s, d):
    sc = table(s, d, "edges").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("c"))
    sc = sc.select("id", F.col("c").cast("double").alias("pagerank"), (F.col("c") % 10).cast("int").alias("community_id"))
    return store.with_scores(nodes(s, d, "id"), sc)


@R.query(f"""WITH {N}, {E}, kept AS (SELECT id FROM n WHERE NOT isnan(coalesce(pagerank, 0)) ORDER BY pagerank DESC NULLS LAST, id LIMIT 500)
    SELECT source_id, target_id, kind, round(confidence, 4) AS confidence FROM e WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)""")
def snk09_viz_edges(s, d):
    top = F.broadcast(nodes(s, d, "id", "pagerank").filter("not isnan(coalesce(pagerank, 0))").orderBy(F.col("pagerank").desc_nulls_last(), "id").limit(500).select("id"))  # 500 rows
    e = edges(s, d).select("source_id", "target_id", "kind", F.round("confidence", 4).alias("confidence"))
    return e.join(top.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(top.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind", "confidence")
