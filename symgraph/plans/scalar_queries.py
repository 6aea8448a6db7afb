"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.core import table
from symgraph.functions import scalars as S
from symgraph.plans.registry import Registry

R = Registry()
QUERIES, ORACLE = R.QUERIES, R.ORACLE


def _nodes(s, d, *cols):
    return table(s, d, "nodes").select("id", *cols).distinct()


_SPLIT = "replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' ')"
_URL = "CASE id % 4 WHEN 0 THEN '/api/{user_id}/x?q=' || id WHEN 1 THEN 'https://h.example:80/v1/:id/$tok#f' WHEN 2 THEN 'users/${u}/posts' ELSE '/plain/' || id END"
_URLS = f"u AS (SELECT id, {_URL} AS url FROM (SELECT doc_id AS id FROM documents))"


def _urls(s, d):
    i = F.col("id")
    m = i % 4
    url = F.when(m == 0, F.concat(F.lit("/api/{user_id}/x?q="), i.cast("string"))).when(m == 1, F.lit("https://h.example:80/v1/:id/$tok#f")).when(m == 2, F.lit("users/${u}/posts")).otherwise(F.concat(F.lit("/plain/"), i.cast("string")))
    return table(s, d, "documents").select(F.col("doc_id").alias("id")).select("id", url.alias("url"))


@R.query(f"""SELECT id, array_to_string(flatten(list_transform(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda w: w <> ''),
    lambda w: CASE WHEN len(list_filter(regexp_split_to_array({_SPLIT.format('w')}, '\\s+'), lambda p: p <> '')) > 1
         THEN list_append(list_filter(regexp_split_to_array({_SPLIT.format('w')}, '\\s+'), lambda p: p <> ''), w)
         ELSE list_filter(regexp_split_to_array({_SPLIT.format('w')}, '\\s+'), lambda p: p <> '') END)) , '* OR ') || '*' AS q
    FROM (SELECT DISTINCT id, name FROM nodes WHERE kind IN ('class', 'method') AND name <> '')""")
def sf01_query_terms(s, d):
    return _nodes(s, d, "name", "kind").filter("kind in ('class', 'method') and name <> ''").select("id", S.query_expression(F.col("name")).alias("q"))


@R.query(f"WITH {_URLS} SELECT id, regexp_replace(url, '\\{{[^}}]+\\}}|\\$[a-zA-Z_][a-zA-Z0-9_]*|:[a-zA-Z_][a-zA-Z0-9_]*|\\$\\{{[^}}]+\\}}', '{{param}}', 'g') AS url FROM u")
def sf02_normalise_url(s, d):
    return _urls(s, d).select("id", S.normalise_url(F.col("url")).alias("url"))


@R.query(f"WITH {_URLS} SELECT id, regexp_replace(url, '\\$\\{{[^}}]+\\}}', '{{param}}', 'g') AS url FROM u")
def sf03_clean_template(s, d):
    return _urls(s, d).select("id", S.clean_template(F.col("url")).alias("url"))


@R.query(f"WITH {_URLS} SELECT id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM u")
def sf04_without_query(s, d):
    return _urls(s, d).select("id", S.without_query(F.col("url")).alias("url"))


@R.query(f"""WITH {_URLS} SELECT id, CASE WHEN url LIKE 'https://%' THEN regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) WHEN url LIKE '/%' THEN url ELSE '/' || url END AS path FROM u""")
def sf05_url_path(s, d):
    return _urls(s, d).select("id", S.url_path(F.col("url")).alias("path"))


@R.query("SELECT id, levenshtein(name, reverse(name)) AS dist FROM (SELECT DISTINCT id, name FROM nodes WHERE name IS NOT NULL)")
def sf06_levenshtein(s, d):
    return _nodes(s, d, "name").filter("name is not null").select("id", F.levenshtein("name", F.reverse("name")).alias("dist"))


@R.query("SELECT DISTINCT file_path, len(list_filter(str_split(file_path, '/'), lambda x: x <> ''))::INT AS n, array_to_string(list_filter(str_split(file_path, '/'), lambda x: x <> '')[1:2], '/') AS head FROM files")
def sf07_segments(s, d):
    f = table(s, d, "files").select("file_path").distinct()
    g = S.segments(F.col("file_path"))
    return f.select("file_path", F.size(g).alias("n"), F.array_join(F.slice(g, 1, 2), "/").alias("head"))


@R.query("SELECT doc_id, len(regexp_extract_all(text, '\\n'))::INT + 1 AS lines FROM documents WHERE text IS NOT NULL")
def sf08_line_number(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"))


@R.query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def sf09_estimate_tokens(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@R.query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def sf10_quarter(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))


@R.query("SELECT doc_id, md5(CASE WHEN length(text) // 4 > 100 THEN left(text, 350) || chr(10) || '...' ELSE text END) AS h FROM documents WHERE text IS NOT NULL")
def sf11_truncate(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.md5(S.truncate_to_budget(F.col("text"), 100)).alias("h"))


@R.query("SELECT doc_id, sha256(text) AS h, 'ext:' || left(sha256(source), 16) AS placeholder FROM documents WHERE text IS NOT NULL")
def sf14_hashes(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", S.content_hash(F.col("text")).alias("h"), S.placeholder_id(F.col("source")).alias("placeholder"))


@R.query("SELECT DISTINCT id, file_path || ':' || start_line || ':' || kind || ':' || name AS made FROM nodes")
def sf15_node_id(s, d):
    n = _nodes(s, d, "file_path", "start_line", "kind", "name")
    return n.select("id", S.node_id(F.col("file_path"), F.col("start_line"), F.col("kind"), F.col("name")).alias("made")).distinct()


@R.query("""WITH n AS (SELECT DISTINCT id, qualified_name AS q FROM nodes WHERE qualified_name IS NOT NULL), p AS (SELECT id, list_filter(str_split(replace(q, '::', '\\'), '\\'), lambda x: x <> '') AS p FROM n)
    SELECT id, p[-1] AS short, len(p)::INT AS n, array_to_string(CASE WHEN len(p) > 2 THEN [array_to_string(p[k:], '\\') FOR k IN range(2, len(p))] ELSE [] END, '|') AS suffixes FROM p""")
def sf16_name_parts(s, d):
    q = F.col("qualified_name")
    return _nodes(s, d, "qualified_name").filter("qualified_name is not null").select("id", S.short_name(q).alias("short"), F.size(S.name_parts(q)).alias("n"), F.array_join(S.name_suffixes(q), "|").alias("suffixes"))


@R.query("""SELECT id, concat_ws(' ', kind || ': ' || name, CASE WHEN file_path <> '' THEN 'in ' || file_path END,
      CASE WHEN regexp_extract(qualified_name, '^(.*)(?:\\.|::)', 1) <> '' THEN '(' || kind || ' of ' || regexp_extract(qualified_name, '^(.*)(?:\\.|::)', 1) || ')' END,
      CASE WHEN qualified_name <> '' AND qualified_name <> name THEN '[' || qualified_name || ']' END,
      CASE WHEN docblock <> '' THEN '. ' || CASE WHEN length(trim(docblock)) > 500 THEN left(trim(docblock), 500) || '...' ELSE trim(docblock) END END) AS text
    FROM (SELECT DISTINCT id, kind, name, file_path, qualified_name, docblock FROM nodes)""")
def sf17_node_text(s, d):
    n = _nodes(s, d, "kind", "name", "file_path", "qualified_name", "docblock")
    return n.select("id", S.node_text(*[F.col(c) for c in ("kind", "name", "file_path", "qualified_name", "docblock")]).alias("text"))


@R.query("SELECT DISTINCT id, regexp_extract(qualified_name, '^(.*)(?:\\.|::)', 1) AS parent FROM nodes WHERE qualified_name IS NOT NULL")
def sf18_parent_name(s, d):
    return _nodes(s, d, "qualified_name").filter("qualified_name is not null").select("id", S.parent_name(F.col("qualified_name")).alias("parent"))


@R.query("""WITH m AS (SELECT max(pagerank) AS pr FROM nodes WHERE NOT isnan(pagerank))
    SELECT DISTINCT id, round(least(1.0, 0.30 * pagerank / pr + 0.25 * (community_id % 10) / 9.0 + 0.25 * CASE kind WHEN 'class' THEN 1.0 WHEN 'function' THEN 0.8 ELSE 0.5 END
      + 0.20 * CASE WHEN lower(name) = 'main' THEN 1.0 WHEN contains(lower(name), 'queue') THEN 0.5 ELSE 0 END), 6) AS score
    FROM nodes, m WHERE pagerank IS NOT NULL AND NOT isnan(pagerank) AND community_id IS NOT NULL""")
def sf19_relevance(s, d):
    n = _nodes(s, d, "kind", "name", "pagerank", "community_id").filter("pagerank is not null and not isnan(pagerank) and community_id is not null")
    top = F.broadcast(table(s, d, "nodes").filter("not isnan(pagerank)").agg(F.max("pagerank").alias("pr")))  # one row
    w = F.when(F.col("kind") == "class", 1.0).when(F.col("kind") == "function", 0.8).otherwise(0.5)
    b = F.when(F.lower("name") == "main", 1.0).when(F.lower("name").contains("queue"), 0.5).otherwise(0.0)
    return n.crossJoin(top).select("id", F.round(S.relevance(F.col("pagerank"), F.col("pr"), F.col("community_id") % 10, F.lit(9.0), w, b), 6).alias("score"))


@R.query("""SELECT query_id, node_id, round(CASE WHEN fts_rank > 0 THEN 0.5 / (fts_rank + 60) ELSE 0 END + CASE WHEN vector_rank > 0 THEN 0.5 / (vector_rank + 60) ELSE 0 END, 9) AS score
    FROM (SELECT DISTINCT query_id, node_id, fts_rank, vector_rank FROM search_results)""")
def sf20_rrf(s, d):
    r = table(s, d, "search_results").select("query_id", "node_id", "fts_rank", "vector_rank").distinct()
    return r.select("query_id", "node_id", F.round(S.rrf(F.col("fts_rank"), F.col("vector_rank")), 9).alias("score"))


@R.query("SELECT event_id, round(exp(-0.693 * date_diff('day', ts::DATE, DATE '2024-02-01') / 90.0), 6) AS recency FROM events")
def sf21_recency(s, d):
    return table(s, d, "events").select("event_id", F.round(S.recency(F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))), 6).alias("recency"))


@R.query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def sf22_iso_dates(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@R.query("""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Method x() should return int but returns string.' WHEN 1 THEN 'Parameter $a of method m() has no type specified.'
      WHEN 2 THEN 'Parameter #1 expects int, string given.' ELSE 'Method y() has no return type specified.' END AS m FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'parameter_type' WHEN 3 THEN 'return_type' END AS missing, nullif(regexp_extract(m, 'should return (.*?) but returns', 1), '') AS expected_return_type,
      nullif(regexp_extract(m, 'expects (.*?),.*given', 1), '') AS expected_type FROM m""")
def sf23_analyser_facts(s, d):
    k = F.col("doc_id") % 4
    m = F.when(k == 0, "Method x() should return int but returns string.").when(k == 1, "Parameter $a of method m() has no type specified.").when(k == 2, "Parameter #1 expects int, string given.").otherwise("Method y() has no return type specified.")
    f = table(s, d, "documents").select("doc_id", S.analyser_facts(m).alias("f"))
    return f.select("doc_id", "f.missing", "f.expected_return_type", "f.expected_type")


@R.query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def sf24_json(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.query("SELECT DISTINCT id, lower(replace(replace(name, '-', ''), '_', '')) AS pascal FROM nodes WHERE kind = 'css_class'")
def sf25_pascal(s, d):
    return _nodes(s, d, "name", "kind").filter("kind = 'css_class'").select("id", F.lower(S.pascal_case(F.col("name"))).alias("pascal"))


@R.query("""SELECT DISTINCT file_path, '/' || array_to_string(list_filter(str_split(regexp_extract(file_path, '(?:^|/)app/(.*)$', 1), '/')[1:-2], lambda x: x <> ''), '/') AS route
    FROM files WHERE regexp_matches(file_path, '/app/') AND NOT regexp_matches(file_path, '/app/.*app/|pages/')""")
def sf26_route_of_file(s, d):
    f = table(s, d, "files").select("file_path").distinct().filter(F.col("file_path").rlike("/app/") & ~F.col("file_path").rlike("/app/.*app/|pages/"))
    return f.select("file_path", S.route_of_file(F.col("file_path")).alias("route"))


@R.query("""SELECT r_name || '-' || m AS k, CASE WHEN a THEN 5 ELSE 7 END AS n FROM region, (VALUES ('web', false), ('api', true)) v(m, a)""")
def sf27_resource_routes(s, d):
    r = table(s, d, "region").select("r_name", F.explode(F.array(F.struct(F.lit("web").alias("m"), F.lit(False).alias("a")), F.struct(F.lit("api").alias("m"), F.lit(True).alias("a")))).alias("v"))
    x = r.select(F.concat_ws("-", "r_name", "v.m").alias("k"), F.explode(S.resource_routes(F.lower("r_name"), F.col("v.a"))).alias("route"))
    return x.groupBy("k").agg(F.count("*").cast("int").alias("n"))


@R.query("""SELECT DISTINCT id, CASE WHEN regexp_extract(name, '^--([a-z]+)', 1) IN ('color', 'spacing', 'font', 'text', 'breakpoint', 'radius', 'shadow', 'animate', 'ease', 'leading', 'tracking')
      THEN regexp_extract(name, '^--([a-z]+)', 1) ELSE 'other' END AS namespace FROM nodes WHERE kind = 'css_variable'""")
def sf28_token_namespace(s, d):
    return _nodes(s, d, "name", "kind").filter("kind = 'css_variable'").select("id", S.token_namespace(F.col("name")).alias("namespace"))


@R.query("""SELECT DISTINCT kind, CASE WHEN regexp_matches(kind, '[^aeiou]y$') THEN left(kind, length(kind) - 1) || 'ies' WHEN regexp_matches(kind, '(?:s|x|ch|sh)$') THEN kind || 'es' ELSE kind || 's' END AS plural FROM nodes""")
def sf29_plural(s, d):
    return table(s, d, "nodes").select("kind").distinct().select("kind", S.plural(F.col("kind")).alias("plural"))


@R.query("""WITH p AS (SELECT community_id, str_split(min(file_path), '/') AS a, str_split(max(file_path), '/') AS b FROM nodes WHERE community_id IS NOT NULL AND file_path LIKE 'harborline/%' GROUP BY 1)
    SELECT community_id, split_part(array_to_string(a, '/'), '/', 1) AS root FROM p""")
def sf30_common_prefix(s, d):
    n = table(s, d, "nodes").filter("community_id is not null and file_path like 'harborline/%'").groupBy("community_id").agg(F.min("file_path").alias("a"), F.max("file_path").alias("b"))
    return n.select("community_id", F.substring_index(S.common_prefix(F.array("a", "b")), "/", 1).alias("root"))


@R.query("SELECT lower(language) AS language, round(100.0 * count(*) / (SELECT count(*) FROM files), 1) AS share FROM files GROUP BY 1")
def sf31_shares(s, d):
    f = table(s, d, "files")
    total = F.broadcast(f.agg(F.count("*").alias("all")))  # one row
    return f.groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("n")).crossJoin(total).select("language", F.round(100.0 * F.col("n") / F.col("all"), 1).alias("share"))


@R.query("""SELECT DISTINCT file_path, CASE WHEN regexp_matches(file_path, '\\.php$') THEN 'php' WHEN regexp_matches(file_path, '\\.(js|mjs|cjs)$') THEN 'javascript' WHEN file_path LIKE '%.ts' THEN 'typescript'
      WHEN regexp_matches(file_path, '\\.pyi?$') THEN 'python' WHEN file_path LIKE '%.css' THEN 'css' WHEN file_path LIKE '%.scss' THEN 'scss' WHEN file_path LIKE '%.go' THEN 'go' WHEN file_path LIKE '%.rs' THEN 'rust' END AS language FROM files""")
def src05_detect_language(s, d):
    return table(s, d, "files").select("file_path").distinct().select("file_path", S.language_of(F.col("file_path")).alias("language"))


@R.query("SELECT DISTINCT file_path FROM files WHERE regexp_matches(file_path, '(^|/)(node_modules|vendor|dist|build|__pycache__|storage)/') OR regexp_matches(file_path, '\\.(min\\.js|min\\.css|map)$')")
def src02_ignored(s, d):
    globs = ["**/node_modules/**", "**/vendor/**", "**/.git/**", "**/dist/**", "**/build/**", "**/__pycache__/**", "**/storage/**", "**/*.min.js", "**/*.min.css", "**/*.map"]
    return table(s, d, "files").select("file_path").distinct().filter(F.col("file_path").rlike(S.glob_to_regex(globs)))


@R.query("""SELECT s.file_path, f.h IS NULL OR f.h <> s.h AS is_changed FROM (SELECT file_path, arg_max(content_hash, {'t': seen_at, 's': scan_id}) AS h FROM file_scans WHERE content_hash IS NOT NULL GROUP BY 1) s
    LEFT JOIN (SELECT file_path, arg_max(content_hash, last_parsed) AS h FROM files WHERE content_hash IS NOT NULL GROUP BY 1) f USING (file_path)""")
def src03_changed(s, d):
    a = table(s, d, "file_scans").filter("content_hash is not null").groupBy("file_path").agg(F.max_by("content_hash", F.struct("seen_at", "scan_id")).alias("h"))
    b = table(s, d, "files").filter("content_hash is not null").groupBy("file_path").agg(F.max_by("content_hash", "last_parsed").alias("stored"))
    return a.join(b, "file_path", "left").select("file_path", (F.col("stored").isNull() | (F.col("stored") != F.col("h"))).alias("is_changed"))
