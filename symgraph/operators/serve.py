"""Answers assembled from the graph under a token budget: symbols, routes, architecture, sessions; exports and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.core import cut_lineage, group_limit
from symgraph.functions import scalars as S
from symgraph.operators import context, graph, search, store
from symgraph.schemas import RELEVANCE_WEIGHTS, weight

# The order of the parts of a symbol's context and the share of the budget up to which each is filled.
PARTS = {"definition": 1.0, "relation": 0.85, "near": 1.0, "far": 1.0}
FAR_LIMIT = 20  # nodes two steps away that an answer names


def clamp(budget: int, least: int = 500, most: int = 16_000) -> int:
    return max(least, min(most, budget))


def _rank() -> Column:
    return F.coalesce(F.when(~F.isnan("pagerank"), F.col("pagerank")), F.lit(0.0))


def markdown(kind: Column, name: Column, path: Column, start: Column, end: Column, doc: Column | None = None) -> Column:
    """A node as a line of Markdown: its kind, name and place, and the first line of its documentation if there is one."""
    line = F.concat(F.lit("- **"), kind, F.lit("** `"), name, F.lit("` ("), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))
    if doc is None:
        return line
    first = F.trim(F.substring_index(F.trim(F.regexp_replace(doc, r"(?m)^\s*(?:/\*+|\*+/|\*|//+|#+)\s?|\*/", "")), "\n", 1))
    return F.concat(line, F.when(first != "", F.concat(F.lit(" - "), first)).otherwise(F.lit("")))


def symbol_context(nodes: DataFrame, edges: DataFrame, symbol: str, budget: int = 4000) -> DataFrame:
    """(place, part, id, text): what a symbol is and is related to, as lines, in order, within a budget.

    First its definition; then what it is directly related to other than by containment, by
    relevance, until 85 % of the budget is used; then nodes one and two steps away (at most
    ``FAR_LIMIT`` of the latter). A line that does not fit is passed over. An unknown symbol gives
    no rows. The parts are reduced to what the budget could hold before they are folded.
    """
    budget = clamp(budget)
    seed = cut_lineage(search.resolve_symbol(nodes, symbol).filter("place = 0").select("id"))
    e = edges.filter("source_id <> target_id").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "kind")
    related = graph.reach(seed, e.filter("kind <> 'contains'"), 1, True).filter("depth = 1").select("id")
    around = graph.reach(seed, e, 2, True).filter("depth > 0")
    first = seed.select("id", F.lit(0).alias("tier")).unionByName(related.select("id", F.lit(1).alias("tier")))
    far = around.select("id", (F.col("depth") + 1).alias("tier"))
    tiers = first.unionByName(far).groupBy("id").agg(F.min("tier").alias("tier"))
    degree = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deg"))
    n = nodes.join(tiers, "id").join(degree, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    score = F.round(0.6 * weight(F.col("kind"), RELEVANCE_WEIGHTS) + 0.4 * F.col("deg") / (F.col("deg") + 10), 6)
    text = markdown(F.col("kind"), F.col("name"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("docblock"))
    lines = n.select("id", "tier", (-score).alias("o"), text.alias("text")).withColumn("tokens", S.estimate_tokens(F.col("text")))
    # a line takes some ten tokens at least, so no tier can put more than a tenth of the budget's tokens of lines into the answer
    most = F.when(F.col("tier") == 3, FAR_LIMIT).otherwise(budget // 10 + 1)
    placed = group_limit(lines, ["tier"], [F.col("o"), F.col("id")], budget // 10 + 1)
    placed = placed.withColumn("rn", F.row_number().over(Window.partitionBy("tier").orderBy("o", "id"))).filter(F.col("rn") <= most)
    rows = F.sort_array(F.collect_list(F.struct("tier", "rn", "id", "text", "tokens")))
    share = F.create_map(*[F.lit(x) for k, v in enumerate(PARTS.values()) for x in (k, float(v))])
    fold = F.aggregate(
        "rows",
        F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<tier:int,rn:int,id:string,text:string,tokens:bigint>>").alias("kept")),
        lambda s, x: F.when(
            s["used"] + x["tokens"] <= budget * share[x["tier"]],
            F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["kept"], F.array(F.struct(x["tier"].alias("tier"), x["rn"].alias("rn"), x["id"].alias("id"), x["text"].alias("text"), x["tokens"].alias("tokens")))).alias("kept")),
        ).otherwise(s),
    )
    placed = placed.select(F.col("tier").cast("int").alias("tier"), F.col("rn").cast("int").alias("rn"), "id", "text", F.col("tokens").cast("bigint").alias("tokens"))
    one = placed.agg(rows.alias("rows")).select(F.posexplode(fold["kept"]).alias("place", "x"))
    names = F.create_map(*[F.lit(x) for k, v in enumerate(PARTS) for x in (k, v)])
    return one.select("place", names[F.col("x.tier")].alias("part"), F.col("x.id").alias("id"), F.col("x.text").alias("text"))


def find_routes(routes: DataFrame, pattern: str, method: str = "ANY") -> DataFrame:
    """Routes (id, name, url, method) whose URL matches a glob or holds the pattern, of a method unless ``ANY``; the URL is ``url`` or else the name."""
    url = F.coalesce("url", "name")
    hit = url.rlike(S.glob_to_regex([pattern])) | url.contains(pattern)
    out = routes.withColumn("url", url).filter(hit)
    return out if method.upper() == "ANY" else out.filter(F.upper("method") == method.upper())


def route_handlers(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, handler_id): the target of a route's first ``routes_to`` edge (by line, then id), else the route itself."""
    to = edges.filter("kind = 'routes_to'").groupBy(F.col("source_id").alias("id")).agg(F.min(F.struct(F.col("line_number").isNull(), "line_number", "target_id"))["target_id"].alias("to"))
    return routes.select("id").join(to, "id", "left").select(F.col("id").alias("route_id"), F.coalesce("to", "id").alias("handler_id"))


def route_callers(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, caller_id, confidence): who calls a route or its handler by an ``api_calls`` edge, the surest edge of each."""
    h = route_handlers(routes, edges)
    ends = h.select("route_id", F.explode(F.array_distinct(F.array("route_id", "handler_id"))).alias("target_id"))
    calls = edges.filter("kind = 'api_calls'").select("source_id", "target_id", "confidence")
    return calls.join(ends, "target_id").groupBy("route_id", F.col("source_id").alias("caller_id")).agg(F.max("confidence").alias("confidence"))


def architecture(nodes: DataFrame, edges: DataFrame, budget: int = 8000, tops: int = 10) -> DataFrame:
    """(section, place, item, n): an overview: kinds, languages, communities, key nodes and entry points, each in order, within a budget."""
    budget = clamp(budget, 1000, 32_000)
    top = lambda df, name: df.orderBy(F.col("n").desc(), "item").limit(tops).select(F.lit(name).alias("section"), F.col("item").cast("string").alias("item"), F.col("n").cast("double").alias("n"))
    counted = lambda c: nodes.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("item")).agg(F.count("*").alias("n"))
    parts = [
        top(counted("kind"), "1 kinds"),
        top(counted("language"), "2 languages"),
        top(counted("community_id"), "3 communities"),
        top(nodes.filter("pagerank > 0 and not isnan(pagerank)").select(F.col("id").alias("item"), F.round("pagerank", 9).alias("n")), "4 key nodes"),
        top(store.entry_points(nodes, edges, tops).select(F.col("id").alias("item"), F.col("score").alias("n")), "5 entry points"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.col("n").desc(), "item")))  # at most `tops` rows a section
    rows = rows.withColumn("tokens", S.estimate_tokens(F.concat_ws(" ", "section", "item"))).withColumn("all", F.lit(1))
    kept = context.fold_budget(rows.withColumn("row", F.concat_ws("\t", "section", F.col("place").cast("string"))), ["all"], [F.col("section"), F.col("place")], "tokens", "row", budget)
    return rows.withColumn("row", F.concat_ws("\t", "section", F.col("place").cast("string"))).join(kept.select("row"), "row").select("section", "place", "item", "n")


def neighbourhood(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 2, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the hits of a search (at most ten): the ``most`` nodes first by depth and pagerank, and the edges between them."""
    seeds = search.search_nodes(nodes, symbol, 10).select("id")
    g = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    found = graph.reach(seeds, g, depth, True)
    kept = cut_lineage(nodes.join(found, "id").withColumn("r", _rank()).orderBy("depth", F.col("r").desc(), "id").limit(most).drop("r"))
    ids = F.broadcast(kept.select("id"))  # `most` rows
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, e


def query(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 20, depth: int = 1, kind: str | None = None) -> DataFrame:
    """(id, depth): the hits of a node search and what lies up to ``depth`` steps around them."""
    hits = search.search_nodes(nodes, text, limit, kind).select("id")
    g = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return graph.reach(hits, g, depth, True)


def session_context(events: DataFrame, notes: DataFrame, budget: int = 1000, hot: int = 20, recent: int = 10) -> DataFrame:
    """(place, part, text): hot targets, then the newest active notes of each category, as lines that fit a budget.

    events: (target); notes: (id, category, text, created_at, active). Texts are whole; one that
    does not fit is passed over.
    """
    h = events.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "target").limit(hot)
    a = h.select(F.lit("hot").alias("part"), F.concat_ws(" x", "target", F.col("n").cast("string")).alias("text"), F.lit(0).alias("o"), (-F.col("n")).cast("double").alias("p"), F.col("target").alias("k"))
    n = group_limit(notes.filter("active and text is not null").select("id", "category", "text", "created_at"), ["category"], [F.col("created_at").desc(), F.col("id")], recent)
    b = n.select(F.col("category").alias("part"), "text", F.lit(1).alias("o"), (-F.unix_timestamp("created_at")).cast("double").alias("p"), F.col("id").cast("string").alias("k"))
    rows = a.unionByName(b).withColumn("tokens", S.estimate_tokens(F.col("text"))).withColumn("all", F.lit(1))
    rows = rows.withColumn("line", F.concat_ws("\t", "part", "text"))
    kept = context.fold_budget(rows, ["all"], [F.col("o"), F.col("part"), F.col("p"), F.col("k")], "tokens", "line", budget)
    return kept.select("place", F.substring_index("line", "\t", 1).alias("part"), F.expr("substring(line, locate('\t', line) + 1)").alias("text"))


def preload(nodes: DataFrame, edges: DataFrame, text: str, budget: int = 4000) -> DataFrame:
    """(part, place, item): what a session starts with: the overview, key files (two fifths of the budget), hits of a search, entry points."""
    files = nodes.filter("kind <> 'file'").groupBy("file_path").agg(F.round(F.sum(_rank()), 9).alias("r"), F.count("*").alias("n"))
    files = files.orderBy(F.col("r").desc(), "file_path").limit(budget // 10).withColumn("tokens", S.estimate_tokens(F.col("file_path")) + F.col("n") * 4).withColumn("all", F.lit(1))
    keys = context.fold_budget(files, ["all"], [-F.col("r"), F.col("file_path")], "tokens", "file_path", budget * 2 // 5)
    over = architecture(nodes, edges, budget).filter("section < '3'").select(F.lit("overview").alias("part"), F.col("place").cast("int").alias("place"), F.concat_ws(" ", "section", "item").alias("item"))
    hits = search.search_nodes(nodes, text, 10).withColumn("place", F.row_number().over(Window.orderBy("tier", F.col("score").desc(), "id")))  # ten rows
    entry = store.entry_points(nodes, edges, 10).withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))  # ten rows
    out = over.unionByName(keys.select(F.lit("key files").alias("part"), "place", F.col("file_path").alias("item")))
    return out.unionByName(hits.select(F.lit("hits").alias("part"), "place", F.col("id").alias("item"))).unionByName(entry.select(F.lit("entry points").alias("part"), "place", F.col("id").alias("item")))


def export_markdown(nodes: DataFrame, scope: str = "full", value: str | None = None, budget: int | None = None) -> DataFrame:
    """(file_path, text): symbols per file as Markdown, whole files in path order while they fit the budget (in tokens).

    scope: ``full``; ``file`` and ``symbol`` take the file of that path or the symbols of that name; ``architecture`` only classes, interfaces and traits.
    """
    n = nodes.filter("kind <> 'file'")
    if scope == "file":
        n = n.filter(F.col("file_path") == value)
    elif scope == "symbol":
        n = n.filter((F.col("name") == value) | (F.col("qualified_name") == value))
    elif scope == "architecture":
        n = n.filter(F.col("kind").isin("class", "interface", "trait"))
    elif scope != "full":
        raise ValueError(f"unknown scope: {scope}")
    line = F.struct("start_line", "id", markdown(F.col("kind"), F.col("name"), F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("line"))
    out = n.groupBy("file_path").agg(F.sort_array(F.collect_list(line)).alias("l"))  # the symbols of one file
    out = out.select("file_path", F.concat(F.lit("## "), F.col("file_path"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
    if budget is None:
        return out
    sized = out.select("file_path", S.estimate_tokens(F.col("text")).alias("tokens"), F.lit(1).alias("all"))
    # a file takes a token at least, so only the first `budget` files can be kept
    first = sized.orderBy("file_path").limit(budget)
    kept = context.fold_budget(first, ["all"], [F.col("file_path")], "tokens", "file_path", budget)
    return out.join(F.broadcast(kept.select("file_path")), "file_path", "left_semi")


def token_stats(usage: DataFrame, kind: str, tokens: Column, cached: Column | None = None) -> DataFrame:
    """(kind, n, total, mean, cached, cached_share): token use per kind, with the part that came from a cache."""
    c = F.coalesce(cached, F.lit(0.0)) if cached is not None else F.lit(0.0)
    g = usage.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.sum(tokens), 3).alias("total"), F.round(F.avg(tokens), 3).alias("mean"), F.round(F.sum(c), 3).alias("cached"))
    return g.withColumn("cached_share", F.round(F.when(F.col("total") > 0, F.col("cached") / F.col("total")).otherwise(0.0), 6))
