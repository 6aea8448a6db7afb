"""The graph store: current state, lookups, upserts, deletions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.core import cut_lineage, group_limit, keep_last, numbered
from symgraph.schemas import ENTRY_WEIGHTS, STYLE_KINDS, weight

BROADCAST_ROWS = 200_000  # keys that may be broadcast; more are joined by a shuffle
LIGHT = ["id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "language", "pagerank", "community_id"]


def current_nodes(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The newest delivery of each node that was not removed; only the named columns are read."""
    cols = columns or LIGHT
    src = nodes.select(*cols, "ingested_at", "removed_at")
    return keep_last(src, ["id"], [F.col("ingested_at")]).filter("removed_at is null").select(*cols)


def current_texts(nodes: DataFrame, kind: str = "file", columns: tuple[str, ...] = ("id", "file_path", "language"), most: int = BROADCAST_ROWS) -> DataFrame:
    """(columns, text): the newest delivery of each node of a kind that was not removed and has a text.

    The newest deliveries are found on narrow columns; texts are read in place and only those of
    superseded and removed deliveries are taken out, by a broadcast of their keys up to ``most`` of
    them and by a join beyond. Only texts that one and the same time was given to twice are
    compared with each other.
    """
    n = nodes.filter(F.col("kind") == kind)
    when = F.coalesce(F.col("ingested_at"), F.to_timestamp(F.lit("0001-01-01"))).alias("at")
    rows = n.select("id", when, F.col("removed_at").isNotNull().alias("gone"))
    newest = rows.groupBy("id").agg(F.max("at").alias("last"))
    per_time = rows.groupBy("id", "at").agg(F.max("gone").alias("gone"), F.count("*").alias("times"))
    out = cut_lineage(per_time.join(newest, "id").filter("at < last or gone or times > 1").select("id", "at", ((F.col("at") == F.col("last")) & ~F.col("gone")).alias("twice")))
    few = out.count() <= most
    keyed = n.filter("source_text is not null").select(*dict.fromkeys(("id", *columns)), F.col("source_text").alias("text"), when)
    kept = keyed.join(F.broadcast(out) if few else out, ["id", "at"], "left_anti")
    again = out.filter("twice").select("id", "at")
    twice = keyed.join(F.broadcast(again) if few else again, ["id", "at"]).dropDuplicates(["id"])
    return kept.unionByName(twice).select(*columns, "text")


def current_edges(edges: DataFrame) -> DataFrame:
    """The last delivery of each (source, target, kind); references that are null or empty are no edges."""
    src = edges.filter("source_id <> '' and target_id <> ''")
    order = [F.col(c) for c in ("ingested_at", "confidence", "line_number", "metadata")]
    return keep_last(src, ["source_id", "target_id", "kind"], order).drop("ingested_at")


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): distinct pairs whose both ends are current nodes; edges to unknown ids are dropped."""
    ids = current_nodes(nodes, ["id"])
    pairs = edges.filter("source_id <> '' and target_id <> ''").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    return pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def numbered_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, number), (src, dst)): the current nodes, numbered in the order of their ids, and ``graph_edges`` between numbers.

    An edge's ids are shuffled once each to get their numbers; that takes out edges to unknown ids too.
    """
    ids = numbered(current_nodes(nodes, ["id"]))
    e = edges.filter("source_id <> '' and target_id <> ''").select("source_id", "target_id")
    e = e.join(ids.select(F.col("id").alias("source_id"), F.col("number").alias("src")), "source_id").select("src", "target_id")
    e = e.join(ids.select(F.col("id").alias("target_id"), F.col("number").alias("dst")), "target_id").select("src", "dst")
    return ids, cut_lineage(e.distinct())


def find_nodes(nodes: DataFrame, kind: str | None = None, language: str | None = None, file_path: str | None = None, name_like: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Nodes by any of kind, language, path and a LIKE pattern (ASCII case ignored), best pagerank first."""
    for c, v in (("kind", kind), ("language", language), ("file_path", file_path)):
        if v is not None:
            nodes = nodes.filter(F.col(c) == v)
    if name_like is not None:
        nodes = nodes.filter(F.col("name").ilike(name_like))
    return nodes.orderBy(F.col("pagerank").desc_nulls_last(), "id").offset(offset).limit(limit)


def get_edges(edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    for c, v in (("source_id", source), ("target_id", target), ("kind", kind)):
        if v is not None:
            edges = edges.filter(F.col(c) == v)
    return edges.filter(F.col("confidence") >= min_confidence)


def node_by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that qualified name with the highest pagerank."""
    return nodes.filter(F.col("qualified_name") == name).orderBy(F.col("pagerank").desc_nulls_last(), "id").limit(1)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with each key of ``new`` replaced or added; of equal keys in ``new`` the last by ``seq`` holds."""
    fresh = keep_last(new, keys, [F.col("seq")]).drop("seq")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of the files in ``paths`` and all edges from or to them."""
    gone = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    kept = nodes.join(paths.select("file_path").distinct(), "file_path", "left_anti")
    e = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return kept, e.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")


def with_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes with pagerank and community_id from ``scores``; nodes without a score keep 0 and null."""
    n = nodes.drop("pagerank", "community_id").join(scores.select("id", "pagerank", "community_id"), "id", "left")
    return n.fillna(0.0, ["pagerank"])


def in_degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree), reduced before it meets any other table."""
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))


def entry_points(nodes: DataFrame, edges: DataFrame, limit: int = 15, language: str | None = None) -> DataFrame:
    """Nodes by in-degree times the importance of their kind."""
    n = nodes.filter("pagerank > 0 and not isnan(pagerank)")
    if language:
        n = n.filter(F.lower("language") == language.lower())
    scored = n.join(in_degrees(edges), "id").withColumn("score", F.round(F.col("in_degree") * weight(F.col("kind"), ENTRY_WEIGHTS), 6))
    return scored.select("id", "kind", "in_degree", "score").orderBy(F.col("score").desc(), "id").limit(limit)


def top_by_pagerank(nodes: DataFrame, limit: int, kind: str | None = None, language: str | None = None, summary: bool = False) -> DataFrame:
    n = nodes.filter("pagerank > 0 and not isnan(pagerank)")
    if kind:
        n = n.filter(F.col("kind") == kind)
    if language:
        n = n.filter(F.lower("language") == language.lower())
    if summary:
        n = n.filter(~F.col("kind").isin(STYLE_KINDS) & (F.col("file_path") != "<external>"))
    return n.orderBy(F.col("pagerank").desc(), "id").limit(limit)


def communities(nodes: DataFrame, limit: int = 15, members: int = 50) -> DataFrame:
    """(community_id, size, id, pagerank): the largest communities and the first members of each."""
    n = nodes.filter("community_id is not null")
    sizes = n.groupBy("community_id").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "community_id").limit(limit)
    rank = F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank"))
    m = n.select("community_id", "id", rank.alias("pagerank")).join(F.broadcast(sizes), "community_id")  # `limit` rows
    return group_limit(m, ["community_id"], [F.col("pagerank").desc_nulls_last(), F.col("id")], members)


def summary_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, kinds and languages as maps, mean confidence and number of communities."""
    a = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community_id").alias("communities"), F.countDistinct("file_path").alias("files"))
    b = edges.agg(F.count("*").alias("edges"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence"))
    return a.crossJoin(b)  # one row each


def as_map(df: DataFrame, key: str) -> DataFrame:
    """One row: the counts of a column's values (few: kinds, languages) as a map."""
    return summary_by(df.filter(F.col(key).isNotNull()), key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("counts"))


def file_map(nodes: DataFrame) -> DataFrame:
    """(file_path, n, kinds): per file its symbols and their kinds."""
    n = nodes.filter("kind <> 'file'")
    return n.groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def directory_counts(nodes: DataFrame) -> DataFrame:
    """(directory, n): symbols of each directory and all below it; files are counted before paths are split."""
    per_file = nodes.filter("kind <> 'file'").groupBy("file_path").agg(F.count("*").alias("n"))
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = per_file.filter(F.size(parts) > 1).select(F.explode(prefixes).alias("directory"), "n")
    return dirs.groupBy("directory").agg(F.sum("n").alias("n"))


def normalise_path(files: DataFrame, path: str) -> DataFrame:
    """The stored path meant by ``path``: equal, equal without a leading slash, or the first that ends so."""
    p = F.col("file_path")
    bare = path.lstrip("/")
    order: Column = F.when(p == path, 0).when(p == bare, 1).when(p.endswith(bare), 2)
    return files.select("file_path", order.alias("tier")).filter("tier is not null").distinct().orderBy("tier", "file_path").limit(1).select("file_path")
