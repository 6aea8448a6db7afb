"""Token-budgeted assembly of answers: greedy folds, symbol, file and impact contexts, session context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.core import group_limit
from symgraph.operators import graph
from symgraph.schemas import RELEVANCE_WEIGHTS, weight

# The kinds of edges that each kind of usage means.
USAGE_KINDS = {
    "calls": ["calls"], "imports": ["imports", "imports_type", "dynamic_imports"], "extends": ["extends"], "implements": ["implements"],
    "instantiates": ["instantiates"], "type_references": ["has_type", "returns_type"],
}


def fold_budget(rows: DataFrame, by: list[str], order: list[Column], tokens: str, item: str, budget: int) -> DataFrame:
    """(by, item, place): items taken greedily in order while their tokens fit the budget; ones too large are passed over.

    Every item of a group is a candidate. A group's rows are sorted in one task, on disk if need
    be, and folded as they stream by; only the tokens used and the next place are held.
    """
    keys = [f"__o{k}" for k in range(len(order))]
    r = rows.select(*by, F.col(item).alias("__i"), F.col(tokens).cast("long").alias("__t"), *[o.alias(k) for k, o in zip(keys, order)])
    r = r.repartition(*by).sortWithinPartitions(*by, *keys, "__t", "__i").select(*by, "__i", "__t")
    out = r.select(*by, F.lit(0).alias("place"), F.col("__i").alias(item))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, place = None, 0, 0
        for b in batches:
            took, places = [], []
            groups = zip(*[b.column(k).to_pylist() for k in range(len(by))])
            for k, (g, t) in enumerate(zip(groups, b.column(len(by) + 1).to_pylist())):
                if g != group:
                    group, used, place = g, 0, 0
                if t is not None and used + t <= budget:
                    took.append(k)
                    places.append(place)
                    used, place = used + t, place + 1
            kept = b.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(by)], pa.array(places, pa.int32()), kept.column(len(by))], [*by, "place", item])

    return r.mapInArrow(fold, out.schema)


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, kind, depth, relevance) of what depends on the seeds: by depth, then relevance."""
    hit = graph.blast_radius(seeds, edges, max_depth)
    deg = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deg"))
    rank = F.when(~F.isnan("pagerank"), F.col("pagerank"))
    tops = F.broadcast(nodes.agg(F.max(rank).alias("max_rank")).crossJoin(deg.agg(F.max("deg").alias("max_deg"))))  # one row
    n = nodes.join(hit, "id").join(deg, "id", "left").fillna(0, ["deg"]).crossJoin(tops)
    score = 0.30 * F.coalesce(rank / F.col("max_rank"), F.lit(0.0)) + 0.25 * F.coalesce(F.col("deg") / F.col("max_deg"), F.lit(0.0)) + 0.25 * weight(F.col("kind"), RELEVANCE_WEIGHTS)
    return n.select("id", "kind", "depth", F.round(score, 6).alias("relevance"))


def by_depth(found: DataFrame) -> DataFrame:
    """(depth, kind, n, some): found nodes per depth and kind, with the first ten ids."""
    counts = found.groupBy("depth", "kind").agg(F.count("*").alias("n"))
    some = group_limit(found.select("depth", "kind", "id"), ["depth", "kind"], [F.col("id")], 10).groupBy("depth", "kind").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("some"))
    return counts.join(some, ["depth", "kind"])


def file_context(nodes: DataFrame, budget: int = 2000) -> DataFrame:
    """(file_path, place, id): the symbols (id, kind, file_path, pagerank, tokens) of every file that fit a budget, by pagerank."""
    rank = F.coalesce(F.when(~F.isnan("pagerank"), F.col("pagerank")), F.lit(0.0))
    n = nodes.filter("kind <> 'file'").withColumn("rank", -rank)
    return fold_budget(n, ["file_path"], [F.col("rank"), F.col("id")], "tokens", "id", budget)


def usages(edges: DataFrame, seeds: DataFrame, usage: str, max_depth: int = 1) -> DataFrame:
    """(id, depth): what uses the seeds in a way, over incoming edges of the kinds that it means."""
    kinds = USAGE_KINDS.get(usage)
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    return graph.blast_radius(seeds, e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), min(max(max_depth, 1), 5))


def session_context(events: DataFrame, notes: DataFrame, hot: int = 20, recent: int = 10) -> DataFrame:
    """(part, text, place): hot targets and the newest notes, as lines for a session's start."""
    h = events.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "target").limit(hot)
    a = h.select(F.lit("hot").alias("part"), F.concat_ws(" x", F.col("target"), F.col("n").cast("string")).alias("text"), (-F.col("n")).cast("double").alias("place"))
    b = notes.orderBy(F.col("created_at").desc(), "id").limit(recent).select(F.lit("note").alias("part"), F.substring("text", 1, 200).alias("text"), (-F.unix_timestamp("created_at")).cast("double").alias("place"))
    return a.unionByName(b)
