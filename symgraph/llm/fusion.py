"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.core import SMALL_BYTES, cut_lineage, group_limit, hot_buckets, key_bucket, salted_join, top_k_window


def standings(values: DataFrame, keys: list[str], value: str, small: int = SMALL_BYTES) -> DataFrame:
    """Adds ``standing``: 1 + the number of rows of the same keys with a higher value; groups of any size.

    Rows are reduced to distinct values with their counts (map-side combine), range-partitioned by
    (keys, value), and the counts before each value are the running sum in its partition plus the
    totals of the group's earlier partitions. No task holds more than its range; the standings of
    a value that many rows share go back to them by a salted join.
    """
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ordered = counts.repartitionByRange(*keys, F.col(value).desc())
    # written once: the ranges must be the same for the sums within and the totals before
    ordered = cut_lineage(ordered.withColumn("__part", F.spark_partition_id()))
    totals = ordered.groupBy(*keys, "__part").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__part").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    ranked = ranked.join(totals, [*keys, "__part"]).select(*keys, value, (F.col("__before") + F.col("__inside") + 1).alias("standing"))
    return salted_join(values, ranked, [*keys, value], small=small)


def _fused(stands: list[Column], k: int) -> list[Column]:
    """fused and n_found from the standings (null: not found) of the measures."""
    parts = [F.coalesce(1.0 / (s + k), F.lit(0.0)) for s in stands]
    return [F.round(sum(parts[1:], parts[0]), 12).alias("fused"), sum((s.isNotNull().cast("int") for s in stands[1:]), stands[0].isNotNull().cast("int")).alias("n_found")]


def _parts(items: DataFrame, group: str, item: str, measures: dict[str, Column], k: int, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The fused rows of the usual groups, still parted by group, and of the hot ones (null if there are none).

    Usual groups are shuffled once: repeated items are combined and all measures ranked where the
    group lies. Groups in hot buckets are ranked by distributed standings, never in one task.
    """
    cols = [F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"m{n}") for n, c in enumerate(measures.values())]
    names = [f"m{n}" for n in range(len(cols))]
    rows = items.select(group, item, *cols).filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    best = [F.max(c).alias(c) for c in names]
    hot = hot_buckets(rows, [group], small)
    is_hot = key_bucket([group]).isin(hot)
    one = (rows.filter(~is_hot) if hot else rows).repartition(group).groupBy(group, item).agg(*best)
    ranks = [F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(group).orderBy(F.col(c).desc_nulls_last()))).alias(f"s{n}") for n, c in enumerate(names)]
    usual = one.select(group, item, *ranks).select(group, item, *_fused([F.col(f"s{n}") for n in range(len(names))], k))
    if not hot:
        return usual, None
    rest = cut_lineage(rows.filter(is_hot).groupBy(group, item).agg(*best))
    out = rest.select(group, item)
    for n, c in enumerate(names):
        stand = standings(rest.filter(F.col(c).isNotNull()).select(group, item, c), [group], c, small).select(group, item, F.col("standing").alias(f"s{n}"))
        out = out.join(stand, [group, item], "left")
    return usual, out.select(group, item, *_fused([F.col(f"s{n}") for n in range(len(names))], k))


def reciprocal_rank_fusion(items: DataFrame, group: str, item: str, measures: dict[str, Column], k: int = 60, small: int = SMALL_BYTES) -> DataFrame:
    """(group, item, fused, n_found): the sum over the measures of 1 / (k + standing).

    ``measures`` maps a name to a column in which higher is better and null means not found;
    a measure in which an item was not found adds nothing, which is worse than any standing.
    NaN counts as not found. Repeated rows of an item count once, with its best values. Rows
    without a group or an item name nothing and take no part. Equal values stand equal.
    """
    usual, hot = _parts(items, group, item, measures, k, small)
    return usual if hot is None else usual.unionByName(hot)


def best_of_groups(items: DataFrame, group: str, item: str, measures: dict[str, Column], n: int, k: int = 60, small: int = SMALL_BYTES) -> DataFrame:
    """(group, item, fused, n_found): the ``n`` items of each group that come first in the fusion; ties by item."""
    usual, hot = _parts(items, group, item, measures, k, small)
    order = [F.col("fused").desc(), F.col(item)]
    first = top_k_window(usual, [group], order, n)
    return first if hot is None else first.unionByName(group_limit(hot, [group], order, n))


def search_measures() -> dict[str, Column]:
    """score, fts_rank and vector_similarity of search results, higher is better, null is not found."""
    return {
        "score": F.col("score"),
        "fts": F.when(F.col("fts_rank") > 0, -F.col("fts_rank")),
        "vector": F.when(F.col("vector_similarity") != 0, F.col("vector_similarity")),
    }


def fuse_search_results(results: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of search results by score, fts_rank and vector_similarity."""
    return reciprocal_rank_fusion(results, "query_id", "node_id", search_measures(), k)


def best_of_each_query(results: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, node_id): the ``n`` items of each query that come first; ties by node_id."""
    return best_of_groups(results, "query_id", "node_id", search_measures(), n).select("query_id", "node_id")
