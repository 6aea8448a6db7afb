"""Top N items within every group, by lower bounds of parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.core import cut_lineage

PART_ROWS = 200_000


def _survivors(keys: list[str], score: str, item: str, n: int, part_rows: int):
    """Of each part (up to ``part_rows`` rows of a partition) the rows not below its own N-th best."""

    def part(batches: list[pa.RecordBatch]) -> pd.DataFrame:
        t = pa.Table.from_batches(batches).to_pandas().drop_duplicates([*keys, item, score])
        t = t.sort_values([score, item], ascending=[False, True], kind="stable").drop_duplicates([*keys, item])
        t["__place"] = t.groupby(keys, sort=False, dropna=False).cumcount() + 1
        t = t[t["__place"] <= n]
        # the part's N-th best is a bound only if the part has N items of the group
        t["is_bound"] = t.pop("__place") == n
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= part_rows:
                yield from pa.Table.from_pandas(part(held), preserve_index=False).to_batches()
                held, rows = [], 0
        if rows:
            yield from pa.Table.from_pandas(part(held), preserve_index=False).to_batches()

    return run


def top_n(rows: DataFrame, keys: list[str], score: str, item: str, n: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, item, score, place): the ``n`` best distinct items of every group.

    Order: score falling, then item rising in byte order; an item's best score counts. Rows with a
    null key, item or score and NaN scores take no part. Groups with fewer than ``n`` items give
    all they have; an empty table gives no rows. Extra columns are ignored.

    Each part of a partition yields its own N best of every group and its N-th best as a bound:
    no row below any part's bound can be among the group's N best. The highest bound of a group is
    joined to the survivors, which it filters again, and what is left is ranked. A group of any
    size shrinks to N rows a part before anything is shuffled.
    """
    ok = [F.col(c).isNotNull() for c in [*keys, item, score]]
    src = rows.select(*keys, item, F.col(score).cast("double").alias(score)).filter(~F.isnan(score))
    for c in ok:
        src = src.filter(c)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", is_bound boolean"
    # written once: the bounds and the rows both come from it, the source is read once
    local = cut_lineage(src.mapInArrow(_survivors(keys, score, item, n, part_rows), schema))
    # the best bound: highest score, then lowest item
    best = local.filter("is_bound").groupBy(*keys).agg(F.max(score).alias("__bound"))
    left = local.join(best, keys, "left").filter(F.col("__bound").isNull() | (F.col(score) >= F.col("__bound")))
    # an item of several parts comes once, with its best score
    left = left.groupBy(*keys, item).agg(F.max(score).alias(score))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item))
    return left.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_nodes(nodes: DataFrame, n: int = 3) -> DataFrame:
    """(community_id, kind, id): the ``n`` nodes of highest pagerank per community and kind."""
    return top_n(nodes, ["community_id", "kind"], "pagerank", "id", n).select("community_id", "kind", "id")
