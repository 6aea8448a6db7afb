"""References to records that do not exist, for simple and composite keys."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def present(nodes: DataFrame, external: DataFrame) -> DataFrame:
    """(ref, born, gone): since when an id is there and until when; null means no bound.

    Of repeated deliveries the first ``ingested_at`` and the earliest ``removed_at`` hold. Ids of
    ``external`` are always there. Partial aggregates only.
    """
    n = nodes.select(F.col("id").alias("ref"), F.col("ingested_at").alias("born"), F.col("removed_at").alias("gone"), F.lit(0).alias("always"))
    x = external.select(F.col("id").alias("ref"), F.lit(None).cast("timestamp").alias("born"), F.lit(None).cast("timestamp").alias("gone"), F.lit(1).alias("always"))
    a = n.unionByName(x).filter("ref is not null and ref <> ''").groupBy("ref")
    a = a.agg(F.min("born").alias("born"), F.min("gone").alias("gone"), F.max("always").alias("always"))
    keep = F.col("always") == 0
    return a.select("ref", F.when(keep, F.col("born")).alias("born"), F.when(keep, F.col("gone")).alias("gone"))


def orphans(refs: DataFrame, parents: DataFrame, on: dict[str, str], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose key (the columns of ``on``: child to parent) matches no parent.

    The rows are grouped by their null mask and each mask is anti-joined on its non-null columns:

    - ``simple``: a key with any null refers to nothing, and is no orphan;
    - ``partial``: the non-null columns must match some parent; all null refers to nothing;
    - ``full``: all null refers to nothing, a key that is partly null is always an orphan.

    Parents are reduced to distinct keys first. Empty refs give no rows; with no parents every
    row that refers to something is an orphan. Other columns are kept as they are.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    parts = []
    for mask in product((True, False), repeat=len(on)):
        cols = [c for c, there in zip(on, mask) if there]
        rows = refs.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() if there else F.col(f"`{c}`").isNull() for c, there in zip(on, mask)]))
        if not cols or (match == "simple" and not all(mask)):
            continue
        if match == "full" and not all(mask):
            parts.append(rows)
            continue
        keys = parents.select(*[F.col(f"`{on[c]}`").alias(f"__p{i}") for i, c in enumerate(cols)]).dropna().distinct()
        parts.append(rows.join(keys, [F.col(f"`{c}`") == F.col(f"__p{i}") for i, c in enumerate(cols)], "left_anti"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def references(edges: DataFrame) -> DataFrame:
    """(ref_field, ref, other, kind, ingested_at): one row per delivered edge and reference field.

    ``other`` is the id at the edge's other end, so an edge is carried once, not with its ids twice.
    """
    both = F.array(
        F.struct(F.lit("source_id").alias("ref_field"), F.col("source_id").alias("ref"), F.col("target_id").alias("other")),
        F.struct(F.lit("target_id").alias("ref_field"), F.col("target_id").alias("ref"), F.col("source_id").alias("other")),
    )
    rows = edges.select("kind", "ingested_at", F.explode(both).alias("r")).select("r.*", "kind", "ingested_at")
    return rows.filter("ref is not null and ref <> ''")


def dangling(edges: DataFrame, nodes: DataFrame, external: DataFrame, salts: int = SALTS) -> DataFrame:
    """(source_id, target_id, kind, ref_field, ref, ingested_at): references that once pointed at nothing.

    An edge is a case if at the time of one of its rows the id was absent, not yet there
    (``born`` later) or gone (``gone`` not later). Null and empty ids are no reference (``simple``
    match); a row without a time is judged by presence alone.

    References are first reduced to one row per id (a hot id is combined on the map side), so the
    parent tables are joined with distinct ids. Only ids with some orphan go back to the edges, in
    ``salts`` copies, so that a missing id that a third of all edges name is spread over tasks.
    One row per delivered edge; repeated deliveries repeat.
    """
    refs = references(edges)
    ids = refs.groupBy("ref").agg(F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))
    there = present(nodes, external)
    absent = orphans(ids, there, {"ref": "ref"}, "simple").select("ref", F.lit(None).cast("timestamp").alias("born"), F.lit(None).cast("timestamp").alias("gone"), F.lit(True).alias("absent"))
    untimely = ids.join(there, "ref").filter("first_at < born or last_at >= gone").select("ref", "born", "gone", F.lit(False).alias("absent"))
    bad = absent.unionByName(untimely).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("other", "kind", "ingested_at"), F.lit(salts)).cast("int"))
    from_source = F.col("ref_field") == "source_id"
    return salted.join(bad, ["ref", "salt"]).filter("absent or ingested_at < born or ingested_at >= gone").select(
        F.when(from_source, F.col("ref")).otherwise(F.col("other")).alias("source_id"),
        F.when(from_source, F.col("other")).otherwise(F.col("ref")).alias("target_id"),
        "kind", "ref_field", "ref", "ingested_at",
    )


def dangling_report(edges: DataFrame, nodes: DataFrame, external: DataFrame) -> DataFrame:
    """(ref_field, month, orphan_refs, orphan_ids): delivered references that point at nothing, per field and month."""
    month = F.date_format("ingested_at", "yyyy-MM").alias("month")
    per_id = dangling(edges, nodes, external).groupBy("ref_field", month, "ref").agg(F.count("*").alias("n"))
    return per_id.groupBy("ref_field", "month").agg(F.sum("n").alias("orphan_refs"), F.count("*").alias("orphan_ids"))
