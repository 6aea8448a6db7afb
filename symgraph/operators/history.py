"""Change history: per-file metrics, hot files and files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.scalars import recency


def file_metrics(commits: DataFrame, now) -> DataFrame:
    """Per path: commits, authors, the main author and share, first and last date, churn, rate and recency.

    ``commits`` has (hash, author, date, path, added, deleted). The main author is the most
    frequent, of equals the first by name: a partial aggregate per (path, author), then per path.
    """
    per = commits.groupBy("path", "author").agg(
        F.countDistinct("hash").alias("c"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")
    )
    a = per.groupBy("path").agg(
        F.sum("c").alias("commits"), F.count("*").alias("authors"), F.min(F.struct((-F.col("c")).alias("c"), "author")).alias("m"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"),
    )
    months = F.greatest(F.datediff("last", "first") / 30.0, F.lit(1.0))
    return a.select(
        "path", "commits", "authors", F.col("m.author").alias("main_author"), F.round(-F.col("m.c") / F.col("commits"), 3).alias("share"), "first", "last",
        (F.col("added") + F.col("deleted")).alias("churn"), F.round(F.col("commits") / months, 3).alias("per_month"), F.round(recency(F.datediff(F.lit(now), "last")), 3).alias("recency"),
    )


def hot_files(metrics: DataFrame, part: float = 0.10) -> DataFrame:
    """(path, commits) at or above the value at place max(1, floor(n * part)) of the falling commit counts.

    The threshold comes from the counts' histogram, which has few rows, not from a global sort.
    """
    hist = metrics.groupBy("commits").agg(F.count("*").alias("n"))
    total = F.broadcast(metrics.agg(F.count("*").alias("all")))  # one row
    run = F.sum("n").over(Window.orderBy(F.col("commits").desc()).rowsBetween(Window.unboundedPreceding, 0))
    at = F.least(F.greatest(F.floor(F.col("all") * part), F.lit(1)), F.col("all") - 1)
    cut = hist.withColumn("run", run).crossJoin(total).filter(F.col("run") > at).agg(F.max("commits").alias("cut"))
    return metrics.select("path", "commits").crossJoin(F.broadcast(cut)).filter("commits >= cut").select("path", "commits")  # one row


def co_changes(commits: DataFrame, max_files: int = 50, min_count: int = 3, min_confidence: float = 0.25) -> DataFrame:
    """(a, b, together, confidence, jaccard): pairs of paths changed in the same commits.

    Commits of more than ``max_files`` paths say nothing of pairs and are left out by definition,
    which also bounds the pairs a commit yields. Confidence is over all commits of the rarer path.
    """
    pairs = commits.select("hash", "path").distinct()
    size = pairs.groupBy("hash").agg(F.count("*").alias("n"))
    small = pairs.join(size.filter(F.col("n").between(2, max_files)).select("hash"), "hash", "left_semi")
    per_commit = small.groupBy("hash").agg(F.sort_array(F.collect_set("path")).alias("p"))  # at most max_files paths
    i = F.explode(F.transform("p", lambda x, k: F.struct(x.alias("a"), F.slice("p", k + 2, F.greatest(F.size("p") - k - 1, F.lit(0))).alias("rest"))))
    together = per_commit.select(i.alias("x")).select("x.a", F.explode("x.rest").alias("b")).groupBy("a", "b").agg(F.count("*").alias("together")).filter(F.col("together") >= min_count)
    every = pairs.groupBy("path").agg(F.count("*").alias("c"))
    few = small.groupBy("path").agg(F.count("*").alias("s"))
    t = together
    for side in ("a", "b"):
        t = t.join(every.select(F.col("path").alias(side), F.col("c").alias(f"c_{side}")), side).join(few.select(F.col("path").alias(side), F.col("s").alias(f"s_{side}")), side)
    conf = F.col("together") / F.least("c_a", "c_b")
    t = t.filter(conf >= min_confidence)
    return t.select("a", "b", "together", F.round(conf, 3).alias("confidence"), F.round(F.col("together") / (F.col("s_a") + F.col("s_b") - F.col("together")), 3).alias("jaccard"))


def co_change_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("co_changes_with").alias("kind"), "confidence")
