"""Sources: source trees, revision logs, analyser reports, staleness."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions import scalars as S

# Globs of paths that are not scanned.
IGNORED = ["**/node_modules/**", "**/vendor/**", "**/.git/**", "**/dist/**", "**/build/**", "**/__pycache__/**", "**/storage/**", "**/*.min.js", "**/*.min.css", "**/*.map"]


def scan_tree(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """(file_path, language, content, content_hash, size_bytes, modified) of the source files below a folder.

    Executors list and read the files; paths are relative to the root; ignored paths and unknown
    extensions are dropped before contents are hashed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    f = raw.select(rel.alias("file_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    f = f.filter(~F.col("file_path").rlike(S.glob_to_regex(ignored))).withColumn("language", S.language_of(F.col("file_path"))).filter("language is not null")
    return f.withColumn("content_hash", F.sha2("content", 256))


def changed(scan: DataFrame, files: DataFrame) -> DataFrame:
    """The scan with ``is_changed``: no stored hash or another one."""
    f = files.groupBy("file_path").agg(F.max_by("content_hash", "last_parsed").alias("stored"))
    return scan.join(f, "file_path", "left").withColumn("is_changed", F.col("stored").isNull() | (F.col("stored") != F.col("content_hash"))).drop("stored")


def project_state(scan: DataFrame, files: DataFrame, first: int = 50) -> DataFrame:
    """(state, n_stale, stale): fresh without stored files, stale if a source is newer than the newest parse, else ready."""
    last = F.broadcast(files.agg(F.max("last_parsed").alias("last")))  # one row
    s = scan.crossJoin(last).filter(F.col("last").isNull() | (F.col("modified") > F.col("last"))).select("file_path", "last")
    n = s.agg(F.count("*").alias("n_stale"))
    some = s.select("file_path").orderBy("file_path").limit(first).agg(F.sort_array(F.collect_list("file_path")).alias("stale"))
    empty = files.limit(1).agg((F.count("*") == 0).alias("fresh"))
    return n.crossJoin(some).crossJoin(empty).select(F.when(F.col("fresh"), "fresh").when(F.col("n_stale") > 0, "stale").otherwise("ready").alias("state"), "n_stale", "stale")


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(hash, author, date, path, added, deleted) of numbered log lines (log, n, line).

    Header lines are ``COMMIT|hash|author|ISO date``, others ``added<TAB>deleted<TAB>path`` with -
    for binary files. The header is carried forward within each log.
    """
    w = Window.partitionBy("log").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("COMMIT|"), F.col("line"))
    x = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).filter(F.col("line").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t."))
    h, p = F.split("head", r"\|"), F.split("line", "\t")
    count = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    return x.select(h[1].alias("hash"), h[2].alias("author"), F.to_timestamp(h[3]).alias("date"), p[2].alias("path"), count(p[0]).alias("added"), count(p[1]).alias("deleted"))


def git_log(spark: SparkSession, repo: str) -> DataFrame:
    """The history of a local repository, by the git command on the driver."""
    out = subprocess.run(["git", "-C", repo, "log", "--pretty=COMMIT|%H|%aN|%aI", "--numstat"], capture_output=True, text=True, check=True).stdout
    rows = [(repo, n, line) for n, line in enumerate(out.split("\n")) if line]
    return parse_git_log(spark.createDataFrame(rows, "log string, n long, line string"))


def analyser_report(reports: DataFrame, column: str = "json") -> DataFrame:
    """(file_path, line, message, identifier, tip, ignorable) of a PHP analyser's JSON reports."""
    kind = "files map<string, struct<messages: array<struct<message: string, line: int, identifier: string, tip: string, ignorable: boolean>>>>"
    f = reports.select(F.explode(F.from_json(column, kind)["files"]).alias("file_path", "v"))
    return f.select("file_path", F.explode("v.messages").alias("m")).select("file_path", F.col("m.line").alias("line"), "m.message", "m.identifier", "m.tip", "m.ignorable")
