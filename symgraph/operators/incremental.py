"""Processing only new or changed records: a ledger of processed sequence numbers.

Processed numbers are kept as disjoint intervals, cut at the bounds of fixed buckets so that every
step below is a window inside one bucket (at most ``width`` numbers), never over the whole table.
Subtracting the ledger from the available numbers leaves the gaps: new records and late commits
alike. Output and merged intervals are committed under one version; a run that dies before its
marker is written leaves nothing that a later run reads, so no record is skipped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.core import salted_join
from symgraph.sources.tables import VersionedTables

WIDTH = 1 << 16


def normal_digest(c: Column) -> Column:
    """One form of a digest: trimmed, lower case, without an algorithm prefix; empty is null."""
    d = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z0-9-]+[:=]\s*|\s+", "")
    return F.when(d != "", d)


def to_intervals(seqs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(bucket, lo, hi): the disjoint maximal runs of the numbers ``seq``, per bucket.

    Nulls and repeated numbers are ignored; an empty input gives no interval.
    """
    s = seqs.select(F.col("seq").cast("long")).filter("seq is not null").distinct()
    s = s.withColumn("bucket", F.floor(F.col("seq") / width))
    run = F.col("seq") - F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))
    return s.withColumn("run", run).groupBy("bucket", "run").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("run")


def merge_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two interval tables as disjoint maximal intervals (per bucket)."""
    u = a.select("bucket", "lo", "hi").unionByName(b.select("bucket", "lo", "hi"))
    w = Window.partitionBy("bucket").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("starts", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    u = u.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return u.groupBy("bucket", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def subtract(available: DataFrame, ledger: DataFrame, width: int = WIDTH) -> DataFrame:
    """(seq): the numbers of ``available`` that lie in no interval of the ledger.

    Interval starts and numbers are sorted together in each bucket and the last start's end is
    carried forward: n log n, where a range join would compare every number with every interval.
    """
    s = available.select(F.col("seq").cast("long")).filter("seq is not null").distinct()
    points = s.select(F.floor(F.col("seq") / width).alias("bucket"), F.col("seq").alias("at"), F.lit(None).cast("long").alias("hi"))
    starts = ledger.select("bucket", F.col("lo").alias("at"), "hi")
    w = Window.partitionBy("bucket").orderBy(F.col("at"), F.col("hi").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    covered = points.unionByName(starts).withColumn("end", F.max("hi").over(w))
    return covered.filter("hi is null and (end is null or end < at)").select(F.col("at").alias("seq"))


def newest_stored(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_path, stored, parsed_at): the newest ``files`` row of a successful run, per file."""
    good = runs.filter(F.col("status") == "success").select("run_id").distinct()
    rows = files.join(good, "run_id", "left_semi").filter(F.col("file_path").isNotNull())
    last = F.struct(F.col("last_parsed").isNotNull(), "last_parsed", "run_id", normal_digest(F.col("content_hash")).isNull())
    return rows.groupBy("file_path").agg(
        F.max_by(F.struct(normal_digest(F.col("content_hash")).alias("stored")), last)["stored"].alias("stored"),
        F.lit(True).alias("has_row"),
    )


def numbered_scans(scans: DataFrame) -> DataFrame:
    """(file_path, seq, op, at, digest): scans by their number; ``at`` orders the scans of a file.

    A null ``seen_at`` is older than all others; of equal times the higher number is newer. Scans
    without a path or a number take no part.
    """
    at = F.struct(F.col("seen_at").isNotNull().alias("timed"), "seen_at", F.col("scan_id").cast("long").alias("seq"))
    s = scans.select("file_path", F.col("scan_id").cast("long").alias("seq"), "op", at.alias("at"), normal_digest(F.col("content_hash")).alias("digest"))
    return s.filter("file_path is not null and seq is not null")


def processed_scans(scans: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """(seq): the numbers of scans that successful runs have dealt with.

    A scan is dealt with if a successful run stored its digest for its file, or if it is older
    than such a scan. The stored digest meets the scans on (path, digest), so a file that holds a
    third of all scans is spread by its digests; the newest scan dealt with goes back to the
    file's scans by a salted join.
    """
    s = numbered_scans(scans)
    stored = newest_stored(files, runs).select("file_path", F.col("stored").alias("digest")).filter("digest is not null")
    upto = s.filter("digest is not null").groupBy("file_path", "digest").agg(F.max("at").alias("upto")).join(stored, ["file_path", "digest"]).select("file_path", "upto")
    return salted_join(s.select("file_path", "seq", "at"), upto, ["file_path"]).filter("at <= upto").select("seq")


def derive_ledger(scans: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger that the stored ``files`` amount to: the processed scan numbers as intervals."""
    return to_intervals(processed_scans(scans, files, runs))


def files_to_parse(scans: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_path): exactly the files that the next run has to parse.

    The ledger of processed numbers is subtracted from the numbers at hand; what is left, late
    commits included, are the scans to be processed. Of these the newest per file decides: a file
    is due if it was not deleted last and some scan left has a digest. (If its newest digest was
    processed, so were all older scans, and no digest is left.)

    Null paths take no part; scans with a null ``seen_at`` count as older than all others; of
    equal times the higher scan_id (or run_id) is newer; empty digests count as null. Repeated
    deliveries of a scan count once; empty tables give no rows. Extra columns are ignored.
    """
    s = numbered_scans(scans)
    pending = subtract(s.select("seq"), derive_ledger(scans, files, runs))
    left = s.join(pending, "seq", "left_semi").groupBy("file_path").agg(F.max_by("op", "at").alias("last_op"), F.count("digest").alias("digests"))
    return left.filter("digests > 0 and (last_op is null or last_op <> 'deleted')").select("file_path")


class Ledger:
    """A ledger in a folder that all executors share; output and intervals become valid together.

    Runs are optimistic: ``pending`` fixes the version a run starts from, ``commit`` adds the next
    one. Of two runs that start from the same version the first to commit holds; the other raises
    ``ConcurrentCommit``, leaves nothing that is read, and starts again with what is then pending.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables, self._base = spark, VersionedTables(spark, path), None

    def versions(self) -> list[int]:
        return self.tables.versions()

    def intervals(self, version: int | None = None) -> DataFrame:
        done = self.tables.read("intervals", version)
        return done if done is not None else self.spark.createDataFrame([], "bucket long, lo long, hi long")

    def pending(self, available: DataFrame) -> DataFrame:
        """The available numbers not yet processed, gaps by late commits included; begins a run."""
        self._base = self.tables.version()
        return subtract(available, self.intervals(self._base))

    def commit(self, output: DataFrame, processed: DataFrame) -> int:
        """Writes the output and the merged intervals of the run, then the marker that makes both valid."""
        base = self.tables.version() if self._base is None else self._base
        merged = merge_intervals(self.intervals(base), to_intervals(processed))
        self._base = None
        return self.tables.commit(base, output=output, intervals=merged)
