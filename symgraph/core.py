"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SPREAD_BYTES = 1 << 30  # an input that may be shuffled once to use all cores
SMALL_BYTES = 1 << 27  # rows that no hot key makes too much for one task
BUCKETS, SKEW, SKEW_ROWS = 4096, 16, 10_000


def build_session(app: str = "symgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` if set, else (tests) a local one.

    A machine-local folder is used only where the master itself is one machine.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.environ.get("SYMGRAPH_CHECKPOINTS")
        if not at:
            at = os.environ["SYMGRAPH_CHECKPOINTS"] = tempfile.mkdtemp(prefix="symgraph-")
            atexit.register(shutil.rmtree, at, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; huge where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python that outweighs a shuffle.

    Only an input of at most ``most`` bytes in fewer scan tasks than cores is shuffled, whatever the
    size of the cluster; a larger one stays where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > most or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def key_bucket(keys: list[str]) -> Column:
    """One of ``BUCKETS`` hashes of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(rows: DataFrame, keys: list[str], small: int = SMALL_BYTES) -> list[int]:
    """The buckets of keys that hold over ``SKEW`` times the mean number of rows: fewer than ``BUCKETS / SKEW``.

    One pass over the keys; at most ``BUCKETS`` counts reach the driver. Rows of at most ``small``
    bytes have none, as no key makes them too much for one task.
    """
    if estimated_bytes(rows) <= small:
        return []
    counts = rows.groupBy(key_bucket(keys).alias("b")).agg(F.count("*").alias("n")).collect()
    mean = sum(r["n"] for r in counts) / BUCKETS
    return sorted(r["b"] for r in counts if r["n"] > SKEW * mean and r["n"] > SKEW_ROWS)


def salted_join(rows: DataFrame, reduced: DataFrame, keys: list[str], how: str = "inner", salts: int = 64, small: int = SMALL_BYTES, hot: list[int] | None = None) -> DataFrame:
    """``rows`` joined with ``reduced`` on ``keys``, where one key may hold a third of all rows.

    Only the rows of hot buckets are salted: they go to ``salts`` tasks and the matching rows of
    ``reduced`` are copied as often. Without such buckets it is a plain join. The salt is a hash of
    the row, the same when a lost task runs again. ``how``: inner or left. Who joins the same rows
    again and again finds the ``hot`` buckets once.
    """
    hot = hot_buckets(rows, keys, small) if hot is None else hot
    if not hot:
        return rows.join(reduced, keys, how)
    is_hot = key_bucket(keys).isin(hot)
    a = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int"))
    b = reduced.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def numbered(ids: DataFrame) -> DataFrame:
    """(id, number): distinct ids numbered from 0 in their order, by range partitions, so equals by the least id are equals by the least number.

    Joins and rounds over numbers move a tenth of what those over long ids do.
    """
    low = F.lit((1 << 33) - 1)
    at = cut_lineage(ids.select("id").filter("id is not null").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())).withColumn("p", F.shiftright("at", 33))
    before = at.groupBy("p").agg(F.count("*").alias("k")).select("p", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a partition
    return at.join(F.broadcast(before), "p").select("id", (F.col("base") + F.col("at").bitwiseAND(low)).alias("number"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's heap is collected, which loops of small plans hardly ever cause.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, found by a partial aggregate.

    ``max_by``-like reduction over a struct, so that a hot key is combined on the map side and
    never collected into one task (as a row_number window would do).
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_k_window(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group (for groups of bounded size)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def group_limit(df: DataFrame, by: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group, groups of any size.

    Two rounds: each (group, salt) keeps its own ``k`` first, then the survivors, at most
    ``k * salts`` a group, are ranked. No task ever holds a whole hot group. The salt is a hash
    of the row, thus the same when a lost task runs again.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = top_k_window(salted, [*by, "__salt"], order, k).drop("__salt")
    return top_k_window(first, by, order, k)
