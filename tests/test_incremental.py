import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from symgraph.core import salted_join
from symgraph.operators import incremental as I
from symgraph.sources.tables import ConcurrentCommit
from tests.conftest import rows

SCANS = "scan_id long, file_path string, op string, content_hash string, size_bytes long, seen_at timestamp, arrived_at timestamp"
FILES = "file_path string, content_hash string, language string, last_parsed timestamp, run_id long"
RUNS = "run_id long, repo string, status string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
def test_subtract_is_set_difference(spark, available, done):
    a = spark.createDataFrame([(x,) for x in available], "seq long")
    ledger = I.to_intervals(spark.createDataFrame([(x,) for x in done], "seq long"), 8)
    assert {r[0] for r in I.subtract(a, ledger, 8).collect()} == available - done


def test_intervals_are_maximal_and_disjoint(spark):
    s = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 8, 8, None, 20)], "seq long")
    assert rows(I.to_intervals(s, 100), "lo", "hi") == [(1, 3), (20, 20), (7, 8)]
    more = I.to_intervals(spark.createDataFrame([(4,), (6,), (9,)], "seq long"), 100)
    assert rows(I.merge_intervals(I.to_intervals(s, 100), more), "lo", "hi") == [(1, 4), (20, 20), (6, 9)]


def test_ledger_takes_late_commits_once(spark, tmp_path):
    led = I.Ledger(spark, str(tmp_path / "ledger"))
    seq = lambda xs: spark.createDataFrame([(x,) for x in xs], "seq long")
    assert {r[0] for r in led.pending(seq([1, 2, 4])).collect()} == {1, 2, 4}
    led.commit(seq([1, 2, 4]), seq([1, 2, 4]))
    assert {r[0] for r in led.pending(seq([1, 2, 3, 4, 5])).collect()} == {3, 5}
    # a run that dies before its marker leaves the ledger as it was
    I.to_intervals(seq([3])).write.parquet(str(tmp_path / "ledger" / "v=2" / "intervals"))
    assert {r[0] for r in led.pending(seq([1, 2, 3, 4, 5])).collect()} == {3, 5}
    led.commit(seq([3, 5]), seq([3, 5]))
    assert led.versions() == [1, 2] and led.pending(seq(range(1, 6))).isEmpty()


def test_files_to_parse(spark):
    scans = spark.createDataFrame(
        [
            (1, "new", "created", "aa", 1, at(1), at(1)),
            (2, "same", "created", "SHA256:BB ", 1, at(1), at(1)),
            (2, "same", "created", "SHA256:BB ", 1, at(1), at(9)),
            (3, "other", "created", "cc", 1, at(1), at(1)),
            (4, "gone", "created", "dd", 1, at(1), at(1)),
            (5, "gone", "deleted", None, None, at(2), at(2)),
            (6, "back", "deleted", None, None, at(1), at(1)),
            (7, "back", "created", "ee", 1, at(2), at(2)),
            (8, "nohash", "created", None, 1, at(1), at(1)),
            (9, "failed", "created", "ff", 1, at(1), at(1)),
            (10, "nullstored", "created", "gg", 1, at(1), at(1)),
            (11, "late", "created", "11", 1, at(5), at(5)),
            (12, "late", "modified", "22", 1, at(2), at(30)),
            (13, "tie", "created", "33", 1, at(1), at(1)),
            (14, "tie", "modified", "44", 1, at(1), at(1)),
            (15, None, "created", "55", 1, at(1), at(1)),
            (16, "moved", "modified", "66", 1, at(1), at(1)),
            (17, "moved", "moved", None, 1, at(2), at(2)),
        ],
        SCANS,
    )
    files = spark.createDataFrame(
        [
            ("same", "bb", "go", at(1), 1),
            ("other", "c0", "go", at(1), 1),
            ("back", "zz", "go", at(1), 1),
            ("failed", "ff", "go", at(2), 2),
            ("nullstored", None, "go", at(2), 1),
            ("late", "11", "go", at(6), 1),
            ("tie", "44", "go", at(2), 1),
            ("moved", "66", "go", at(1), 1),
        ],
        FILES,
    )
    runs = spark.createDataFrame([(1, "r", "success"), (2, "r", "failed")], RUNS)
    assert rows(I.files_to_parse(scans, files, runs)) == [("back",), ("failed",), ("new",), ("nullstored",), ("other",)]
    # extra columns with clashing names are ignored
    assert I.files_to_parse(scans.withColumn("stored", scans.op), files.withColumn("digest", files.language), runs).count() == 5


@pytest.mark.parametrize("empty", ["scans", "files", "runs"])
def test_empty_tables(spark, empty):
    t = {
        "scans": spark.createDataFrame([(1, "a", "created", "x", 1, at(1), at(1))], SCANS),
        "files": spark.createDataFrame([("a", "x", "go", at(1), 1)], FILES),
        "runs": spark.createDataFrame([(1, "r", "success")], RUNS),
    }
    t[empty] = t[empty].limit(0)
    assert I.files_to_parse(t["scans"], t["files"], t["runs"]).count() == (0 if empty == "scans" else 1)


def test_the_intervals_decide_the_files(spark, monkeypatch):
    scans = spark.createDataFrame([(1, "same", "created", "aa", 1, at(1), at(1)), (2, "due", "created", "bb", 1, at(1), at(1)), (3, "due", "modified", "cc", 1, at(2), at(2))], SCANS)
    files = spark.createDataFrame([("same", "aa", "go", at(2), 1), ("due", "bb", "go", at(1), 1)], FILES)
    runs = spark.createDataFrame([(1, "r", "success")], RUNS)
    assert rows(I.derive_ledger(scans, files, runs), "lo", "hi") == [(1, 2)]
    assert rows(I.files_to_parse(scans, files, runs)) == [("due",)]
    monkeypatch.setattr(I, "subtract", lambda available, ledger: available.distinct())
    assert rows(I.files_to_parse(scans, files, runs)) == [("due",), ("same",)]


def test_two_runs_from_one_version_commit_once(spark, tmp_path):
    seq = lambda xs: spark.createDataFrame([(x,) for x in xs], "seq long")
    a, b = (I.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    a.commit(seq([1]), seq([1]))
    assert rows(a.pending(seq([1, 2, 3]))) == rows(b.pending(seq([1, 2, 3]))) == [(2,), (3,)]
    a.commit(seq([2, 3]), seq([2, 3]))
    with pytest.raises(ConcurrentCommit):
        b.commit(seq([2, 3, 99]), seq([2, 3, 99]))
    # the first commit stands as it was, and the second run finds nothing left
    assert a.versions() == [1, 2] and rows(a.tables.read("output")) == [(2,), (3,)]
    assert rows(b.pending(seq([1, 2, 3, 4]))) == [(4,)]


def test_a_kill_between_the_writes_leaves_nothing(spark, tmp_path, monkeypatch):
    seq = lambda xs: spark.createDataFrame([(x,) for x in xs], "seq long")
    led = I.Ledger(spark, str(tmp_path / "ledger"))
    led.commit(seq([1]), seq([1]))
    led.pending(seq([1, 2]))
    with monkeypatch.context() as m:
        m.setattr(type(led.tables), "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            led.commit(seq([2]), seq([2]))
    assert led.versions() == [1] and rows(led.tables.read("output")) == [(1,)]
    assert rows(led.pending(seq([1, 2]))) == [(2,)]
    led.commit(seq([2]), seq([2]))
    assert led.pending(seq([1, 2])).isEmpty()


def test_salted_join_is_a_join(spark):
    r = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    d = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = salted_join(r, d, ["k"], how, salts=4, small=0)
        assert "__salt" in got._jdf.queryExecution().analyzed().toString()
        assert got.exceptAll(r.join(d, "k", how)).isEmpty() and got.count() == r.join(d, "k", how).count()
