import datetime as dt
import json

from pyspark.sql import functions as F

from symgraph.sources import files as S
from symgraph.sources import tables as T
from symgraph.streaming import changes
from tests.conftest import rows


def test_scan_and_changes(spark, tmp_path):
    for p, t in (("a/x.py", "x = 1\n"), ("a/node_modules/y.js", "1"), ("b.min.js", "1"), ("c.go", "package c\n"), ("README", "r")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    scan = S.scan_tree(spark, str(tmp_path))
    assert rows(scan, "file_path", "language", "size_bytes") == [("a/x.py", "python", 6), ("c.go", "go", 10)]
    stored = scan.filter("file_path = 'c.go'").select("file_path", "content_hash", F.current_timestamp().alias("last_parsed"))
    assert rows(S.changed(scan, stored), "file_path", "is_changed") == [("a/x.py", True), ("c.go", False)]
    assert S.project_state(scan, stored).first()["state"] == "ready" and S.project_state(scan, stored.limit(0)).first()["state"] == "fresh"


def test_git_log(spark):
    lines = ["COMMIT|h1|Ann|2025-01-02T03:04:05+02:00", "3\t1\ta.py", "-\t-\tb.png", "COMMIT|h2|Bob|2025-01-03T00:00:00Z", "1\t0\ta.py"]
    df = spark.createDataFrame([("l", k, x) for k, x in enumerate(lines)], "log string, n long, line string")
    got = rows(S.parse_git_log(df), "hash", "author", "path", "added", "deleted")
    assert got == [("h1", "Ann", "a.py", 3, 1), ("h1", "Ann", "b.png", 0, 0), ("h2", "Bob", "a.py", 1, 0)]
    assert S.parse_git_log(df).filter("hash = 'h1'").first()["date"] == dt.datetime(2025, 1, 2, 1, 4, 5)


def test_analyser_report(spark):
    report = json.dumps({"files": {"a.php": {"messages": [{"message": "m", "line": 3, "identifier": "i", "ignorable": True}]}}})
    assert rows(S.analyser_report(spark.createDataFrame([(report,), ("no json",)], "json string")), "file_path", "line", "message") == [("a.php", 3, "m")]


def test_versions_are_valid_at_once(spark, tmp_path):
    t = T.VersionedTables(spark, str(tmp_path / "g"))
    assert t.version() == 0 and t.read("nodes") is None
    t.commit(nodes=spark.createDataFrame([("a",)], "id string"), edges=spark.createDataFrame([("a", "b")], "s string, t string"))
    # a write that died before its marker is not read
    spark.createDataFrame([("z",)], "id string").write.parquet(str(tmp_path / "g" / "v=2" / "nodes"))
    assert rows(t.read("nodes")) == [("a",)]
    assert t.commit(nodes=spark.createDataFrame([("b",)], "id string")) == 2
    assert rows(t.read("nodes")) == [("b",)] and rows(t.read("edges")) == [("a", "b")]
    m = T.set_metadata(T.set_metadata(spark.createDataFrame([], "key string, value string"), a="1"), a="2", b="3")
    assert rows(m) == [("a", "2"), ("b", "3")]


EVENTS = "path string, op string, ts timestamp, dest string"


def test_watch_stream_deletes_then_changes(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    src = tmp_path / "in"
    data = [("a.py", "modified", s(1), None), ("a.py", "deleted", s(2), None), ("b.py", "deleted", s(1), None), ("b.py", "created", s(3), None), ("c.py", "moved", s(1), "d.py"), ("node_modules/x.js", "created", s(1), None), ("x.txt", "created", s(1), None)]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(str(src))
    seen = {}

    def apply(deleted, changed, n):
        seen[n] = (sorted(r[0] for r in deleted.collect()), sorted(r[0] for r in changed.collect()))

    q = changes.apply_changes(spark.readStream.schema(EVENTS).parquet(str(src)), apply, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == {0: (["a.py", "c.py"], ["b.py", "d.py"])}


def test_debounce_and_state(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    burst = spark.createDataFrame([("a", s(k)) for k in (0, 1, 2, 10)], "file_path string, ts timestamp")
    assert rows(changes.debounced(burst), "file_path", "changes") == [("a", 1), ("a", 3)]
    src = tmp_path / "h"
    spark.createDataFrame([("a", "1", s(0)), ("a", "1", s(1)), ("a", "2", s(2)), ("b", None, s(0))], "file_path string, content_hash string, ts timestamp").coalesce(1).write.parquet(str(src))
    stream = changes.hash_changes(spark.readStream.schema("file_path string, content_hash string, ts timestamp").parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("hashes").option("checkpointLocation", str(tmp_path / "hc")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("hashes")) == [("a", "1", "parse"), ("a", "2", "reparse")]


def test_event_windows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    src = tmp_path / "e"
    spark.createDataFrame([(k, t + dt.timedelta(minutes=10 * k), "view", 1.0) for k in range(12)] + [(3, t + dt.timedelta(minutes=30), "view", 1.0)], "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(src))
    e = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(src))
    q = changes.windowed_counts(changes.session_log(e), late=None).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ec")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("windows"), "n", "total") == [(6, 6.0)]
