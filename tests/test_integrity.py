import datetime as dt

import pytest

from symgraph.operators import integrity as I
from tests.conftest import rows


def at(n):
    return dt.datetime(2025, 1, n)


EDGES = "source_id string, target_id string, kind string, ingested_at timestamp, id string"
NODES = "id string, ingested_at timestamp, removed_at timestamp, ref string"


def frames(spark):
    edges = spark.createDataFrame(
        [
            ("a", "b", "calls", at(5), "x"),
            ("a", "b", "calls", at(5), "x"),
            ("a", "gone", "calls", at(10), "x"),
            ("a", "gone", "uses", at(3), "x"),
            ("late", "a", "calls", at(2), "x"),
            ("a", "never", "calls", at(9), "x"),
            ("a", None, "calls", at(9), "x"),
            ("a", "", "calls", at(9), "x"),
            ("a", "ext:1", "calls", at(1), "x"),
            ("a", "A", "calls", at(9), "x"),
            ("a", "gone", "twice", at(3), "x"),
            ("a", "gone", "twice", at(12), "x"),
            ("n", "a", "calls", None, "x"),
        ],
        EDGES,
    )
    nodes = spark.createDataFrame(
        [("a", at(1), None, ""), ("b", at(5), None, ""), ("b", at(8), None, ""), ("gone", at(1), at(10), ""), ("late", at(4), None, ""), (None, at(1), None, "")], NODES
    )
    ext = spark.createDataFrame([("ext:1", "n", "go")], "id string, name string, language string")
    return edges, nodes, ext


def test_dangling(spark):
    got = {(r.source_id, r.target_id, r.kind, r.ref_field) for r in I.dangling(*frames(spark)).collect()}
    assert got == {
        ("a", "gone", "calls", "target_id"),
        ("late", "a", "calls", "source_id"),
        ("a", "never", "calls", "target_id"),
        ("a", "A", "calls", "target_id"),
        ("a", "gone", "twice", "target_id"),
        ("n", "a", "calls", "source_id"),
    }


def test_report_counts_deliveries(spark):
    got = rows(I.dangling_report(*frames(spark)))
    assert ("target_id", "2025-01", 4, 3) in got and ("source_id", "2025-01", 1, 1) in got and ("source_id", None, 1, 1) in got


def test_empty_tables(spark):
    edges, nodes, ext = frames(spark)
    assert I.dangling(edges.limit(0), nodes, ext).count() == 0
    assert I.dangling(edges.limit(1), nodes.limit(0), ext.limit(0)).count() == 2


@pytest.mark.parametrize("match, want", [("simple", [1]), ("partial", [1, 4]), ("full", [1, 2, 4])])
def test_composite_keys(spark, match, want):
    refs = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "a", None), (3, None, None), (4, "z", None)], "n int, x string, y int")
    if match == "full":
        want = [1, 2, 4]
    parents = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", None)], "x string, y int")
    assert [r.n for r in I.orphans(refs, parents, {"x": "x", "y": "y"}, match).orderBy("n").collect()] == want


def test_unknown_semantics(spark):
    with pytest.raises(ValueError):
        I.orphans(spark.range(1), spark.range(1), {"id": "id"}, "vague")
