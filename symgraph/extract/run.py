"""Extraction over DataFrames: one Arrow pass over texts where they lie."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.core import spread
from symgraph.extract import c_like, frameworks, python_source, styles  # noqa: F401  (they register themselves)
from symgraph.extract.records import Found
from symgraph.extract.registry import detectors_for, extractor_for

_KIND = pa.struct([("id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docblock", pa.string()), ("metadata", pa.string())])
_EDGE = pa.struct([("source_id", pa.string()), ("target_id", pa.string()), ("kind", pa.string()), ("confidence", pa.float64()), ("line_number", pa.int32()), ("metadata", pa.string())])
_REF = pa.struct([("source_id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line_number", pa.int32()), ("metadata", pa.string())])
_ERR = pa.struct([("line_number", pa.int32()), ("message", pa.string()), ("severity", pa.string()), ("node_type", pa.string())])
SCHEMA = (
    "file_path string, language string, "
    "nodes array<struct<id: string, kind: string, name: string, qualified_name: string, start_line: int, end_line: int, docblock: string, metadata: string>>, "
    "edges array<struct<source_id: string, target_id: string, kind: string, confidence: double, line_number: int, metadata: string>>, "
    "refs array<struct<source_id: string, name: string, kind: string, line_number: int, metadata: string>>, "
    "errors array<struct<line_number: int, message: string, severity: string, node_type: string>>"
)


def extract_one(path: str, text: str, language: str, detect: bool = True) -> Found:
    """What one text holds; a failure of an extractor is an error row, not a failed task."""
    language = (language or "").lower()
    f = extractor_for(language)
    if f is None:
        found = Found(path, language)
        found.error(None, f"no extractor for {language}", "warning")
        return found
    try:
        found = f(path, text, language)
        if detect:
            for _, d in detectors_for(language):
                d(path, text, found)
        return found
    except Exception as e:  # noqa: BLE001
        found = Found(path, language)
        found.error(None, f"{type(e).__name__}: {e}")
        return found


def _dump(rows: list[dict]) -> list[dict]:
    return [r | {"metadata": json.dumps(r["metadata"], sort_keys=True, default=str)} if "metadata" in r else r for r in rows]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            p = b.slice(k, 500)
            found = [extract_one(*x) for x in zip(*(p.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays(
                [p.column(0), p.column(2), *(pa.array([_dump(getattr(f, n)) for f in found], pa.list_(t)) for n, t in (("nodes", _KIND), ("edges", _EDGE), ("refs", _REF), ("errors", _ERR)))],
                ["file_path", "language", "nodes", "edges", "refs", "errors"],
            )


def extract(files: DataFrame) -> DataFrame:
    """(file_path, language, nodes, edges, refs, errors) of texts (file_path, text, language).

    Files are independent, so nothing but a too small input is shuffled; null texts give no row. What a file holds stays
    in its row until the parts are exploded.
    """
    return spread(files.filter("text is not null").select("file_path", "text", "language")).mapInArrow(_run, SCHEMA)


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, *c) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in frameworks.api_calls(t)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()))], ["file_path", "url", "method", "line", "confidence"])


def calls_of(files: DataFrame) -> DataFrame:
    """(file_path, url, method, line, confidence): the HTTP calls in texts (file_path, text)."""
    return spread(files.filter("text is not null").select("file_path", "text")).mapInArrow(_calls, "file_path string, url string, method string, line int, confidence double")


def nodes_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("file_path", "language", F.explode("nodes").alias("n")).select("n.*", "file_path", "language")


def edges_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("edges").alias("e")).select("e.*")


def references_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("language", F.explode("refs").alias("r")).select("r.*", "language")


def errors(extracted: DataFrame) -> DataFrame:
    return extracted.select("file_path", F.explode("errors").alias("e")).select("file_path", "e.*")
