"""Tasks work on small pieces of what comes in one batch."""

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from talkledger.operators import batches, chunks, exchanges, segments
from talkledger.sources import readers

KB = 1024


def test_pieces_are_small_and_keep_the_order():
    texts = ["x" * KB * (1 + k % 3) for k in range(900)] + ["y" * 3_000_000, ""]
    found = list(batches.pieces([pa.RecordBatch.from_pydict({"t": texts}), pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})], 64 * KB))
    assert [x for p in found for x in p.column("t").to_pylist()] == texts
    assert all(p.nbytes <= 64 * KB or p.num_rows == 1 for p in found) and len(found) > 20


@pytest.fixture
def in_tasks(monkeypatch, spark):
    """The functions that go to tasks."""
    kind, seen = type(spark.range(0)), []
    sent = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema, *a, **k: (seen.append(f), sent(df, f, schema, *a, **k))[1])
    return seen


def _small(out, most=8 * batches.PIECE_BYTES):
    out = list(out)
    assert len(out) > 1 and all(b.nbytes <= most for b in out)
    return pa.Table.from_batches(out)


def test_calls_answer_piece_by_piece(spark, in_tasks):
    exchanges.call_model(spark.createDataFrame([(1, "a", 2)], "id long, prompt string, n int"), lambda p, n: p[:n], options=("n",), error="why")
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(600)), "prompt": ["ab" * 10 * KB] * 600, "n": pa.array([1, 2] * 300, pa.int32())})
    out = _small(in_tasks[0](iter([rows])))
    assert out.column("response").to_pylist() == ["a", "ab"] * 300 and out.column("why").null_count == 600


def test_chunks_are_cut_piece_by_piece(spark, in_tasks):
    chunks.chunk_texts(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text", 800, 0)
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(300)), "_text": ["ab" * 10 * KB] * 300})
    out = _small(in_tasks[0](iter([rows])))
    assert out.num_rows == 300 * 26 and out.column("id").to_pylist()[-1] == 299


def test_sheets_are_read_piece_by_piece(spark, in_tasks):
    readers.sheet_rows(spark.createDataFrame([(1, b"a")], "sheet_id long, content binary"))
    rows = pa.RecordBatch.from_pydict({"sheet_id": pa.array([7, 8, 9]), "content": [b"a,,b\n\n" * 400_000, b"\x81\xff", b""]})
    out = _small(in_tasks[0](iter([rows])))
    assert out.num_rows == 400_001 and out.slice(399_999).to_pylist() == [
        {"sheet_id": 7, "row_idx": 399_999, "cells": ["a", "", "b"]}, {"sheet_id": 8, "row_idx": 0, "cells": None}]


def test_long_segments_are_cut_piece_by_piece(spark, in_tasks):
    n = 2000
    stamps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 90).cast("long").alias("start"), (i * 90 + 80).cast("long").alias("end")))
    rows = spark.range(200).select(F.lit("r").alias("recording_id"), F.col("id").alias("seg_idx"), F.lit("ab, " * (n // 4)).alias("text"), stamps.alias("timestamps"))
    segments.split_long_segments(rows)
    out = _small(in_tasks[0](iter(rows.coalesce(1).toArrow().to_batches())))
    first = out.filter(pa.compute.equal(out.column("seg_idx"), 150)).to_pylist()
    assert [p["start_ms"] for p in first][:2] == [0, 167 * 90] and first[-1]["end_ms"] == (n - 1) * 90 + 80
    assert "".join(p["text"] for p in first).replace(" ", "") == "ab," * (n // 4)
