"""Streams fed from files, run to their end."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from talkledger.operators.evidence import apply_review
from talkledger.operators.ordered import SLICE_ROWS
from talkledger.streaming import reviews, tokens

START = datetime(2024, 1, 1)


def at(ms):
    return START + timedelta(milliseconds=ms)


def test_debounced_reviews(spark, tmp_path):
    schema = "recording_id long, ts timestamp, upd_seq long, seq long, status string"
    source = str(tmp_path / "in")
    first = [(1, at(0), 0, 5, "confirmed"), (1, at(300), 1, 5, "rejected"), (1, at(600), 2, 6, "confirmed"), (1, at(1500), 3, 5, "pending")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    flushed = []
    stream = spark.readStream.schema(schema).parquet(source)
    query = reviews.start_reviews(
        stream, lambda df, _: flushed.extend(df.collect()), str(tmp_path / "cp"), processingTime="0 seconds"
    )
    try:
        query.processAllAvailable()
        # a later update moves the watermark past both bursts
        spark.createDataFrame([(2, at(60_000), 0, 1, "confirmed")], schema).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.first_ts, r.seq, r.upd_seq, r.status) for r in flushed)
    assert got == [(at(0), 5, 1, "rejected"), (at(0), 6, 2, "confirmed"), (at(1500), 5, 3, "pending")]
    found = spark.createDataFrame([(1, 5, "pending"), (1, 6, "pending")], "recording_id long, seq long, status string")
    burst = spark.createDataFrame([(1, r.seq, r.upd_seq, r.status) for r in flushed if r.first_ts == at(0)], "recording_id long, seq long, upd_seq long, status string")
    assert [r.status for r in apply_review(found, burst).orderBy("seq").collect()] == ["rejected", "confirmed"]


def test_late_updates_are_found_in_the_log(spark):
    log = spark.createDataFrame(
        [(1, 0, 5, "confirmed"), (1, 1, 5, "rejected"), (1, 2, 6, "confirmed"), (2, 0, 5, "pending"), (2, 1, 7, "rejected")],
        "recording_id long, upd_seq long, seq long, status string",
    )
    flushed = log.where("upd_seq = 0 OR seq = 6")
    got = sorted((r.recording_id, r.seq, r.upd_seq, r.status) for r in reviews.late_updates(log, flushed).collect())
    assert got == [(1, 5, 1, "rejected"), (2, 7, 1, "rejected")]
    assert reviews.late_updates(log, log).count() == 0


def test_stream_and_batch_agree_on_bursts(spark):
    rows = [(1, 0, 5, 0, "a"), (1, 1, 5, 499_999, "b"), (1, 2, 6, 999_999, "c"), (1, 3, 5, 1_500_000, "d")]
    df = spark.createDataFrame(rows, "recording_id long, upd_seq long, seq long, ts_us long, status string")
    for size in (SLICE_ROWS, 2):
        got = sorted((r.burst, r.seq, r.status) for r in reviews.bursts(df, rows=size).collect())
        assert got == [(0, 5, "b"), (0, 6, "c"), (1, 5, "d")]


def test_response_stream(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = "request_id string, line_no long, line string"
    source = str(tmp_path / "in")

    def chunk(text, **more):
        return json.dumps({"message": {"content": text}, **more})

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    put([("a", 0, chunk("Hel")), ("b", 0, chunk("lost")), ("a", 1, "not json")])
    out = []
    query = (
        tokens.assembled_stream(spark.readStream.schema(schema).parquet(source), 15_000)
        .writeStream.foreachBatch(lambda df, _: out.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(processingTime="1 second")
        .start()
    )
    # with processing-time timers the stream never counts as drained, so poll with a deadline
    try:
        time.sleep(8)
        put([("a", 2, chunk("lo", done=True, model="m", eval_count=7, total_duration=9))])
        deadline = time.time() + 60
        while len(out) < 2 and time.time() < deadline:
            time.sleep(1)
    finally:
        query.stop()
    got = {r.request_id: r for r in out}
    assert (got["a"].content, got["a"].model, got["a"].eval_count, got["a"].timed_out) == ("Hello", "m", 7, False)
    assert (got["b"].content, got["b"].timed_out) == ("lost", True)


def test_response_files_survive_odd_lines_and_ended_requests(spark, tmp_path):
    schema = "request_id string, line_no long, line string"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        tokens.assemble_files(spark.readStream.schema(schema).parquet(source), out, checkpoint)
        return sorted(tuple(r) for r in spark.read.parquet(out).select("request_id", "content", "model", "eval_count").collect())

    said = [("a", 1, '{"message":{"content":"lo"}}'), ("a", 0, '{"message":{"content":"Hel"}}'), ("a", 2, '{"message":"text"}'),
            ("a", 3, None), ("a", None, "[]"), ("a", 4, "5"), (None, 0, '{"done":true}'), ("b", 0, '{"message":{"content":"open"}}'),
            ("c", 0, '{"done":true,"model":"m"}'), ("c", 1, '{"message":{"content":"after its end"}}')]
    assert run(said) == [("c", "", "m", None)]
    more = [("a", 5, '{"message":{"content":"!"},"done":true,"eval_count":3}'), ("c", 2, '{"message":{"content":"late"},"done":true}')]
    assert run(more) == [("a", "Hello!", None, 3), ("c", "", "m", None)]
    assert run([("a", 6, '{"done":true}'), ("b", 1, '{"done":true,"eval_count":"x"}')]) == [("a", "Hello!", None, 3), ("b", "open", None, None), ("c", "", "m", None)]


def test_review_table_counts_every_update_once(spark, tmp_path):
    schema = "recording_id long, ts timestamp, upd_seq long, seq long, status string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        query = reviews.write_reviews(stream, table, str(tmp_path / "cp"), lambda: spark.read.parquet(source), 500, "1 second", availableNow=True)
        query.awaitTermination()
        return shown()

    def shown():
        rows = reviews.current_reviews(spark.read.parquet(table)).collect()
        return sorted((r.recording_id, r.seq, r.upd_seq, r.status) for r in rows)

    put((1, at(0), 0, 5, "confirmed"), (1, at(300), 1, 5, "rejected"), (1, at(600), 2, 6, "confirmed"), (2, at(60_000), 0, 1, "pending"))
    first = [(1, 5, 1, "rejected"), (1, 6, 2, "confirmed")]
    assert run() == first
    # late by a minute: the watermark drops it, the log has it; the newest update closes the cell of recording 2
    put((1, at(700), 3, 6, "rejected"), (2, at(120_000), 1, 2, "confirmed"))
    second = [(1, 5, 1, "rejected"), (1, 6, 3, "rejected"), (2, 1, 0, "pending")]
    assert run() == second
    # a batch that runs again replaces what it wrote
    numbers = sorted(r.batch for r in spark.read.parquet(table).select("batch").distinct().collect())
    for number in numbers:
        again = spark.read.parquet(table).where(f"batch = {number}").drop("batch")
        again = spark.createDataFrame(again.collect(), again.schema)
        reviews.review_sink(table, lambda: spark.read.parquet(source), 500)(again, number)
        assert shown() == second
    assert reviews.missed_updates(spark.read.parquet(source), spark.read.parquet(table), 500).count() == 0
    left = reviews.missed_updates(spark.read.parquet(source), spark.read.parquet(table), 500, every=True).collect()
    assert [(r.recording_id, r.seq, r.status) for r in left] == [(2, 2, "confirmed")]


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


class _Cell:
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("exists", "get"):
                return bool(self.rows) if name == "exists" else iter(self.rows)
            self.rows = {"clear": [], "update": list(args), "appendList": self.rows + list(args[0] if args else ())}[name]

        return call


class _Handle:
    def __init__(self):
        self.calls = []

    def getListState(self, name, schema):
        return _Cell(self.calls)

    getValueState = getListState


def test_a_request_that_ends_at_once_sends_no_part_through_the_state():
    handle = _Handle()
    machine = tokens.ResponseAssembler(None, None)
    machine.init(handle)

    def line(n, part, done=False):
        return Row(request_id="a", line_no=n, part=part, done=done, model="m" if done else None, total_duration=None, eval_count=n if done else None)

    out = list(machine.handleInputRows(("a",), iter([line(3, "after"), line(1, "lo", True), line(0, "Hel"), line(2, None, True)]), None))
    assert [tuple(r) for r in out] == [("a", "Hello", "m", None, 1, False)]
    assert sorted(handle.calls) == ["exists", "get", "update"]
    assert list(machine.handleInputRows(("a",), iter([line(4, "late", True)]), None)) == []


def test_parts_of_an_open_request_wait_in_the_state():
    machine = tokens.ResponseAssembler(None, None)
    machine.init(_Handle())

    def line(n, part, done=False):
        return Row(request_id="a", line_no=n, part=part, done=done, model=None, total_duration=None, eval_count=None)

    assert list(machine.handleInputRows(("a",), iter([line(2, "c"), line(0, "a")]), None)) == []
    out = list(machine.handleInputRows(("a",), iter([line(3, None, True), line(1, "b")]), None))
    assert [r.content for r in out] == ["abc"]
