"""Responses put together from a live stream of token chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkledger.functions import responses as r
from talkledger.functions import text as t

OUTPUT = (
    "request_id string, content string, model string, total_duration bigint, eval_count bigint, "
    "timed_out boolean"
)


class ResponseAssembler(StatefulProcessor):
    """Keeps the parts of one request until its ``done`` line, or until no line came for ``timeout_ms``.

    Parts are a list state, so that a long response is appended, not rewritten; what comes with the ``done``
    line goes out without a way through the state, whose every call is a message to the store. What is left of an ended
    request is a tombstone: lines that still come are dropped, and after ``tombstone_ms`` it goes by itself.
    Without ``timeout_ms`` there is no clock: open requests and tombstones stay in the state.
    """

    def __init__(self, timeout_ms: int | None, tombstone_ms: int | None) -> None:
        self.timeout_ms = timeout_ms
        self.tombstone_ms = tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "line_no bigint, part string")
        self.timer = handle.getValueState("timer", "at bigint")
        life = {"ttlDurationMs": self.tombstone_ms} if self.timeout_ms else {}
        self.ended = handle.getValueState("ended", "at bigint", **life)

    def _end(self, key, now: int, new=(), model=None, duration=None, tokens=None, timed_out: bool = False) -> Row:
        old = [tuple(part) for part in self.parts.get()]
        if old:
            self.parts.clear()
        if self.timeout_ms:
            self.timer.clear()
        self.ended.update((now,))
        text = "".join(p for _, p in sorted([*old, *new]))
        return Row(request_id=key[0], content=text, model=model, total_duration=duration, eval_count=tokens, timed_out=timed_out)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.ended.exists():
            for _ in rows:
                pass
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms else 0
        new, final = [], None
        for row in rows:
            if row.done and (final is None or row.line_no < final.line_no):
                final = row
            if row.part is not None:
                new.append((row.line_no, row.part))
        if self.timeout_ms and self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if final is not None:
            new = [part for part in new if part[0] <= final.line_no]
            yield self._end(key, now, new, final.model, final.total_duration, final.eval_count)
            return
        if new:
            self.parts.appendList(new)
        if self.timeout_ms:
            at = now + self.timeout_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._end(key, timerValues.getCurrentProcessingTimeInMs(), timed_out=True)

    def close(self) -> None:
        pass


def read_chunks(lines: DataFrame) -> DataFrame:
    """(request_id, line_no, part, done, model, total_duration, eval_count) of token lines.

    Blank, null and unreadable lines, lines that are no objects, and messages that are no objects give
    nothing; they are told apart here, before any state, so that no line can stop a stream.
    """
    read = lines.where(F.col("line").isNotNull() & ~t.is_blank("line") & F.col("request_id").isNotNull())
    read = t.computed(read.select("request_id", "line_no", "line"), _v=r.parsed(F.col("line")))
    part = F.nullif(F.try_variant_get("_v", "$.message.content", "string"), F.lit(""))
    rows = read.where(F.col("_v").isNotNull()).select(
        "request_id", F.coalesce("line_no", F.lit(0).cast("long")).alias("line_no"), part.alias("part"),
        F.coalesce(F.try_variant_get("_v", "$.done", "boolean"), F.lit(False)).alias("done"),
        F.try_variant_get("_v", "$.model", "string").alias("model"),
        F.try_variant_get("_v", "$.total_duration", "bigint").alias("total_duration"),
        F.try_variant_get("_v", "$.eval_count", "bigint").alias("eval_count"),
    )
    return rows.where(F.col("part").isNotNull() | F.col("done"))


def assembled_stream(lines: DataFrame, timeout_ms: int | None = 300_000, tombstone_ms: int | None = 3_600_000) -> DataFrame:
    """``lines`` is a stream of (request_id, line_no, line). Needs the RocksDB state store.

    One row per request: at its first ``done`` line with the parts up to it, or timed out with what came.
    """
    return read_chunks(lines).groupBy("request_id").transformWithState(
        statefulProcessor=ResponseAssembler(timeout_ms, tombstone_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if timeout_ms else "None",
    )


def assemble_files(lines: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all files that ``lines`` has not yet taken in, and add the ended responses to ``path``.

    What is still open stays in ``checkpoint`` for the next call; a run that broke off is taken up there.
    A run over files has an end, so nothing times out in it.
    """
    spark = lines.sparkSession
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        query = assembled_stream(lines, None, None).writeStream.format("parquet").outputMode("append")
        query.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
