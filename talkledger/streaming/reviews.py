"""Debounced review updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from talkledger import fixed_values as fixed
from talkledger.operators import ordered as o
from talkledger.session import cut_lineage


def burst_stream(
    updates: DataFrame, quiet_ms: int = fixed.QUIET_MS, delay: str = "10 seconds"
) -> DataFrame:
    """Streaming form: the updates of each burst, once no update of the recording came for
    ``quiet_ms``. ``updates`` is (recording_id, ts, upd_seq, seq, status). Updates that come later
    than ``delay`` are not in it; ``late_updates`` finds them in the log."""
    window = F.session_window("ts", f"{quiet_ms} milliseconds")
    return (
        updates.withWatermark("ts", delay)
        .groupBy("recording_id", window.alias("burst"))
        .agg(F.collect_list(F.struct("upd_seq", "seq", "status")).alias("_all"))
        .select(
            "recording_id",
            F.col("burst.start").alias("first_ts"),
            F.explode("_all").alias("_u"),
        )
        .select("recording_id", "first_ts", "_u.seq", "_u.upd_seq", "_u.status")
    )


def start_reviews(
    updates: DataFrame,
    flush: Callable[[DataFrame, int], None],
    checkpoint: str,
    quiet_ms: int = fixed.QUIET_MS,
    delay: str = "10 seconds",
    **trigger,
):
    """Run the stream; ``flush`` gets the last status of every finding of closed bursts, as
    ``apply_review`` takes it."""

    def last(batch: DataFrame, batch_id: int) -> None:
        settled = batch.groupBy("recording_id", "first_ts", "seq").agg(
            F.max("upd_seq").alias("upd_seq"), F.max_by("status", "upd_seq").alias("status")
        )
        flush(settled, batch_id)

    return (
        burst_stream(updates, quiet_ms, delay)
        .writeStream.foreachBatch(last)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def bursts(
    updates: DataFrame, quiet_ms: int = fixed.QUIET_MS, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Batch twin: (recording_id, burst, seq, upd_seq, status), last status per finding. As in
    the stream, an update at exactly the quiet time still belongs to the burst.

    ``upd_seq`` is the arrival order inside a recording, ``ts_us`` its time in microseconds.
    """
    runs = o.islands(
        updates, ["recording_id"], "upd_seq", ["ts_us"],
        lambda b, h: h("ts_us") - b("ts_us") > quiet_ms * 1000, "burst", rows,
    )
    return runs.groupBy("recording_id", "burst", "seq").agg(
        F.max("upd_seq").alias("upd_seq"), F.max_by("status", "upd_seq").alias("status")
    )


def late_updates(log: DataFrame, flushed: DataFrame) -> DataFrame:
    """Last status of every finding whose newest update never left the stream.

    ``log`` is the batch read of the updates, ``flushed`` what ``flush`` was given. Applied by
    ``apply_review``, where the highest ``upd_seq`` wins, so a repeat does no harm.
    """
    finding = ["recording_id", "seq"]
    last = log.groupBy(*finding).agg(F.max("upd_seq").alias("upd_seq"), F.max_by("status", "upd_seq").alias("status"))
    done = flushed.groupBy(*finding).agg(F.max("upd_seq").alias("_done"))
    return last.join(done, finding, "left").where("_done IS NULL OR _done < upd_seq").drop("_done")


#: A cell of the review table's state spans so many quiet times.
CELL_QUIETS = 8
REVIEW = "recording_id, seq, upd_seq, status, closed_ts"


def cell_stream(updates: DataFrame, quiet_ms: int = fixed.QUIET_MS, delay: str = "10 seconds") -> DataFrame:
    """The last status of every finding in each cell of time, once the watermark has passed the cell.

    State is one small row per (recording, finding, cell), so that neither a busy recording nor a long
    burst gathers anywhere; a burst that spans cells is flushed cell by cell, the last status in the end.
    """
    cell = F.window("ts", f"{CELL_QUIETS * quiet_ms} milliseconds").alias("_cell")
    settled = updates.withWatermark("ts", delay).groupBy("recording_id", "seq", cell).agg(
        F.max("upd_seq").alias("upd_seq"), F.max_by("status", "upd_seq").alias("status")
    )
    return settled.select("recording_id", "seq", "upd_seq", "status", F.col("_cell.end").alias("closed_ts"))


def missed_updates(log: DataFrame, table: DataFrame, quiet_ms: int = fixed.QUIET_MS, every: bool = False) -> DataFrame:
    """Rows for the review table of logged updates that it lacks although their cell is closed.

    ``every``: of open cells too, as at the end of a stream. The end of the latest cell in the table is a
    time that the watermark has passed, so all cells up to it are closed.
    """
    end = F.window("ts", f"{CELL_QUIETS * quiet_ms} milliseconds")["end"]
    rows = log.select("recording_id", "seq", "upd_seq", "status", end.alias("closed_ts"))
    if not every:
        rows = rows.where(F.col("closed_ts") <= F.lit(table.agg(F.max("closed_ts")).first()[0]))
    last = rows.groupBy("recording_id", "seq").agg(F.max_by(F.struct("upd_seq", "status", "closed_ts"), F.col("upd_seq")).alias("_l"))
    done = table.groupBy("recording_id", "seq").agg(F.max("upd_seq").alias("_done"))
    open_ = last.join(done, ["recording_id", "seq"], "left").where("_done IS NULL OR _done < _l.upd_seq")
    return open_.select("recording_id", "seq", "_l.*")


def review_sink(
    path: str, log: Callable[[], DataFrame] | None = None, quiet_ms: int = fixed.QUIET_MS
) -> Callable[[DataFrame, int], None]:
    """What a stream of cells calls for each batch: the batch, and what came too late for it, go into the
    folder that the batch's number names. A batch that runs again replaces what it wrote before, so each
    counts once. ``log`` reads all updates so far as a batch table; None: late ones are not looked for."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the batch as a table of its own: it is read several times, and its folder may be in what is read
        rows = cut_lineage(batch.selectExpr(*REVIEW.split(", ")))
        if log is not None:
            # an empty batch, so that there is a table to read
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch=-1")
            before = review_rows(spark, path, rows.schema).where(F.col("batch") != batch_id).select(*rows.columns)
            rows = cut_lineage(rows.unionByName(missed_updates(log(), before.unionByName(rows), quiet_ms)))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return flush


def review_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the review table with the batch that wrote them."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)


def write_reviews(
    updates: DataFrame, path: str, checkpoint: str, log: Callable[[], DataFrame] | None = None,
    quiet_ms: int = fixed.QUIET_MS, delay: str = "10 seconds", **trigger,
):
    """S1 into a table, each update once: ``updates`` (recording_id, ts, upd_seq, seq, status) as a stream."""
    writer = cell_stream(updates, quiet_ms, delay).writeStream.foreachBatch(review_sink(path, log, quiet_ms))
    return (
        writer.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def current_reviews(table: DataFrame) -> DataFrame:
    """(recording_id, seq, upd_seq, status): the last status of every finding in the table."""
    return table.groupBy("recording_id", "seq").agg(
        F.max("upd_seq").alias("upd_seq"), F.max_by("status", "upd_seq").alias("status")
    )
