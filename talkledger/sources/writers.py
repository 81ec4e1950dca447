"""Sinks: run-partitioned artifacts, subtitles, documents, results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import times
from talkledger.operators import ordered as o
from talkledger.operators.evidence import rename_speakers
from talkledger.operators.segments import with_blocks


def write_artifacts(df: DataFrame, path: str, run: int, recordings: DataFrame | None = None) -> None:
    """SNK1: replace what run number ``run`` wrote, leave all other runs untouched.

    ``recordings`` names every recording the run covered, those without a row in ``df`` as well;
    None: those with rows. One folder per run, not per recording: the number of files follows the
    data. Every attempt at a run writes a folder of its own, and the manifest, written after the rows,
    names the one that counts: an attempt that broke off in between leaves what was there before.
    """
    attempt = f"a-{uuid.uuid4().hex}"
    rows = f"{path}/rows/run={run}/attempt={attempt}"
    df.write.parquet(rows)
    covered = df.sparkSession.read.schema(df.schema).parquet(rows) if recordings is None else recordings
    manifest = covered.select("recording_id").distinct().withColumn("attempt", F.lit(attempt))
    manifest.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/manifest/run={run}")


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """SNK1: for every recording the rows of the highest run that covered it; none where that run
    found nothing."""
    manifest = spark.read.parquet(f"{path}/manifest")
    newest = manifest.groupBy("recording_id").agg(F.max_by(F.struct("run", "attempt"), F.col("run")).alias("_n")).select("recording_id", "_n.*")
    rows = spark.read.parquet(f"{path}/rows").join(newest, ["recording_id", "run", "attempt"], "left_semi")
    return rows.drop("run", "attempt")


def invalidated(
    evaluations: DataFrame, compliance: DataFrame, rerun: DataFrame, evaluation_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """SNK4: what stays after ``rerun`` recordings are transcribed (or only evaluated) again."""
    ids = rerun.select("recording_id")
    return (
        evaluations.join(ids, "recording_id", "left_anti"),
        compliance if evaluation_only else compliance.join(ids, "recording_id", "left_anti"),
    )


def subtitle_cues(
    entries: DataFrame,
    corrected: bool = True,
    cue_ms: int = fixed.DEFAULT_CUE_MS,
    rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """SNK2: one row per cue, with its text block."""
    seen = o.scan(
        entries, ["recording_id"], "seq",
        {"_next": o.following(F.col("timestamp_ms")), "cue": o.running(F.lit(1))}, rows,
    )
    start = F.col("timestamp_ms")
    end = times.or_else(F.col("end_ms"), F.coalesce("_next", start + cue_ms))
    return seen.select(
        "recording_id",
        "cue",
        F.format_string(
            "%d\n%s --> %s\n%s: %s\n",
            "cue", times.subtitle_time(start), times.subtitle_time(end), "speaker",
            "text_corrected" if corrected else "text",
        ).alias("block"),
    )


def subtitle_files(entries: DataFrame, corrected: bool = True, rows: int = o.SLICE_ROWS) -> DataFrame:
    """SNK2: one subtitle text per recording."""
    cues = subtitle_cues(entries, corrected, rows=rows)
    return o.joined_text(cues, ["recording_id"], "cue", F.col("block"), "\n", "srt", rows)


def document_blocks(
    entries: DataFrame, names: DataFrame, corrected: bool = True, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """SNK3: speaker (renamed), time and text of every display block."""
    blocks = (
        with_blocks(entries, rows=rows)
        .withColumn("_shown", F.col("text_corrected" if corrected else "text"))
        .groupBy("recording_id", "block_idx")
        .agg(
            F.min_by("speaker", "seq").alias("speaker"),
            F.min_by("timestamp_ms", "seq").alias("_start"),
            F.expr("listagg(_shown, '') WITHIN GROUP (ORDER BY seq)").alias("text"),
        )
    )
    return rename_speakers(blocks, names).select(
        "recording_id", "block_idx", "speaker", times.clock(F.col("_start")).alias("time"), "text"
    )


def task_results(
    inventory: DataFrame,
    artifacts: Mapping[str, DataFrame],
    ocr: DataFrame,
    visual_events: DataFrame,
) -> DataFrame:
    """Everything known about a recording; absent artifacts stay null.

    ``artifacts`` maps transcript, evaluation and compliance to (recording_id, value).
    """
    rows = inventory
    for name, df in artifacts.items():
        rows = rows.join(df.select("recording_id", F.col("value").alias(name)), "recording_id", "left")
    for name, df in (("ocr_text_count", ocr), ("visual_event_count", visual_events)):
        counts = df.groupBy("recording_id").agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(counts, "recording_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.withColumn("has_audio", F.col("audio_path").isNotNull())
