"""Frames, detections and screen text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.operators import ordered as o

RECORDING = ("recording_id",)


def keep_screen_text(
    ocr: DataFrame,
    min_confidence: float = fixed.OCR_CONFIDENCE,
    min_length: int = fixed.OCR_MIN_LENGTH,
) -> DataFrame:
    """P7."""
    return ocr.where(
        (F.col("confidence") >= min_confidence) & (F.length("text") >= min_length)
    ).withColumn("confidence", F.round("confidence", 4))


def frame_faces(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Faces per frame, 0 for frames without one."""
    faces = detections.groupBy("recording_id", "frame_path").agg(
        F.count(F.lit(1)).alias("face_count"), F.max(F.round("confidence", 4)).alias("max_confidence")
    )
    return (
        frames.join(faces, ["recording_id", "frame_path"], "left")
        .withColumn("face_count", F.coalesce("face_count", F.lit(0)))
        .withColumn("max_confidence", F.coalesce("max_confidence", F.lit(0.0)))
    )


def face_timeline(
    frames: DataFrame,
    interval_ms: int,
    missing_ms: int = fixed.FACE_MISSING_MS,
    rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """Presence events. An event ends where the next state begins; short absences are
    dropped and their neighbours stay apart. ``seq`` is the frame's place in its list."""
    ordered = o.positions(frames, RECORDING, "timestamp_ms", "seq", rows=rows).withColumn(
        "_seen", F.col("face_count") > 0
    )
    runs = o.islands(
        ordered, RECORDING, "pos", ["_seen"], lambda b, h: b("_seen") != h("_seen"), rows=rows,
        carries={"_next": o.following(F.col("timestamp_ms"))},
    )
    events = runs.groupBy("recording_id", "island").agg(
        F.min_by("_seen", "pos").alias("_seen"),
        F.min("timestamp_ms").alias("start_ms"),
        F.max("timestamp_ms").alias("_last"),
        F.max_by("_next", "pos").alias("_next"),
        F.max("max_confidence").alias("confidence"),
        F.min_by("frame_path", "pos").alias("frame_path"),
    )
    end = F.coalesce("_next", F.col("_last") + interval_ms)
    return events.where(F.col("_seen") | (end - F.col("start_ms") >= missing_ms)).select(
        "recording_id",
        "island",
        F.when(F.col("_seen"), "face_detected").otherwise("face_missing").alias("event_type"),
        "start_ms",
        end.alias("end_ms"),
        F.round("confidence", 4).alias("confidence"),
        "frame_path",
    )


def sample_frames(
    frames: DataFrame, max_count: int = fixed.FRAME_MAX, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Frames floor(i*n/max) for i below max; all of them when there are fewer.

    ``frame_idx`` is the place from 0. Whether some i lands on a frame is checked by
    arithmetic on its place, so nothing is exploded or joined.
    """
    counts = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("_n") / F.lit(float(max_count))
    guess = F.floor(F.col("frame_idx") / step)
    hit = F.lit(False)
    for near in (-1, 0, 1, 2):
        i = guess + near
        hit = hit | ((i >= 0) & (i < max_count) & (F.floor(i.cast("double") * step) == F.col("frame_idx")))
    return (
        frames.join(counts, "recording_id").where((F.col("_n") <= max_count) | hit).drop("_n")
    )


def frame_times(frames: DataFrame, interval_s: float, interval_mode: bool = True) -> DataFrame:
    """Ms from a numeric file name (from 1) in interval mode, else from the place."""
    stem = F.regexp_extract("frame_path", r"([^/]*?)(\.[^./]*)?\z", 1)
    number = F.when(stem.rlike(r"^[0-9]+\z"), stem).try_cast("bigint")
    by_place = F.col("frame_idx") * interval_s * 1000
    by_name = (number - 1) * interval_s * 1000
    ms = F.coalesce(by_name, by_place) if interval_mode else by_place
    return frames.withColumn("timestamp_ms", ms.cast("long"))
