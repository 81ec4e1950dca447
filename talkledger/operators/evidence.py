"""Joins by time and by key: evidence, clips, renames, review updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import text as t
from talkledger.functions import times
from talkledger.operators import ordered as o

RECORDING = ("recording_id",)


def distinct_screen_text(ocr: DataFrame) -> DataFrame:
    """One row per (time, trimmed text), the first in the list; blank text dropped."""
    rows = ocr.withColumn("_text", t.strip("text")).where(F.col("_text") != "")
    kept = [c for c in ocr.columns if c not in ("recording_id", "timestamp_ms")]
    first = F.min_by(F.struct(*kept), F.col("seq")).alias("_row")
    return (
        rows.groupBy("recording_id", "timestamp_ms", "_text")
        .agg(first)
        .select("recording_id", "timestamp_ms", "_row.*")
        .select(*ocr.columns)
    )


def screen_text_of_chunks(
    entries: DataFrame, ocr: DataFrame, margin_ms: int = fixed.OCR_MARGIN_MS
) -> DataFrame:
    """OCR rows within ``margin_ms`` of a chunk. ``entries`` carry ``chunk_idx``.

    Copies are dropped before the join (all copies of one (time, text) fall into the same
    chunks), and both sides meet on (recording, time cell).
    """
    spans = entries.groupBy("recording_id", "chunk_idx").agg(
        (F.min("timestamp_ms") - margin_ms).alias("_from"),
        (F.max("end_ms") + margin_ms).alias("_to"),
    ).where(F.col("_from") <= F.col("_to"))
    spans = o.interval_cells(spans, F.col("_from"), F.col("_to"))
    shown = distinct_screen_text(ocr)
    # times alone are copied into the cells of every class; texts meet them once, by time
    points = o.point_cells(shown.select("recording_id", "timestamp_ms").distinct(), F.col("timestamp_ms"))
    met = (
        points.join(spans, ["recording_id", "_cell"])
        .where(F.col("timestamp_ms").between(F.col("_from"), F.col("_to")))
        .drop("_cell", "_from", "_to")
    )
    return shown.join(met, ["recording_id", "timestamp_ms"])


def _nearest_marks(
    points: DataFrame, marks: DataFrame, time: str, slice_ms: int
) -> DataFrame:
    """For each distinct point time the mark times just before and just after it."""
    both = (
        points.select("recording_id", time, F.lit(True).alias("_point"), F.lit(None).cast("long").alias("_mark"))
        .unionByName(
            marks.select("recording_id", time, F.lit(False).alias("_point"), F.col(time).alias("_mark"))
        )
        .groupBy("recording_id", time)
        .agg(F.bool_or("_point").alias("_point"), F.max("_mark").alias("_mark"))
    )
    return o.scan(
        both,
        RECORDING,
        time,
        {"_before": o.latest(F.col("_mark")), "_after": o.soonest(F.col("_mark"))},
        slice_ms,
    ).where("_point").select("recording_id", time, "_before", "_after")


def nearest_screen_text(
    violations: DataFrame,
    ocr: DataFrame,
    margin_ms: int = fixed.EVIDENCE_MARGIN_MS,
    slice_ms: int = o.SLICE_MS,
) -> DataFrame:
    """Fill evidence of transcript violations from the OCR row nearest in time.

    Ties go to the first OCR row of the list. Both sides are reduced to distinct times, a
    scan gives the OCR time before and after each, and at most two candidates are compared.
    """
    at_time = ocr.groupBy("recording_id", "timestamp_ms").agg(
        F.min_by(F.struct("seq", "text", "frame_path"), F.col("seq")).alias("_ocr")
    )
    open_ = (F.coalesce(F.col("evidence_text"), F.lit("")) == "") & (F.col("source") == "transcript")
    points = violations.where(open_).select("recording_id", "timestamp_ms").distinct()
    near = _nearest_marks(points, at_time, "timestamp_ms", slice_ms)
    near = near.select(
        "recording_id", "timestamp_ms", F.explode(F.array_distinct(F.array("_before", "_after"))).alias("_at")
    ).where(F.abs(F.col("_at") - F.col("timestamp_ms")) <= margin_ms)
    found = at_time.withColumnRenamed("timestamp_ms", "_at")
    best = (
        near.join(found, ["recording_id", "_at"])
        .groupBy("recording_id", "timestamp_ms")
        .agg(
            F.min_by(
                "_ocr", F.struct(F.abs(F.col("_at") - F.col("timestamp_ms")), F.col("_ocr.seq"))
            ).alias("_ocr")
        )
    )
    joined = violations.join(best, ["recording_id", "timestamp_ms"], "left")
    take = open_ & F.col("_ocr").isNotNull()
    frame = t.base_name(F.coalesce(F.col("_ocr.frame_path"), F.lit("")))
    return joined.select(
        *[c for c in violations.columns if c not in ("evidence_text", "evidence_url")],
        F.when(take, F.col("_ocr.text")).otherwise(F.col("evidence_text")).alias("evidence_text"),
        F.when(take & (F.coalesce(F.col("_ocr.frame_path"), F.lit("")) != ""), frame)
        .otherwise(F.col("evidence_url"))
        .alias("evidence_url"),
    ).select(*violations.columns)


def active_block(
    probes: DataFrame, blocks: DataFrame, slice_ms: int = o.SLICE_MS
) -> DataFrame:
    """The last block that starts at or before ``time_ms`` (-1 when there is none)."""
    starts = blocks.groupBy("recording_id", F.col("start_ms").alias("time_ms")).agg(
        F.max("block_idx").alias("_block")
    )
    both = (
        probes.select("recording_id", "time_ms", F.lit(True).alias("_point"), F.lit(None).cast("long").alias("_block"))
        .unionByName(starts.select("recording_id", "time_ms", F.lit(False).alias("_point"), F.col("_block").cast("long")))
        .groupBy("recording_id", "time_ms")
        .agg(F.bool_or("_point").alias("_point"), F.max("_block").alias("_block"))
    )
    found = o.scan(both, RECORDING, "time_ms", {"block_idx": o.latest(F.col("_block"))}, slice_ms)
    found = found.where("_point").select(
        "recording_id", "time_ms", F.coalesce("block_idx", F.lit(-1)).alias("block_idx")
    )
    return probes.join(found, ["recording_id", "time_ms"])


def active_sentences(
    probes: DataFrame, entries: DataFrame, cue_ms: int = fixed.DEFAULT_CUE_MS
) -> DataFrame:
    """Entries with start <= time < (end, or start + ``cue_ms``)."""
    end = times.or_else(F.col("end_ms"), F.col("timestamp_ms") + cue_ms)
    spans = entries.withColumn("_to", end).where(F.col("_to") > F.col("timestamp_ms"))
    return _covered(probes, spans, F.col("timestamp_ms"), F.col("_to") - 1).drop("_to")


def active_blocks(
    probes: DataFrame, blocks: DataFrame, cue_ms: int = fixed.DEFAULT_CUE_MS
) -> DataFrame:
    """J6, block form: start <= time <= end + ``cue_ms``."""
    spans = blocks.where(F.col("start_ms") <= F.col("end_ms") + cue_ms)
    return _covered(probes, spans, F.col("start_ms"), F.col("end_ms") + cue_ms)


def _covered(probes: DataFrame, spans: DataFrame, start: Column, end: Column) -> DataFrame:
    cells = o.interval_cells(spans.withColumn("_s", start).withColumn("_e", end), F.col("_s"), F.col("_e"))
    points = o.point_cells(probes.select("recording_id", "time_ms").distinct(), F.col("time_ms"))
    met = (
        points.join(cells, ["recording_id", "_cell"])
        .where(F.col("time_ms").between(F.col("_s"), F.col("_e")))
        .drop("_cell", "_s", "_e")
    )
    return probes.join(met, ["recording_id", "time_ms"])


def rename_speakers(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` is (recording_id, speaker, name); unmapped speakers keep theirs."""
    return (
        rows.join(names, ["recording_id", "speaker"], "left")
        .withColumn("speaker", F.coalesce("name", "speaker"))
        .drop("name")
    )


def visible_speakers(rows: DataFrame, visible: DataFrame) -> DataFrame:
    """P10: rows whose (recording_id, speaker) is listed."""
    return rows.join(visible.select("recording_id", "speaker"), ["recording_id", "speaker"], "left_semi")


def displayed_text(rows: DataFrame, edits: DataFrame, corrected: bool = True) -> DataFrame:
    """``edits`` is (recording_id, block_idx, sentence_idx, edited)."""
    own = "text_corrected" if corrected else "text"
    return (
        rows.join(edits, ["recording_id", "block_idx", "sentence_idx"], "left")
        .withColumn("shown", F.coalesce("edited", own))
        .drop("edited")
    )


def search_transcript(rows: DataFrame, query: str, shown: str = "shown") -> DataFrame:
    """Case-sensitive; an empty query marks nothing."""
    return rows.where(F.lit(bool(query)) & F.contains(F.col(shown), F.lit(query)))


def precise_times(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace the model's times by those of the first entry of the chunk that shows
    the same ``timestamp``; otherwise the model's ms, or the parsed text."""
    first = (
        entries.where(F.coalesce("timestamp", F.lit("")) != "")
        .groupBy("recording_id", "chunk_idx", "timestamp")
        .agg(F.min_by(F.struct("timestamp_ms", "end_ms"), F.col("seq")).alias("_hit"))
    )
    rows = findings.join(first, ["recording_id", "chunk_idx", "timestamp"], "left")
    hit = F.col("_hit").isNotNull()
    start = F.when(hit, F.col("_hit.timestamp_ms")).otherwise(
        times.or_else(F.col("model_ms"), times.parse_time(F.col("timestamp")))
    )
    end = F.when(hit, F.col("_hit.end_ms")).otherwise(F.col("model_end_ms"))
    return (
        rows.withColumn("timestamp_ms", start.cast("long"))
        .withColumn("end_ms", times.or_else(end, F.col("timestamp_ms")).cast("long"))
        .drop("_hit", "model_ms", "model_end_ms")
    )


def entry_context(
    violations: DataFrame, entries: DataFrame, reach: int = fixed.CONTEXT_ENTRIES
) -> DataFrame:
    """Entries within ``reach`` places of the first entry that starts at the time of a
    transcript violation."""
    first = entries.groupBy("recording_id", "timestamp_ms").agg(F.min("seq").alias("_at"))
    places = F.sequence(F.greatest(F.col("_at") - reach, F.lit(0)), F.col("_at") + reach)
    wanted = (
        violations.where(F.col("source") == "transcript")
        .select("recording_id", F.col("seq").alias("violation_seq"), "timestamp_ms")
        .join(first, ["recording_id", "timestamp_ms"])
        .select(
            "recording_id", "violation_seq", F.col("timestamp_ms").alias("_time"), F.explode(places).alias("seq")
        )
    )
    return (
        wanted.join(entries, ["recording_id", "seq"])
        .withColumn("is_current", F.col("timestamp_ms") == F.col("_time"))
        .drop("_time")
    )


def apply_review(violations: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` is (recording_id, seq, upd_seq, status); the latest wins, unknown
    places are ignored."""
    last = updates.groupBy("recording_id", "seq").agg(F.max_by("status", "upd_seq").alias("_new"))
    return (
        violations.join(last, ["recording_id", "seq"], "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .drop("_new")
    )


def apply_batch_review(violations: DataFrame, updates: DataFrame) -> DataFrame:
    """J11, batch form: ``updates`` is (recording_id, timestamp_ms, rule_id, upd_seq,
    status); every violation that shares the key is touched."""
    keys = ["recording_id", "timestamp_ms", "rule_id"]
    last = updates.groupBy(*keys).agg(F.max_by("status", "upd_seq").alias("_new"))
    return (
        violations.join(last, keys, "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .drop("_new")
    )
