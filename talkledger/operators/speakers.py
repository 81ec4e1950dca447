"""Who speaks when: analysis windows, votes, turns; window labels are a table a model wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import text as t
from talkledger.operators import ordered as o

RECORDING = ("recording_id",)


def analysis_windows(
    segments: DataFrame,
    recordings: DataFrame,
    window_ms: int = fixed.SPEAKER_WINDOW_MS,
    step_ms: int = fixed.SPEAKER_STEP_MS,
    min_ms: int = fixed.SPEAKER_MIN_WINDOW_MS,
    long_ms: int = fixed.SPEAKER_LONG_MS,
    max_windows: int = fixed.SPEAKER_MAX_WINDOWS,
) -> DataFrame:
    """Sliding windows of long segments, one window for short ones.

    ``recordings`` is (recording_id, duration_ms). A recording with one segment and no
    times is covered whole, with a step that keeps it to about ``max_windows``.
    """
    untimed = (F.col("start_ms") == 0) & (F.col("end_ms") == 0)
    shape = segments.groupBy("recording_id").agg(
        ((F.count(F.lit(1)) == 1) & F.bool_and(untimed)).alias("_lone")
    )
    rows = segments.join(
        shape.join(recordings.select("recording_id", "duration_ms"), "recording_id"), "recording_id"
    )
    whole = F.col("_lone") | (untimed & (F.length("text") > 0))
    begin = F.when(whole, 0).otherwise(F.col("start_ms")).cast("long")
    end = F.when(whole, F.col("duration_ms")).otherwise(F.col("end_ms")).cast("long")
    total = F.col("duration_ms")
    wide = F.floor(total / max_windows)
    step = F.when(F.col("_lone") & (F.floor(total / step_ms) > max_windows), wide).otherwise(step_ms)
    rows = rows.select(
        "recording_id", "seg_idx", begin.alias("_b"), end.alias("_e"), step.cast("long").alias("_step"),
        (F.col("_lone") | (end - begin > long_ms)).alias("_slides"),
    ).where(F.col("_e") > F.col("_b"))
    starts = F.when(
        F.col("_slides"), F.sequence(F.col("_b"), F.col("_e") - 1, F.col("_step"))
    ).otherwise(F.array("_b"))
    found = rows.select("*", F.explode(starts).alias("start_ms"))
    stop = F.when(F.col("_slides"), F.least(F.col("start_ms") + window_ms, F.col("_e"))).otherwise(F.col("_e"))
    return (
        found.withColumn("end_ms", stop)
        .where(F.col("end_ms") - F.col("start_ms") >= min_ms)
        .select("recording_id", "seg_idx", "start_ms", "end_ms")
    )


def vote_speakers(segments: DataFrame, windows: DataFrame, segment_key: str = "seg_idx") -> DataFrame:
    """The label most windows of a segment carry, ties to the label seen first."""
    counts = windows.groupBy("recording_id", segment_key, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.min("win_idx").alias("_first")
    )
    winner = counts.groupBy("recording_id", segment_key).agg(
        F.max_by("label", F.struct(F.col("_n"), -F.col("_first"))).alias("_label")
    )
    return (
        segments.drop("speaker")
        .join(winner, ["recording_id", segment_key], "left")
        .withColumn("speaker", F.coalesce("_label", F.lit(-1)))
        .drop("_label")
    )


def speaker_turns(windows: DataFrame, rows: int = o.SLICE_ROWS) -> DataFrame:
    """Runs of one label over windows in time order."""
    ordered = o.positions(windows, RECORDING, "start_ms", "win_idx", rows=rows)
    runs = o.islands(
        ordered, RECORDING, "pos", ["label"], lambda b, h: b("label") != h("label"), "turn_idx", rows
    )
    return runs.groupBy("recording_id", "turn_idx").agg(
        F.min_by("label", "pos").alias("speaker"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
    )


def split_text_over_turns(
    turns: DataFrame, texts: DataFrame, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """A recording's text shared out over its turns by duration.

    ``texts`` is (recording_id, text, start_ms, end_ms) of the one original segment; it is
    returned with speaker 0 when no turn gets any text.
    """
    whole = texts.select(
        "recording_id", "text", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"),
        F.length("text").alias("_len"),
    )
    spanned = o.scan(
        turns, RECORDING, "turn_idx",
        {
            "_from": o.overall_min(F.col("start_ms")),
            "_to": o.final(F.col("end_ms")),
            "_last": o.overall_max(F.col("turn_idx")),
        },
        rows,
    )
    total = F.col("_to") - F.col("_from")
    share = (F.col("_len") * (F.col("end_ms") - F.col("start_ms"))) / F.when(total > 0, total).otherwise(1)
    sized = spanned.join(whole.select("recording_id", "_len"), "recording_id").select(
        *turns.columns, "_last", "_len", F.floor(share).cast("long").alias("_chars")
    )
    placed = o.scan(sized, RECORDING, "turn_idx", {"_upto": o.running(F.col("_chars"))}, rows)
    take = F.when(F.col("turn_idx") == F.col("_last"), F.col("_len")).otherwise(F.col("_chars"))
    turn = F.struct(
        "turn_idx", F.col("speaker").cast("long").alias("speaker"), "start_ms", "end_ms",
        (F.col("_upto") - F.col("_chars")).cast("int").alias("_off"), take.cast("int").alias("_take"),
    )
    # the places of a slice of turns meet the text as one row, and leave it as pieces
    slices = placed.groupBy("recording_id", F.floor(F.col("turn_idx") / rows).alias("_slice")).agg(F.collect_list(turn).alias("_turns"))
    text = F.col("text")
    pieces = F.transform(
        "_turns",
        lambda x: F.struct(*[x[c].alias(c) for c in ("turn_idx", "speaker", "start_ms", "end_ms")], F.substring(text, x["_off"] + 1, x["_take"]).alias("text")),
    )
    cut = slices.join(whole.select("recording_id", "text"), "recording_id").select(
        "recording_id", F.inline(F.filter(pieces, lambda x: ~t.is_blank(x["text"])))
    )
    # a recording without any piece comes back whole
    alone = whole.join(cut.select("recording_id").distinct(), "recording_id", "left_anti").select(
        "recording_id", F.lit(0).cast("long").alias("turn_idx"), F.lit(0).cast("long").alias("speaker"),
        F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"), "text",
    )
    return cut.withColumn("turn_idx", F.col("turn_idx").cast("long")).unionByName(alone)
