"""Joins by key and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from checks.sequences import BLOCKS
from talkledger.operators import evidence, exchanges, ordered, segments, visual


def _entries(spark, folder):
    return v.entries(spark, folder, v.SLICE)


def _blocked(spark, folder):
    n = v.SLICE
    return segments.with_blocks(v.entries(spark, folder, n), 2000, n)


def _blocks(spark, folder):
    n = v.SLICE
    return segments.view_blocks(v.entries(spark, folder, n), 2000, n)


@check(
    "p5_confidence_gate",
    "WITH " + v.SEGMENTS + """,
x AS (SELECT recording_id, seg_idx, CASE WHEN recording_id%6=0 THEN 0 ELSE confidence END AS confidence FROM v_segments)
SELECT recording_id, seg_idx, max(confidence) OVER (PARTITION BY recording_id) <= 0 OR confidence < 0.95 AS needs_correction FROM x""",
)
def gate(spark, folder):
    s = v.segments(spark, folder, v.SLICE)
    s = s.withColumn("confidence", F.when(F.col("recording_id") % 6 == 0, 0.0).otherwise(F.col("confidence")))
    return segments.needs_correction(s).select("recording_id", "seg_idx", "needs_correction")


@check(
    "p7_screen_text_filter",
    "WITH " + v.TIMELINE + "," + v.OCR + " SELECT seq, text, round(confidence * 3, 4) AS confidence FROM v_ocr WHERE confidence * 3 >= 0.6 AND length(text) >= 14",
)
def screen_filter(spark, folder):
    o = v.ocr(spark, folder).withColumn("confidence", F.col("confidence") * 3)
    return visual.keep_screen_text(o, min_length=14).select("seq", "text", "confidence")


@check(
    "p10_visible_speakers",
    "WITH " + BLOCKS + " SELECT recording_id, block_idx, speaker FROM v_blocks WHERE (recording_id%2=0 AND speaker='Speaker 1') OR (recording_id%2=1 AND speaker='Speaker 2')",
)
def visible(spark, folder):
    blocks = _blocks(spark, folder)
    shown = v.table(spark, folder, "conversations").select(F.col("conv_id").alias("recording_id")).distinct()
    shown = shown.withColumn("speaker", F.format_string("Speaker %d", F.col("recording_id") % 2 + 1))
    return evidence.visible_speakers(blocks, shown).select("recording_id", "block_idx", "speaker")


def _sentences(spark, folder):
    return _blocked(spark, folder).withColumn("sentence_idx", F.col("seq"))


def _edits(spark, folder):
    return _sentences(spark, folder).where("(recording_id + seq) % 4 = 0").select(
        "recording_id", "block_idx", "sentence_idx", F.concat(F.lit("edited "), F.upper("speaker")).alias("edited")
    )


DISPLAYED = BLOCKS + """,
shown AS (SELECT recording_id, block_idx, seq, CASE WHEN (recording_id+seq)%4=0 THEN concat('edited ', upper(speaker)) ELSE text_corrected END AS shown FROM v_blocked)"""


@check("j10_edited_text", "WITH " + DISPLAYED + " SELECT * FROM shown")
def edited(spark, folder):
    rows = evidence.displayed_text(_sentences(spark, folder), _edits(spark, folder))
    return rows.select("recording_id", "block_idx", "seq", "shown")


@check("p11_transcript_search", "WITH " + DISPLAYED + " SELECT recording_id, seq FROM shown WHERE contains(shown, 'EN')")
def transcript_search(spark, folder):
    rows = evidence.displayed_text(_sentences(spark, folder), _edits(spark, folder))
    return evidence.search_transcript(rows, "EN").select("recording_id", "seq")


@check(
    "j2_precise_times",
    "WITH " + v.ENTRIES + """,
f AS (SELECT recording_id, seq, chunk_idx, CASE WHEN (recording_id+seq)%3=0 THEN '59:59' ELSE "timestamp" END AS ts,
  CASE WHEN seq%2=0 THEN 0 ELSE timestamp_ms + 1 END AS model_ms, CASE WHEN seq%4=0 THEN 0 ELSE timestamp_ms + 9 END AS model_end FROM v_entries),
h AS (SELECT recording_id, chunk_idx, "timestamp" AS ts, arg_min(timestamp_ms, seq) AS t, arg_min(end_ms, seq) AS e FROM v_entries GROUP BY ALL),
j AS (SELECT f.*, h.t IS NOT NULL AS hit, CASE WHEN h.t IS NOT NULL THEN h.t WHEN model_ms <> 0 THEN model_ms WHEN ts = '59:59' THEN 3599000 END AS timestamp_ms,
  CASE WHEN h.t IS NOT NULL THEN h.e ELSE model_end END AS e FROM f LEFT JOIN h USING (recording_id, chunk_idx, ts))
SELECT recording_id, seq, timestamp_ms, CASE WHEN e = 0 THEN timestamp_ms ELSE e END AS end_ms FROM j""",
)
def precise(spark, folder):
    e = _entries(spark, folder)
    found = e.select(
        "recording_id", "seq", "chunk_idx",
        F.when((F.col("recording_id") + F.col("seq")) % 3 == 0, "59:59").otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(F.col("seq") % 2 == 0, 0).otherwise(F.col("timestamp_ms") + 1).alias("model_ms"),
        F.when(F.col("seq") % 4 == 0, 0).otherwise(F.col("timestamp_ms") + 9).alias("model_end_ms"),
    )
    return evidence.precise_times(found, e).select("recording_id", "seq", "timestamp_ms", "end_ms")


def _chunked_timeline(spark, folder):
    """Events as entries of a day long chunk."""
    t = v.timeline(spark, folder)
    return t.select(
        "recording_id", F.floor(F.col("timestamp_ms") / 86_400_000).alias("chunk_idx"), "timestamp_ms",
        (F.col("timestamp_ms") + F.col("seq") % 7 * 60_000).alias("end_ms"),
    )


@check(
    "j3_screen_text_of_chunks",
    "WITH " + v.TIMELINE + "," + v.OCR + """,
c AS (SELECT recording_id, timestamp_ms//86400000 AS chunk_idx, min(timestamp_ms) - 7200000 AS f, max(timestamp_ms + seq%7*60000) + 7200000 AS t FROM v_timeline GROUP BY ALL),
d AS (SELECT recording_id, timestamp_ms, trim(text) AS k, min(seq) AS seq FROM v_ocr GROUP BY ALL)
SELECT c.recording_id, c.chunk_idx, d.timestamp_ms, d.seq FROM c JOIN d ON d.recording_id = c.recording_id AND d.timestamp_ms BETWEEN c.f AND c.t""",
)
def screen_of_chunks(spark, folder):
    rows = evidence.screen_text_of_chunks(_chunked_timeline(spark, folder), v.ocr(spark, folder), 7_200_000)
    return rows.select("recording_id", "chunk_idx", "timestamp_ms", "seq")


def _probes(spark, folder):
    """A moment of play per turn, some before the first block."""
    return v.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("probe"),
        (F.col("turn") * 2711 + F.length("text") * 3 % 5000 - 500).alias("time_ms"),
    )


PROBES = """
v_probes AS (SELECT conv_id AS recording_id, turn AS probe, turn*2711 + length(text)*3%5000 - 500 AS time_ms FROM conversations)"""


@check(
    "j5_active_block",
    "WITH " + BLOCKS + "," + PROBES + """,
a AS (SELECT p.recording_id, p.probe, p.time_ms, b.block_idx FROM v_probes p ASOF LEFT JOIN
  (SELECT recording_id, start_ms, max(block_idx) AS block_idx FROM v_blocks GROUP BY ALL) b ON p.recording_id = b.recording_id AND p.time_ms >= b.start_ms)
SELECT recording_id, probe, time_ms, coalesce(block_idx, -1) AS block_idx FROM a""",
)
def active_block(spark, folder):
    size = ordered.SLICE_MS
    return evidence.active_block(_probes(spark, folder), _blocks(spark, folder), size).select("recording_id", "probe", "time_ms", "block_idx")


@check(
    "j6_active_sentences",
    "WITH " + v.ENTRIES + "," + PROBES + """
SELECT p.recording_id, p.probe, e.seq FROM v_probes p JOIN v_entries e ON e.recording_id = p.recording_id
AND p.time_ms >= e.timestamp_ms AND p.time_ms < CASE WHEN e.end_ms = 0 THEN e.timestamp_ms + 5000 ELSE e.end_ms END""",
)
def active_sentences(spark, folder):
    return evidence.active_sentences(_probes(spark, folder), _entries(spark, folder)).select("recording_id", "probe", "seq")


@check(
    "j6_active_blocks",
    "WITH " + BLOCKS + "," + PROBES + """
SELECT p.recording_id, p.probe, b.block_idx FROM v_probes p JOIN v_blocks b ON b.recording_id = p.recording_id AND p.time_ms BETWEEN b.start_ms AND b.end_ms + 5000""",
)
def active_blocks(spark, folder):
    return evidence.active_blocks(_probes(spark, folder), _blocks(spark, folder)).select("recording_id", "probe", "block_idx")


def names(spark, folder):
    return v.table(spark, folder, "conversations").select(F.col("conv_id").alias("recording_id")).distinct().where("recording_id % 3 <> 0").select(
        "recording_id", F.lit("Speaker 2").alias("speaker"), F.format_string("Guest %d", "recording_id").alias("name")
    )


@check(
    "j9_speaker_rename",
    "WITH " + v.ENTRIES + """
SELECT recording_id, seq, CASE WHEN recording_id%3<>0 AND speaker='Speaker 2' THEN concat('Guest ', recording_id) ELSE speaker END AS speaker FROM v_entries""",
)
def rename(spark, folder):
    return evidence.rename_speakers(_entries(spark, folder), names(spark, folder)).select("recording_id", "seq", "speaker")


@check(
    "j13_correction_overlay",
    "WITH " + v.SEGMENTS + """
SELECT recording_id, seg_idx, CASE WHEN seg_idx%2=0 THEN concat(text, '!') ELSE text END AS text_corrected FROM v_segments""",
)
def overlay(spark, folder):
    s = v.segments(spark, folder, v.SLICE)
    fixes = s.where("seg_idx % 2 = 0").select("recording_id", "seg_idx", F.concat("text", F.lit("!")).alias("text"))
    return segments.overlay_corrections(s, fixes).select("recording_id", "seg_idx", "text_corrected")


@check(
    "j15_audit_work_list",
    "WITH " + v.ENTRIES + """,
c AS (SELECT DISTINCT recording_id, chunk_idx, recording_id%2 AS sheet_id FROM v_entries),
g AS (SELECT DISTINCT doc_id%2 AS sheet_id, CASE doc_id%3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'ocr' ELSE 'mixed' END AS group_name FROM documents),
o AS (SELECT DISTINCT user_id AS recording_id FROM events WHERE user_id%4<>0)
SELECT c.recording_id, c.chunk_idx, c.sheet_id, g.group_name, o.recording_id IS NOT NULL AND g.group_name <> 'transcript' AS with_ocr
FROM c JOIN g USING (sheet_id) LEFT JOIN o ON o.recording_id = c.recording_id WHERE g.group_name <> 'ocr' OR o.recording_id IS NOT NULL""",
)
def work_list(spark, folder):
    chunks = _entries(spark, folder).select("recording_id", "chunk_idx").distinct().withColumn("sheet_id", F.col("recording_id") % 2)
    groups = v.table(spark, folder, "documents").select(
        (F.col("doc_id") % 2).alias("sheet_id"),
        F.expr("CASE doc_id%3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'ocr' ELSE 'mixed' END").alias("group_name"),
    ).distinct()
    return exchanges.audit_work(chunks, groups, v.ocr_like(spark, folder))
