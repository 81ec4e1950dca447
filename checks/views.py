"""Transcript-shaped views over the given tables, in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger.functions import times
from talkledger.operators import ordered as o

START_MS = 1_704_067_200_000
SLICE = o.SLICE_ROWS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments(spark: SparkSession, folder: str, size: int = o.SLICE_ROWS) -> DataFrame:
    """Turns of a conversation as segments of a recording."""
    x = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("seg_idx"),
        F.expr("CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END").alias("speaker"),
        "text",
        (F.length("text") * 5).cast("long").alias("_dur"),
        ((F.col("conv_id") * 31 + F.col("turn") * 17) % 3000).alias("_gap"),
        (((F.col("conv_id") * 7 + F.col("turn") * 13) % 100).cast("double") / 100).alias("confidence"),
    )
    x = o.scan(x, ["recording_id"], "seg_idx", {"end_ms": o.running(F.col("_dur") + F.col("_gap"))}, size)
    return x.select(
        "recording_id", "seg_idx", "speaker", "text", "confidence",
        (F.col("end_ms") - F.col("_dur")).alias("start_ms"), "end_ms",
    )


SEGMENTS = """
seg_x AS (SELECT conv_id AS recording_id, turn AS seg_idx,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker, text,
  CAST(length(text)*5 AS BIGINT) AS dur_ms, CAST((conv_id*31+turn*17)%3000 AS BIGINT) AS gap_ms,
  CAST((conv_id*7+turn*13)%100 AS DOUBLE)/100 AS confidence FROM conversations),
v_segments AS (SELECT recording_id, seg_idx, speaker, text, confidence,
  CAST(SUM(dur_ms+gap_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS BIGINT) - dur_ms AS start_ms,
  CAST(SUM(dur_ms+gap_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS BIGINT) AS end_ms FROM seg_x)"""


def entries(spark: SparkSession, folder: str, size: int = o.SLICE_ROWS) -> DataFrame:
    """Every segment as a transcript entry; some without an end."""
    s = segments(spark, folder, size)
    return s.select(
        "recording_id",
        F.col("seg_idx").alias("seq"),
        times.minutes_seconds(F.col("start_ms")).alias("timestamp"),
        F.col("start_ms").alias("timestamp_ms"),
        F.when((F.col("recording_id") + F.col("seg_idx")) % 7 == 0, 0).otherwise(F.col("end_ms")).alias("end_ms"),
        times.speaker_label(F.col("speaker")).alias("speaker"),
        "text",
        F.replace("text", F.lit("en"), F.lit("EN")).alias("text_corrected"),
        (F.col("seg_idx") / 3).cast("long").alias("chunk_idx"),
    )


ENTRIES = SEGMENTS + """,
v_entries AS (SELECT recording_id, seg_idx AS seq,
  printf('%02d:%02d', start_ms//60000, (start_ms//1000)%60) AS "timestamp", start_ms AS timestamp_ms,
  CASE WHEN (recording_id+seg_idx)%7=0 THEN 0 ELSE end_ms END AS end_ms,
  concat('Speaker ', speaker+1) AS speaker, text, replace(text,'en','EN') AS text_corrected,
  seg_idx//3 AS chunk_idx FROM v_segments)"""


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("recording_id"),
        F.col("event_id").alias("seq"),
        (F.unix_millis(F.col("ts").cast("timestamp")) - START_MS).alias("timestamp_ms"),
        "event_type", "value", "props",
    )


TIMELINE = f"""
v_timeline AS (SELECT user_id AS recording_id, event_id AS seq,
  epoch_us(ts)//1000 - {START_MS} AS timestamp_ms, event_type, value, props FROM events)"""


#: Every third recording is audited against two sheets.
SHEET_OF_FINDING = "CASE WHEN recording_id % 3 = 0 AND seq % 4 = 2 THEN 2 ELSE 1 END"


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Findings: every other event (the others are screen text, see ``ocr``)."""
    none = F.lit(None).cast("string")
    return timeline(spark, folder).where("seq % 2 = 0").select(
        "recording_id", "seq", "timestamp_ms",
        F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
               "WHEN 'signup' THEN 4 ELSE 5 END").cast("long").alias("rule_id"),
        (F.col("value") / 500).alias("confidence"),
        F.expr("CASE seq%3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias("severity"),
        F.expr("CASE WHEN seq%5=0 THEN 'ocr' ELSE 'transcript' END").alias("source"),
        F.lit("pending").alias("status"),
        F.col("props").alias("original_text"),
        F.concat(F.lit("Saw "), F.col("event_type")).alias("reason"),
        F.concat(F.lit("Rule "), F.col("event_type")).alias("rule_content"),
        F.expr("CASE WHEN seq%14=0 THEN timestamp_ms+seq ELSE 0 END").alias("end_ms"),
        F.expr("CASE WHEN seq%22=0 THEN 'seen before' END").alias("evidence_text"),
        none.alias("evidence_url"),
        F.expr(SHEET_OF_FINDING).cast("long").alias("sheet_id"),
    )


VIOLATIONS = TIMELINE + f""",
v_violations AS (SELECT recording_id, seq, timestamp_ms,
  CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
    WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS rule_id,
  value/500 AS confidence, CASE seq%3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN seq%5=0 THEN 'ocr' ELSE 'transcript' END AS source, 'pending' AS status, props AS original_text,
  concat('Saw ', event_type) AS reason, concat('Rule ', event_type) AS rule_content,
  CASE WHEN seq%14=0 THEN timestamp_ms+seq ELSE 0 END AS end_ms,
  CASE WHEN seq%22=0 THEN 'seen before' END AS evidence_text, CAST({SHEET_OF_FINDING} AS BIGINT) AS sheet_id
FROM v_timeline WHERE seq%2=0)"""


def ocr(spark: SparkSession, folder: str) -> DataFrame:
    return timeline(spark, folder).where("seq % 2 = 1").select(
        "recording_id", "seq", "timestamp_ms",
        F.concat("event_type", F.lit(" "), "props").alias("text"),
        (F.col("value") / 500).alias("confidence"),
        F.concat(F.lit("/frames/"), F.col("seq").cast("string"), F.lit(".jpg")).alias("frame_path"),
    )


OCR = """
v_ocr AS (SELECT recording_id, seq, timestamp_ms, concat(event_type,' ',props) AS text, value/500 AS confidence,
  concat('/frames/',CAST(seq AS VARCHAR),'.jpg') AS frame_path FROM v_timeline WHERE seq%2=1)"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    seen = F.col("event_type").isin("click", "view", "signup")
    return timeline(spark, folder).select(
        "recording_id", "seq", "timestamp_ms",
        F.when(seen, 1 + F.col("seq") % 3).otherwise(0).cast("long").alias("face_count"),
        F.when(seen, F.col("value") / 500).otherwise(0.0).alias("max_confidence"),
        F.concat(F.col("seq").cast("string"), F.lit(".jpg")).alias("frame_path"),
    )


FRAMES = TIMELINE + """,
v_frames AS (SELECT recording_id, seq, timestamp_ms,
  CASE WHEN event_type IN ('click','view','signup') THEN 1+seq%3 ELSE 0 END AS face_count,
  CASE WHEN event_type IN ('click','view','signup') THEN value/500 ELSE 0 END AS max_confidence,
  concat(CAST(seq AS VARCHAR),'.jpg') AS frame_path FROM v_timeline)"""


def windows(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        (v % 20).alias("recording_id"), v.alias("win_idx"), (v % 100 - v % 20).alias("seg_key"),
        (v * 750).alias("start_ms"), (v * 750 + 1500).alias("end_ms"),
        F.col("label").cast("long").alias("label"), "embedding",
    )


WINDOWS = """
v_windows AS (SELECT vec_id%20 AS recording_id, vec_id AS win_idx, (vec_id%100 - vec_id%20) AS seg_key,
  vec_id*750 AS start_ms, vec_id*750+1500 AS end_ms, CAST(label AS BIGINT) AS label FROM embeddings)"""


def sheet_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document as the rows of a rule sheet."""
    plain = F.replace(F.replace("text", F.lit('"'), F.lit("")), F.lit("\r"), F.lit(""))
    return (
        table(spark, folder, "documents")
        .select(F.col("doc_id").alias("sheet_id"), F.posexplode(F.split(plain, "\n")).alias("row_idx", "_line"))
        .withColumn(
            "_line",
            F.expr("CASE row_idx % 3 WHEN 0 THEN concat(row_idx + 7, ' ', _line) "
                   "WHEN 1 THEN _line ELSE concat(row_idx, _line, ',None, x ,') END"),
        )
        .select("sheet_id", F.col("row_idx").cast("long"), F.split("_line", ",").alias("cells"))
    )


SHEET_LINES = r"""
doc_lines AS (SELECT doc_id AS sheet_id,
    unnest(string_split(replace(replace(text,'"',''),chr(13),''), chr(10))) AS line,
    generate_subscripts(string_split(replace(replace(text,'"',''),chr(13),''), chr(10)), 1) - 1 AS row_idx
  FROM documents),
sheet_lines AS (SELECT sheet_id, row_idx, string_split(CASE row_idx % 3 WHEN 0 THEN concat(row_idx + 7, ' ', line)
    WHEN 1 THEN line ELSE concat(row_idx, line, ',None, x ,') END, ',') AS cells FROM doc_lines)"""


def ocr_like(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings that have screen text."""
    return table(spark, folder, "events").select(F.col("user_id").alias("recording_id")).where("recording_id % 4 <> 0")
