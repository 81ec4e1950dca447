"""Sources and sinks (SRC, SNK, J12 J14, O3, P16)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as v
from checks.joins import names
from checks.registry import check
from talkledger.operators import ordered, rules
from talkledger.session import new_folder, shared_folder
from talkledger.sources import files, readers, writers


@check(
    "src1_sheet_rows",
    r"""WITH l AS (SELECT doc_id AS sheet_id, unnest(string_split(replace(replace(text,'"',''),chr(13),''), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text,'"',''),chr(13),''), chr(10)), 1) AS i FROM documents)
SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY i) - 1 AS row_idx, len(string_split(line, ',')) AS n_cells, array_to_string(string_split(line, ','), '|') AS cells FROM l WHERE line <> ''""",
)
def sheet_rows(spark, folder):
    plain = F.replace(F.replace("text", F.lit('"'), F.lit("")), F.lit("\r"), F.lit(""))
    files = v.table(spark, folder, "documents").select(F.col("doc_id").alias("sheet_id"), F.encode(plain, "UTF-8").alias("content"))
    return readers.sheet_rows(files).select(
        "sheet_id", "row_idx", F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", "|").alias("cells")
    )


HEADERS = ("ou la", "the of", "license")
STOP = "7 Die"
ACCEPTED = v.SHEET_LINES + r""",
a AS (SELECT sheet_id, row_idx, cells, regexp_replace(cells[1], '^\s+|\s+$', '', 'g') AS a FROM sheet_lines),
lv AS (SELECT * FROM a WHERE a <> '' AND NOT contains(a, 'ou la') AND NOT contains(a, 'the of') AND NOT contains(a, 'license')),
st AS (SELECT sheet_id, min(row_idx) AS stop FROM lv WHERE starts_with(a, '7 Die') GROUP BY 1),
ac AS (SELECT lv.*, row_number() OVER (PARTITION BY lv.sheet_id ORDER BY row_idx) AS rule_no FROM lv LEFT JOIN st USING (sheet_id) WHERE stop IS NULL OR row_idx < stop),
v_rules AS (SELECT sheet_id, rule_no, cells, CAST(CASE WHEN regexp_matches(a, '(?s)^[0-9]+\s*.') THEN CAST(regexp_extract(a, '(?s)^([0-9]+)\s*(.+)', 1) AS BIGINT) ELSE rule_no END AS BIGINT) AS rule_id,
  CASE WHEN regexp_matches(a, '(?s)^[0-9]+\s*.') THEN regexp_replace(regexp_extract(a, '(?s)^([0-9]+)\s*(.+)', 2), '^\s+|\s+$', '', 'g') ELSE a END AS content FROM ac)"""


@check("src2_sheet_rules", "WITH " + ACCEPTED + " SELECT sheet_id, rule_no, rule_id, content FROM v_rules")
def sheet_rules(spark, folder):
    return rules.sheet_rules(v.sheet_lines(spark, folder), HEADERS, STOP, v.SLICE).withColumn(
        "rule_no", F.col("rule_no").cast("long")
    )


EXAMPLES = ACCEPTED + r""",
cx AS (SELECT sheet_id, rule_no, rule_id, content, unnest(cells[2:]) AS cell, generate_subscripts(cells[2:], 1) - 1 AS cell_no FROM v_rules WHERE len(cells) > 1),
v_examples AS (SELECT sheet_id, rule_no, cell_no, concat('规则', rule_id, '(', substring(content, 1, 20), '...): ', regexp_replace(cell, '^\s+|\s+$', '', 'g')) AS example FROM cx
  WHERE regexp_replace(cell, '^\s+|\s+$', '', 'g') NOT IN ('合格', '不涉及', 'None', ''))"""


@check("src2_sheet_examples", "WITH " + EXAMPLES + " SELECT * FROM v_examples")
def sheet_examples(spark, folder):
    rows = rules.sheet_examples(v.sheet_lines(spark, folder), HEADERS, STOP, slice_rows=v.SLICE)
    return rows.select("sheet_id", F.col("rule_no").cast("long"), F.col("cell_no").cast("long"), "example")


@check(
    "o3_first_examples",
    "WITH " + EXAMPLES + """,
f AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY rule_no, cell_no) AS r FROM v_examples)
SELECT sheet_id, string_agg(example, '|' ORDER BY r) AS examples FROM f WHERE r <= 5 GROUP BY sheet_id""",
)
def first_examples(spark, folder):
    rows = rules.sheet_examples(v.sheet_lines(spark, folder), HEADERS, STOP, slice_rows=v.SLICE)
    return rules.first_examples(rows).select("sheet_id", F.array_join("examples", "|").alias("examples"))


def _transcript_files(spark, folder):
    e = v.entries(spark, folder, v.SLICE)
    item = F.struct("timestamp", "timestamp_ms", "end_ms", "speaker", "text", "text_corrected")
    listed = e.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("_l"))
    body = F.to_json(F.struct(F.transform("_l", lambda x: x["item"]).alias("transcript"), F.lit(1.5).alias("processing_time_ms")))
    broken = F.col("recording_id") % 5 == 0
    return listed.select(
        "recording_id", F.encode(F.when(broken, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body), "UTF-8").alias("content")
    )


@check(
    "src3_artifact_json",
    "WITH " + v.ENTRIES + """ SELECT recording_id, seq, "timestamp", timestamp_ms, end_ms, speaker, text, text_corrected FROM v_entries WHERE recording_id%5<>0""",
)
def artifact_json(spark, folder):
    return readers.entries_of(readers.read_artifacts(_transcript_files(spark, folder), "transcript.json"))


def _hotword_lines(spark, folder):
    line = F.expr(
        "CASE event_id%6 WHEN 0 THEN concat('# ', event_type) WHEN 1 THEN '  ' WHEN 2 THEN concat(' ', event_type, ' -> ', props, '->x ') "
        "WHEN 3 THEN upper(event_type) WHEN 4 THEN concat('->', event_type) ELSE concat(event_type, event_id % 10) END"
    )
    return v.table(spark, folder, "events").select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))


HOTWORDS = """
hl AS (SELECT user_id, event_id AS line_no, CASE event_id%6 WHEN 2 THEN event_type WHEN 3 THEN upper(event_type) ELSE concat(event_type, event_id % 10) END AS wrong,
  CASE event_id%6 WHEN 2 THEN concat(props, '->x') WHEN 3 THEN upper(event_type) ELSE concat(event_type, event_id % 10) END AS "right",
  CASE event_id%6 WHEN 2 THEN 'mapping' ELSE 'protected' END AS kind FROM events WHERE event_id%6 IN (2, 3, 5))"""


@check(
    "src4_hotword_dictionary",
    "WITH " + HOTWORDS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(wrong) ORDER BY line_no DESC) AS n FROM hl)
SELECT user_id, wrong, "right", kind, line_no FROM r WHERE n = 1""",
)
def hotword_dictionary(spark, folder):
    return readers.hotwords(_hotword_lines(spark, folder), ["user_id"])


@check("src5_hotword_list", "WITH " + HOTWORDS + """ SELECT user_id, line_no, "right" AS word FROM hl""")
def hotword_list(spark, folder):
    return readers.hotword_list(_hotword_lines(spark, folder), ["user_id"])


@check(
    "src5_request_hotwords",
    """SELECT event_id, CASE event_id%6 WHEN 0 THEN concat('a|b|', event_type, '|x') WHEN 1 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'a|b' END AS words,
  CASE event_id%6 WHEN 1 THEN 'not an array of strings' WHEN 4 THEN 'not valid JSON' WHEN 5 THEN 'not an array of strings' END AS reject_reason FROM events""",
)
def request_hotwords(spark, folder):
    given = F.expr(
        "CASE event_id%6 WHEN 0 THEN concat('[\"', event_type, '\",\"x\"]') WHEN 1 THEN props WHEN 2 THEN '[]' WHEN 3 THEN '' WHEN 4 THEN '[oops' "
        "ELSE concat('[\"', event_type, '\", 1]') END"
    )
    requests = v.table(spark, folder, "events").select("event_id", given.alias("hotwords"))
    return readers.request_hotwords(requests, ("a", "b")).select("event_id", F.array_join("words", "|").alias("words"), "reject_reason")


@check(
    "src6_media_inventory",
    "SELECT concat('/m/', page_id, CASE page_id%3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.wav' ELSE '' END) AS path, sha256(html) AS content_hash, CASE page_id%3 WHEN 0 THEN 'video' ELSE 'audio' END AS media_type FROM pages",
)
def media_inventory(spark, folder):
    files = v.table(spark, folder, "pages").select(
        F.expr("concat('/m/', page_id, CASE page_id%3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.wav' ELSE '' END)").alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return readers.media_inventory(files)


def _paths(spark, folder):
    file = F.expr(
        "CASE WHEN event_id%97=0 THEN 'transcript.json' WHEN event_id%89=0 THEN 'evaluation.json' WHEN event_id%83=0 THEN 'compliance.json' "
        "WHEN event_id%79=0 THEN 'video.mp4' WHEN event_id%73=0 THEN 'audio.wav' WHEN event_id%71=0 THEN 'ocr_results.json' "
        "WHEN event_id%67=0 THEN 'visual_events.json' ELSE concat('frames/', event_id, '.jpg') END"
    )
    return v.table(spark, folder, "events").select(F.col("user_id").alias("recording_id"), file.alias("file"))


PATHS = """
fp AS (SELECT user_id AS recording_id, CASE WHEN event_id%97=0 THEN 'transcript.json' WHEN event_id%89=0 THEN 'evaluation.json' WHEN event_id%83=0 THEN 'compliance.json'
  WHEN event_id%79=0 THEN 'video.mp4' WHEN event_id%73=0 THEN 'audio.wav' WHEN event_id%71=0 THEN 'ocr_results.json'
  WHEN event_id%67=0 THEN 'visual_events.json' ELSE concat('frames/', event_id, '.jpg') END AS file FROM events),
v_inv AS (SELECT recording_id, bool_or(file='transcript.json') AS has_transcript, bool_or(file='evaluation.json') AS has_evaluation, bool_or(file='compliance.json') AS has_compliance,
  bool_or(file='ocr_results.json') AS has_ocr_results, bool_or(file='visual_events.json') AS has_visual_events, bool_or(file='video.mp4') AS has_video,
  count(*) FILTER (starts_with(file, 'frames/')) AS keyframe_count,
  coalesce(max(file) FILTER (file='audio.wav'), CASE WHEN recording_id%4=0 THEN concat('/old/', recording_id, '.mp3') END) AS audio_path,
  coalesce(max(file) FILTER (file='video.mp4'), max(file) FILTER (file='audio.wav'), CASE WHEN recording_id%4=0 THEN concat('/old/', recording_id, '.mp3') END) AS media_path
  FROM fp WHERE recording_id%7<>0 GROUP BY recording_id)"""


def _inventory(spark, folder):
    ids = v.table(spark, folder, "events").select(F.col("user_id").alias("recording_id")).distinct()
    legacy = ids.where("recording_id % 4 = 0").withColumn("path", F.format_string("/old/%d.mp3", "recording_id"))
    return readers.artifact_inventory(_paths(spark, folder), ids.where("recording_id % 7 <> 0"), legacy)


@check("src7_artifact_inventory", "WITH " + PATHS + " SELECT * FROM v_inv")
def inventory(spark, folder):
    return _inventory(spark, folder)


@check("src7_restorable_recordings", "WITH " + PATHS + " SELECT recording_id FROM v_inv WHERE has_transcript AND recording_id%5<>0 AND recording_id IN (SELECT conv_id FROM conversations)")
def restorable(spark, folder):
    read = readers.read_artifacts(_transcript_files(spark, folder), "transcript.json")
    return readers.restorable(_inventory(spark, folder), read).select("recording_id")


@check(
    "j14_task_results",
    "WITH " + PATHS + """,
tr AS (SELECT conv_id AS recording_id, count(*) AS n_entries FROM conversations WHERE conv_id%5<>0 GROUP BY 1),
oc AS (SELECT user_id AS recording_id, count(*) AS n FROM events GROUP BY 1),
ve AS (SELECT user_id AS recording_id, count(*) AS n FROM events GROUP BY 1)
SELECT i.recording_id, n_entries, audio_path IS NOT NULL AS has_audio, has_video, keyframe_count, coalesce(oc.n, 0) AS ocr_text_count, coalesce(ve.n, 0) AS visual_event_count
FROM v_inv i LEFT JOIN tr USING (recording_id) LEFT JOIN oc ON oc.recording_id = i.recording_id LEFT JOIN ve ON ve.recording_id = i.recording_id""",
)
def results(spark, folder):
    read = readers.read_artifacts(_transcript_files(spark, folder), "transcript.json")
    e = v.table(spark, folder, "events").withColumnRenamed("user_id", "recording_id")
    rows = writers.task_results(
        _inventory(spark, folder), {"transcript": read}, e, e
    )
    n = F.size("transcript.transcript").cast("long")
    return rows.select(
        "recording_id", F.when(n >= 0, n).alias("n_entries"), "has_audio", "has_video", "keyframe_count", "ocr_text_count", "visual_event_count"
    )


def _uploads(spark, folder):
    d = v.table(spark, folder, "documents").select(F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("content_hash"))
    index = d.where("upload_id % 3 = 0").groupBy("content_hash").agg(F.min("upload_id").alias("recording_id"))
    return d, index, d.where("upload_id % 2 = 0").select(F.col("upload_id").alias("recording_id"))


UPLOADS = """
up AS (SELECT doc_id AS upload_id, sha256(text) AS content_hash FROM documents),
ix AS (SELECT content_hash, min(upload_id) AS recording_id FROM up WHERE upload_id%3=0 GROUP BY 1)"""


@check(
    "j12_u3_ingest_dedup",
    "WITH " + UPLOADS + """
SELECT upload_id, up.content_hash, CASE WHEN recording_id%2=0 THEN recording_id END AS existing_id,
  CASE WHEN recording_id%2=0 THEN 'existing' WHEN upload_id <> min(upload_id) OVER (PARTITION BY up.content_hash) THEN 'repeat' WHEN recording_id IS NOT NULL THEN 'stale' ELSE 'new' END AS decision
FROM up LEFT JOIN ix USING (content_hash)""",
)
def ingest(spark, folder):
    return readers.ingest_decisions(*_uploads(spark, folder))


@check("u3_stale_index_entries", "WITH " + UPLOADS + " SELECT content_hash, recording_id FROM ix WHERE recording_id%2<>0")
def stale(spark, folder):
    _, index, done = _uploads(spark, folder)
    return readers.stale_index(index, done)


@check(
    "p16_input_validation",
    """SELECT event_id, CASE event_id%7 WHEN 0 THEN 'transcript is empty' WHEN 1 THEN 'transcript is not a JSON array' WHEN 2 THEN 'transcript is not valid JSON' WHEN 4 THEN 'text is blank' WHEN 6 THEN 'not an array of strings' END AS reject_reason FROM events""",
)
def validation(spark, folder):
    k = F.col("event_id") % 7
    raw = v.table(spark, folder, "events").select(
        "event_id",
        F.when(k <= 3, "audit").when(k <= 5, "evaluation").otherwise("transcript").alias("request_kind"),
        F.when(k == 0, "[]").when(k == 1, F.col("props")).when(k == 2, "[{").when(k == 3, F.concat(F.lit("["), "props", F.lit("]"))).alias("transcript"),
        F.when(k == 4, " \n ").otherwise(F.col("event_type")).alias("text"),
        F.when(k == 6, F.lit("[1]")).alias("hotwords"),
    )
    return readers.checked_inputs(raw).select("event_id", "reject_reason")


@check(
    "snk1_run_artifacts",
    "WITH " + v.ENTRIES + """ SELECT recording_id, seq, CASE WHEN recording_id%3=0 THEN 'second' ELSE 'first' END AS version FROM v_entries WHERE recording_id%3<>0 OR seq > 0""",
)
def run_artifacts(spark, folder):
    e = v.entries(spark, folder, v.SLICE).select("recording_id", "seq")
    path = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    writers.write_artifacts(e.withColumn("version", F.lit("first")), path, 9)
    covered = e.where("recording_id % 3 = 0")
    again = covered.where("seq > 0").withColumn("version", F.lit("second"))
    for _ in range(2):  # writing a run twice changes nothing
        writers.write_artifacts(again, path, 10, covered)
    return writers.read_written(spark, path)


@check(
    "snk2_subtitle_cues",
    "WITH " + v.ENTRIES + """,
c AS (SELECT *, row_number() OVER w AS cue, CASE WHEN end_ms <> 0 THEN end_ms ELSE coalesce(lead(timestamp_ms) OVER w, timestamp_ms + 5000) END AS e FROM v_entries WINDOW w AS (PARTITION BY recording_id ORDER BY seq))
SELECT recording_id, cue, concat(cue, chr(10), printf('%02d:%02d:%02d,%03d', timestamp_ms//3600000, (timestamp_ms//60000)%60, (timestamp_ms//1000)%60, timestamp_ms%1000), ' --> ',
  printf('%02d:%02d:%02d,%03d', e//3600000, (e//60000)%60, (e//1000)%60, e%1000), chr(10), speaker, ': ', text_corrected, chr(10)) AS block FROM c""",
)
def cues(spark, folder):
    n = v.SLICE
    return writers.subtitle_cues(v.entries(spark, folder, n), rows=n).withColumn("cue", F.col("cue").cast("long"))


@check(
    "snk2_subtitle_files",
    "WITH " + v.ENTRIES + """,
c AS (SELECT *, row_number() OVER w AS cue, CASE WHEN end_ms <> 0 THEN end_ms ELSE coalesce(lead(timestamp_ms) OVER w, timestamp_ms + 5000) END AS e FROM v_entries WINDOW w AS (PARTITION BY recording_id ORDER BY seq))
SELECT recording_id, string_agg(concat(cue, chr(10), printf('%02d:%02d:%02d,%03d', timestamp_ms//3600000, (timestamp_ms//60000)%60, (timestamp_ms//1000)%60, timestamp_ms%1000), ' --> ',
  printf('%02d:%02d:%02d,%03d', e//3600000, (e//60000)%60, (e//1000)%60, e%1000), chr(10), speaker, ': ', text, chr(10)), chr(10) ORDER BY cue) AS srt FROM c GROUP BY recording_id""",
)
def subtitle_files(spark, folder):
    # always in slices, the form long recordings take
    return writers.subtitle_files(v.entries(spark, folder, 3), False, 3)


@check(
    "snk3_document_blocks",
    "WITH " + v.ENTRIES + """,
op AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL THEN 0 WHEN lag(speaker) OVER w <> speaker
    OR timestamp_ms - lag(CASE WHEN end_ms = 0 THEN timestamp_ms ELSE end_ms END) OVER w >= 30000 THEN 1 ELSE 0 END AS opens
  FROM v_entries WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
b AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY seq) AS BIGINT) AS block_idx FROM op),
g AS (SELECT recording_id, block_idx, arg_min(speaker, seq) AS speaker, min(timestamp_ms) AS t, string_agg(text_corrected, '' ORDER BY seq) AS text FROM b GROUP BY ALL)
SELECT recording_id, block_idx, CASE WHEN recording_id%3<>0 AND speaker='Speaker 2' THEN concat('Guest ', recording_id) ELSE speaker END AS speaker,
  CASE WHEN t >= 3600000 THEN printf('%02d:%02d:%02d', t//3600000, (t//60000)%60, (t//1000)%60) ELSE printf('%02d:%02d', t//60000, (t//1000)%60) END AS time, text FROM g""",
)
def documents(spark, folder):
    n = v.SLICE
    return writers.document_blocks(v.entries(spark, folder, n), names(spark, folder), rows=n)


@check(
    "snk4_invalidated_results",
    """SELECT 'evaluation' AS kind, doc_id AS recording_id FROM documents WHERE doc_id%4<>0 UNION ALL SELECT 'compliance', doc_id FROM documents WHERE doc_id%4<>0
UNION ALL SELECT 'compliance after evaluation only', doc_id FROM documents""",
)
def invalidated(spark, folder):
    d = v.table(spark, folder, "documents").select(F.col("doc_id").alias("recording_id"))
    rerun = d.where("recording_id % 4 = 0")
    left, kept = writers.invalidated(d, d, rerun)
    _, all_kept = writers.invalidated(d, d, rerun, evaluation_only=True)
    return (
        left.withColumn("kind", F.lit("evaluation"))
        .unionByName(kept.withColumn("kind", F.lit("compliance")))
        .unionByName(all_kept.withColumn("kind", F.lit("compliance after evaluation only")))
    )


CUES = v.ENTRIES + """,
c AS (SELECT *, row_number() OVER w AS cue, CASE WHEN end_ms <> 0 THEN end_ms ELSE coalesce(lead(timestamp_ms) OVER w, timestamp_ms + 5000) END AS e FROM v_entries WINDOW w AS (PARTITION BY recording_id ORDER BY seq))"""


@check(
    "snk2_written_subtitles",
    "WITH " + CUES + """
SELECT CAST(recording_id AS VARCHAR) AS recording_id, string_agg(concat(cue, chr(10), printf('%02d:%02d:%02d,%03d', timestamp_ms//3600000, (timestamp_ms//60000)%60, (timestamp_ms//1000)%60, timestamp_ms%1000), ' --> ',
  printf('%02d:%02d:%02d,%03d', e//3600000, (e//60000)%60, (e//1000)%60, e%1000), chr(10), speaker, ': ', text_corrected, chr(10)), chr(10) ORDER BY cue) AS srt FROM c GROUP BY recording_id""",
)
def written_subtitles(spark, folder):
    root = new_folder(spark, "subtitles")
    files.write_subtitles(v.entries(spark, folder, v.SLICE), root)
    return readers.artifact_files(spark, root, "subtitles.srt").select("recording_id", F.col("content").cast("string").alias("srt"))


@check(
    "snk1_written_transcripts",
    "WITH " + v.ENTRIES + """ SELECT CAST(recording_id AS VARCHAR) AS recording_id, seq, "timestamp", timestamp_ms, end_ms, speaker, text, text_corrected FROM v_entries""",
)
def written_transcripts(spark, folder):
    """JSON files of all recordings, half of them written twice, read back as artifacts."""
    root = new_folder(spark, "transcripts")
    e = v.entries(spark, folder, v.SLICE)
    files.write_transcripts(e.where("recording_id % 2 = 0").withColumn("text", F.lit("first")), root)
    files.write_transcripts(e, root)
    return readers.entries_of(readers.read_artifacts(readers.artifact_files(spark, root, "transcript.json"), "transcript.json"))


@check(
    "src7_incremental_inventory",
    """SELECT CAST(conv_id AS VARCHAR) AS recording_id, true AS has_transcript, conv_id%3=0 AS has_video, CAST(count(*) FILTER (conv_id%3=0) AS BIGINT) AS keyframe_count, min(CASE WHEN conv_id%3=0 THEN 'video.mp4' END) AS media_path
FROM conversations GROUP BY conv_id""",
)
def incremental_inventory(spark, folder):
    """Files that come in two steps; each run takes in the new ones alone."""
    base = new_folder(spark, "inventory")
    root = f"{base}/files"
    e = v.entries(spark, folder, v.SLICE)
    one = e.groupBy("recording_id").agg(F.lit(0).cast("long").alias("place"), F.lit("{}").alias("part"))
    frames = e.where("recording_id % 3 = 0").select(F.format_string("%d/frames/%04d.jpg", "recording_id", "seq").alias("_to"))
    files.write_transcripts(e, root)
    files.write_files(one, root, "meta.json")
    files.take_in_paths(spark, root, f"{base}/table", f"{base}/checkpoint")
    files.write_files(one.where("recording_id % 3 = 0"), root, "video.mp4")
    shown = frames.select(F.col("_to").alias("recording_id"), F.lit(0).alias("place"), F.lit("f").alias("part"))
    files.write_files(shown, root, "frame")
    files.take_in_paths(spark, root, f"{base}/table", f"{base}/checkpoint")
    # a frame of a recording was written as a recording of its own: its name has the slashes quoted
    table = files.taken_in(spark, f"{base}/table")
    name = F.replace("recording_id", F.lit("%2F"), F.lit("/"))
    moved = table.withColumn("file", F.when(F.col("file") == "frame", F.regexp_replace(name, "^[^/]*/", "")).otherwise(F.col("file")))
    moved = moved.withColumn("recording_id", F.split_part(name, F.lit("/"), F.lit(1)))
    metas = readers.read_artifacts(readers.artifact_files(spark, root, "meta.json"), "meta.json").where("NOT corrupt")
    found = readers.artifact_inventory(moved, metas)
    return found.select("recording_id", "has_transcript", "has_video", "keyframe_count", "media_path")
