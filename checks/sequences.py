"""Ordered operators over segments, windows, frames and texts (W, and A5 A6 A7 A11 A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import SQL, check
from talkledger.functions import text as t
from talkledger.functions import times
from talkledger.operators import chunks, ordered, segments, speakers, visual
from talkledger.session import cut_lineage, new_folder

# --- speaker turns ---------------------------------------------------------------

SMOOTHED = v.SEGMENTS + """,
nxt AS (SELECT *, lead(speaker) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS after_speaker FROM v_segments),
smoothed AS (
  SELECT recording_id, seg_idx, speaker, text, confidence, start_ms, end_ms FROM nxt WHERE seg_idx = 0
  UNION ALL
  SELECT n.recording_id, n.seg_idx,
    CASE WHEN n.speaker <> s.speaker AND n.after_speaker = s.speaker AND n.end_ms - n.start_ms < 1500
      THEN s.speaker ELSE n.speaker END, n.text, n.confidence, n.start_ms, n.end_ms
  FROM smoothed s JOIN nxt n ON n.recording_id = s.recording_id AND n.seg_idx = s.seg_idx + 1)"""


def merged_sql(source: str, gap: int) -> str:
    return f"""
flagged AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL THEN 0
    WHEN lag(speaker) OVER w <> speaker OR start_ms - lag(end_ms) OVER w >= {gap} THEN 1 ELSE 0 END AS opens
  FROM {source} WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx)),
runs AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS BIGINT) AS island FROM flagged),
v_merged AS (SELECT recording_id, island AS seg_idx, string_agg(text, '' ORDER BY seg_idx) AS text,
  arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms,
  CASE WHEN sum(length(text)) > 0 THEN sum(confidence*length(text))/sum(length(text))
    ELSE arg_min(confidence, seg_idx) END AS confidence,
  arg_min(speaker, seg_idx) AS speaker, list(text ORDER BY seg_idx) AS subs, count(*) AS n_subs
  FROM runs GROUP BY recording_id, island)"""


@check(
    "w1_w4_speaker_turn_counts",
    "WITH RECURSIVE " + SMOOTHED + "," + merged_sql("smoothed", 1000) + """
SELECT recording_id, concat('Speaker ', speaker + 1) AS speaker, count(*) AS n_turns,
  printf('%02d:%02d', min(start_ms)//60000, (min(start_ms)//1000)%60) AS first_at,
  CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM v_merged GROUP BY recording_id, speaker""",
)
def speaker_turn_counts(spark, folder):
    n = v.SLICE
    merged = segments.merge_segments(segments.smooth_speakers(v.segments(spark, folder, n), rows=n), 1000, n)
    return merged.groupBy("recording_id", times.speaker_label(F.col("speaker")).alias("speaker")).agg(
        F.count(F.lit(1)).alias("n_turns"),
        times.minutes_seconds(F.min("start_ms")).alias("first_at"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@check(
    "w1_segment_premerge",
    "WITH " + v.SEGMENTS + "," + merged_sql("v_segments", 1000) + """
SELECT recording_id, seg_idx, text, start_ms, end_ms, round(confidence, 6) AS confidence, speaker, n_subs FROM v_merged""",
)
def premerge(spark, folder):
    n = v.SLICE
    return segments.merge_segments(v.segments(spark, folder, n), 1000, n).select(
        "recording_id", "seg_idx", "text", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence"),
        "speaker", F.size("sub_sentences").cast("long").alias("n_subs"),
    )


BLOCKS = v.ENTRIES + """,
opened AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL THEN 0 WHEN lag(speaker) OVER w <> speaker
    OR timestamp_ms - lag(CASE WHEN end_ms = 0 THEN timestamp_ms ELSE end_ms END) OVER w >= 2000 THEN 1 ELSE 0 END AS opens
  FROM v_entries WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
v_blocked AS (SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY seq) AS BIGINT) AS block_idx FROM opened),
v_blocks AS (SELECT recording_id, block_idx, arg_min(speaker, seq) AS speaker, arg_min(timestamp_ms, seq) AS start_ms,
  arg_max(CASE WHEN end_ms = 0 THEN timestamp_ms ELSE end_ms END, seq) AS end_ms, count(*) AS n_sentences,
  string_agg(text_corrected, '' ORDER BY seq) AS text
  FROM v_blocked GROUP BY recording_id, block_idx)"""


@check(
    "w2_view_blocks",
    "WITH " + BLOCKS + """
SELECT recording_id, block_idx, speaker, start_ms, end_ms, n_sentences FROM v_blocks""",
)
def view_blocks(spark, folder):
    n = v.SLICE
    return segments.view_blocks(v.entries(spark, folder, n), 2000, n).withColumn(
        "n_sentences", F.size("sentences").cast("long")
    ).drop("sentences")


@check(
    "w3_entry_merge",
    "WITH RECURSIVE " + v.SEGMENTS + """,
e AS (SELECT recording_id, seg_idx AS seq, (seg_idx//3)%2 AS speaker, start_ms AS timestamp_ms, text FROM v_segments),
g AS (SELECT recording_id, seq, speaker, timestamp_ms AS anchor, 0 AS group_idx FROM e WHERE seq = 0
  UNION ALL SELECT e.recording_id, e.seq, e.speaker,
    CASE WHEN e.speaker = g.speaker AND e.timestamp_ms - g.anchor < 5000 THEN g.anchor ELSE e.timestamp_ms END,
    CASE WHEN e.speaker = g.speaker AND e.timestamp_ms - g.anchor < 5000 THEN g.group_idx ELSE g.group_idx + 1 END
  FROM g JOIN e ON e.recording_id = g.recording_id AND e.seq = g.seq + 1)
SELECT g.recording_id, CAST(group_idx AS BIGINT) AS group_idx, min(g.seq) AS seq, min(e.timestamp_ms) AS timestamp_ms,
  concat('Speaker ', min(g.speaker)+1) AS speaker, string_agg(e.text, '' ORDER BY e.seq) AS text
FROM g JOIN e ON e.recording_id = g.recording_id AND e.seq = g.seq GROUP BY g.recording_id, group_idx""",
)
def entry_merge(spark, folder):
    n = v.SLICE
    e = v.entries(spark, folder, n).withColumn(
        "speaker", times.speaker_label(F.col("chunk_idx") % 2)
    )
    return segments.merge_entries(e, 5000, n).select(
        "recording_id", "group_idx", "seq", "timestamp_ms", "speaker", "text"
    )


@check(
    "w4_speaker_smoothing",
    "WITH RECURSIVE " + SMOOTHED + " SELECT recording_id, seg_idx, speaker FROM smoothed",
)
def smoothing(spark, folder):
    n = v.SLICE
    return segments.smooth_speakers(v.segments(spark, folder, n), rows=n).select("recording_id", "seg_idx", "speaker")


PACKED = v.ENTRIES + """,
p AS (SELECT recording_id, seq, length(text_corrected) AS chars, 0 AS chunk FROM v_entries WHERE seq = 0
  UNION ALL SELECT e.recording_id, e.seq,
    CASE WHEN p.chars + length(e.text_corrected) > 900 THEN length(e.text_corrected) ELSE p.chars + length(e.text_corrected) END,
    CASE WHEN p.chars + length(e.text_corrected) > 900 THEN p.chunk + 1 ELSE p.chunk END
  FROM p JOIN v_entries e ON e.recording_id = p.recording_id AND e.seq = p.seq + 1)"""


@check(
    "w6_pack_by_chars",
    "WITH RECURSIVE " + PACKED + " SELECT recording_id, seq, CAST(chunk AS BIGINT) AS chunk_idx FROM p",
)
def pack(spark, folder):
    n = v.SLICE
    e = v.entries(spark, folder, n).drop("chunk_idx")
    return segments.pack_by_chars(e, "seq", "text_corrected", 900, rows=n).select("recording_id", "seq", "chunk_idx")


@check(
    "w7_batches_by_rows_and_chars",
    "WITH RECURSIVE " + v.ENTRIES + """,
b AS (SELECT recording_id, seq, length(text) AS chars, 1 AS n, 0 AS batch FROM v_entries WHERE seq = 0
  UNION ALL SELECT e.recording_id, e.seq,
    CASE WHEN b.chars > 800 OR length(e.text) > 800 OR b.n >= 3 OR b.chars + length(e.text) > 800 THEN length(e.text) ELSE b.chars + length(e.text) END,
    CASE WHEN b.chars > 800 OR length(e.text) > 800 OR b.n >= 3 OR b.chars + length(e.text) > 800 THEN 1 ELSE b.n + 1 END,
    CASE WHEN b.chars > 800 OR length(e.text) > 800 OR b.n >= 3 OR b.chars + length(e.text) > 800 THEN b.batch + 1 ELSE b.batch END
  FROM b JOIN v_entries e ON e.recording_id = b.recording_id AND e.seq = b.seq + 1)
SELECT recording_id, seq, CAST(batch AS BIGINT) AS batch_idx FROM b""",
)
def batches(spark, folder):
    n = v.SLICE
    return segments.batch_rows(v.entries(spark, folder, n), "seq", "text", max_rows=3, rows=n).select(
        "recording_id", "seq", "batch_idx"
    )


# --- frames ----------------------------------------------------------------------


@check(
    "w8_face_timeline",
    "WITH " + v.FRAMES + """,
s AS (SELECT *, face_count > 0 AS seen, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, seq) AS rn FROM v_frames),
f AS (SELECT *, CASE WHEN lag(seen) OVER (PARTITION BY recording_id ORDER BY rn) <> seen THEN 1 ELSE 0 END AS opens FROM s),
i AS (SELECT *, sum(opens) OVER (PARTITION BY recording_id ORDER BY rn) AS island FROM f),
e AS (SELECT recording_id, island, arg_min(seen, rn) AS seen, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS last_ms,
  max(max_confidence) AS confidence, arg_min(frame_path, rn) AS frame_path FROM i GROUP BY recording_id, island),
n AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY recording_id ORDER BY island), last_ms + 1000) AS end_ms FROM e)
SELECT recording_id, CAST(island AS BIGINT) AS island, CASE WHEN seen THEN 'face_detected' ELSE 'face_missing' END AS event_type,
  start_ms, end_ms, round(confidence, 4) AS confidence, frame_path
FROM n WHERE seen OR end_ms - start_ms >= 7200000""",
)
def face_timeline(spark, folder):
    n = v.SLICE
    return visual.face_timeline(v.frames(spark, folder), 1000, 7_200_000, n)


def _placed(spark, folder):
    n = v.SLICE
    return ordered.positions(v.frames(spark, folder), ["recording_id"], "timestamp_ms", "seq", "frame_idx", n)


PLACED = v.FRAMES + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, seq) - 1 AS frame_idx,
  count(*) OVER (PARTITION BY recording_id) AS n FROM v_frames)"""


@check(
    "w16_uniform_frame_sample",
    "WITH " + PLACED + """,
picks AS (SELECT DISTINCT recording_id, CAST(floor(i*(n/37.0::DOUBLE)) AS BIGINT) AS frame_idx
  FROM (SELECT DISTINCT recording_id, n FROM placed WHERE n > 37), range(0, 37) r(i))
SELECT recording_id, seq, frame_idx FROM placed p WHERE n <= 37
  OR EXISTS (SELECT 1 FROM picks k WHERE k.recording_id = p.recording_id AND k.frame_idx = p.frame_idx)""",
)
def frame_sample(spark, folder):
    return visual.sample_frames(_placed(spark, folder), 37).select("recording_id", "seq", "frame_idx")


@check(
    "w17_frame_times",
    "WITH " + PLACED + """
SELECT recording_id, seq, CAST(CASE WHEN seq%3=0 THEN frame_idx*2.5::DOUBLE*1000 ELSE (seq-1)*2.5::DOUBLE*1000 END AS BIGINT) AS timestamp_ms
FROM placed""",
)
def frame_times(spark, folder):
    named = _placed(spark, folder).withColumn(
        "frame_path", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("f"), "frame_path")).otherwise(F.col("frame_path"))
    )
    return visual.frame_times(named, 2.5).select("recording_id", "seq", "timestamp_ms")


DETECTED = v.FRAMES + """,
found AS (SELECT recording_id, frame_path, max_confidence / k AS confidence
  FROM v_frames, range(1, 4) r(k) WHERE k <= face_count)"""


def _detections(spark, folder):
    f = v.frames(spark, folder).where("face_count > 0")
    return f.select("recording_id", "frame_path", F.explode(F.sequence(F.lit(1), F.col("face_count"))).alias("k"), "max_confidence").select(
        "recording_id", "frame_path", (F.col("max_confidence") / F.col("k")).alias("confidence")
    )


@check(
    "j18_a6_frame_faces",
    "WITH " + DETECTED + """
SELECT f.recording_id, f.seq, count(d.frame_path) AS face_count, coalesce(max(round(d.confidence, 4)), 0.0) AS max_confidence
FROM v_frames f LEFT JOIN found d ON d.recording_id = f.recording_id AND d.frame_path = f.frame_path
GROUP BY f.recording_id, f.seq""",
)
def frame_faces(spark, folder):
    f = v.frames(spark, folder).select("recording_id", "seq", "frame_path")
    return visual.frame_faces(f, _detections(spark, folder)).drop("frame_path")


# --- speakers --------------------------------------------------------------------

TURNS = v.WINDOWS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, win_idx) AS rn FROM v_windows),
fl AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording_id ORDER BY rn) <> label THEN 1 ELSE 0 END AS opens FROM o),
tu AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY rn) AS BIGINT) AS turn_idx FROM fl),
v_turns AS (SELECT recording_id, turn_idx, arg_min(label, rn) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, rn) AS end_ms
  FROM tu GROUP BY recording_id, turn_idx)"""


@check("w9_speaker_turns", "WITH " + TURNS + " SELECT * FROM v_turns")
def turns(spark, folder):
    w = v.windows(spark, folder)
    return speakers.speaker_turns(w, v.SLICE)


#: Windows of every document: one per line, of three voices.
DOCUMENT_TURNS = r"""
li AS (SELECT doc_id AS recording_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS win_idx FROM documents),
lw AS (SELECT recording_id, win_idx, win_idx * 750 AS start_ms, win_idx * 750 + 1500 AS end_ms, length(line)%3 AS label FROM li),
lo AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording_id ORDER BY win_idx) = label THEN 0 ELSE 1 END AS opens FROM lw),
lr AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY win_idx) AS BIGINT) - 1 AS turn_idx FROM lo),
v_turns AS (SELECT recording_id, turn_idx, arg_min(label, win_idx) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, win_idx) AS end_ms FROM lr GROUP BY ALL)"""


@check(
    "w10_text_over_turns",
    "WITH " + DOCUMENT_TURNS + """,
b AS (SELECT recording_id, arg_min(start_ms, turn_idx) AS s, arg_max(end_ms, turn_idx) AS e, max(turn_idx) AS last_turn FROM v_turns GROUP BY 1),
c AS (SELECT t.*, d.text, b.last_turn,
  CAST(floor(length(d.text)*(t.end_ms - t.start_ms) / greatest(b.e - b.s, 1)::DOUBLE) AS BIGINT) AS chars
  FROM v_turns t JOIN b USING (recording_id) JOIN documents d ON d.doc_id = t.recording_id),
p AS (SELECT *, CAST(sum(chars) OVER (PARTITION BY recording_id ORDER BY turn_idx) AS BIGINT) - chars AS off FROM c),
q AS (SELECT recording_id, turn_idx, speaker, start_ms, end_ms,
  CASE WHEN turn_idx = last_turn THEN substring(text, off + 1) ELSE substring(text, off + 1, chars) END AS text FROM p),
k AS (SELECT * FROM q WHERE regexp_matches(text, '\\S'))
SELECT * FROM k UNION ALL SELECT doc_id, 0, 0, 0, 0, text FROM documents WHERE doc_id NOT IN (SELECT recording_id FROM k)
UNION ALL SELECT -1 - doc_id, 0, 0, 0, 0, ' ' FROM documents WHERE doc_id%50=0""",
)
def text_over_turns(spark, folder):
    d = v.table(spark, folder, "documents").select(F.col("doc_id").alias("recording_id"), "text")
    lines = d.select("recording_id", F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    i = F.col("_i").cast("long")
    w = lines.select(
        "recording_id", i.alias("win_idx"), (i * 750).alias("start_ms"), (i * 750 + 1500).alias("end_ms"),
        (F.length("_line") % 3).cast("long").alias("label"),
    )
    blank = d.where("recording_id % 50 = 0").select((-1 - F.col("recording_id")).alias("recording_id"), F.lit(" ").alias("text"))
    texts = d.unionByName(blank).select("*", F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms"))
    n = v.SLICE
    return speakers.split_text_over_turns(speakers.speaker_turns(w, n), texts, n)


@check(
    "w11_token_confidence",
    "WITH " + v.SEGMENTS + "," + v.TIMELINE + """,
tok AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, seq) - 1 AS tok_idx, value/500 AS confidence FROM v_timeline),
n AS (SELECT recording_id, seg_idx, (length(text)%20) AS n, CAST(sum(length(text)%20) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS BIGINT) AS upto FROM v_segments)
SELECT n.recording_id, n.seg_idx, round(coalesce(avg(t.confidence), 0.0), 9) AS confidence
FROM n LEFT JOIN tok t ON t.recording_id = n.recording_id AND t.tok_idx >= upto - n AND t.tok_idx < upto
GROUP BY n.recording_id, n.seg_idx""",
)
def token_confidence(spark, folder):
    n, m = v.SLICE, v.SLICE
    tokens = ordered.positions(v.timeline(spark, folder), ["recording_id"], "timestamp_ms", "seq", "tok_idx", m).select(
        "recording_id", "tok_idx", (F.col("value") / 500).alias("confidence")
    )
    both = v.SLICE
    found = segments.allocate_confidence(v.segments(spark, folder, n), tokens, F.length("text") % 20, both)
    return found.select("recording_id", "seg_idx", F.round("confidence", 9).alias("confidence"))


@check(
    "w11_scored_characters",
    """SELECT doc_id, CAST(length(regexp_replace(text, '[。！？；，、：“”‘’（）《》【】…—·\n.!?;,:"''()\\[\\]]', '', 'g')) AS BIGINT) AS n FROM documents""",
)
def scored_characters(spark, folder):
    return v.table(spark, folder, "documents").select(
        "doc_id", segments.scored_characters("text").cast("long").alias("n")
    )


@check(
    "w18_analysis_windows",
    "WITH " + v.SEGMENTS + """,
d AS (SELECT recording_id, max(end_ms) AS duration_ms FROM v_segments GROUP BY recording_id
  UNION ALL SELECT -1-recording_id, max(end_ms) * 90 FROM v_segments GROUP BY recording_id),
s AS (SELECT recording_id, seg_idx, CASE WHEN (recording_id+seg_idx)%11=0 THEN 0 ELSE start_ms END AS start_ms,
  CASE WHEN (recording_id+seg_idx)%11=0 THEN 0 ELSE end_ms END AS end_ms FROM v_segments
  UNION ALL SELECT -1-recording_id, 0, 0, 0 FROM (SELECT DISTINCT recording_id FROM v_segments)),
l AS (SELECT recording_id, count(*)=1 AND bool_and(start_ms=0 AND end_ms=0) AS lone FROM s GROUP BY recording_id),
x AS (SELECT s.recording_id, seg_idx, lone,
  CASE WHEN lone OR (start_ms=0 AND end_ms=0) THEN 0 ELSE start_ms END AS b,
  CASE WHEN lone OR (start_ms=0 AND end_ms=0) THEN duration_ms ELSE end_ms END AS e,
  CASE WHEN lone AND duration_ms//750 > 500 THEN duration_ms//500 ELSE 750 END AS step
  FROM s JOIN d USING (recording_id) JOIN l USING (recording_id)),
w AS (SELECT recording_id, seg_idx, e, lone OR e-b > 3000 AS slides,
  unnest(CASE WHEN lone OR e-b > 3000 THEN range(b, e, step) ELSE [b] END) AS start_ms FROM x)
SELECT recording_id, seg_idx, start_ms, CASE WHEN slides THEN least(start_ms+1500, e) ELSE e END AS end_ms FROM w
WHERE CASE WHEN slides THEN least(start_ms+1500, e) ELSE e END - start_ms >= 500""",
)
def analysis_windows(spark, folder):
    s = v.segments(spark, folder, v.SLICE)
    zero = (F.col("recording_id") + F.col("seg_idx")) % 11 == 0
    lengths = s.groupBy("recording_id").agg(F.max("end_ms").alias("duration_ms"))
    s = s.select(
        "recording_id", "seg_idx", "text",
        F.when(zero, 0).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(zero, 0).otherwise(F.col("end_ms")).alias("end_ms"),
    )
    # beside every recording one of a single segment without times and 90 times its length
    other = (-1 - F.col("recording_id")).alias("recording_id")
    nothing = F.lit(0).cast("long")
    lone = lengths.select(other, nothing.alias("seg_idx"), F.lit("").alias("text"), nothing.alias("start_ms"), nothing.alias("end_ms"))
    lengths = lengths.unionByName(lengths.select(other, (F.col("duration_ms") * 90).alias("duration_ms")))
    return speakers.analysis_windows(s.unionByName(lone), lengths)


@check(
    "a7_majority_speaker",
    "WITH " + v.WINDOWS + """,
c AS (SELECT recording_id, seg_key, label, count(*) AS n, min(win_idx) AS first_win FROM v_windows GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_key ORDER BY n DESC, first_win) AS r FROM c)
SELECT s.recording_id, s.seg_key, coalesce(b.label, -1) AS speaker
FROM (SELECT DISTINCT recording_id, seg_key FROM v_windows UNION SELECT DISTINCT recording_id, -1 - seg_key FROM v_windows) s LEFT JOIN b ON b.recording_id=s.recording_id AND b.seg_key=s.seg_key AND r=1""",
)
def majority(spark, folder):
    w = v.windows(spark, folder)
    segs = w.select("recording_id", "seg_key").distinct()
    # and segments that have no windows
    segs = segs.unionByName(segs.withColumn("seg_key", -1 - F.col("seg_key")))
    return speakers.vote_speakers(segs, w, "seg_key")


# --- splitting -------------------------------------------------------------------


def _long_runs(spark, folder):
    """Segments merged from up to three turns, with a corrected text."""
    n = v.SLICE
    s = v.segments(spark, folder, n).withColumn("speaker", (F.col("seg_idx") / 3).cast("int") % 2)
    merged = segments.merge_segments(s, 3001, n)
    noise = (F.col("recording_id") + F.col("seg_idx")) % 13 == 0
    return merged.withColumn(
        "text_corrected", F.when(noise, "").otherwise(F.replace("text", F.lit("en"), F.lit("EN! ")))
    )


LONG_RUNS = v.SEGMENTS + """,
three AS (SELECT * REPLACE ((seg_idx//3)%2 AS speaker) FROM v_segments),""" + merged_sql("three", 3001) + """,
corrected AS (SELECT *, CASE WHEN (recording_id+seg_idx)%13=0 THEN '' ELSE replace(text, 'en', 'EN! ') END AS text_corrected FROM v_merged),
parts AS (SELECT *, CASE WHEN n_subs = 1 OR NOT regexp_matches(text_corrected, '\\S') THEN [text_corrected] ELSE
  CASE WHEN len(list_filter(regexp_extract_all(text_corrected, '[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+'), lambda x: regexp_matches(x, '\\S'))) = 0 THEN [text_corrected]
  ELSE list_filter(regexp_extract_all(text_corrected, '[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+'), lambda x: regexp_matches(x, '\\S')) END END AS pieces FROM corrected),
pieces AS (SELECT recording_id, seg_idx, n_subs, text_corrected, start_ms AS f, end_ms AS t, len(pieces) AS n, list_sum(list_transform(pieces, lambda x: length(x))) AS chars,
  unnest(pieces) AS fragment, generate_subscripts(pieces, 1) - 1 AS pos FROM parts),
shares AS (SELECT *, CAST(round_even(greatest(t-f,1) * (length(fragment)/greatest(chars,1)::DOUBLE), 0) AS BIGINT) AS share FROM pieces),
v_fragments AS (SELECT recording_id, seg_idx, pos, fragment, n_subs,
  CASE WHEN NOT regexp_matches(text_corrected, '\\S') THEN 0 ELSE f + CAST(sum(share) OVER w AS BIGINT) - share END AS start_ms,
  CASE WHEN NOT regexp_matches(text_corrected, '\\S') THEN 0 WHEN pos = n - 1 THEN t ELSE f + CAST(sum(share) OVER w AS BIGINT) END AS end_ms
  FROM shares WINDOW w AS (PARTITION BY recording_id, seg_idx ORDER BY pos))"""


@check(
    "w12_corrected_fragments",
    "WITH " + LONG_RUNS + " SELECT recording_id, seg_idx, pos, fragment, start_ms, end_ms FROM v_fragments",
)
def corrected_fragments(spark, folder):
    return segments.corrected_fragments(_long_runs(spark, folder)).withColumn("pos", F.col("pos").cast("long"))


@check(
    "w13_original_fragments",
    "WITH " + LONG_RUNS + """,
u AS (SELECT recording_id, seg_idx, text, n_subs, unnest(subs) AS sub, generate_subscripts(subs, 1) - 1 AS pos FROM v_merged),
-- every 5th merged text has its second half changed, so a prefix fails there
x AS (SELECT recording_id, seg_idx, n_subs, pos, sub, CASE WHEN (recording_id+seg_idx)%5=0 THEN concat(left(text, length(text)//2), replace(substring(text, length(text)//2+1), 'e', '_')) ELSE text END AS text FROM u),
o AS (SELECT *, CAST(sum(length(sub)) OVER (PARTITION BY recording_id, seg_idx ORDER BY pos) AS BIGINT) - length(sub) AS off FROM x),
m AS (SELECT *, min(CASE WHEN pos < n_subs - 1 AND substring(text, off+1, length(sub)) <> sub THEN pos END) OVER (PARTITION BY recording_id, seg_idx) AS miss FROM o)
SELECT recording_id, seg_idx, pos, CASE WHEN n_subs = 1 THEN text WHEN pos > miss THEN '' WHEN pos = miss OR pos = n_subs - 1 THEN substring(text, off+1) ELSE sub END AS original FROM m""",
)
def original_fragments(spark, folder):
    half = F.floor(F.length("text") / 2).cast("int")
    tail = F.substring(F.col("text"), half + 1, F.length("text"))
    changed = F.concat(F.substring(F.col("text"), F.lit(1), half), F.replace(tail, F.lit("e"), F.lit("_")))
    rows = _long_runs(spark, folder).withColumn(
        "text", F.when((F.col("recording_id") + F.col("seg_idx")) % 5 == 0, changed).otherwise(F.col("text"))
    )
    return segments.original_fragments(rows).withColumn("pos", F.col("pos").cast("long"))


@check(
    "w14_p6_transcript_entries",
    "WITH " + LONG_RUNS + """,
e AS (SELECT f.recording_id, f.seg_idx, f.pos, f.start_ms, f.end_ms, c.speaker, f.fragment AS text_corrected,
  CASE WHEN c.n_subs = 1 THEN c.text ELSE coalesce(c.subs[f.pos+1], f.fragment) END AS text
  FROM v_fragments f JOIN corrected c USING (recording_id, seg_idx) WHERE c.text_corrected <> '')
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, pos) - 1 AS seq,
  printf('%02d:%02d', start_ms//60000, (start_ms//1000)%60) AS "timestamp", start_ms AS timestamp_ms, end_ms,
  concat('Speaker ', speaker+1) AS speaker, text, text_corrected FROM e""",
)
def transcript_entries(spark, folder):
    return segments.transcript_entries(_long_runs(spark, folder), rows=v.SLICE)


@check(
    "w15_budget_prefix",
    "WITH " + v.ENTRIES + """,
r AS (SELECT *, sum(length(text_corrected)) OVER (PARTITION BY recording_id ORDER BY seq) AS upto FROM v_entries)
SELECT recording_id, seq, length(text_corrected) AS n_chars FROM r WHERE upto <= 1500""",
)
def budget(spark, folder):
    n = v.SLICE
    kept = segments.within_budget(v.entries(spark, folder, n), budget=1500, rows=n)
    return kept.select("recording_id", "seq", F.length("text_corrected").cast("long").alias("n_chars"))


@check(
    "w19_long_segment_split",
    "WITH RECURSIVE " + v.SEGMENTS + r""",
c AS (SELECT recording_id, seg_idx, text, length(text) AS n, 0 AS start, CASE WHEN 166 >= length(text) THEN length(text)
    ELSE coalesce(168 - nullif(strpos(reverse(translate(substring(text, 2, 166), '。！？；，、：!?;,:', '............')), '.'), 0), 166) END AS cut
  FROM v_segments WHERE (length(text)-1)*90+80 > 15000
  UNION ALL SELECT recording_id, seg_idx, text, n, cut, CASE WHEN cut + 166 >= n THEN n
    ELSE cut + coalesce(168 - nullif(strpos(reverse(translate(substring(text, cut + 2, 166), '。！？；，、：!?;,:', '............')), '.'), 0), 166) END
  FROM c WHERE cut < n),
k AS (SELECT recording_id, seg_idx, start, cut, regexp_replace(substring(text, start + 1, cut - start), '^\s+|\s+$', '', 'g') AS text FROM c)
SELECT recording_id, seg_idx, row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY start) - 1 AS part, text, CAST(start*90 AS BIGINT) AS start_ms, CAST((cut-1)*90+80 AS BIGINT) AS end_ms FROM k WHERE text <> ''
UNION ALL SELECT recording_id, seg_idx, 0, text, 0, (length(text)-1)*90+80 FROM v_segments WHERE length(text) > 0 AND (length(text)-1)*90+80 <= 15000
UNION ALL SELECT recording_id, -1 - seg_idx, 0, '', 0, 0 FROM v_segments""",
)
def long_split(spark, folder):
    stamps = F.transform(
        F.sequence(F.lit(0), F.length("text") - 1),
        lambda i: F.struct((i * 90).cast("long").alias("start"), (i * 90 + 80).cast("long").alias("end")),
    )
    s = v.segments(spark, folder, v.SLICE)
    s = s.withColumn("timestamps", F.when(F.length("text") > 0, stamps).otherwise(F.slice(stamps, 1, 0)))
    empty = s.select("recording_id", (-1 - F.col("seg_idx")).alias("seg_idx"), F.lit("").alias("text"), F.slice("timestamps", 1, 0).alias("timestamps"))
    return segments.split_long_segments(s.select(*empty.columns).unionByName(empty))


CHUNKS = r"""
ch AS (SELECT doc_id, CAST(0 AS BIGINT) AS chunk_idx, CAST(0 AS BIGINT) AS start,
    CASE WHEN length(text) <= 800 THEN length(text) ELSE coalesce(
      401 + length(substring(text, 402, 400)) - nullif(strpos(reverse(translate(substring(text, 402, 400), '。！？!?；;' || chr(10), '........')), '.'), 0) + 1, 800) END AS cut,
    length(text) AS n FROM documents
  UNION ALL
  SELECT c.doc_id, c.chunk_idx + 1, c.cut - 50,
    CASE WHEN c.cut - 50 + 800 >= c.n THEN c.n ELSE c.cut - 50 + coalesce(
      401 + 400 - nullif(strpos(reverse(translate(substring(d.text, c.cut - 50 + 402, 400), '。！？!?；;' || chr(10), '........')), '.'), 0) + 1, 800) END,
    c.n FROM ch c JOIN documents d ON d.doc_id = c.doc_id WHERE c.cut < c.n)"""


@check(
    "w20_overlapping_chunks",
    "WITH RECURSIVE " + CHUNKS + """
SELECT c.doc_id, chunk_idx, start, substring(d.text, start + 1, cut - start) AS chunk FROM ch c JOIN documents d USING (doc_id)""",
)
def overlapping_chunks(spark, folder):
    return chunks.chunk_texts(v.table(spark, folder, "documents"), "doc_id")


@check("w21_chunk_merge", "SELECT doc_id, text FROM documents")
def chunk_merge(spark, folder):
    return chunks.merge_chunks(chunks.chunk_texts(v.table(spark, folder, "documents"), "doc_id"), "doc_id")


@check(
    "w22_sentences",
    r"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(replace(text, '. ', '。'), '[^。！？；\n]*[。！？；\n]|[^。！？；\n]+'), lambda x: regexp_matches(x, '\S')) AS parts, replace(text, '. ', '。') AS text FROM documents),
k AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN len(parts) = 0 THEN [text] ELSE parts END AS parts FROM s)
SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM k""",
)
def sentences(spark, folder):
    marked = v.table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("。")).alias("text"))
    return marked.select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos").cast("long")
    )


# --- aggregates over segments ----------------------------------------------------


@check(
    "a5_confidence_stats",
    "WITH " + v.SEGMENTS + """,
f AS (SELECT recording_id, arg_min(confidence, seg_idx) AS c0, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
  round(avg(confidence), 9) AS avg_confidence, count(*) FILTER (confidence >= 0.95) AS n_trusted, count(*) AS n_segments
  FROM v_segments GROUP BY recording_id)
SELECT * EXCLUDE (c0) FROM f WHERE c0 <> 0""",
)
def confidence_stats(spark, folder):
    return segments.confidence_stats(v.segments(spark, folder, v.SLICE)).withColumn(
        "avg_confidence", F.round("avg_confidence", 9)
    )


@check(
    "a11_speakers_in_order",
    "WITH " + v.ENTRIES + """,
f AS (SELECT recording_id, speaker, min(seq) AS first_seq FROM v_entries GROUP BY ALL)
SELECT recording_id, speaker, first_seq, row_number() OVER (PARTITION BY recording_id ORDER BY first_seq) AS place FROM f""",
)
def speakers_in_order(spark, folder):
    from talkledger.operators.reports import distinct_speakers

    return distinct_speakers(v.entries(spark, folder, v.SLICE))


@check(
    "a12_merge_totals",
    "WITH " + v.SEGMENTS + "," + merged_sql("v_segments", 1000) + """
SELECT 'after' AS stage, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM v_merged
UNION ALL SELECT 'before', count(*), CAST(sum(length(text)) AS BIGINT) FROM v_segments""",
)
def merge_totals(spark, folder):
    from talkledger.operators.reports import totals

    n = v.SLICE
    s = v.segments(spark, folder, n)
    return totals({"before": s, "after": segments.merge_segments(s, 1000, n)}, "text")


@check("a12_observed_totals", SQL["a12_merge_totals"])
def observed_totals(spark, folder):
    """Counted while both stages are written."""
    from talkledger.operators.reports import StageTotals

    seen, n = StageTotals(), v.SLICE
    s = cut_lineage(seen.watch("before", v.segments(spark, folder, n), "text"))
    seen.watch("after", segments.merge_segments(s, 1000, n), "text").write.parquet(new_folder(spark, "merged"))
    return seen.frame(spark)


# --- the form long recordings take: the same operators in slices of a few rows ---

for _name, _query in {
    "w1_segment_premerge_in_slices": lambda spark, folder: segments.merge_segments(v.segments(spark, folder, 3), 1000, 3).select(
        "recording_id", "seg_idx", "text", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence"),
        "speaker", F.size("sub_sentences").cast("long").alias("n_subs"),
    ),
    "w4_speaker_smoothing_in_slices": lambda spark, folder: segments.smooth_speakers(v.segments(spark, folder, 3), rows=3).select(
        "recording_id", "seg_idx", "speaker"
    ),
    "w6_pack_by_chars_in_slices": lambda spark, folder: segments.pack_by_chars(
        v.entries(spark, folder, 2).drop("chunk_idx"), "seq", "text_corrected", 900, rows=2
    ).select("recording_id", "seq", "chunk_idx"),
    "w7_batches_by_rows_and_chars_in_slices": lambda spark, folder: segments.batch_rows(
        v.entries(spark, folder, 2), "seq", "text", max_rows=3, rows=2
    ).select("recording_id", "seq", "batch_idx"),
    "w8_face_timeline_in_slices": lambda spark, folder: visual.face_timeline(v.frames(spark, folder), 1000, 7_200_000, 16),
    "w9_speaker_turns_in_slices": lambda spark, folder: speakers.speaker_turns(v.windows(spark, folder), 8),
}.items():
    check(_name, SQL[_name.removesuffix("_in_slices")])(_query)
