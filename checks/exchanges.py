"""Model requests, responses and whole flows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks import findings as fi
from checks import views as v
from checks.registry import check
from checks.sequences import LONG_RUNS, SMOOTHED, merged_sql
from talkledger.functions import responses as r
from talkledger.operators import exchanges, ordered, violations
from talkledger.plans import audit, evaluation, transcript
from talkledger.session import new_folder
from talkledger.streaming import reviews, tokens


@check(
    "a8_full_texts",
    "WITH " + v.ENTRIES + """
SELECT recording_id, string_agg(text_corrected, ' ' ORDER BY seq) AS audit_text, string_agg(text_corrected, chr(10) ORDER BY seq) AS evaluation_text FROM v_entries GROUP BY recording_id""",
)
def full_texts(spark, folder):
    n = v.SLICE
    e = v.entries(spark, folder, n)
    text = F.col("text_corrected")
    a = ordered.joined_text(e, ["recording_id"], "seq", text, " ", "audit_text", n)
    b = ordered.joined_text(e, ["recording_id"], "seq", text, "\n", "evaluation_text", n)
    return a.join(b, "recording_id")


def _every_entry(e):
    """All entries, and copies of every fourth recording that have no screen text."""
    return e.unionByName(e.where("recording_id % 4 = 0").withColumn("recording_id", -1 - F.col("recording_id")))


EVERY_ENTRY = """
v_every AS (SELECT * FROM v_entries UNION ALL SELECT -1 - recording_id, * EXCLUDE (recording_id) FROM v_entries WHERE recording_id%4=0)"""


def _sheets(e):
    """A sheet for every recording, and the other one too for every third."""
    own = F.abs(F.col("recording_id")) % 2
    listed = F.when(F.abs(F.col("recording_id")) % 3 == 0, F.array(own, 1 - own)).otherwise(F.array(own))
    return e.select("recording_id").distinct().select("recording_id", F.explode(listed).alias("sheet_id"))


def _rules(spark, folder):
    b = v.table(spark, folder, "benchmark")
    none = F.array().cast("array<string>")
    return b.select(
        (F.col("item_id") % 2).alias("sheet_id"), F.col("item_id").alias("rule_no"), F.col("item_id").alias("rule_id"),
        F.col("text").alias("content"), F.when(F.col("item_id") % 5 == 0, "exact").otherwise("semantic").alias("check_mode"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("transcript"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("ocr")))
        .otherwise(F.array(F.lit("transcript"), F.lit("ocr"))).alias("evidence_sources"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.substring("text", 2, 3))).otherwise(none).alias("keywords"),
        F.when(F.col("item_id") % 4 == 0, "D").otherwise("").alias("description"),
        F.lit("high").alias("severity_default"),
    )


def _examples(spark, folder):
    return v.table(spark, folder, "benchmark").select(
        (F.col("item_id") % 2).alias("sheet_id"), F.col("item_id").alias("rule_no"), F.lit(0).cast("long").alias("cell_no"),
        F.col("text").alias("example"),
    )


def _screens(e):
    return e.where("recording_id >= 0").select(
        "recording_id", "seq", (F.col("timestamp_ms") + 700).alias("timestamp_ms"), "text",
        F.lit(0.9).alias("confidence"), F.format_string("/f/%d.jpg", "seq").alias("frame_path"),
    )


PROMPTS = r"""
v_sheets AS (SELECT DISTINCT recording_id, abs(recording_id)%2 AS sheet_id FROM v_every UNION SELECT DISTINCT recording_id, 1 - abs(recording_id)%2 FROM v_every WHERE abs(recording_id)%3=0),
gr AS (SELECT item_id%2 AS sheet_id, CASE item_id%3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'ocr' ELSE 'mixed' END AS group_name,
  string_agg(concat(item_id, '. [', CASE WHEN item_id%5=0 THEN 'exact' ELSE 'semantic' END, '] ', text, CASE WHEN item_id%4=0 THEN concat(chr(10), '  Note: D') ELSE '' END), chr(10) ORDER BY item_id) AS rules_text
  FROM benchmark GROUP BY 1, 2),
ex AS (SELECT item_id%2 AS sheet_id, string_agg(concat('- ', text), chr(10) ORDER BY item_id) AS known
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id%2 ORDER BY item_id) AS rn FROM benchmark) WHERE rn <= 5 GROUP BY 1),
oc AS (SELECT recording_id, timestamp_ms + 700 AS t, regexp_replace(text, '^\s+|\s+$', '', 'g') AS k, min(seq) AS seq, arg_min(text, seq) AS text
  FROM v_every WHERE recording_id >= 0 GROUP BY ALL),
sp AS (SELECT recording_id, chunk_idx, min(timestamp_ms) - 500 AS f, max(end_ms) + 500 AS t FROM v_chunked GROUP BY ALL),
se AS (SELECT sp.recording_id, sp.chunk_idx, string_agg(concat('[', printf('%02d:%02d', oc.t//60000, (oc.t//1000)%60), '] "', oc.text, '"'), chr(10) ORDER BY oc.t, oc.seq) AS seen
  FROM sp JOIN oc ON oc.recording_id = sp.recording_id AND oc.t BETWEEN sp.f AND sp.t AND oc.k <> '' GROUP BY ALL),
tr AS (SELECT recording_id, chunk_idx, string_agg(concat('[', "timestamp", '] [', speaker, ']: ', text_corrected), chr(10) ORDER BY seq) AS spoken FROM v_chunked GROUP BY ALL),
nc AS (SELECT recording_id, max(chunk_idx) + 1 AS n FROM v_chunked GROUP BY 1),
v_prompts AS (SELECT tr.recording_id, sh.sheet_id, tr.chunk_idx, gr.group_name, concat_ws(chr(10)||chr(10), concat('Rules', chr(10), rules_text), concat('Known findings', chr(10), known),
  CASE WHEN tr.recording_id >= 0 AND gr.group_name <> 'transcript' AND seen IS NOT NULL THEN concat('Screen text', chr(10), seen) END,
  concat('Transcript ', tr.chunk_idx + 1, '/', nc.n, chr(10), spoken), 'Answer with a JSON array of findings.') AS prompt
FROM tr JOIN nc USING (recording_id) JOIN v_sheets sh ON sh.recording_id = tr.recording_id JOIN gr ON gr.sheet_id = sh.sheet_id LEFT JOIN ex ON ex.sheet_id = sh.sheet_id
LEFT JOIN se ON se.recording_id = tr.recording_id AND se.chunk_idx = tr.chunk_idx
WHERE gr.group_name <> 'ocr' OR tr.recording_id >= 0)"""


@check(
    "a9_audit_prompts",
    "WITH " + v.ENTRIES + "," + EVERY_ENTRY + ", v_chunked AS (SELECT * FROM v_every)," + PROMPTS + """
SELECT recording_id, sheet_id, chunk_idx, group_name, prompt FROM v_prompts""",
)
def prompts(spark, folder):
    e = _every_entry(v.entries(spark, folder, v.SLICE))
    found = audit.audit_requests(
        e, _sheets(e), _rules(spark, folder), _examples(spark, folder), _screens(e),
        limits=audit.AuditLimits(ocr_margin_ms=500),
    )
    return found.select("recording_id", "sheet_id", "chunk_idx", "group_name", "prompt")


@check(
    "a13_best_attempt",
    """SELECT event_id AS request_id, CASE WHEN event_id%3=0 THEN CASE WHEN event_id%2=0 THEN props END ELSE concat('[', props, ']') END AS raw FROM events""",
)
def best_attempt(spark, folder):
    e = v.table(spark, folder, "events")
    requests = e.select(F.col("event_id").alias("request_id"))
    one = e.select(F.col("event_id").alias("request_id"), F.lit(1).alias("attempt"),
                   F.when(F.col("event_id") % 3 == 0, F.lit("no [json")).otherwise(F.concat(F.lit("["), "props", F.lit("]"))).alias("raw"))
    two = e.select(F.col("event_id").alias("request_id"), F.lit(2).alias("attempt"),
                   F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("{")).alias("raw"))
    three = e.select(F.col("event_id").alias("request_id"), F.lit(3).alias("attempt"), F.lit("[]").alias("raw"))
    every = one.unionByName(two).unionByName(three)
    return exchanges.best_attempts(requests, every, r.parsed(F.col("raw")).isNotNull(), 2)


@check(
    "a14_response_assembly",
    """WITH l AS (SELECT user_id AS request_id, event_id AS line_no, event_type, event_id%10=0 AS done FROM events WHERE event_id%7 NOT IN (0, 1))
SELECT request_id, string_agg(event_type, '' ORDER BY line_no) AS content, bool_or(done) AS done,
  max(line_no) FILTER (done) AS eval_count, arg_max(concat('m', event_type), line_no) FILTER (done) AS model FROM l GROUP BY request_id""",
)
def assembly(spark, folder):
    e = v.table(spark, folder, "events")
    line = (
        F.when(F.col("event_id") % 7 == 0, F.lit("  "))
        .when(F.col("event_id") % 7 == 1, F.lit('{"message": '))
        .when(F.col("event_id") % 10 == 0, F.format_string('{"message":{"content":"%s"},"done":true,"model":"m%s","eval_count":%d,"total_duration":5}', "event_type", "event_type", "event_id"))
        .otherwise(F.format_string('{"message":{"content":"%s"},"done":false}', "event_type"))
    )
    lines = e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("line_no"), line.alias("line"))
    n = v.SLICE
    return exchanges.assembled_responses(lines, n).select("request_id", "content", "done", "eval_count", "model")


def _upper(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise TimeoutError("no answer")
    return prompt.replace("e", "E")


@check(
    "m1_batch_model_call",
    "SELECT doc_id, CASE WHEN length(text)%5=0 THEN NULL ELSE replace(text, 'e', 'E') END AS response, CASE WHEN length(text)%5=0 THEN 'TimeoutError: no answer' END AS error FROM documents",
)
def model_call(spark, folder):
    d = v.table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    return exchanges.call_model(d, _upper, delay_s=0.0, error="error").select("doc_id", "response", "error")


#: Cleaned text; what cleaning does not change keeps its blanks.
_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_CLEANED = rf"regexp_replace(regexp_replace({_STRIPPED}, '^\s*(?:the\s+)+', '', 'i'), '^\s+|\s+$', '', 'g')"
PLAIN = f"CASE WHEN {_CLEANED} = {_STRIPPED} THEN text ELSE {_CLEANED} END"


def _same(prompt: str) -> str:
    return prompt


@check(
    "m3_transcript_correction",
    "WITH " + v.SEGMENTS + r""",
g AS (SELECT *, max(confidence) OVER (PARTITION BY recording_id) <= 0 OR confidence < 0.95 AS needs FROM v_segments),
n AS (SELECT recording_id, seg_idx, text, needs, """ + PLAIN + """ AS c FROM g)
SELECT recording_id, seg_idx, CASE WHEN needs THEN array_to_string(list_transform(regexp_extract_all(c, '(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]'), lambda x: CASE WHEN lower(x) = 'und' THEN 'u.' ELSE x END), '') ELSE text END AS text_corrected FROM n""",
)
def transcript_correction(spark, folder):
    n = v.SLICE
    s = v.segments(spark, folder, n)
    rows = transcript.correct_transcript(s, {"und": "u."}, _same, slice_rows=n)
    return rows.select("recording_id", "seg_idx", "text_corrected")


@check("m4_text_correction", "SELECT doc_id, CASE WHEN doc_id%9=0 THEN '  ' ELSE text END AS text FROM documents")
def text_correction(spark, folder):
    d = v.table(spark, folder, "documents").select("doc_id", F.expr("CASE WHEN doc_id%9=0 THEN '  ' ELSE text END").alias("text"))
    # the model trims its answer, so it gets and gives back quoted text
    return transcript.correct_texts(d, "doc_id", _keep_blank_edges)


def _keep_blank_edges(prompt: str) -> str:
    return prompt if prompt == prompt.strip() else ""


def _upper_or_none(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise TimeoutError("no answer")
    return "" if len(prompt) % 7 == 0 else prompt.replace("e", "E")


@check(
    "m4_segment_correction",
    "WITH " + v.SEGMENTS + r"""
SELECT recording_id, seg_idx, CASE WHEN length(text)%5=0 OR length(text)%7=0 THEN text ELSE regexp_replace(replace(text, 'e', 'E'), '^\s+|\s+$', '', 'g') END AS text_corrected FROM v_segments
UNION ALL SELECT recording_id, -1 - seg_idx, '  ' FROM v_segments WHERE seg_idx%3=0""",
)
def segment_correction(spark, folder):
    s = v.segments(spark, folder, v.SLICE).select("recording_id", "seg_idx", "text")
    blank = s.where("seg_idx % 3 = 0").select("recording_id", (-1 - F.col("seg_idx")).alias("seg_idx"), F.lit("  ").alias("text"))
    rows = transcript.correct_segments(s.unionByName(blank), _upper_or_none, delay_s=0.0)
    return rows.select("recording_id", "seg_idx", "text_corrected")


@check(
    "m3_corrector_between",
    "WITH " + v.SEGMENTS + r""",
g AS (SELECT *, max(confidence) OVER (PARTITION BY recording_id) <= 0 OR confidence < 0.95 AS needs FROM v_segments),
n AS (SELECT recording_id, seg_idx, text, needs, """ + PLAIN + r""" AS c FROM g)
SELECT recording_id, seg_idx, CASE WHEN needs THEN replace(array_to_string(list_transform(regexp_extract_all(c, '(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]'), lambda x: CASE WHEN lower(x) = 'und' THEN 'u.' ELSE x END), ''), 'en', 'EN') ELSE text END AS text_corrected FROM n""",
)
def corrector_between(spark, folder):
    """A dictionary table, and a light corrector before the model; the model also gets a budget."""
    n = v.SLICE
    words = v.table(spark, folder, "documents").limit(1).select(F.lit("und").alias("wrong"), F.lit("u.").alias("right"))
    rows = transcript.correct_transcript(
        v.segments(spark, folder, n), words, _within, slice_rows=n, with_budget=True,
        between=lambda df: df.withColumn("prepared", F.replace("prepared", F.lit("en"), F.lit("EN"))),
    )
    return rows.select("recording_id", "seg_idx", "text_corrected")


def _within(prompt: str, max_tokens: int) -> str:
    return prompt if 1024 < max_tokens <= 4096 else "[]"


def _length(chunk: str) -> str:
    return f"n={len(chunk)}"


def _evaluate(prompt: str) -> str:
    title = prompt if prompt.startswith("Part 1 of ") and "n=" in prompt[:20] else str(len(prompt))
    return "thinking</think> " + json.dumps({"meta": {"title": title}, "summary": "S"})


@check(
    "m5_text_evaluation",
    r"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\S')),
ch AS (SELECT doc_id, 0 AS i, 0 AS start, coalesce(3001 + 3000 - nullif(strpos(reverse(translate(substring(text, 3002, 3000), '。！？!?；;' || chr(10), '........')), '.'), 0) + 1, 6000) AS cut, length(text) AS n
  FROM d WHERE length(text) > 6000
  UNION ALL SELECT c.doc_id, c.i + 1, c.cut, CASE WHEN c.cut + 6000 >= c.n THEN c.n ELSE c.cut + coalesce(3001 + 3000 - nullif(strpos(reverse(translate(substring(d.text, c.cut + 3002, 3000), '。！？!?；;' || chr(10), '........')), '.'), 0) + 1, 6000) END, c.n
  FROM ch c JOIN d ON d.doc_id = c.doc_id WHERE c.cut < c.n),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM ch)
SELECT doc_id, string_agg(concat('Part ', i + 1, ' of ', total, chr(10), 'n=', cut - start), concat(chr(10), chr(10), '* * *', chr(10), chr(10)) ORDER BY i) AS title, 'S' AS summary FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, CAST(length(text) AS VARCHAR), 'S' FROM d WHERE length(text) <= 6000""",
)
def text_evaluation(spark, folder):
    d = v.table(spark, folder, "documents").select("doc_id", "text")
    rows = evaluation.evaluate_texts(d, "doc_id", _length, _evaluate)
    return rows.select("doc_id", F.col("evaluation.meta.title").alias("title"), F.col("evaluation.summary").alias("summary"))


DEDUP = """
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, sheet_id, rule_id ORDER BY timestamp_ms, seq) AS rn FROM al),
cl AS (SELECT recording_id, sheet_id, rule_id, rn, timestamp_ms AS anchor, confidence AS a_conf, seq AS kept, 0 AS cluster_idx FROM o WHERE rn = 1
  UNION ALL SELECT o.recording_id, o.sheet_id, o.rule_id, o.rn,
    CASE WHEN o.timestamp_ms - cl.anchor < {window} THEN cl.anchor ELSE o.timestamp_ms END,
    CASE WHEN o.timestamp_ms - cl.anchor < {window} THEN cl.a_conf ELSE o.confidence END,
    CASE WHEN o.timestamp_ms - cl.anchor < {window} THEN CASE WHEN o.confidence > cl.a_conf THEN o.seq ELSE cl.kept END ELSE o.seq END,
    CASE WHEN o.timestamp_ms - cl.anchor < {window} THEN cl.cluster_idx ELSE cl.cluster_idx + 1 END
  FROM cl JOIN o ON o.recording_id = cl.recording_id AND o.sheet_id = cl.sheet_id AND o.rule_id = cl.rule_id AND o.rn = cl.rn + 1),
kp AS (SELECT recording_id, sheet_id, rule_id, cluster_idx, arg_max(kept, rn) AS seq FROM cl GROUP BY ALL),
si AS (SELECT al.* FROM al SEMI JOIN kp ON kp.recording_id = al.recording_id AND kp.sheet_id = al.sheet_id AND kp.seq = al.seq),
ne AS (SELECT s.recording_id, s.sheet_id, s.seq, o.text, row_number() OVER (PARTITION BY s.recording_id, s.sheet_id, s.seq ORDER BY abs(o.timestamp_ms - s.timestamp_ms), o.seq) AS r
  FROM si s JOIN v_ocr o ON o.recording_id = s.recording_id AND abs(o.timestamp_ms - s.timestamp_ms) <= {margin} WHERE s.source = 'transcript' AND s.evidence_text IS NULL),
v_chain AS (SELECT s.* EXCLUDE (evidence_text), coalesce(ne.text, s.evidence_text) AS evidence_text
  FROM si s LEFT JOIN ne ON ne.recording_id = s.recording_id AND ne.sheet_id = s.sheet_id AND ne.seq = s.seq AND ne.r = 1)"""

CHAIN = fi.v.VIOLATIONS + "," + fi.v.OCR + "," + fi.EXACT + """,
good AS (SELECT v.recording_id, v.sheet_id, v.seq, v.rule_id, v.timestamp_ms, v.confidence, v.severity, v.source, v.evidence_text
  FROM v_violations v LEFT JOIN v_exact x ON x.sheet_id = v.sheet_id AND x.rule_id = v.rule_id
  WHERE confidence >= 0.1 AND (x.rule_id IS NULL OR len(list_filter(x.keywords, lambda k: contains(v.original_text, k) OR contains(translate(v.original_text, '9', '7'), translate(k, '9', '7')))) > 0)),
sh AS (SELECT DISTINCT user_id AS recording_id, 1 AS sheet_id FROM events UNION ALL SELECT DISTINCT user_id, 2 FROM events WHERE user_id%3=0),
tx AS (SELECT user_id AS recording_id, string_agg(props, ' ' ORDER BY event_id) AS text FROM events GROUP BY 1),
pr AS (SELECT recording_id, sheet_id, rule_id, keywords, text FROM tx JOIN sh USING (recording_id) JOIN v_exact USING (sheet_id)
  WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.recording_id = tx.recording_id AND g.sheet_id = v_exact.sheet_id AND g.rule_id = v_exact.rule_id)),
ad AS (SELECT recording_id, sheet_id, 1152921504606846976 + rule_id AS seq, rule_id, 0 AS timestamp_ms,
  CASE WHEN len(list_filter(keywords, lambda k: contains(text, k))) > 0 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence, 'high' AS severity, 'transcript' AS source, NULL AS evidence_text
  FROM pr WHERE len(list_filter(keywords, lambda k: contains(text, k) OR contains(translate(text, '9', '7'), translate(k, '9', '7')))) > 0),
al AS (SELECT * FROM good UNION ALL SELECT * FROM ad),""" + DEDUP.format(window=604800000, margin=43200000)


def _chain(spark, folder):
    none = F.lit(None).cast("string")
    found = v.violations(spark, folder)
    found = found.select(
        *found.columns, F.lit("").alias("timestamp"), F.lit("").alias("speaker"), none.alias("rule_ref"), none.alias("reasoning")
    )
    events = v.table(spark, folder, "events").withColumnRenamed("user_id", "recording_id")
    texts = ordered.joined_text(events, ["recording_id"], "event_id", F.col("props"), " ", "text", v.SLICE)
    limits = audit.AuditLimits(confidence=0.1, dedup_window_ms=fi.WEEK, evidence_margin_ms=43_200_000)
    return audit.filtered(
        found, fi.exact_table(spark, folder), texts, fi.two_sheets(events), v.ocr(spark, folder), fi.SOUNDS, limits
    )


@check(
    "m6_filter_chain",
    "WITH RECURSIVE " + CHAIN + " SELECT recording_id, sheet_id, seq, rule_id, timestamp_ms, confidence, severity, source, evidence_text FROM v_chain",
)
def filter_chain(spark, folder):
    return _chain(spark, folder).select(
        "recording_id", "sheet_id", "seq", "rule_id", "timestamp_ms", "confidence", "severity", "source", "evidence_text"
    )


@check(
    "u1_union_of_findings",
    "WITH RECURSIVE " + CHAIN + """
SELECT CASE WHEN seq >= 1152921504606846976 THEN 'added' ELSE 'kept' END AS part, rule_id, count(*) AS n, CAST(sum(seq%1000003) AS BIGINT) AS checksum FROM v_chain GROUP BY ALL""",
)
def union_of_findings(spark, folder):
    """Reported and added findings together, as they leave the filter chain."""
    part = F.when(F.col("seq") >= violations.ADDED_SEQ, "added").otherwise("kept").alias("part")
    return _chain(spark, folder).groupBy(part, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seq") % 1000003).alias("checksum"))


@check(
    "m6_audit_reports",
    "WITH RECURSIVE " + CHAIN + """,
ct AS (SELECT recording_id, sheet_id, count(*) AS n, count(*) FILTER (severity='high') AS h, count(*) FILTER (severity='medium') AS m, count(*) FILTER (severity='low') AS l,
  sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END) AS lost, count(*) FILTER (source='ocr') AS n_ocr FROM v_chain GROUP BY 1, 2),
ru AS (SELECT sheet_id, count(DISTINCT rule_id) AS total_rules FROM v_violations GROUP BY 1),
ev AS (SELECT user_id AS recording_id, count(*) AS n_entries FROM events GROUP BY 1)
SELECT sh.recording_id, CAST(sh.sheet_id AS BIGINT) AS sheet_id, coalesce(total_rules, 0) AS total_rules, n_entries AS total_segments_checked, greatest(round(100.0 - coalesce(lost, 0), 1), 0)::DOUBLE AS compliance_score,
  CASE WHEN n IS NULL THEN '审核完成，未发现违规内容。' ELSE concat('发现 ', n, ' 条违规（高风险 ', h, ' 条，中风险 ', m, ' 条，低风险 ', l, ' 条）。') END AS summary,
  coalesce(n_ocr, 0) AS n_ocr FROM sh LEFT JOIN ct ON ct.recording_id = sh.recording_id AND ct.sheet_id = sh.sheet_id
  LEFT JOIN ru ON ru.sheet_id = sh.sheet_id LEFT JOIN ev ON ev.recording_id = sh.recording_id""",
)
def audit_reports(spark, folder):
    events = v.timeline(spark, folder).select("recording_id")
    rows = audit.reports(fi.two_sheets(events), events, fi.exact_table(spark, folder), _chain(spark, folder))
    return rows.select(
        "recording_id", "sheet_id", "total_rules", "total_segments_checked", "compliance_score", "summary",
        F.coalesce(F.try_element_at("source_counts", F.lit("ocr")), F.lit(0)).alias("n_ocr"),
    )


def _audit_model(prompt: str) -> str:
    """Reports one of three rules for every line of the transcript that shouts EN."""
    if len(prompt) % 11 == 0:
        return "sorry"
    found = []
    for line in prompt.split("\n"):
        if line.startswith("[") and "]: " in line and "EN" in line:
            found.append({
                "rule_id": (0, 1, 5)[len(line) % 3], "timestamp": line[1:6], "severity": "HIGH", "confidence": "0.9",
                "original_text": line.split("]: ", 1)[1][:40], "reason": "EN", "speaker": None,
            })
    return "<think>hm</think>```json\n" + json.dumps({"violations": found}) + "\n```"


@check(
    "m6_compliance_audit",
    "WITH RECURSIVE " + v.ENTRIES + "," + EVERY_ENTRY + """,
p AS (SELECT recording_id, seq, length(text_corrected) AS chars, 0 AS chunk_idx FROM v_every WHERE seq = 0
  UNION ALL SELECT e.recording_id, e.seq, CASE WHEN p.chars + length(e.text_corrected) > 900 THEN length(e.text_corrected) ELSE p.chars + length(e.text_corrected) END,
    CASE WHEN p.chars + length(e.text_corrected) > 900 THEN p.chunk_idx + 1 ELSE p.chunk_idx END
  FROM p JOIN v_every e ON e.recording_id = p.recording_id AND e.seq = p.seq + 1),
v_chunked AS (SELECT e.* EXCLUDE (chunk_idx), p.chunk_idx FROM v_every e JOIN p USING (recording_id, seq)),""" + PROMPTS + r""",
asked AS (SELECT *, chr(10) || chr(10) || 'The last answer could not be read. Answer with the JSON array alone, without any other text.' AS again FROM v_prompts),
lines AS (SELECT recording_id, sheet_id, chunk_idx, group_name, list_filter(string_split(prompt, chr(10)), lambda l: l[1] = '[' AND contains(l, ']: ') AND contains(l, 'EN')) AS l
  FROM asked WHERE length(prompt)%11 <> 0 OR length(prompt || again)%11 <> 0),
said AS (SELECT recording_id, sheet_id, chunk_idx, group_name, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS place FROM lines),
found AS (SELECT s.*, substring(line, 2, 5) AS "timestamp", substring(line, strpos(line, ']: ') + 3, 40) AS original_text, [0, 1, 5][length(line)%3 + 1] AS rule_id FROM said s),
first AS (SELECT recording_id, chunk_idx, "timestamp", arg_min({'t': timestamp_ms, 'e': end_ms}, seq) AS hit FROM v_chunked GROUP BY ALL),
timed AS (SELECT f.recording_id, f.sheet_id, CASE group_name WHEN 'transcript' THEN 0 WHEN 'ocr' THEN 1 ELSE 2 END * 72057594037927936 + chunk_idx * 16777216 + place AS seq, rule_id, original_text,
  coalesce(hit.t, CASE WHEN regexp_full_match("timestamp", '[0-9]+:[0-9]+') THEN (CAST(split_part("timestamp", ':', 1) AS BIGINT) * 60 + CAST(split_part("timestamp", ':', 2) AS BIGINT)) * 1000 ELSE 0 END) AS timestamp_ms,
  hit.e AS e FROM found f LEFT JOIN first USING (recording_id, chunk_idx, "timestamp")),
v_exact AS (SELECT item_id%2 AS sheet_id, item_id AS rule_id, substring(text, 2, 3) AS keyword FROM benchmark WHERE item_id%5=0),
good AS (SELECT t.recording_id, t.sheet_id, t.seq, t.rule_id, t.timestamp_ms, CASE WHEN coalesce(e, 0) = 0 THEN t.timestamp_ms ELSE e END AS end_ms, t.original_text, CAST(0.9 AS DOUBLE) AS confidence
  FROM timed t LEFT JOIN v_exact x ON x.sheet_id = t.sheet_id AND x.rule_id = t.rule_id WHERE x.rule_id IS NULL OR contains(t.original_text, x.keyword)),
tx AS (SELECT recording_id, string_agg(text_corrected, ' ' ORDER BY seq) AS text FROM v_every GROUP BY 1),
ad AS (SELECT recording_id, sheet_id, 1152921504606846976 + rule_id AS seq, rule_id, 0 AS timestamp_ms, 0 AS end_ms,
    substring(text, greatest(strpos(text, keyword) - 80, 1), strpos(text, keyword) + 80 - greatest(strpos(text, keyword) - 80, 1)) AS original_text, CAST(1.0 AS DOUBLE) AS confidence
  FROM tx JOIN v_sheets USING (recording_id) JOIN v_exact USING (sheet_id) WHERE contains(text, keyword)
  AND NOT EXISTS (SELECT 1 FROM good g WHERE g.recording_id = tx.recording_id AND g.sheet_id = v_exact.sheet_id AND g.rule_id = v_exact.rule_id)),
al AS (SELECT *, 'high' AS severity, 'transcript' AS source, NULL AS evidence_text FROM (SELECT * FROM good UNION ALL SELECT * FROM ad)),
v_ocr AS (SELECT recording_id, seq, timestamp_ms + 700 AS timestamp_ms, text FROM v_every WHERE recording_id >= 0),""" + DEDUP.format(window=30000, margin=10000) + """
SELECT recording_id, sheet_id, CAST(seq AS BIGINT) AS seq, CAST(rule_id AS BIGINT) AS rule_id, CAST(timestamp_ms AS BIGINT) AS timestamp_ms, CAST(end_ms AS BIGINT) AS end_ms,
  severity, confidence, original_text, evidence_text FROM v_chain""",
)
def compliance_audit(spark, folder):
    n = v.SLICE
    e = _every_entry(v.entries(spark, folder, n)).drop("chunk_idx")
    limits = audit.AuditLimits(chunk_chars=900, slice_rows=n, ocr_margin_ms=500)
    kept, _ = audit.audit(
        e, _sheets(e), _rules(spark, folder), _examples(spark, folder), _screens(e), _audit_model, limits=limits
    )
    return kept.select(
        "recording_id", "sheet_id", "seq", "rule_id", "timestamp_ms", "end_ms", "severity", "confidence", "original_text", "evidence_text"
    )


@check(
    "e1_recording_to_transcript",
    "WITH RECURSIVE " + SMOOTHED + "," + merged_sql("smoothed", 1000) + """,
gated AS (SELECT *, max(confidence) OVER (PARTITION BY recording_id) <= 0 OR confidence < 0.95 AS needs FROM v_merged),
corrected AS (SELECT *, CASE WHEN needs THEN array_to_string(list_transform(regexp_extract_all(""" + PLAIN + """, '(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]'),
  lambda x: CASE WHEN lower(x) = 'und' THEN 'u.' ELSE x END), '') ELSE text END AS text_corrected FROM gated),
""" + LONG_RUNS[LONG_RUNS.index("parts AS"):] + """,
e AS (SELECT f.recording_id, f.seg_idx, f.pos, f.start_ms, f.end_ms, c.speaker, f.fragment AS text_corrected,
  CASE WHEN c.n_subs = 1 THEN c.text ELSE coalesce(c.subs[f.pos+1], f.fragment) END AS text
  FROM v_fragments f JOIN corrected c USING (recording_id, seg_idx) WHERE c.text_corrected <> '')
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, pos) - 1 AS seq,
  printf('%02d:%02d', start_ms//60000, (start_ms//1000)%60) AS "timestamp", start_ms AS timestamp_ms, end_ms,
  concat('Speaker ', speaker+1) AS speaker, text, text_corrected FROM e""",
)
def recording_to_transcript(spark, folder):
    n = v.SLICE
    return transcript.transcripts(v.segments(spark, folder, n), {"und": "u."}, _same, slice_rows=n)


@check(
    "s1_debounced_reviews",
    """WITH u AS (SELECT user_id AS recording_id, event_id - event_id%3 AS seq, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id) - 1 AS upd_seq, epoch_us(ts) AS us, CASE event_id%2 WHEN 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM events),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY recording_id ORDER BY upd_seq) > 21600000000 THEN 1 ELSE 0 END AS opens FROM u),
b AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY upd_seq) AS BIGINT) AS burst FROM f)
SELECT recording_id, burst, seq, max(upd_seq) AS upd_seq, arg_max(status, upd_seq) AS status FROM b GROUP BY recording_id, burst, seq""",
)
def debounced(spark, folder):
    n = v.SLICE
    e = v.table(spark, folder, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_id").alias("_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.unix_millis(F.col("ts").cast("timestamp")).alias("_ms"),
        (F.col("event_id") - F.col("event_id") % 3).alias("seq"),
        F.expr("CASE event_id%2 WHEN 0 THEN 'confirmed' ELSE 'rejected' END").alias("status"),
    )
    placed = ordered.positions(e, ["recording_id"], "_ms", "_id", "upd_seq", n)
    return reviews.bursts(placed, 21_600_000, n)


@check(
    "s2_response_stream",
    """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS request_id, event_id AS line_no, event_type, event_id%10 IN (0, 5) AS done,
    event_id%7 > 1 AND event_id%11 <> 0 AND event_id%13 <> 0 AND event_id%17 <> 0 AS readable FROM events),
e AS (SELECT request_id, min(line_no) AS ended FROM l WHERE done AND readable GROUP BY 1)
SELECT request_id, string_agg(event_type, '' ORDER BY line_no) AS content, max(concat('m', event_type)) FILTER (line_no = ended) AS model,
  max(line_no) FILTER (line_no = ended) AS eval_count, false AS timed_out
FROM l JOIN e USING (request_id) WHERE readable AND line_no <= ended GROUP BY request_id""",
)
def response_stream(spark, folder):
    """Lines that arrive in two runs of one stream; requests go on, and end, across them."""
    e = v.table(spark, folder, "events")
    n = F.col("event_id")
    said = F.format_string('{"message":{"content":"%s"},"done":', "event_type")
    line = (
        F.when(n % 7 == 0, F.lit("  ")).when(n % 7 == 1, F.lit('{"message": ')).when(n % 11 == 0, F.lit('{"message":"no object"}'))
        .when(n % 13 == 0, F.lit(None)).when(n % 17 == 0, F.lit("[1]"))
        .when((n % 10).isin(0, 5), F.concat(said, F.format_string('true,"model":"m%s","eval_count":%d,"total_duration":5}', "event_type", n)))
        .otherwise(F.concat(said, F.lit("false}")))
    )
    lines = e.select(F.col("user_id").cast("string").alias("request_id"), n.alias("line_no"), line.alias("line"))
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    base = new_folder(spark, "response-stream")
    for part in (lines.where(F.col("line_no") <= half), lines.where(F.col("line_no") > half)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{base}/in")
        tokens.assemble_files(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("request_id", "content", "model", "eval_count", "timed_out")


@check(
    "s1_review_table",
    """SELECT user_id AS recording_id, event_id - event_id%3 AS seq, max(event_id) AS upd_seq, arg_max(CASE event_id%2 WHEN 0 THEN 'confirmed' ELSE 'rejected' END, event_id) AS status
FROM events GROUP BY 1, 2""",
)
def review_table(spark, folder):
    """Every event as an update, in two runs of one stream: the first lacks every eleventh, which comes late in the second."""
    e = v.table(spark, folder, "events")
    late = F.col("event_id") % 11 == 0
    rows = e.select(
        F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("upd_seq"),
        (F.col("event_id") - F.col("event_id") % 3).alias("seq"),
        F.expr("CASE event_id%2 WHEN 0 THEN 'confirmed' ELSE 'rejected' END").alias("status"), late.alias("_late"),
    )
    base = new_folder(spark, "reviews")
    quiet = 21_600_000 // reviews.CELL_QUIETS
    for part in (rows.where(~F.col("_late")), rows.where("_late")):
        part.drop("_late").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.drop("_late").schema).parquet(f"{base}/in")
        query = reviews.write_reviews(
            stream, f"{base}/table", f"{base}/checkpoint", lambda: spark.read.parquet(f"{base}/in"), quiet, "1 hour", availableNow=True
        )
        query.awaitTermination()
    table = spark.read.parquet(f"{base}/table").drop("batch")
    rest = reviews.missed_updates(spark.read.parquet(f"{base}/in"), table, quiet, every=True)
    return reviews.current_reviews(table.unionByName(rest))


def _upper_batch(prompts: list[str]) -> list[str | None]:
    return [None if len(p) % 5 == 0 else p.replace("e", "E") for p in prompts]


def _bracketed(prompts: list[str]) -> list[str | None]:
    return [f"[{len(p)}]" for p in prompts]


@check(
    "m1_logged_model_calls",
    "SELECT doc_id, CASE WHEN length(text)%5=0 THEN concat('[', length(text), ']') ELSE replace(text, 'e', 'E') END AS response FROM documents",
)
def logged_calls(spark, folder):
    """Two runs with one log: the second, with another model, asks what the first left unanswered and nothing else."""
    d = v.table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    log = new_folder(spark, "answers")
    exchanges.call_model_logged(d, _upper_batch, log, delay_s=0.0)
    return exchanges.call_model_logged(d, _bracketed, log, delay_s=0.0).select("doc_id", "response")
