"""Findings: filters, de-duplication, evidence, review, reports (P8-P13, J4 J7 J11 J16 J17, W5, A1-A4, O, U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from talkledger.functions import times
from talkledger.operators import evidence, ordered, rules, violations

WEEK = 604_800_000


@check("p8_confident_findings", "WITH " + v.VIOLATIONS + " SELECT recording_id, seq, confidence FROM v_violations WHERE confidence >= 0.1")
def confident(spark, folder):
    return violations.confident(v.violations(spark, folder), 0.1).select("recording_id", "seq", "confidence")


@check(
    "p9_finding_search",
    "WITH " + v.VIOLATIONS + """
SELECT recording_id, seq FROM v_violations WHERE severity = 'high' AND source = 'transcript' AND status = 'pending'
AND (contains(lower(reason), 'click') OR contains(lower(original_text), 'click') OR contains(lower(rule_content), 'click') OR coalesce(contains(lower(evidence_text), 'click'), false))""",
)
def search(spark, folder):
    return violations.search_violations(v.violations(spark, folder), "CLICK", "high", "pending", "transcript").select("recording_id", "seq")


@check(
    "p12_review_clips",
    "WITH " + v.VIOLATIONS + """
SELECT recording_id, seq, greatest(timestamp_ms - 5000, 0) AS clip_start_ms, CASE WHEN end_ms = 0 THEN timestamp_ms ELSE end_ms END + 10000 AS clip_end_ms FROM v_violations""",
)
def clips(spark, folder):
    return violations.review_clips(v.violations(spark, folder)).select("recording_id", "seq", "clip_start_ms", "clip_end_ms")


@check(
    "p13_report_defaults",
    "WITH " + v.VIOLATIONS + """
SELECT recording_id, seq, CASE WHEN seq%4=0 OR seq%6=0 THEN 'pending' ELSE 'confirmed' END AS status, CASE WHEN seq%8=0 THEN 'transcript' ELSE source END AS source FROM v_violations""",
)
def defaults(spark, folder):
    raw = v.violations(spark, folder).withColumn(
        "status", F.expr("CASE WHEN seq%4=0 THEN '' WHEN seq%6=0 THEN NULL ELSE 'confirmed' END")
    ).withColumn("source", F.expr("CASE WHEN seq%8=0 THEN NULL ELSE source END"))
    return violations.with_report_defaults(raw).select("recording_id", "seq", "status", "source")


@check(
    "p15_a1_scores_and_bands",
    "WITH " + v.VIOLATIONS + """,
u AS (SELECT DISTINCT recording_id FROM v_timeline),
p AS (SELECT recording_id, sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END) AS lost FROM v_violations WHERE value_ok GROUP BY 1)
SELECT u.recording_id, CAST(greatest(round(100.0 - coalesce(lost, 0), 1), 0.0) AS DOUBLE) AS compliance_score,
  CASE WHEN 100 - coalesce(lost, 0) >= 80 THEN 'good' WHEN 100 - coalesce(lost, 0) >= 60 THEN 'fair' ELSE 'poor' END AS band
FROM u LEFT JOIN p USING (recording_id)""".replace("WHERE value_ok", "WHERE confidence >= 0.3"),
)
def scores(spark, folder):
    vs = v.violations(spark, folder)
    recordings = v.timeline(spark, folder).select("recording_id").distinct()
    scored = violations.scores(recordings, violations.confident(vs, 0.3))
    return scored.withColumn("band", times.score_band(F.col("compliance_score")))


@check(
    "a2_source_counts",
    "WITH " + v.VIOLATIONS + """
SELECT recording_id, source, count(*) AS n FROM v_violations GROUP BY ALL""",
)
def source_counts(spark, folder):
    counts = violations.source_counts(v.violations(spark, folder))
    return counts.select("recording_id", F.explode("source_counts").alias("source", "n"))


@check(
    "a3_review_dashboard",
    "WITH " + v.VIOLATIONS + """
SELECT recording_id, count(*) AS n_all, count(*) FILTER (severity='high') AS n_high, count(*) FILTER (severity='medium') AS n_medium,
  count(*) FILTER (severity='low') AS n_low, count(*) FILTER (source='transcript') AS n_transcript, count(*) FILTER (source='ocr') AS n_ocr,
  count(*) FILTER (source='vision') AS n_vision, count(*) FILTER (status='pending') AS n_pending FROM v_violations GROUP BY recording_id""",
)
def dashboard(spark, folder):
    return violations.dashboard(v.violations(spark, folder))


@check(
    "a4_summaries",
    "WITH " + v.VIOLATIONS + """,
u AS (SELECT DISTINCT recording_id FROM v_timeline),
c AS (SELECT recording_id, count(*) AS n, count(*) FILTER (severity='high') AS h, count(*) FILTER (severity='medium') AS m, count(*) FILTER (severity='low') AS l
  FROM v_violations WHERE confidence >= 0.35 GROUP BY 1)
SELECT u.recording_id, CASE WHEN n IS NULL THEN '审核完成，未发现违规内容。' WHEN u.recording_id%2=0 THEN 'model says'
  ELSE concat('发现 ', n, ' 条违规（高风险 ', h, ' 条，中风险 ', m, ' 条，低风险 ', l, ' 条）。') END AS summary FROM u LEFT JOIN c USING (recording_id)""",
)
def summaries(spark, folder):
    vs = v.violations(spark, folder)
    recordings = v.timeline(spark, folder).select("recording_id").distinct()
    said = recordings.withColumn("text", F.when(F.col("recording_id") % 2 == 0, "model says"))
    return violations.summaries(recordings, violations.confident(vs, 0.35), said)


CLUSTERED = v.VIOLATIONS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, sheet_id, rule_id ORDER BY timestamp_ms, seq) AS rn FROM v_violations),
cl AS (SELECT recording_id, sheet_id, rule_id, rn, timestamp_ms AS anchor, confidence AS a_conf, seq AS kept, 0 AS cluster_idx FROM o WHERE rn = 1
  UNION ALL SELECT o.recording_id, o.sheet_id, o.rule_id, o.rn,
    CASE WHEN o.timestamp_ms - cl.anchor < 604800000 THEN cl.anchor ELSE o.timestamp_ms END,
    CASE WHEN o.timestamp_ms - cl.anchor < 604800000 THEN cl.a_conf ELSE o.confidence END,
    CASE WHEN o.timestamp_ms - cl.anchor < 604800000 THEN CASE WHEN o.confidence > cl.a_conf THEN o.seq ELSE cl.kept END ELSE o.seq END,
    CASE WHEN o.timestamp_ms - cl.anchor < 604800000 THEN cl.cluster_idx ELSE cl.cluster_idx + 1 END
  FROM cl JOIN o ON o.recording_id = cl.recording_id AND o.sheet_id = cl.sheet_id AND o.rule_id = cl.rule_id AND o.rn = cl.rn + 1)"""


@check(
    "w5_anchored_dedup",
    "WITH RECURSIVE " + CLUSTERED + """,
k AS (SELECT recording_id, sheet_id, rule_id, cluster_idx, arg_max(kept, rn) AS seq FROM cl GROUP BY ALL)
SELECT v.recording_id, v.rule_id, v.seq, v.timestamp_ms, v.confidence FROM v_violations v SEMI JOIN k ON k.recording_id = v.recording_id AND k.seq = v.seq""",
)
def dedup(spark, folder):
    size = ordered.SLICE_MS
    return violations.deduplicated(v.violations(spark, folder), WEEK, slice_ms=size).select(
        "recording_id", "rule_id", "seq", "timestamp_ms", "confidence"
    )


@check(
    "w5_dedup_by_confidence",
    "WITH RECURSIVE " + CLUSTERED + """,
k AS (SELECT o.recording_id, o.sheet_id, o.rule_id, cluster_idx, arg_min(o.seq, (-o.confidence, o.rn)) AS seq FROM cl JOIN o USING (recording_id, sheet_id, rule_id, rn) GROUP BY ALL)
SELECT recording_id, rule_id, seq FROM k""",
)
def dedup_by_confidence(spark, folder):
    # always in slices, the form long recordings take
    return violations.deduplicated(v.violations(spark, folder), WEEK, "max_confidence").select("recording_id", "rule_id", "seq")


@check(
    "j4_nearest_screen_text",
    "WITH " + v.VIOLATIONS + "," + v.OCR + """,
n AS (SELECT v.recording_id, v.seq, o.text, o.frame_path, row_number() OVER (PARTITION BY v.recording_id, v.seq ORDER BY abs(o.timestamp_ms - v.timestamp_ms), o.seq) AS r
  FROM v_violations v JOIN v_ocr o ON o.recording_id = v.recording_id AND abs(o.timestamp_ms - v.timestamp_ms) <= 43200000
  WHERE v.source = 'transcript' AND v.evidence_text IS NULL)
SELECT v.recording_id, v.seq, coalesce(n.text, v.evidence_text) AS evidence_text, replace(n.frame_path, '/frames/', '') AS evidence_url
FROM v_violations v LEFT JOIN n ON n.recording_id = v.recording_id AND n.seq = v.seq AND n.r = 1""",
)
def nearest(spark, folder):
    size = ordered.SLICE_MS
    return evidence.nearest_screen_text(v.violations(spark, folder), v.ocr(spark, folder), 43_200_000, size).select(
        "recording_id", "seq", "evidence_text", "evidence_url"
    )


def exact_table(spark, folder):
    """A rule per event type, from the events: two of them exact, with keywords out of props."""
    e = v.violations(spark, folder)
    kinds = e.groupBy("sheet_id", "rule_id").agg(F.max("rule_content").alias("content"), F.max("original_text").alias("_kw"))
    return kinds.select(
        "sheet_id", F.col("rule_id").alias("rule_no"), "rule_id", "content",
        F.when(F.col("rule_id") <= 2, "exact").otherwise("semantic").alias("check_mode"),
        F.array(F.substring("_kw", 2, 6), F.lit("1}"), F.lit("7")).alias("keywords"),
        F.lit("high").alias("severity_default"),
    )


EXACT = """
xr AS (SELECT sheet_id, rule_id, max(rule_content) AS content, max(original_text) AS kw FROM v_violations GROUP BY sheet_id, rule_id),
v_exact AS (SELECT sheet_id, rule_id, content, [substring(kw, 2, 6), '1}', '7'] AS keywords FROM xr WHERE rule_id <= 2)"""


def two_sheets(recordings):
    """(recording_id, sheet_id): sheet 1, and sheet 2 too for every third recording."""
    one, two = (F.lit(k).cast("long") for k in (1, 2))
    listed = F.when(F.col("recording_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    return recordings.select("recording_id").distinct().select("recording_id", F.explode(listed).alias("sheet_id"))


# heard alike: 7 and 9
SOUNDS = {"9": "7", "7": "7"}


@check(
    "j7_exact_rule_verification",
    "WITH " + v.VIOLATIONS + "," + EXACT + """
SELECT v.recording_id, v.seq FROM v_violations v LEFT JOIN v_exact x ON x.sheet_id = v.sheet_id AND x.rule_id = v.rule_id
WHERE x.rule_id IS NULL OR len(list_filter(x.keywords, lambda k: contains(v.original_text, k) OR contains(translate(v.original_text, '9', '7'), translate(k, '9', '7')))) > 0""",
)
def verification(spark, folder):
    rows = violations.verified(v.violations(spark, folder), exact_table(spark, folder), SOUNDS)
    return rows.select("recording_id", "seq")


@check(
    "j16_u3_missed_exact_findings",
    "WITH " + v.VIOLATIONS + "," + EXACT + """,
d AS (SELECT doc_id AS recording_id, concat(substring(text, 1, 200), '7', text) AS text FROM documents WHERE doc_id%3=0
  UNION ALL SELECT doc_id, replace(text, ',', '9') FROM documents WHERE doc_id%3=1 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id%3=2),
sh AS (SELECT doc_id AS recording_id, 1 AS sheet_id FROM documents UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id%3=0),
p AS (SELECT recording_id, sheet_id, rule_id, content, keywords, text FROM d JOIN sh USING (recording_id) JOIN v_exact USING (sheet_id)
  WHERE NOT EXISTS (SELECT 1 FROM v_violations v WHERE v.recording_id = d.recording_id AND v.sheet_id = v_exact.sheet_id AND v.rule_id = v_exact.rule_id)),
h AS (SELECT *, list_min(list_filter(list_transform(keywords, lambda k, i: {'at': strpos(text, k), 'place': i - 1, 'word': k}), lambda s: s.at > 0)) AS hit,
  list_filter(keywords, lambda k: contains(translate(text, '9', '7'), translate(k, '9', '7')))[1] AS heard FROM p)
SELECT recording_id, CAST(sheet_id AS BIGINT) AS sheet_id, rule_id, content AS rule_content, CASE WHEN hit IS NOT NULL THEN concat('精确匹配检测到禁止用语「', hit.word, '」') ELSE concat('拼音匹配检测到禁止用语同音字（对应「', heard, '」）') END AS reason,
  CAST(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0.95 END AS DOUBLE) AS confidence,
  CASE WHEN hit IS NULL THEN left(text, 80) ELSE substring(text, greatest(hit.at - 80, 1), hit.at + 80 - greatest(hit.at - 80, 1)) END AS original_text
FROM h WHERE hit IS NOT NULL OR heard IS NOT NULL""",
)
def missed(spark, folder):
    texts = v.table(spark, folder, "documents").select(
        F.col("doc_id").alias("recording_id"),
        F.expr("CASE doc_id%3 WHEN 0 THEN concat(substring(text, 1, 200), '7', text) WHEN 1 THEN replace(text, ',', '9') ELSE text END").alias("text"),
    )
    rows = violations.missed_exact(texts, two_sheets(texts), v.violations(spark, folder), exact_table(spark, folder), SOUNDS)
    return rows.select("recording_id", "sheet_id", "rule_id", "rule_content", "reason", "confidence", "original_text")


def _updates(spark, folder):
    t = v.timeline(spark, folder)
    return t.select(
        "recording_id",
        (F.col("seq") - F.col("seq") % 3).alias("seq"),
        F.col("seq").alias("upd_seq"),
        F.expr("CASE seq%2 WHEN 0 THEN 'confirmed' ELSE 'rejected' END").alias("status"),
    )


@check(
    "j11_review_updates",
    "WITH " + v.VIOLATIONS + """,
u AS (SELECT recording_id, seq - seq%3 AS seq, arg_max(CASE seq%2 WHEN 0 THEN 'confirmed' ELSE 'rejected' END, seq) AS status FROM v_timeline GROUP BY 1, 2)
SELECT v.recording_id, v.seq, coalesce(u.status, v.status) AS status FROM v_violations v LEFT JOIN u ON u.recording_id = v.recording_id AND u.seq = v.seq""",
)
def review(spark, folder):
    return evidence.apply_review(v.violations(spark, folder), _updates(spark, folder)).select("recording_id", "seq", "status")


@check(
    "j11_batch_review_updates",
    "WITH " + v.VIOLATIONS + """,
h AS (SELECT recording_id, seq, timestamp_ms//3600000 AS timestamp_ms, rule_id, status FROM v_violations),
u AS (SELECT recording_id, timestamp_ms, rule_id, arg_max(CASE seq%3 WHEN 0 THEN 'confirmed' ELSE 'rejected' END, seq) AS status FROM h WHERE seq%4=0 GROUP BY ALL)
SELECT h.recording_id, h.seq, coalesce(u.status, h.status) AS status FROM h LEFT JOIN u USING (recording_id, timestamp_ms, rule_id)""",
)
def batch_review(spark, folder):
    h = v.violations(spark, folder).withColumn("timestamp_ms", F.floor(F.col("timestamp_ms") / 3_600_000))
    u = h.where("seq % 4 = 0").select(
        "recording_id", "timestamp_ms", "rule_id", F.col("seq").alias("upd_seq"),
        F.expr("CASE seq%3 WHEN 0 THEN 'confirmed' ELSE 'rejected' END").alias("status"),
    )
    return evidence.apply_batch_review(h, u).select("recording_id", "seq", "status")


@check(
    "j17_entry_context",
    "WITH " + v.TIMELINE + """,
e AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, seq) - 1 AS seq, timestamp_ms//86400000 AS timestamp_ms FROM v_timeline),
f AS (SELECT recording_id, timestamp_ms, min(seq) AS at FROM e GROUP BY ALL),
q AS (SELECT recording_id, seq AS violation_seq, timestamp_ms//86400000 AS t FROM v_timeline WHERE seq%2=0 AND seq%5<>0)
SELECT q.recording_id, q.violation_seq, e.seq, e.timestamp_ms = q.t AS is_current
FROM q JOIN f ON f.recording_id=q.recording_id AND f.timestamp_ms=q.t JOIN e ON e.recording_id=q.recording_id AND e.seq BETWEEN f.at-3 AND f.at+3""",
)
def context(spark, folder):
    day = F.floor(F.col("timestamp_ms") / 86_400_000)
    t = v.timeline(spark, folder)
    e = ordered.positions(t.withColumnRenamed("seq", "_s"), ["recording_id"], "timestamp_ms", "_s", "seq", v.SLICE)
    e = e.withColumn("timestamp_ms", day).select("recording_id", "seq", "timestamp_ms")
    found = v.violations(spark, folder).withColumn("timestamp_ms", day)
    return evidence.entry_context(found, e).select("recording_id", "violation_seq", "seq", "is_current")


@check(
    "o1_o2_findings_in_order",
    "WITH " + v.VIOLATIONS + """
SELECT recording_id, seq, row_number() OVER (PARTITION BY recording_id ORDER BY sheet_id, timestamp_ms//86400000, rule_id, seq) AS place FROM v_violations""",
)
def in_order(spark, folder):
    """Places as the sorted rows come, with whole days of tied times."""
    found = v.violations(spark, folder).withColumn("timestamp_ms", F.floor(F.col("timestamp_ms") / 86_400_000))
    listed = violations.in_time_order(found).select("recording_id", "seq", F.monotonically_increasing_id().alias("_at"))
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("_at"))
    return listed.select("recording_id", "seq", place.cast("long").alias("place"))


@check(
    "u2_distinct_screen_text",
    "WITH " + v.TIMELINE + "," + v.OCR + """,
d AS (SELECT recording_id, timestamp_ms//86400000 AS timestamp_ms, trim(split_part(text, ' ', 1)) AS text, seq, frame_path FROM v_ocr)
SELECT recording_id, timestamp_ms, text, min(seq) AS seq, arg_min(frame_path, seq) AS frame_path FROM d GROUP BY recording_id, timestamp_ms, text""",
)
def distinct_text(spark, folder):
    o = v.ocr(spark, folder).select(
        "recording_id", F.floor(F.col("timestamp_ms") / 86_400_000).alias("timestamp_ms"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("text"), "seq", "frame_path",
    )
    return evidence.distinct_screen_text(o)


# --- rules -----------------------------------------------------------------------

TOKENS = {1: ("the ", "and"), 2: ("les ", "que"), 3: ("und ", "ung", "die"), 4: ("con", "ción", "los "), 5: ("tion",)}


def _token_scores() -> str:
    scores = []
    for rule, words in TOKENS.items():
        terms = " + ".join(f"contains(text, '{w}')::INT" for w in words)
        scores.append(f"{{'score': {terms}, 'neg': -{rule}}}")
    return "list_max([" + ", ".join(scores) + "])"


@check(
    "j1_o4_rule_enrichment",
    f"""WITH s AS (SELECT doc_id, text, {_token_scores()} AS best FROM documents)
SELECT doc_id AS sheet_id, CAST(CASE WHEN best.score > 0 THEN -best.neg ELSE doc_id + 100 END AS BIGINT) AS rule_id, CAST(best.score AS BIGINT) AS score,
  CASE WHEN best.score > 0 THEN ['behavioral','behavioral','visual_check','behavioral','forbidden_phrase'][-best.neg] ELSE 'behavioral' END AS category,
  CASE WHEN best.score > 0 AND best.neg = -3 THEN 'visual' ELSE 'semantic' END AS check_mode,
  CASE WHEN best.score > 0 AND best.neg = -3 THEN 'ocr' WHEN best.score > 0 AND best.neg = -5 THEN 'transcript,ocr' ELSE 'transcript' END AS sources,
  CASE WHEN best.score > 0 THEN ['medium','medium','medium','high','high'][-best.neg] ELSE 'medium' END AS severity FROM s""",
)
def enrichment(spark, folder):
    d = v.table(spark, folder, "documents").select(
        F.col("doc_id").alias("sheet_id"), (F.col("doc_id") + 100).alias("rule_id"), F.col("text").alias("content")
    )
    return rules.enrich_rules(d, TOKENS).select(
        "sheet_id", "rule_id", F.col("score").cast("long").alias("score"), "category", "check_mode",
        F.array_join("evidence_sources", ",").alias("sources"), F.col("severity_default").alias("severity"),
    )


@check(
    "a10_rule_groups",
    f"""WITH s AS (SELECT doc_id, lang, {_token_scores()} AS best FROM documents)
SELECT lang AS sheet_id, CASE WHEN best.score > 0 AND best.neg = -3 THEN 'ocr' WHEN best.score > 0 AND best.neg = -5 THEN 'mixed' ELSE 'transcript' END AS group_name, count(*) AS n_rules
FROM s GROUP BY ALL""",
)
def groups(spark, folder):
    d = v.table(spark, folder, "documents").select(
        F.col("lang").alias("sheet_id"), F.col("doc_id").alias("rule_no"), F.col("doc_id").alias("rule_id"), F.col("text").alias("content")
    )
    enriched = rules.enrich_rules(d, TOKENS)
    return enriched.withColumn("group_name", rules.evidence_group(F.col("evidence_sources"))).groupBy("sheet_id", "group_name").agg(
        F.count(F.lit(1)).alias("n_rules")
    )
