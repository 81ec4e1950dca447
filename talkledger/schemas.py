"""Spark schemas of the tables this library reads and writes."""

SUB_SENTENCES = "ARRAY<STRUCT<text: STRING, start_ms: BIGINT, end_ms: BIGINT>>"
SEGMENTS = (
    "recording_id BIGINT, seg_idx BIGINT, text STRING, start_ms BIGINT, end_ms BIGINT, "
    f"confidence DOUBLE, speaker INT, sub_sentences {SUB_SENTENCES}"
)
ENTRY = (
    "timestamp STRING, timestamp_ms BIGINT, end_ms BIGINT, speaker STRING, text STRING, "
    "text_corrected STRING"
)
ENTRIES = f"recording_id BIGINT, seq BIGINT, {ENTRY}"
KEYFRAME = "index INT, timestamp_ms BIGINT, path STRING"
OCR_RECORD = (
    "timestamp_ms BIGINT, text STRING, confidence DOUBLE, frame_path STRING, bbox ARRAY<ARRAY<INT>>"
)
VISUAL_EVENT = (
    "event_type STRING, start_ms BIGINT, end_ms BIGINT, confidence DOUBLE, frame_path STRING"
)
RULE = "id INT, content STRING"
VIOLATION = (
    "rule_id INT, rule_content STRING, reason STRING, severity STRING, confidence DOUBLE, "
    "status STRING, timestamp STRING, timestamp_ms BIGINT, end_ms BIGINT, speaker STRING, "
    "original_text STRING, source STRING, evidence_url STRING, evidence_text STRING, "
    "rule_ref STRING, reasoning STRING"
)
REPORT = (
    "total_rules INT, total_segments_checked INT, "
    "violations ARRAY<STRUCT<" + VIOLATION.replace(" STRING", ": STRING").replace(" INT", ": INT")
    .replace(" BIGINT", ": BIGINT").replace(" DOUBLE", ": DOUBLE") + ">>, "
    "summary STRING, compliance_score DOUBLE, source_counts MAP<STRING, BIGINT>"
)


def _struct(fields: str) -> str:
    out, depth, start, parts = [], 0, 0, []
    for i, c in enumerate(fields + ","):
        depth += c == "<"
        depth -= c == ">"
        if c == "," and depth == 0:
            parts.append(fields[start:i].strip())
            start = i + 1
    for part in parts:
        name, kind = part.split(" ", 1)
        out.append(f"{name}: {kind}")
    return f"STRUCT<{', '.join(out)}>"


EVALUATION = (
    "meta STRUCT<title: STRING, category: STRING, keywords: ARRAY<STRING>>, "
    "scores STRUCT<logic: BIGINT, info_density: BIGINT, expression: BIGINT, total: BIGINT>, "
    "analysis STRUCT<main_points: ARRAY<STRING>, key_data: ARRAY<STRING>, sentiment: STRING>, "
    "summary STRING"
)
META = (
    "filename STRING, hash STRING, audio_suffix STRING, media_type STRING, created_at STRING, "
    "video_suffix STRING"
)

#: Artifact file to the schema its JSON is read with.
ARTIFACTS = {
    "transcript.json": f"transcript ARRAY<{_struct(ENTRY)}>, processing_time_ms DOUBLE",
    "keyframes.json": f"ARRAY<{_struct(KEYFRAME)}>",
    "ocr_results.json": f"ARRAY<{_struct(OCR_RECORD)}>",
    "visual_events.json": f"ARRAY<{_struct(VISUAL_EVENT)}>",
    "compliance.json": f"rules ARRAY<{_struct(RULE)}>, report {_struct(REPORT)}, processing_time_ms DOUBLE",
    "evaluation.json": EVALUATION,
    "meta.json": META,
}
