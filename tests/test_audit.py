"""The whole audit with a stand-in model."""

import json
import sys

from pyspark import cloudpickle

from talkledger.plans import audit

# the model below is called in tasks, which cannot import the tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = [
    (1, 0, "00:30", 30_000, 45_000, "Speaker 1", "a", "欢迎各位"),
    (1, 1, "01:00", 60_000, 75_000, "Speaker 1", "b", "这个产品稳赚"),
    (1, 2, "01:30", 90_000, 105_000, "Speaker 1", "c", "还有利息可拿"),
    (2, 0, "00:30", 30_000, 45_000, "Speaker 1", "d", "一切正常"),
]
RULES = [
    (7, 1, 5, "no promises", "semantic", ["transcript", "ocr"], [], "", "high"),
    (7, 2, 12, "no interest", "exact", ["transcript", "ocr"], ["利息"], "only the word", "high"),
    (7, 3, 3, "show terms", "visual", ["ocr"], [], "", "medium"),
]


def model(prompt):
    if "欢迎" not in prompt or "5. [semantic]" not in prompt:
        return "[]"
    finding = {"rule_id": "5", "timestamp": "01:00", "timestamp_ms": 1, "severity": "HIGH", "confidence": 0.95,
               "original_text": "稳赚", "reason": "promise", "speaker": "Speaker 1"}
    weak = {**finding, "timestamp": "00:30", "confidence": 0.69}
    unsure = {**finding, "rule_id": 12, "original_text": "no such word", "confidence": 0.9}
    return f"<think>...</think>```json\n{json.dumps([finding, weak, unsure])}\n```"


def test_audit(spark):
    entries = spark.createDataFrame(
        ENTRIES, "recording_id long, seq long, timestamp string, timestamp_ms long, end_ms long, speaker string, text string, text_corrected string"
    )
    rules = spark.createDataFrame(
        RULES, "sheet_id long, rule_no long, rule_id long, content string, check_mode string, evidence_sources array<string>, "
        "keywords array<string>, description string, severity_default string",
    )
    sheets = spark.createDataFrame([(1, 7), (2, 7)], "recording_id long, sheet_id long")
    examples = spark.createDataFrame([], "sheet_id long, rule_no long, cell_no long, example string")
    ocr = spark.createDataFrame([(1, 0, 62_000, "年化", 0.9, "/f/9.jpg")], "recording_id long, seq long, timestamp_ms long, text string, confidence double, frame_path string")
    prompts = audit.audit_requests(audit.chunked_entries(entries), sheets, rules, examples, ocr).collect()
    groups = {(p.recording_id, p.group_name) for p in prompts}
    assert groups == {(1, "mixed"), (1, "ocr"), (2, "mixed")}
    assert all('[01:02] "年化"' in p.prompt for p in prompts if p.recording_id == 1)
    kept, reports = audit.audit(entries, sheets, rules, examples, ocr, model)
    got = kept.orderBy("timestamp_ms", "rule_id").collect()
    # the weak finding goes, the unproven one is dropped and found again in the whole text
    assert [(x.rule_id, x.timestamp_ms, x.end_ms, x.confidence) for x in got] == [(12, 0, 0, 1.0), (5, 60_000, 75_000, 0.95)]
    assert got[0].original_text == "欢迎各位 这个产品稳赚 还有利息可拿" and got[0].evidence_text is None
    assert (got[1].severity, got[1].rule_content, got[1].evidence_text, got[1].evidence_url) == ("high", "no promises", "年化", "9.jpg")
    _, summed = audit.audit(entries, sheets, rules, examples, ocr, model, summarise=lambda prompt: prompt)
    assert summed.where("recording_id = 1").first().summary == (
        "3 rules, 2 findings\n- [00:00] [high] 12: " + got[0].reason + "\n- [01:00] [high] 5: promise"
    )
    rows = {x.recording_id: x for x in reports.collect()}
    assert (rows[1].compliance_score, rows[1].total_rules, rows[1].total_segments_checked, rows[1].source_counts) == (70.0, 3, 3, {"transcript": 2})
    assert (rows[2].compliance_score, rows[2].source_counts, rows[2].total_segments_checked) == (100.0, {}, 1)


def test_audit_without_readable_answers(spark):
    entries = spark.createDataFrame(
        ENTRIES[3:], "recording_id long, seq long, timestamp string, timestamp_ms long, end_ms long, speaker string, text string, text_corrected string"
    )
    rules = spark.createDataFrame(
        RULES, "sheet_id long, rule_no long, rule_id long, content string, check_mode string, evidence_sources array<string>, "
        "keywords array<string>, description string, severity_default string",
    )
    sheets = spark.createDataFrame([(2, 7)], "recording_id long, sheet_id long")
    examples = spark.createDataFrame([(7, 1, 0, "seen once")], "sheet_id long, rule_no long, cell_no long, example string")
    ocr = spark.createDataFrame([], "recording_id long, seq long, timestamp_ms long, text string, confidence double, frame_path string")
    kept, reports = audit.audit(entries, sheets, rules, examples, ocr, lambda prompt: "no json")
    assert kept.count() == 0 and reports.first().compliance_score == 100.0
    finding = '[{"rule_id": 5, "timestamp_ms": 30000, "confidence": 0.9, "original_text": "一切正常"}]'
    asked_again = lambda prompt: finding if prompt.endswith("any other text.") and "5. [semantic]" in prompt else "no json"
    kept, _ = audit.audit(entries, sheets, rules, examples, ocr, asked_again)
    assert [x.rule_id for x in kept.collect()] == [5]


def test_rule_texts_join_prompts_last_and_go_no_further(spark, monkeypatch):
    entries = spark.createDataFrame([(1, 0, "00:00", 0, 5, "S", "a", "a")], "recording_id long, seq long, timestamp string, timestamp_ms long, end_ms long, speaker string, text string, text_corrected string")
    rules = spark.createDataFrame([(7, 1, 5, "LONG TEXT", "semantic", ["transcript"], [], "", "high")], "sheet_id long, rule_no long, rule_id long, content string, check_mode string, "
                                  "evidence_sources array<string>, keywords array<string>, description string, severity_default string")
    sheets = spark.createDataFrame([(1, 7)], "recording_id long, sheet_id long")
    examples = spark.createDataFrame([], "sheet_id long, rule_no long, cell_no long, example string")
    ocr = spark.createDataFrame([], "recording_id long, seq long, timestamp_ms long, text string, confidence double, frame_path string")
    asked, call = [], audit.exchanges.call_model
    monkeypatch.setattr(audit.exchanges, "call_model", lambda rows, *args, **more: asked.append(rows) or call(rows, *args, **more))
    audit.audit(entries, sheets, rules, examples, ocr, lambda prompt: "[]")
    assert asked[0].columns == ["recording_id", "chunk_idx", "sheet_id", "group_name", "prompt"]
    assert "LONG TEXT" in asked[0].first().prompt
