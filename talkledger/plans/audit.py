"""Compliance audit of transcripts against rule sheets (M6)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import responses as r
from talkledger.functions import text as t
from talkledger.operators import evidence, exchanges, ordered, rules, segments, violations
from talkledger.session import cut_lineage, written


#: A recording has one report for each sheet it is audited against.
REPORT = ("recording_id", "sheet_id")


@dataclass(frozen=True)
class AuditLimits:
    #: Characters of a recording that are looked at; None: all.
    max_chars: int | None = None
    chunk_chars: int = fixed.AUDIT_CHUNK_CHARS
    ocr_margin_ms: int = fixed.OCR_MARGIN_MS
    evidence_margin_ms: int = fixed.EVIDENCE_MARGIN_MS
    confidence: float = fixed.VIOLATION_CONFIDENCE
    dedup_window_ms: int = fixed.DEDUP_WINDOW_MS
    group_by_source: bool = True
    #: How often a prompt is asked while its answer cannot be read.
    attempts: int = 2
    slice_rows: int = ordered.SLICE_ROWS


def chunked_entries(entries: DataFrame, limits: AuditLimits = AuditLimits()) -> DataFrame:
    """W6, after W15 where the limits name a budget."""
    kept = entries
    if limits.max_chars is not None:
        kept = segments.within_budget(entries, budget=limits.max_chars, rows=limits.slice_rows)
    return segments.pack_by_chars(kept, "seq", "text_corrected", limits.chunk_chars, rows=limits.slice_rows)


def audit_requests(
    chunked: DataFrame,
    sheets: DataFrame,
    enriched: DataFrame,
    examples: DataFrame,
    ocr: DataFrame,
    words: exchanges.PromptWords = exchanges.PromptWords(),
    limits: AuditLimits = AuditLimits(),
) -> DataFrame:
    """(recording_id, chunk_idx, sheet_id, group_name, prompt).

    ``sheets`` is (recording_id, sheet_id).
    """
    # written, so that the planner knows how few bytes it is and takes it to the prompts, not them to it
    groups = written(rules.rules_text(enriched, limits.group_by_source), "rule-groups")
    known = written(rules.first_examples(examples), "examples")
    places = chunked.select("recording_id", "chunk_idx").distinct().join(sheets, "recording_id")
    work = exchanges.audit_work(places, groups.drop("rules_text"), ocr)
    seen = evidence.screen_text_of_chunks(chunked, ocr, limits.ocr_margin_ms)
    prompts = exchanges.audit_prompts(work, chunked, seen, known, words, groups)
    return prompts.select("recording_id", "chunk_idx", "sheet_id", "group_name", "prompt")


def read_findings(responses: DataFrame, chunked: DataFrame, enriched: DataFrame) -> DataFrame:
    """Findings of (recording_id, chunk_idx, sheet_id, group_name, response).

    ``seq`` orders them as the reference lists them: by group, chunk and place.
    """
    value = r.parsed(r.json_array_text(r.strip_thinking(F.col("response"))))
    found = responses.select(
        "recording_id", "chunk_idx", "sheet_id", "group_name",
        F.posexplode(r.finding_items(value)).alias("_place", "_item"),
    )
    found = t.computed(found, _f=r.finding(F.col("_item")))
    group = F.array_position(F.array(*[F.lit(g) for g in rules.GROUP_ORDER]), F.col("group_name")) - 1
    found = found.select(
        "recording_id", "chunk_idx", "sheet_id", "group_name",
        (group * (1 << 56) + F.col("chunk_idx") * (1 << 24) + F.col("_place")).alias("seq"),
        "_f.*",
    )
    by_group = rules.evidence_group(F.col("evidence_sources"))
    known = enriched.withColumn("_g", by_group).groupBy("sheet_id", F.col("_g").alias("group_name"), "rule_id").agg(
        F.max_by("content", "rule_no").alias("_known")
    )
    known = known.unionByName(
        enriched.withColumn("group_name", F.lit("all"))
        .groupBy("sheet_id", "group_name", "rule_id")
        .agg(F.max_by("content", "rule_no").alias("_known"))
    )
    found = found.join(known, ["sheet_id", "group_name", "rule_id"], "left").withColumn(
        "rule_content", F.coalesce(F.nullif("rule_content", F.lit("")), "_known", F.lit(""))
    )
    timed = evidence.precise_times(found, chunked)
    return timed.withColumn("source", F.lit("transcript")).withColumn("status", F.lit("pending")).select(
        "recording_id", "sheet_id", "seq", "rule_id", "rule_content", "reason", "severity", "confidence",
        "status", "timestamp", "timestamp_ms", "end_ms", "speaker", "original_text", "source",
        *[F.lit(None).cast("string").alias(c) for c in ("evidence_url", "evidence_text", "rule_ref")],
        "reasoning",
    )


def filtered(
    found: DataFrame,
    enriched: DataFrame,
    texts: DataFrame,
    sheets: DataFrame,
    ocr: DataFrame,
    sounds: Mapping[str, str] | DataFrame | None = None,
    limits: AuditLimits = AuditLimits(),
) -> DataFrame:
    """The filter chain: P8, J7, J16, W5, J4, each within a recording and a sheet.

    ``texts`` is (recording_id, text), ``sheets`` (recording_id, sheet_id). Every step reads the findings more than once, so they are written in between; they are
    few against the texts they come from.
    """
    good = cut_lineage(violations.verified(violations.confident(found, limits.confidence), enriched, sounds))
    added = violations.missed_exact(texts, sheets, good, enriched, sounds)
    every = cut_lineage(good.unionByName(added))
    single = cut_lineage(violations.deduplicated(every, limits.dedup_window_ms))
    return evidence.nearest_screen_text(single, ocr, limits.evidence_margin_ms)


def full_texts(chunked: DataFrame, limits: AuditLimits = AuditLimits()) -> DataFrame:
    """Audited text of each recording (bounded by the character budget)."""
    return ordered.joined_text(chunked, ["recording_id"], "seq", F.col("text_corrected"), " ", "text", limits.slice_rows)


def reports(
    sheets: DataFrame, chunked: DataFrame, enriched: DataFrame, kept: DataFrame, model_text: DataFrame | None = None
) -> DataFrame:
    """A1, A2, A4: one report row per audited recording and sheet."""
    n_rules = enriched.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("total_rules"))
    n_entries = chunked.groupBy("recording_id").agg(F.count(F.lit(1)).alias("total_segments_checked"))
    rows = sheets.join(n_rules, "sheet_id", "left").join(n_entries, "recording_id", "left")
    rows = violations.scores(rows, kept, keys=REPORT)
    rows = violations.summaries(rows, kept, model_text, REPORT)
    empty = F.create_map().cast("map<string,bigint>")
    rows = rows.join(violations.source_counts(kept, REPORT), list(REPORT), "left")
    return rows.withColumn("source_counts", F.coalesce("source_counts", empty)).fillna(
        0, ["total_rules", "total_segments_checked"]
    )


def audit(
    entries: DataFrame,
    sheets: DataFrame,
    enriched: DataFrame,
    examples: DataFrame,
    ocr: DataFrame,
    ask: Callable[[str], str],
    sounds: Mapping[str, str] | DataFrame | None = None,
    words: exchanges.PromptWords = exchanges.PromptWords(),
    width: int | None = None,
    limits: AuditLimits = AuditLimits(),
    summarise: Callable[[str], str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """M6: (findings, reports). Responses are checkpointed: calls are not repeatable."""
    chunked = cut_lineage(chunked_entries(entries, limits))
    requests = audit_requests(chunked, sheets, enriched, examples, ocr, words, limits)
    readable = r.parsed(r.json_array_text(r.strip_thinking(F.col("response")))).isNotNull()

    def asked(rows: DataFrame) -> DataFrame:
        answered = exchanges.call_model(rows, ask, width=width)
        answered = t.computed(answered, readable=F.coalesce(readable, F.lit(False)))
        # a prompt that was answered is not needed again
        return cut_lineage(answered.withColumn("prompt", F.when(~F.col("readable"), F.col("prompt"))))

    last = asked(requests)
    answers = last.where("readable")
    for k in range(1, limits.attempts):
        unread = last.where(~F.col("readable")).drop("response", "readable")
        if k == 1:
            unread = unread.withColumn("prompt", F.concat_ws("\n\n", "prompt", F.lit(words.again)))
        last = asked(unread)
        answers = answers.unionByName(last.where("readable"))
    found = read_findings(answers, chunked, enriched)
    kept = cut_lineage(filtered(found, enriched, full_texts(chunked, limits), sheets, ocr, sounds, limits))
    said = None
    if summarise is not None:
        line = F.format_string("- [%s] [%s] %d: %s", "timestamp", "severity", "rule_id", "reason")
        place = F.struct("timestamp_ms", "rule_id", "seq", line.alias("line"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["line"]), "\n")
        n_rules = enriched.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("_rules"))
        rows = kept.groupBy(*REPORT).agg(F.count(F.lit(1)).alias("_found"), lines.alias("_lines")).join(n_rules, "sheet_id")
        rows = rows.select(*REPORT, F.format_string(words.summary, "_rules", "_found", "_lines").alias("prompt"))
        said = cut_lineage(exchanges.call_model(rows, summarise, width=width)).select(
            *REPORT, t.strip(r.strip_thinking(F.col("response"))).alias("text")
        )
    return kept, reports(sheets, chunked, enriched, kept, said)
