"""Findings: the filter chain, scores, reports, review views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import text as t
from talkledger.functions import times
from talkledger.operators import matching
from talkledger.operators import ordered as o
from talkledger.operators.folds import Rule, greedy_groups
from talkledger.operators.rules import exact_rules

ADDED_SEQ = 1 << 60
#: What findings are told apart by: a recording may be audited against several sheets.
RULE = ("recording_id", "sheet_id", "rule_id")
REPORT = ("recording_id",)


def confident(violations: DataFrame, threshold: float = fixed.VIOLATION_CONFIDENCE) -> DataFrame:
    """P8, inclusive."""
    return violations.where(F.col("confidence") >= threshold)


def verified(
    violations: DataFrame, rules: DataFrame, sounds: Mapping[str, str] | DataFrame | None = None
) -> DataFrame:
    """Findings of exact rules stay only if their quote holds a keyword, or (J8) one
    that sounds like it. Other findings pass."""
    exact = exact_rules(rules).select("sheet_id", "rule_id", "keywords")
    quote = F.coalesce("original_text", F.lit(""))
    holds = F.exists("keywords", lambda k: F.contains(quote, k))
    rows = violations.join(exact, ["sheet_id", "rule_id"], "left")
    if isinstance(sounds, DataFrame):
        # joined once, since a lambda takes no subquery: a mark that no keyword holds keeps them apart
        mark = chr(0x10FFFD)
        rows = rows.withColumn("_heard", matching.heard(quote, sounds)).withColumn(
            "_sounds", F.split(matching.heard(F.array_join("keywords", mark), sounds), mark)
        )
        holds = holds | F.exists("_sounds", lambda k: F.contains("_heard", k))
    elif sounds:
        holds = holds | t.first_sounding_keyword(quote, F.col("keywords"), sounds).isNotNull()
    return rows.where(F.col("keywords").isNull() | holds).select(*violations.columns)


def missed_exact(
    texts: DataFrame,
    sheets: DataFrame,
    violations: DataFrame,
    rules: DataFrame,
    sounds: Mapping[str, str] | DataFrame | None = None,
    radius: int = fixed.CONTEXT_CHARS,
) -> DataFrame:
    """Exact rules of a recording's sheets without a finding, searched in the whole text.

    ``texts`` is (recording_id, text), ``sheets`` (recording_id, sheet_id). All keywords of all sheets are
    looked up in a text at once; only what was found then meets sheets and rules, by ids.
    """
    placed = exact_rules(rules).select(
        "sheet_id", "rule_id", "rule_content", "severity", F.posexplode("keywords").alias("_place", "keyword")
    )
    hits = matching.keyword_hits(texts, placed, ["recording_id"], "text", sounds, radius)
    reported = violations.select("recording_id", "sheet_id", "rule_id").distinct()
    found = hits.join(sheets.select("recording_id", "sheet_id").distinct(), "recording_id").join(placed, ["sheet_id", "keyword"])
    written = F.when(F.col("at") > 0, F.struct("at", F.col("_place").alias("place"), F.col("keyword").alias("word"), "context"))
    sounded = F.struct(F.col("_place").alias("place"), F.col("keyword").alias("word"), "context")
    best = found.groupBy("recording_id", "sheet_id", "rule_id").agg(
        F.min(written).alias("_hit"), F.min(sounded).alias("_heard"),
        F.first("rule_content").alias("rule_content"), F.first("severity").alias("severity"),
    )
    rows = best.join(reported, ["recording_id", "sheet_id", "rule_id"], "left_anti")
    seen = F.col("_hit").isNotNull()
    return rows.select(
        "recording_id",
        "sheet_id",
        (F.lit(ADDED_SEQ) + F.col("rule_id")).alias("seq"),
        "rule_id",
        "rule_content",
        F.when(seen, F.format_string(fixed.EXACT_REASON, "_hit.word"))
        .otherwise(F.format_string(fixed.SOUND_REASON, "_heard.word"))
        .alias("reason"),
        "severity",
        F.when(seen, 1.0).otherwise(0.95).alias("confidence"),
        F.lit("pending").alias("status"),
        F.lit("00:00").alias("timestamp"),
        F.lit(0).cast("long").alias("timestamp_ms"),
        F.lit(0).cast("long").alias("end_ms"),
        F.lit("").alias("speaker"),
        F.when(seen, F.col("_hit.context")).otherwise(F.col("_heard.context")).alias("original_text"),
        F.lit("transcript").alias("source"),
        *[F.lit(None).cast("string").alias(c) for c in ("evidence_url", "evidence_text", "rule_ref", "reasoning")],
    )


def clusters(
    violations: DataFrame, window_ms: int = fixed.DEDUP_WINDOW_MS, slice_ms: int = o.SLICE_MS
) -> DataFrame:
    """Anchored clusters of one rule's findings: (recording, sheet, rule, time) to ``cluster_idx``.

    Works on distinct times, so a slice holds at most its width in ms of rows, however many
    findings share one time.
    """
    keys = list(RULE)
    distinct = violations.select(*keys, "timestamp_ms").distinct()
    # a slice spans several windows, so that few of its times can be the first cut
    width = max(8 * window_ms, slice_ms)
    rule = Rule(window_ms, anchored=True, rising=True)
    return greedy_groups(
        distinct, keys, "timestamp_ms", F.col("timestamp_ms"), rule, rows=width, out="cluster_idx"
    )


def deduplicated(
    violations: DataFrame,
    window_ms: int = fixed.DEDUP_WINDOW_MS,
    keep: str = "last_above_anchor",
    slice_ms: int = o.SLICE_MS,
) -> DataFrame:
    """One finding per cluster of a recording, a sheet and a rule. ``last_above_anchor``: the last one more confident than
    the cluster's first, else the first. ``max_confidence``: the most confident one."""
    keys = list(RULE)
    cluster = [*keys, "cluster_idx"]
    narrow = violations.select(*keys, "timestamp_ms", "seq", "confidence").join(
        clusters(violations, window_ms, slice_ms), [*keys, "timestamp_ms"]
    )
    place = F.struct("timestamp_ms", "seq")
    if keep == "max_confidence":
        best = F.min_by("seq", F.struct(-F.col("confidence"), F.col("timestamp_ms"), F.col("seq")))
        kept = narrow.groupBy(*cluster).agg(best.alias("seq"))
    else:
        anchor = narrow.groupBy(*cluster).agg(
            F.min_by("seq", place).alias("_seq"), F.min_by("confidence", place).alias("_conf")
        )
        above = F.when(F.col("confidence") > F.col("_conf"), place)
        kept = (
            narrow.join(anchor, cluster)
            .groupBy(*cluster)
            .agg(F.coalesce(F.max_by(F.col("seq"), above), F.min("_seq")).alias("seq"))
        )
    return violations.join(kept.select("recording_id", "sheet_id", "seq"), ["recording_id", "sheet_id", "seq"], "left_semi")


def in_time_order(violations: DataFrame) -> DataFrame:
    """O1: the reference's stable sort of each report, with its tie-break written out."""
    return violations.orderBy("recording_id", "sheet_id", "timestamp_ms", "rule_id", "seq")


def search_violations(
    violations: DataFrame,
    query: str = "",
    severity: str = "all",
    status: str = "all",
    source: str = "all",
) -> DataFrame:
    """Filters by equality, and a case-insensitive substring in four texts."""
    rows = violations
    for name, wanted in (("severity", severity), ("status", status), ("source", source)):
        if wanted != "all":
            rows = rows.where(F.col(name) == wanted)
    if t_query := query.lower():
        if query.strip():
            fields = ("reason", "original_text", "rule_content", "evidence_text")
            hit = F.lit(False)
            for name in fields:
                hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(t_query)), F.lit(False))
            rows = rows.where(hit)
    return rows


def with_report_defaults(violations: DataFrame) -> DataFrame:
    """P13."""
    return violations.withColumn(
        "status", F.coalesce(F.nullif("status", F.lit("")), F.lit("pending"))
    ).withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("transcript")))


def review_clips(violations: DataFrame) -> DataFrame:
    """P12."""
    return violations.withColumn("clip_start_ms", times.clip_start(F.col("timestamp_ms"))).withColumn(
        "clip_end_ms", times.clip_end(F.col("timestamp_ms"), F.col("end_ms"))
    )


def _points() -> Column:
    points = F.lit(fixed.OTHER_POINTS)
    for severity, value in fixed.SEVERITY_POINTS.items():
        points = F.when(F.col("severity") == severity, value).otherwise(points)
    return points


def scores(
    recordings: DataFrame, violations: DataFrame, exclude_rejected: bool = False, keys: Sequence[str] = REPORT
) -> DataFrame:
    """A1: 100 minus points per finding, not below 0; 100 without findings. ``keys`` name a report."""
    rows = violations.where(F.col("status") != "rejected") if exclude_rejected else violations
    lost = rows.groupBy(*keys).agg(F.sum(_points()).alias("_lost"))
    score = F.greatest(F.round(100.0 - F.coalesce("_lost", F.lit(0.0)), 1), F.lit(0.0))
    return recordings.join(lost, list(keys), "left").withColumn("compliance_score", score).drop("_lost")


def source_counts(violations: DataFrame, keys: Sequence[str] = REPORT) -> DataFrame:
    """A2: report to map of source counts."""
    counts = violations.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "_n")))).alias("source_counts")
    )


def dashboard(violations: DataFrame) -> DataFrame:
    """A3: all counters of the review page in one pass (the categories are fixed)."""

    def n(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value).alias(f"n_{value}")

    return violations.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_all"),
        *[n("severity", s) for s in fixed.SEVERITIES],
        *[n("source", s) for s in ("transcript", "ocr", "vision")],
        n("status", "pending"),
    )


def summaries(
    recordings: DataFrame, violations: DataFrame, model_text: DataFrame | None = None, keys: Sequence[str] = REPORT
) -> DataFrame:
    """A4: fixed sentence without findings, else the model's text, else counts.

    ``model_text`` is (keys, text), text null when the call failed.
    """
    counts = violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in fixed.SEVERITIES],
    )
    rows = recordings.join(counts, list(keys), "left")
    said = F.lit(None).cast("string")
    if model_text is not None:
        rows = rows.join(model_text.select(*keys, F.col("text").alias("_said")), list(keys), "left")
        said = F.col("_said")
    counted = F.format_string(fixed.COUNT_SUMMARY, "_all", "_high", "_medium", "_low")
    text = F.when(F.col("_all").isNull(), fixed.NO_FINDING_SUMMARY).otherwise(F.coalesce(said, counted))
    return rows.withColumn("summary", text).drop("_all", "_high", "_medium", "_low", "_said")
