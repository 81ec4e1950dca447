"""Recordings to transcripts, and text correction."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import responses as r
from talkledger.functions import text as t
from talkledger.operators import chunks, exchanges, matching, ordered, segments
from talkledger.operators.reports import StageTotals
from talkledger.operators.folds import Rule, greedy_groups
from talkledger.session import cut_lineage


def prepared_rows(rows: DataFrame, dictionary: Mapping[str, str] | DataFrame) -> DataFrame:
    """(recording_id, seg_idx, prepared) of (recording_id, seg_idx, text); null for noise.

    A text that cleaning does not change keeps its blanks at both ends. ``dictionary`` is a mapping, or a
    table (wrong, right) of any size, such as SRC4 reads.
    """
    made = t.computed(rows.select("recording_id", "seg_idx", "text"), _c=t.normalise("text"))
    made = made.withColumn("_n", F.when(F.col("_c") == t.strip("text"), F.col("text")).otherwise(F.col("_c"))).drop("_c")
    if isinstance(dictionary, DataFrame):
        return matching.replace_from_table(made, ["recording_id", "seg_idx"], dictionary, "_n", "prepared").select(
            "recording_id", "seg_idx", "prepared"
        )
    return t.computed(made, prepared=t.replace_words("_n", dictionary)).select(
        "recording_id", "seg_idx", "prepared"
    )


def correction_requests(
    prepared: DataFrame,
    max_rows: int = fixed.BATCH_ROWS,
    max_chars: int = fixed.BATCH_CHARS,
    slice_rows: int = ordered.SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(prepared rows with ``batch_idx``, one request per batch). Noise is in none."""
    live = prepared.where(F.col("prepared").isNotNull())
    rule = Rule(max_chars, max_rows=max_rows)
    groups = greedy_groups(
        live, ["recording_id"], "seg_idx", F.length("prepared"), rule, rows=slice_rows, out="batch_idx"
    )
    batched = prepared.join(groups, ["recording_id", "seg_idx"], "left")
    item = F.struct(F.col("seg_idx").alias("id"), F.col("prepared").alias("text"))
    requests = batched.where(F.col("batch_idx").isNotNull()).groupBy("recording_id", "batch_idx").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("entries"))).alias("prompt"),
        r.output_budget(F.sum(F.length("prepared"))).alias("max_tokens"),
    )
    return batched, requests


def corrected_rows(prepared: DataFrame, responses: DataFrame) -> DataFrame:
    """corrected text of every prepared row; its own when the response lacks it, "" for
    noise. ``responses`` is (recording_id, batch_idx, response)."""
    read = responses.select(
        "recording_id", "batch_idx", F.posexplode(r.corrections(F.col("response"))).alias("_pos", "_c")
    )
    last = read.groupBy("recording_id", "batch_idx", F.col("_c.id").alias("seg_idx")).agg(
        F.max_by("_c.text", "_pos").alias("_text")
    )
    keys = ["recording_id", "batch_idx", "seg_idx"]
    return prepared.join(last, keys, "left").select(
        "recording_id",
        "seg_idx",
        F.when(F.col("prepared").isNull(), "").otherwise(F.coalesce("_text", "prepared")).alias("text"),
    )


def correct_transcript(
    merged: DataFrame,
    dictionary: Mapping[str, str] | DataFrame,
    ask: Callable[..., str],
    threshold: float = fixed.TRUSTED_CONFIDENCE,
    width: int | None = None,
    keep_responses: bool = True,
    slice_rows: int = ordered.SLICE_ROWS,
    with_budget: bool = False,
    between: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """M3: P5, P3, P4, W7, M1, F9, J13. Adds ``text_corrected`` to merged segments.

    ``between`` changes the prepared rows (recording_id, seg_idx, prepared; null: noise) before they are
    batched, such as a light corrector does. ``with_budget``: ``ask`` also gets ``max_tokens`` (F11), the bound of the answer's length. Responses are written before they are read on (``keep_responses``): a lost executor
    must not call the model again.
    """
    gated = segments.needs_correction(merged, threshold).where("needs_correction")
    keep = cut_lineage if keep_responses else (lambda df: df)
    prepared = prepared_rows(gated, dictionary)
    prepared = keep(between(prepared) if between else prepared)
    batched, requests = correction_requests(prepared, slice_rows=slice_rows)
    options = ("max_tokens",) if with_budget else ()
    responses = keep(exchanges.call_model(requests, ask, width=width, options=options))
    return segments.overlay_corrections(merged, corrected_rows(batched, responses))


def correct_texts(
    texts: DataFrame,
    key: str,
    ask: Callable[[str], str],
    size: int = fixed.CHUNK_CHARS,
    overlap: int = fixed.CHUNK_OVERLAP,
    width: int | None = None,
    keep_responses: bool = True,
) -> DataFrame:
    """M4: W20, M1, W21. Blank texts stay; a chunk whose answer is blank or failed stays."""
    full = texts.where(~t.is_blank("text"))
    parts = exchanges.call_model(chunks.chunk_texts(full, key, "text", size, overlap), ask, "chunk", width=width)
    if keep_responses:
        parts = cut_lineage(parts)
    said = t.strip(r.strip_thinking(F.col("response")))
    parts = t.computed(parts, _said=said).withColumn("chunk", F.coalesce(F.nullif("_said", F.lit("")), "chunk"))
    merged = chunks.merge_chunks(parts, key, "chunk", overlap)
    return merged.unionByName(texts.where(t.is_blank("text")).select(key, "text"))


def correct_segments(
    rows: DataFrame,
    ask: Callable[[str], str],
    text: str = "text",
    out: str = "text_corrected",
    width: int | None = None,
    keep_responses: bool = True,
    delay_s: float = 2.0,
) -> DataFrame:
    """M4 for texts that are short as they are: one call each, no chunks, no overlap. Blank and null texts
    are not asked for; a text whose answer is blank or failed stays."""
    blank = F.coalesce(t.is_blank(text), F.lit(True))
    asked = exchanges.call_model(rows.where(~blank), ask, text, "_response", width, delay_s=delay_s)
    if keep_responses:
        asked = cut_lineage(asked)
    said = t.computed(asked, _said=t.strip(r.strip_thinking(F.col("_response"))))
    done = said.withColumn(out, F.coalesce(F.nullif("_said", F.lit("")), F.col(text))).select(*rows.columns, out)
    return done.unionByName(rows.where(blank).withColumn(out, F.col(text)))


def merged_segments(raw: DataFrame, gap_ms: int = 1000, slice_rows: int = ordered.SLICE_ROWS) -> DataFrame:
    """W4, W1 with the gap the recording flow uses."""
    return segments.merge_segments(segments.smooth_speakers(raw, rows=slice_rows), gap_ms, slice_rows)


def transcripts(
    raw: DataFrame,
    dictionary: Mapping[str, str] | DataFrame,
    ask: Callable[..., str],
    width: int | None = None,
    keep_responses: bool = True,
    slice_rows: int = ordered.SLICE_ROWS,
    with_budget: bool = False,
    seen: StageTotals | None = None,
) -> DataFrame:
    """Raw segments to transcript entries: W4, W1, M3, W12-W14. ``seen`` counts the merged segments
    while they are kept."""
    merged = merged_segments(raw, slice_rows=slice_rows)
    if keep_responses and seen is not None:
        merged = seen.watch("merged", merged, "text")
    if keep_responses:
        merged = cut_lineage(merged)
    corrected = correct_transcript(
        merged, dictionary, ask, width=width, keep_responses=keep_responses, slice_rows=slice_rows, with_budget=with_budget
    )
    return segments.transcript_entries(corrected, rows=slice_rows)
