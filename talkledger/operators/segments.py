"""Segments of a recording: smoothing, merging, splitting, confidence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import text as t
from talkledger.functions import times
from talkledger.operators import ordered as o
from talkledger.operators.batches import pieces
from talkledger.operators.folds import Rule, greedy_groups

RECORDING = ("recording_id",)


def smooth_speakers(
    segments: DataFrame, max_ms: int = fixed.SMOOTH_MS, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """A short segment between two of one other speaker takes that speaker.

    The speaker before is the *smoothed* one. A row can flip only when both original
    neighbours agree and differ from it, and a flip rules out one on the next row; so
    inside a run of such rows exactly the 1st, 3rd, 5th ... flip. That needs the length
    of the run so far and no sequential pass.
    """
    seen = o.scan(
        o.sliced(segments, "seg_idx", rows),
        RECORDING,
        "seg_idx",
        {
            "_before": o.previous(F.col("speaker")),
            "_after": o.following(F.col("speaker")),
            "_row": o.running(F.lit(1)),
        },
        rows,
    )
    short = F.col("end_ms") - F.col("start_ms") < max_ms
    flip = F.coalesce(
        (F.col("_before") == F.col("_after")) & (F.col("speaker") != F.col("_before")) & short,
        F.lit(False),
    )
    seen = seen.withColumn("_can", flip)
    runs = o.scan(
        seen, RECORDING, "seg_idx", {"_kept": o.latest(F.when(~F.col("_can"), F.col("_row")))}, rows
    )
    odd = (F.col("_row") - F.col("_kept")) % 2 == 1
    return runs.withColumn(
        "speaker", F.when(F.col("_can") & odd, F.col("_before")).otherwise(F.col("speaker"))
    ).select(*segments.columns)


def merge_segments(
    segments: DataFrame, gap_ms: int = fixed.MERGE_GAP_MS, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Neighbours of one speaker closer than ``gap_ms`` become one segment."""
    runs = o.islands(
        segments,
        RECORDING,
        "seg_idx",
        ["speaker", "start_ms", "end_ms"],
        lambda before, here: (before("speaker") != here("speaker"))
        | (here("start_ms") - before("end_ms") >= gap_ms),
        rows=rows,
    ).withColumn("_len", F.length("text"))
    merged = runs.groupBy("recording_id", "island").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seg_idx)").alias("text"),
        F.min_by("start_ms", "seg_idx").alias("start_ms"),
        F.max_by("end_ms", "seg_idx").alias("end_ms"),
        F.sum(F.col("confidence") * F.col("_len")).alias("_weighted"),
        F.sum("_len").alias("_len"),
        F.min_by("confidence", "seg_idx").alias("_first"),
        F.min_by("speaker", "seg_idx").alias("speaker"),
        F.array_sort(F.collect_list(F.struct("seg_idx", "text", "start_ms", "end_ms"))).alias("_subs"),
    )
    return merged.select(
        "recording_id",
        F.col("island").alias("seg_idx"),
        F.coalesce("text", F.lit("")).alias("text"),
        "start_ms",
        "end_ms",
        F.when(F.col("_len") > 0, F.try_divide("_weighted", "_len"))
        .otherwise(F.col("_first"))
        .alias("confidence"),
        "speaker",
        F.transform("_subs", lambda s: s.dropFields("seg_idx")).alias("sub_sentences"),
    )


def view_blocks(
    entries: DataFrame, gap_ms: int = fixed.VIEW_GAP_MS, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Display blocks; a block ends where its last entry ends (or starts)."""
    return (
        with_blocks(entries, gap_ms, rows)
        .groupBy("recording_id", "block_idx")
        .agg(
            F.min_by("speaker", "seq").alias("speaker"),
            F.min_by("timestamp_ms", "seq").alias("start_ms"),
            F.max_by(times.or_else(F.col("end_ms"), F.col("timestamp_ms")), F.col("seq")).alias("end_ms"),
            F.array_sort(
                F.collect_list(F.struct("seq", "timestamp_ms", "end_ms", "text", "text_corrected"))
            ).alias("sentences"),
        )
    )


def with_blocks(
    entries: DataFrame, gap_ms: int = fixed.VIEW_GAP_MS, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """W2, row form: the block number of every entry."""
    ended = entries.withColumn("_end", times.or_else(F.col("end_ms"), F.col("timestamp_ms")))
    return o.islands(
        ended,
        RECORDING,
        "seq",
        ["speaker", "timestamp_ms", "_end"],
        lambda before, here: (before("speaker") != here("speaker"))
        | (here("timestamp_ms") - before("_end") >= gap_ms),
        out="block_idx",
        rows=rows,
    ).drop("_end")


def merge_entries(
    entries: DataFrame, window_ms: int = fixed.ENTRY_MERGE_MS, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Entries of one speaker within ``window_ms`` of the *first* entry of the group."""
    changed = o.scan(entries, RECORDING, "seq", {"_before": o.previous(F.col("speaker"))}, rows)
    groups = greedy_groups(
        changed,
        RECORDING,
        "seq",
        F.col("timestamp_ms"),
        Rule(window_ms, anchored=True),
        force=F.col("_before") != F.col("speaker"),
        rows=rows,
    )
    kept = [c for c in entries.columns if c not in ("recording_id", "text", "text_corrected")]
    return (
        entries.join(groups, ["recording_id", "seq"])
        .groupBy("recording_id", "group_idx")
        .agg(
            *[F.min_by(c, "seq").alias(c) for c in kept],
            F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seq)").alias("text"),
            F.expr("listagg(text_corrected, '') WITHIN GROUP (ORDER BY seq)").alias("text_corrected"),
        )
    )


def pack_by_chars(
    rows_df: DataFrame,
    order: str,
    text: str | Column,
    limit: int,
    out: str = "chunk_idx",
    rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """Greedy chunks of at most ``limit`` characters, rows never split."""
    text = F.col(text) if isinstance(text, str) else text
    groups = greedy_groups(
        rows_df, RECORDING, order, F.length(text), Rule(limit), rows=rows, out=out
    )
    return rows_df.join(groups, ["recording_id", order])


def batch_rows(
    rows_df: DataFrame,
    order: str,
    text: str | Column,
    max_rows: int = fixed.BATCH_ROWS,
    max_chars: int = fixed.BATCH_CHARS,
    out: str = "batch_idx",
    rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """Greedy batches by rows and characters; an over-long row stands alone."""
    text = F.col(text) if isinstance(text, str) else text
    rule = Rule(max_chars, max_rows=max_rows)
    groups = greedy_groups(rows_df, RECORDING, order, F.length(text), rule, rows=rows, out=out)
    return rows_df.join(groups, ["recording_id", order])


def within_budget(
    entries: DataFrame,
    order: str = "seq",
    text: str = "text_corrected",
    budget: int = fixed.MAX_TEXT_CHARS,
    rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """The longest prefix whose summed length stays within the budget."""
    summed = o.scan(entries, RECORDING, order, {"_chars": o.running(F.length(text))}, rows)
    return summed.where(F.col("_chars") <= budget).drop("_chars")


def _running(sizes: Column) -> Column:
    """Running sums of a short array of numbers."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))

    def add(so_far: Column, size: Column) -> Column:
        upto = so_far["sum"] + size
        return F.struct(upto.alias("sum"), F.concat(so_far["all"], F.array(upto)).alias("all"))

    return F.aggregate(sizes, zero, add, lambda so_far: so_far["all"])


def _with_fragments(segments: DataFrame, corrected: str) -> DataFrame:
    """W12 in the row: ``_fragments``, an array of (fragment, start_ms, end_ms)."""
    subs, text = F.col("sub_sentences"), F.col(corrected)
    plain = F.coalesce(F.size(subs) < 1, F.lit(True)) | t.is_blank(text)
    begin = F.when(plain, 0).otherwise(subs[0]["start_ms"]).cast("long")
    finish = F.when(plain, 0).otherwise(F.element_at(subs, -1)["end_ms"]).cast("long")
    parts = F.when(plain | (F.size(subs) == 1), F.array(text)).otherwise(t.sentences(text))
    rows = t.computed(segments, _from=begin, _to=finish, _parts=parts)
    chars = F.greatest(F.aggregate("_parts", F.lit(0), lambda a, p: a + F.length(p)), F.lit(1))
    total = F.greatest(F.col("_to") - F.col("_from"), F.lit(1))

    def passed(chars: Column) -> Column:
        return _running(F.transform("_parts", lambda p: F.bround(total * (F.length(p) / chars)).cast("long")))

    rows = t.computed(rows, _upto=t.let(chars, passed))

    def timed(part: Column, i: Column) -> Column:
        start = F.col("_from") + F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("_upto", i - 1))
        end = F.when(i == F.size("_parts") - 1, F.col("_to")).otherwise(F.col("_from") + F.get("_upto", i))
        return F.struct(part.alias("fragment"), start.alias("start_ms"), end.alias("end_ms"))

    return rows.withColumn("_fragments", F.transform("_parts", timed)).drop("_from", "_to", "_parts", "_upto")


def _with_originals(segments: DataFrame) -> DataFrame:
    """W13 in the row: ``_originals``, an array of texts."""
    many = F.size("sub_sentences") > 1
    rows = t.computed(
        segments, _subs=F.when(many, F.transform("sub_sentences", lambda s: s["text"])).otherwise(F.array("text"))
    )
    rows = t.computed(rows, _ends=_running(F.transform("_subs", lambda s: F.length(s).cast("long"))))
    last = F.size("_subs") - 1

    def off(i: Column) -> Column:
        return F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("_ends", i - 1)).cast("int")

    misses = F.transform(
        "_subs", lambda s, i: F.when((i < last) & (F.substring(F.col("text"), off(i) + 1, F.length(s)) != s), i)
    )
    rows = t.computed(rows, _miss=F.array_min(misses))

    def cut(sub: Column, i: Column) -> Column:
        rest = F.substring(F.col("text"), off(i) + 1, F.length("text"))
        return F.when(i > F.col("_miss"), "").when((i == F.col("_miss")) | (i == last), rest).otherwise(sub)

    return rows.withColumn("_originals", F.transform("_subs", cut)).drop("_subs", "_ends", "_miss")


def corrected_fragments(
    segments: DataFrame, corrected: str = "text_corrected", carry: Sequence[str] = ()
) -> DataFrame:
    """Corrected text cut at sentence marks, time shared out by length. Columns named in
    ``carry`` come along. All of it happens inside the row."""
    rows = _with_fragments(segments, corrected).select("recording_id", "seg_idx", *carry, F.posexplode("_fragments").alias("pos", "_f"))
    return rows.select("recording_id", "seg_idx", *carry, "pos", "_f.*")


def original_fragments(segments: DataFrame) -> DataFrame:
    """Original text cut where the sub-sentences lie; the first sub-sentence that does
    not fit takes all the rest. All of it happens inside the row."""
    return _with_originals(segments).select("recording_id", "seg_idx", F.posexplode("_originals").alias("pos", "original"))


def transcript_entries(
    segments: DataFrame, corrected: str = "text_corrected", rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Entries from merged segments and their corrected text."""
    many = F.size("sub_sentences") > 1
    kept = _with_originals(_with_fragments(segments.where(F.col(corrected) != ""), corrected))
    split = F.transform(
        "_fragments",
        lambda f, i: F.struct(
            f["start_ms"].alias("start_ms"), f["end_ms"].alias("end_ms"),
            F.coalesce(F.get("_originals", i), f["fragment"]).alias("text"), f["fragment"].alias("text_corrected"),
        ),
    )
    whole = F.array(
        F.struct(
            F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"),
            F.col("text").alias("text"), F.col(corrected).alias("text_corrected"),
        )
    )
    kept = t.computed(kept.drop("_n"), _all=F.when(many, split).otherwise(whole)).select("recording_id", "seg_idx", "speaker", "_all")
    # the one thing that is counted across rows: how many entries come before
    kept = o.scan(kept, RECORDING, "seg_idx", {"_upto": o.running(F.size("_all"))}, rows)
    pieces = kept.select("recording_id", "speaker", (F.col("_upto") - F.size("_all")).alias("_seq"), F.posexplode("_all").alias("pos", "_e"))
    pieces = pieces.select("recording_id", (F.col("_seq") + F.col("pos")).alias("seq"), "speaker", "_e.*")
    return pieces.select(
        "recording_id",
        "seq",
        times.minutes_seconds(F.col("start_ms")).alias("timestamp"),
        F.col("start_ms").alias("timestamp_ms"),
        "end_ms",
        times.speaker_label(F.col("speaker")).alias("speaker"),
        "text",
        "text_corrected",
    )


def needs_correction(
    segments: DataFrame, threshold: float = fixed.TRUSTED_CONFIDENCE
) -> DataFrame:
    """P5: rows below the threshold; all rows of a recording without any confidence."""
    best = segments.groupBy("recording_id").agg(F.max("confidence").alias("_best"))
    return (
        segments.join(best, "recording_id")
        .withColumn("needs_correction", ~(F.col("_best") > 0) | (F.col("confidence") < threshold))
        .drop("_best")
    )


def overlay_corrections(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected text by id, else the own text."""
    fixed_text = corrections.select("recording_id", "seg_idx", F.col("text").alias("_fixed"))
    return (
        segments.join(fixed_text, ["recording_id", "seg_idx"], "left")
        .withColumn("text_corrected", F.coalesce("_fixed", "text"))
        .drop("_fixed")
    )


def confidence_stats(segments: DataFrame, threshold: float = fixed.TRUSTED_CONFIDENCE) -> DataFrame:
    """A5: skipped for recordings whose first segment has confidence 0."""
    return (
        segments.groupBy("recording_id")
        .agg(
            F.min_by("confidence", "seg_idx").alias("_first"),
            F.min("confidence").alias("min_confidence"),
            F.max("confidence").alias("max_confidence"),
            F.avg("confidence").alias("avg_confidence"),
            F.count_if(F.col("confidence") >= threshold).alias("n_trusted"),
            F.count(F.lit(1)).alias("n_segments"),
        )
        .where(F.col("_first") != 0)
        .drop("_first")
    )


def allocate_confidence(
    segments: DataFrame, tokens: DataFrame, n_tokens: Column, rows: int = o.SLICE_ROWS
) -> DataFrame:
    """Each segment takes the next ``n_tokens`` token confidences; mean, else 0.

    ``tokens`` is (recording_id, tok_idx from 0, confidence). Every token finds its
    segment by the last segment that begins at or before it; no array is copied around.
    """
    begun = o.scan(
        segments.withColumn("_n", n_tokens.cast("long")),
        RECORDING,
        "seg_idx",
        {"_upto": o.running(F.col("_n"))},
        rows,
    ).withColumn("_from", F.col("_upto") - F.col("_n"))
    marks = begun.where(F.col("_n") > 0).select(
        "recording_id", F.col("_from").alias("tok_idx"), F.col("seg_idx").alias("_seg"), F.lit(None).cast("double").alias("_conf")
    )
    both = marks.unionByName(
        tokens.select("recording_id", "tok_idx", F.lit(None).cast("long").alias("_seg"), F.col("confidence").alias("_conf"))
    ).groupBy("recording_id", "tok_idx").agg(F.max("_seg").alias("_seg"), F.max("_conf").alias("_conf"))
    owned = o.scan(both, RECORDING, "tok_idx", {"_owner": o.latest(F.col("_seg"))}, rows)
    # tokens past the last segment's share belong to nobody
    ends = begun.select("recording_id", F.col("seg_idx").alias("_owner"), "_upto")
    means = (
        owned.join(ends, ["recording_id", "_owner"])
        .where(F.col("tok_idx") < F.col("_upto"))
        .groupBy("recording_id", F.col("_owner").alias("seg_idx"))
        .agg(F.avg("_conf").alias("_mean"))
    )
    return (
        segments.drop("confidence")
        .join(means, ["recording_id", "seg_idx"], "left")
        .withColumn("confidence", F.coalesce("_mean", F.lit(0.0)))
        .drop("_mean")
    )


def scored_characters(text: str | Column) -> Column:
    """W11 (plain sentences): characters that take a token confidence."""
    text = F.col(text) if isinstance(text, str) else text
    return F.length(F.translate(text, fixed.UNSCORED_MARKS, ""))


def _first_at_least(values: np.ndarray, begin: int, least: int, step: int = 1024) -> int:
    """Place of the first value of at least ``least`` from ``begin`` on, -1 without one; looks no further than it has to."""
    for at in range(begin, len(values), step):
        hit = values[at : at + step] >= least
        if hit.any():
            return at + int(hit.argmax())
    return -1


def _boundaries(starts: np.ndarray, ends: np.ndarray, marks: np.ndarray, max_ms: int) -> list[tuple[int, int]]:
    """(first character, its time) of every piece.

    The next overdue character is looked up in the array of ends, the punctuation before it among
    the sorted places of marks.
    """
    opened, overdue = [(0, int(starts[0]))], -1
    while True:
        place, time = opened[-1]
        overdue = _first_at_least(ends, overdue + 1, time + max_ms)
        if overdue < 0:
            return opened
        mark = int(np.searchsorted(marks, overdue, "right")) - 1
        after = int(marks[mark]) + 1 if mark >= 0 and marks[mark] > place else overdue
        opened.append((after, int(starts[after]) if after < len(starts) else time))


def _times(stamps: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """For starts and for ends: an array for every row, cut out of the column as it is."""
    cuts, spans = stamps.offsets.to_numpy(), stamps.values
    for k in ("start", "end"):
        every = spans.field(k).to_numpy().astype(np.int64, copy=False)
        yield [every[a:b] for a, b in zip(cuts, cuts[1:])]


def _pieces(text: str, starts: np.ndarray, ends: np.ndarray, max_ms: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of an over-long segment's parts; blank parts are left out."""
    if len(starts) < 2:
        return [(text, 0, 0)]
    marks = np.flatnonzero(np.isin(np.array(list(text), dtype="U1"), list(fixed.SPLIT_MARKS)))
    opened = _boundaries(starts, ends, marks, max_ms)
    closed = [place for place, _ in opened[1:]] + [len(text)]
    last = len(ends) - 1
    parts = [
        (text[place:stop].strip(), time, int(ends[last if stop == len(text) and k + 1 == len(opened) else min(stop - 1, last)]))
        for k, ((place, time), stop) in enumerate(zip(opened, closed))
    ]
    return [p for p in parts if p[0]] or [(text, int(starts[0]), int(ends[-1]))]


def split_long_segments(segments: DataFrame, max_ms: int = fixed.LONG_SEGMENT_MS) -> DataFrame:
    """Over-long segments cut after the nearest punctuation before the limit.

    ``timestamps`` holds one start/end per character. The walk depends on its last cut,
    so it runs row by row in Python, on long rows only.
    """
    stamps = F.col("timestamps")
    begin = F.coalesce(F.get(stamps, F.lit(0))["start"], F.lit(0))
    end = F.coalesce(F.try_element_at(stamps, F.lit(-1))["end"], F.lit(0))
    long = (F.size(stamps) > 0) & (end - begin > max_ms)
    columns = "recording_id {rid}, seg_idx bigint, part bigint, text string, start_ms bigint, end_ms bigint"
    schema = columns.format(rid=dict(segments.dtypes)["recording_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            owner, parts = [], []
            texts = zip(rows.column("text").to_pylist(), *_times(rows.column("timestamps")), strict=True)
            for r, (text, starts, ends) in enumerate(texts):
                found = _pieces(text, starts, ends, max_ms)
                owner += [r] * len(found)
                parts += [(k, *piece) for k, piece in enumerate(found)]
            part, text, start, end = zip(*parts) if parts else ((),) * 4
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("recording_id").take(at), rows.column("seg_idx").take(at).cast(pa.int64()), pa.array(part, pa.int64()),
                    pa.array(text, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                ],
                ["recording_id", "seg_idx", "part", "text", "start_ms", "end_ms"],
            )

    narrow = segments.select("recording_id", "seg_idx", "text", "timestamps")
    short = narrow.where(~long).select(
        "recording_id", "seg_idx", F.lit(0).cast("long").alias("part"), "text",
        begin.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
    )
    return narrow.where(long).mapInArrow(cut, schema).unionByName(short)
