"""Model requests and responses: chunk streams, best attempts, prompts, work lists, calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger.functions import responses as r
from talkledger.functions import text as t
from talkledger.functions import times
from talkledger.operators import ordered as o
from talkledger.operators.batches import pieces
from talkledger.session import cut_lineage


def assembled_responses(lines: DataFrame, rows: int = o.SLICE_ROWS) -> DataFrame:
    """(request_id, line_no, line) token chunks to one response row per request.

    Blank and unreadable lines are skipped; model, duration and token count come from the
    last ``done`` line.
    """
    read = lines.where(~t.is_blank("line")).withColumn("_v", r.parsed(F.col("line")))
    read = read.where(F.col("_v").isNotNull()).select(
        "request_id",
        "line_no",
        F.try_variant_get("_v", "$.message.content", "string").alias("_part"),
        F.coalesce(F.try_variant_get("_v", "$.done", "boolean"), F.lit(False)).alias("_done"),
        F.try_variant_get("_v", "$.model", "string").alias("_model"),
        F.try_variant_get("_v", "$.total_duration", "bigint").alias("_duration"),
        F.try_variant_get("_v", "$.eval_count", "bigint").alias("_tokens"),
    )
    text = o.joined_text(read, ["request_id"], "line_no", F.coalesce("_part", F.lit("")), "", "content", rows)
    done = F.when(F.col("_done"), F.col("line_no"))
    stats = read.groupBy("request_id").agg(
        F.bool_or("_done").alias("done"),
        F.max_by("_model", done).alias("model"),
        F.max_by("_duration", done).alias("total_duration"),
        F.max_by("_tokens", done).alias("eval_count"),
    )
    return text.join(stats, "request_id")


def best_attempts(
    requests: DataFrame, responses: DataFrame, readable: Column, max_attempts: int | None = None
) -> DataFrame:
    """The first readable attempt of every request, of the first ``max_attempts`` where given; null when
    there is none."""
    if max_attempts is not None:
        responses = responses.where(F.col("attempt") <= max_attempts)
    first = (
        responses.where(readable)
        .groupBy("request_id")
        .agg(F.min_by("raw", "attempt").alias("raw"))
    )
    return requests.join(first, "request_id", "left")


def call_model(
    requests: DataFrame,
    ask: Callable[[str], str],
    prompt: str = "prompt",
    out: str = "response",
    width: int | None = None,
    retries: int = 2,
    delay_s: float = 2.0,
    error: str | None = None,
    options: Sequence[str] = (),
) -> DataFrame:
    """M1: call ``ask`` on every prompt, retry with a doubling pause, null after the last
    failure. ``width`` bounds the calls in flight (one per partition); ``error`` names a column
    that says why the last call failed (null where it did not). ``options`` names columns that
    ``ask`` gets by name beside the prompt, such as a bound of the answer's length."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def one(text: str, given: dict) -> tuple[str | None, str | None]:
        reason = None
        for attempt in range(retries + 1):
            try:
                return ask(text, **given), None
            except Exception as e:  # the row falls back, the job goes on
                reason = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(delay_s * 2**attempt)
        return None, reason

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            more = rows.select(list(options)).to_pylist() if options else [{}] * rows.num_rows
            said = [one(p, given) for p, given in zip(rows.column(prompt).to_pylist(), more, strict=True)]
            added = [(out, 0)] + ([(error, 1)] if error else [])
            for name, place in added:
                rows = rows.append_column(name, pa.array([s[place] for s in said], pa.string()))
            yield rows

    rows = requests.repartition(width) if width else requests
    return rows.mapInArrow(run, f"{schema}, `{out}` string" + (f", `{error}` string" if error else ""))


_LOG = "prompt_key string, response string, error string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LOG).parquet(path)


def call_model_logged(
    requests: DataFrame,
    ask: Callable[[list[str]], list[str | None]],
    log: str,
    prompt: str = "prompt",
    out: str = "response",
    error: str | None = None,
    width: int = 16,
    batch: int = 8,
    per_second: float | None = None,
    waves: int = 4,
    retries: int = 2,
    delay_s: float = 2.0,
    salt: str = "",
) -> DataFrame:
    """M1 with a log: equal prompts are asked once, and what the log holds is not asked again.

    ``log`` is an append-only table of answers by the hash of their prompt (and ``salt``, which names the
    model and its settings). ``ask`` takes up to ``batch`` prompts and gives an answer for each, null where it
    has none; a call that raises is repeated after a doubling pause, then its prompts count as unanswered. What
    is missing goes out in ``waves``, each written when it ends, so that a run that breaks off loses one wave
    at most; unanswered prompts are asked by the next run. ``width`` calls run at a time, ``per_second`` bounds
    the calls of all together. Null prompts get null.
    """
    spark = requests.sparkSession
    key = F.sha2(F.concat(F.lit(f"{salt}\n"), F.col(prompt)), 256)
    wanted = requests.where(F.col(prompt).isNotNull()).select(key.alias("prompt_key"), F.col(prompt).alias("_p")).dropDuplicates(["prompt_key"])
    pause = width / per_second if per_second else 0.0

    def asked(texts: list[str]) -> tuple[list[str | None], str | None]:
        reason = None
        for attempt in range(retries + 1):
            try:
                said = list(ask(texts))
                if len(said) != len(texts):
                    raise ValueError(f"{len(said)} answers to {len(texts)} prompts")
                return said, None
            except Exception as e:  # the prompts stay unanswered, the job goes on
                reason = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(delay_s * 2**attempt)
        return [None] * len(texts), reason

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                begun, rows = time.monotonic(), pdf.iloc[at : at + batch]
                said, reason = asked(rows["_p"].tolist())
                yield pd.DataFrame({"prompt_key": rows["prompt_key"].tolist(), "response": said, "error": [reason] * len(said)}, dtype=object)
                time.sleep(max(0.0, pause - (time.monotonic() - begun)))

    # so that there is a table, however new the log is
    spark.createDataFrame([], _LOG).coalesce(1).write.mode("append").parquet(log)
    known = _log(spark, log).where(F.col("response").isNotNull())
    open_ = cut_lineage(wanted.join(known, "prompt_key", "left_anti"))
    for wave in range(waves):
        rows = open_.where(F.pmod(F.xxhash64("prompt_key"), F.lit(waves)) == wave).repartition(width, "prompt_key")
        rows.mapInPandas(run, _LOG).write.mode("append").parquet(log)
    answers = _log(spark, log).groupBy("prompt_key").agg(F.max("response").alias(out), F.max("error").alias("_error"))
    joined = requests.withColumn("prompt_key", key).join(answers, "prompt_key", "left")
    failed = F.when(F.col(out).isNull(), F.col("_error"))
    return joined.select(*requests.columns, out, *([failed.alias(error)] if error else []))


def audit_work(chunks: DataFrame, groups: DataFrame, ocr: DataFrame) -> DataFrame:
    """Every chunk with every rule group of its sheet; the screen-text group only for
    recordings that have screen text."""
    has = ocr.select("recording_id").distinct().withColumn("_ocr", F.lit(True))
    rows = chunks.join(groups, "sheet_id").join(has, "recording_id", "left")
    seen = F.coalesce("_ocr", F.lit(False))
    return (
        rows.where((F.col("group_name") != "ocr") | seen)
        .withColumn("with_ocr", seen & F.col("group_name").isin("ocr", "mixed", "all"))
        .drop("_ocr")
    )


@dataclass(frozen=True)
class PromptWords:
    """Wording of a prompt; ``%d`` takes chunk number and chunk count."""

    rules: str = "Rules\n%s"
    examples: str = "Known findings\n%s"
    screen: str = "Screen text\n%s"
    transcript: str = "Transcript %d/%d\n%s"
    closing: str = "Answer with a JSON array of findings."
    #: Over the findings of a report that is to be summed up: how many rules and findings there are.
    summary: str = "%d rules, %d findings\n%s"
    #: Added to the prompt of a further attempt.
    again: str = "The last answer could not be read. Answer with the JSON array alone, without any other text."


def audit_prompts(
    work: DataFrame,
    entries: DataFrame,
    screen_text: DataFrame,
    examples: DataFrame,
    words: PromptWords = PromptWords(),
    groups: DataFrame | None = None,
) -> DataFrame:
    """One prompt per (chunk, group); parts that are absent are left out.

    ``work`` has the text of its rules, or ``groups`` has it by sheet and group: a text that is long and shared
    by many prompts then joins them last, after all shuffles.
    """
    chunk = ["recording_id", "chunk_idx"]
    line = F.format_string("[%s] [%s]: %s", "timestamp", "speaker", "text_corrected")
    spoken = entries.withColumn("_line", line).groupBy(*chunk).agg(
        F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY seq)").alias("_spoken")
    )
    shown = F.concat(F.lit("["), times.minutes_seconds(F.col("timestamp_ms")), F.lit('] "'), F.col("text"), F.lit('"'))
    seen = screen_text.select(*chunk, F.struct("timestamp_ms", "seq", shown.alias("line")).alias("_row")).groupBy(
        *chunk
    ).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x["line"]), "\n").alias("_seen"))
    totals = entries.groupBy("recording_id").agg((F.max("chunk_idx") + 1).alias("n_chunks"))
    listed = examples.select(
        "sheet_id",
        F.array_join(F.transform("examples", lambda e: F.concat(F.lit("- "), e)), "\n").alias("_known"),
    )
    rows = (
        work.join(spoken, chunk)
        .join(totals, "recording_id")
        .join(seen, chunk, "left")
        .join(listed, "sheet_id", "left")
    )
    if groups is not None:
        rows = rows.join(groups.select("sheet_id", "group_name", "rules_text"), ["sheet_id", "group_name"])
    prompt = F.concat_ws(
        "\n\n",
        F.format_string(words.rules, "rules_text"),
        F.when(F.col("_known") != "", F.format_string(words.examples, "_known")),
        F.when(F.col("with_ocr") & F.col("_seen").isNotNull(), F.format_string(words.screen, "_seen")),
        F.format_string(words.transcript, F.col("chunk_idx") + 1, "n_chunks", "_spoken"),
        F.lit(words.closing),
    )
    return rows.select(*work.columns, "n_chunks", prompt.alias("prompt"))
