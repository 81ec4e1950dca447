"""Map-reduce evaluation of texts (M5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import responses as r
from talkledger.functions import text as t
from talkledger.operators import chunks, exchanges, ordered
from talkledger.session import cut_lineage


@dataclass(frozen=True)
class MapWords:
    """Wording of the text that joins the summaries of a long text's chunks."""

    piece: str = "Part %d of %d\n%s"
    missing: str = "(part %d gave no summary)"
    between: str = "\n\n* * *\n\n"


def combined_summaries(parts: DataFrame, key: str, words: MapWords = MapWords()) -> DataFrame:
    """(key, chunk_idx, chunk, response) to one numbered text per key."""
    totals = parts.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    number = F.col("chunk_idx") + 1
    said = r.chunk_summary(F.col("response"), F.col("chunk"), number, words.missing)
    rows = parts.join(totals, key).withColumn(
        "_piece", F.format_string(words.piece, number, "_total", said)
    )
    return ordered.joined_text(rows, [key], "chunk_idx", F.col("_piece"), words.between, "prompt")


#: Added to the prompt of a further attempt.
AGAIN = "The last answer could not be read. Answer with the JSON object alone, without any other text."


def evaluated_attempts(
    requests: DataFrame, ask: Callable[[str], str], width: int | None = None, attempts: int = 2, again: str = AGAIN
) -> DataFrame:
    """Ask again, and say why, where the answer cannot be read; ``evaluation`` null if none can."""
    done, open_ = None, requests
    for attempt in range(attempts):
        worded = F.col("prompt") if attempt == 0 else F.concat_ws("\n\n", "prompt", F.lit(again))
        answers = exchanges.call_model(open_.withColumn("_worded", worded), ask, "_worded", width=width).drop("_worded")
        asked = cut_lineage(t.computed(answers, evaluation=r.evaluation(F.col("response"))))
        settled = asked if attempt + 1 == attempts else asked.where(F.col("evaluation").isNotNull())
        done = settled if done is None else done.unionByName(settled)
        open_ = asked.where(F.col("evaluation").isNull()).drop("response", "evaluation")
    return done.drop("response")


def evaluate_texts(
    texts: DataFrame,
    key: str,
    summarise: Callable[[str], str],
    evaluate: Callable[[str], str],
    max_chars: int | None = None,
    size: int = fixed.EVALUATION_CHUNK_CHARS,
    width: int | None = None,
    words: MapWords = MapWords(),
) -> DataFrame:
    """M5: texts of up to ``size`` characters in one request, longer ones chunk by chunk and then as a
    whole, so ``size`` also decides which prompts a text gets. Texts are whole unless ``max_chars``
    is given (P17)."""
    whole = F.col("text") if max_chars is None else t.truncated("text", max_chars)
    cut = texts.where(~t.is_blank("text")).select(key, whole.alias("text"))
    short = cut.where(F.length("text") <= size).select(key, F.col("text").alias("prompt"))
    parts = chunks.chunk_texts(cut.where(F.length("text") > size), key, "text", size, 0)
    summed = cut_lineage(exchanges.call_model(parts, summarise, "chunk", width=width))
    long = combined_summaries(summed, key, words).select(key, "prompt")
    return evaluated_attempts(short.unionByName(long), evaluate, width).select(key, "prompt", "evaluation")
