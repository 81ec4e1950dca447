"""Small aggregates over transcripts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def distinct_speakers(entries: DataFrame, order: str = "seq") -> DataFrame:
    """Speakers of a recording in order of first appearance."""
    first = entries.groupBy("recording_id", "speaker").agg(F.min(order).alias("first_seq"))
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("first_seq"))
    return first.withColumn("place", place.cast("long"))


def totals(stages: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Rows and characters at every stage."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))
        .withColumn("stage", F.lit(name))
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counted).select("stage", "n_rows", "n_chars")


class StageTotals:
    """A12 on the run itself: rows and characters of every stage, counted while the stage is written.

    ``watch`` goes round a stage before it is written (or checkpointed); once that is done, ``frame`` has the
    same rows as ``totals``, without reading or computing any stage again. A stage must be written by one
    action, and not be read twice below it.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, stage: str, df: DataFrame, text: str) -> DataFrame:
        if stage in self._seen:
            raise ValueError(f"{stage} is watched already")
        self._seen[stage] = Observation(stage)
        return df.observe(
            self._seen[stage], F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars")
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(stage, seen.get["n_rows"], seen.get["n_chars"]) for stage, seen in self._seen.items()]
        return spark.createDataFrame(rows, "stage string, n_rows long, n_chars long")
