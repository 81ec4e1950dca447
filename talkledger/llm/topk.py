"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every candidate, block by block. Histograms of the scores, finer with
each pass, locate the value of every query's k-th highest score; a last pass keeps what reaches that
value and breaks ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talkledger.llm.common import stored

#: Bins of one histogram; a score range of 2**26 takes two passes.
BINS = 1 << 13
EXACT = float(1 << 53)
#: Score of a query with itself.
OWN = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(_row, _id, _v): a number for the row, its id, and floor(scale * x) of every component.

    Rows without an id, null and empty vectors, and vectors that hold a null, NaN or infinite
    component are left out. Rows that share an id are vectors of their own. Row numbers are fixed once
    the result is written.
    """
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{vector_column}`").alias("_raw"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_raw").isNotNull() & (F.size("_raw") > 0))
    fit = rows.where(F.forall("_raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("_raw", lambda x: F.floor(x.cast("double") * scale))
    return fit.select(F.monotonically_increasing_id().alias("_row"), "_id", whole.alias("_v"))


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows packed by about ``size``: one row per block, with the ids, all numbers in a row, and begins."""
    n = max(1, -(-rows.count() // size))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "_row"])
        flat = np.zeros((len(group), max(map(len, group["_v"]))), np.int32)
        for k, v in enumerate(group["_v"]):
            flat[k, : len(v)] = v
        ids, begin = group["_id"].to_numpy(np.int64), group["_begin"].to_numpy(np.int64)
        numbers = group["_row"].to_numpy(np.int64)
        row = [int(group["_block"].iloc[0]), numbers.tobytes(), ids.tobytes(), flat.tobytes(), begin.tobytes()]
        return pd.DataFrame([row], columns=[name, f"{name}_rows", f"{name}_ids", f"{name}_v", f"{name}_begin"])

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(n)))
    schema = f"{name} long, {name}_rows binary, {name}_ids binary, {name}_v binary, {name}_begin binary"
    return dealt.groupBy("_block").applyInPandas(packed, schema)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate ids, and whole scores (a query's own row: the least number)."""
    q_rows, c_rows = np.frombuffer(row["q_rows"], np.int64), np.frombuffer(row["c_rows"], np.int64)
    c_ids = np.frombuffer(row["c_ids"], np.int64)
    q = np.frombuffer(row["q_v"], np.int32).reshape(len(q_rows), -1)
    c = np.frombuffer(row["c_v"], np.int32).reshape(len(c_ids), -1)
    width = min(q.shape[1], c.shape[1])
    scores = (q[:, :width].astype(np.float64) @ c[:, :width].astype(np.float64).T).astype(np.int64)
    scores[q_rows[:, None] == c_rows[None, :]] = OWN
    return q_rows, c_ids, scores


def _binned(k: int, width: int, span: int):
    """Per query the bins that hold the block's k highest scores inside the query's present range.

    The k-th highest score of all is never below the k-th highest of one block, so lower bins of
    the block cannot hold it.
    """

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                q_rows, _, scores = _scores(row)
                begins = np.frombuffer(row["q_begin"], np.int64)
                query, place, count = [], [], []
                for at, begin in enumerate(begins):
                    own = scores[at]
                    own = own[(own >= begin) & (own < begin + span)]
                    if len(own) > k:
                        own = own[own >= np.partition(own, len(own) - k)[len(own) - k]]
                    bins, n = np.unique((own - begin) // width, return_counts=True)
                    query.append(np.full(len(bins), q_rows[at])), place.append(bins), count.append(n)
                yield pd.DataFrame(
                    {"query": np.concatenate(query), "bin": np.concatenate(place), "n": np.concatenate(count)}
                )

    return binned


def _reached(k: int):
    """Per query and block the k best candidates that reach the query's k-th score."""

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                q_rows, c_ids, scores = _scores(row)
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                query, named, found, score = [], [], [], []
                for at, begin in enumerate(np.frombuffer(row["q_begin"], np.int64)):
                    place = np.flatnonzero((scores[at] >= begin) & (scores[at] > OWN))
                    place = place[np.lexsort((c_ids[place], -scores[at][place]))[:k]]
                    query.append(np.full(len(place), q_rows[at])), named.append(np.full(len(place), q_ids[at])), found.append(c_ids[place]), score.append(scores[at][place])
                yield pd.DataFrame(
                    {
                        "query": np.concatenate(query), "query_id": np.concatenate(named), "vec_id": np.concatenate(found),
                        "score": np.concatenate(score),
                    }
                )

    return reached


def top_k(
    df: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: int = 256, query_rows: int = 512, candidate_rows: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by ``every`` the ``k``
    highest inner products with all other rows, ties to the smaller id; all, if fewer. Rows that share an
    id are candidates, and queries, of their own, for each other too.

    See ``quantised`` for rows that take no part. A shorter vector counts as padded with zeros. An
    empty table gives no rows. Scores must stay below 2**53, else an error is raised, not a wrong
    answer. Memory: one block of queries by one block of candidates per task.
    """
    rows = stored(quantised(df, id_column, vector_column, scale), "vectors")
    bounds = rows.agg(
        F.max(F.array_max(F.transform("_v", lambda x: F.abs(x)))).alias("most"), F.max(F.size("_v")).alias("size")
    ).first()
    reach = (bounds.most or 0) ** 2 * (bounds.size or 0) + 1
    if reach >= EXACT or (bounds.most or 0) >= 1 << 31:
        raise ValueError("vectors are too large for exact whole scores")
    candidates = stored(_blocks(rows.withColumn("_begin", F.lit(0)), "c", candidate_rows), "candidates")
    asked = rows.where(F.col("_id") % every == 0)

    def met(state: DataFrame) -> DataFrame:
        """Every query block beside every candidate block: a stated query set against all rows."""
        with_begin = asked.join(state.select("query", F.col("begin").alias("_begin")), F.col("_row") == F.col("query"))
        queries = _blocks(with_begin, "q", query_rows)
        ids = candidates.select(F.lit(1).alias("_one"), F.col("c").alias("_c"))
        spread = queries.withColumn("_one", F.lit(1)).join(ids, "_one").drop("_one")
        return spread.join(candidates, F.col("_c") == F.col("c")).select("q_rows", "q_ids", "q_v", "q_begin", "c_rows", "c_ids", "c_v")

    state = asked.select(F.col("_row").alias("query"), F.lit(-reach).cast("long").alias("begin"), F.lit(k).cast("long").alias("left"))
    span = 2 * reach
    while True:
        width = -(-span // BINS)
        bins = met(state).mapInPandas(_binned(k, width, span), "query long, bin long, n long")
        bins = bins.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = W.Window.partitionBy("query").orderBy(F.desc("bin"))
        bins = bins.withColumn("above", F.sum("n").over(down) - F.col("n")).join(
            state.select(F.col("query").alias("_q"), "left"), F.col("query") == F.col("_q")
        )
        # the bin in which the k-th highest score lies; none, if there are fewer scores
        held = bins.where("above < left and above + n >= left").select("_q", F.col("bin").alias("_bin"), F.col("above").alias("_above"))
        state = stored(
            state.join(held, F.col("query") == F.col("_q"), "left").select(
                "query", (F.col("begin") + F.coalesce("_bin", F.lit(0)) * width).alias("begin"),
                (F.col("left") - F.coalesce("_above", F.lit(0))).alias("left"),
            ),
            "state",
        )
        if width == 1:
            break
        span = width
    best = met(state).mapInPandas(_reached(k), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
