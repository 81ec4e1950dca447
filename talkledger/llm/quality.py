"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated.

Cosines of random projections approximate a Gaussian kernel over the standardised statistics. The
normal equations are sums over documents, kept per fold as whole numbers, so that every order of
adding gives the same model and leaving a fold out is a subtraction. Scores of left-out folds are
binned and made monotone (isotonic regression), which turns scores into chances.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger.llm.common import remainder, stored, text_bytes

STATISTICS = (
    "characters words word_length word_spread longest_word distinct_words top_word distinct_pairs capitals digits "
    "symbols blanks foreign wordless odd_ends stops commas short_words titled lines line_words repeated_lines "
    "pipes packed"
).split()
FEATURES, SEED, RIDGE = 192, 7, 3e-3
#: Whole numbers stand for multiples of these.
STAT_UNIT, FEATURE_UNIT = 1 / 4096, 1 / 1024
FOLDS = (1, 2, 3, 4)
BINS = 2_000


def statistics(raw: bytes) -> list[float]:
    """STATISTICS of a whole text; shares of nothing are 0."""
    text = raw.decode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, count = max(1, len(text)), max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    seen = Counter(words)
    upper, digits = len(text) - len(text.translate(_UPPER)), len(text) - len(text.translate(_DIGITS))
    symbols = len(text) - len(text.translate(_SYMBOLS))
    blanks = n - sum(map(len, words)) if words else 0
    plain = sum(map(str.isalnum, words))
    ends = [w[-1] for w in words]
    end = Counter(ends)
    kept = [x for x in lines if x.strip()]
    return [
        np.log1p(len(text)) / 4, np.log1p(len(words)) / 4,
        np.log1p(sizes.mean()) if words else 0.0, np.log1p(sizes.std()) if words else 0.0,
        np.log1p(sizes.max()) if words else 0.0, len(seen) / count, max(seen.values(), default=0) / count,
        len(set(zip(words, words[1:]))) / max(1, len(words) - 1), upper / n, digits / n, symbols / n, blanks / n,
        (len(raw) - len(text)) / n, plain / count, sum(end[c] for c in "*&%$#@!^~|=+<>") / count,
        sum(end[c] for c in ".?") / count, end[","] / count, float((sizes <= 3).mean()) if words else 0.0,
        sum(map(str.istitle, words)) / count, np.log1p(len(kept)), np.log1p(count / max(1, len(kept))),
        1 - len(set(kept)) / max(1, len(kept)), seen["|"] / count, len(zlib.compress(raw, 1)) / max(16, len(raw)),
    ]


_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = str.maketrans("", "", "0123456789")
_SYMBOLS = str.maketrans("", "", "*&%$#@!^~|=+<>{}[]\\/_")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(statistics(t.as_py()), np.float32).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["_id", "_fold", "_stats"])


def measured(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 5) -> DataFrame:
    """(_id, _fold, _stats): crc32 of the id modulo ``folds`` (-1: no id) and the packed statistics."""
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), remainder(id_column, folds).alias("_fold"), text_bytes(text_column).alias("_raw"))
    return rows.mapInArrow(_measured, "_id long, _fold int, _stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)


@dataclass
class Model:
    """Everything a score needs; its size does not depend on the data."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[int, np.ndarray]
    scores: np.ndarray
    chances: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Whole numbers: random cosines in units of FEATURE_UNIT, and a constant."""
        rng = np.random.default_rng(SEED)
        project = rng.normal(0, 1 / np.sqrt(len(STATISTICS)), (len(STATISTICS), FEATURES))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.spread, -5, 5)
        wave = np.sqrt(2.0) * np.cos(x @ project + shift)
        return np.hstack([np.rint(wave / FEATURE_UNIT), np.full((len(x), 1), 1 / FEATURE_UNIT)])

    def raw(self, stats: np.ndarray, without: int = 0) -> np.ndarray:
        return self.features(stats) @ self.weights[without] * FEATURE_UNIT

    def chance(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.scores):
            return np.full(len(raw), 0.5)
        # a trace of the raw score keeps the order inside the steps
        return 0.999 * np.interp(raw, self.scores, self.chances) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(STATISTICS)
    total, square, n = np.zeros(k, np.int64), np.zeros(k, np.int64), 0
    for batch in batches:
        if batch.num_rows:
            x = np.rint(_matrix(batch.column(0)) / STAT_UNIT).astype(np.int64)
            total, square, n = total + x.sum(0), square + (x * x).sum(0), n + len(x)
    columns = [pa.array(range(k), pa.int32()), pa.array(total), pa.array(square), pa.array([n] * k, pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["k", "total", "square", "n"])


def _equations(model: Model):
    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds, good, n = (batch.column(c).to_numpy() for c in (1, 2, 3))
            z = model.features(_matrix(batch.column(0)))
            for fold in np.unique(folds):
                own = folds == fold
                weight = n[own].astype(np.float64)
                # float products of whole numbers below 2**53 are exact
                square = (z[own] * weight[:, None]).T @ z[own]
                aim = z[own].T @ good[own].astype(np.float64)
                part = np.hstack([square, aim[:, None]]).astype(np.int64)
                sums[int(fold)] = sums.get(int(fold), 0) + part
        for fold, part in sums.items():
            i, j = np.nonzero(np.triu(np.ones(part.shape, bool)))
            columns = [pa.array(np.full(len(i), fold, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(part[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "i", "j", "v"])

    return equations


def _solved(square: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """Ridge weights for features in units of FEATURE_UNIT; the constant is not shrunk."""
    square, aim = square * FEATURE_UNIT**2, aim * FEATURE_UNIT
    ridge = np.eye(len(aim)) * RIDGE * max(1.0, square[-1, -1])
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(square + ridge, aim)


def monotone(place: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: mean place and share of every pool of neighbouring bins, shares rising."""
    pools: list[list[float]] = []
    for p, g, c in zip(place, good, n):
        pools.append([p * c, g, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _binned(model: Model):
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            folds, stats = batch.column(1).to_numpy(), _matrix(batch.column(0))
            raw = np.zeros(len(folds))
            for fold in np.unique(folds):
                raw[folds == fold] = model.raw(stats[folds == fold], int(fold))
            bins = (np.clip((raw + 0.5) / 2, 0, 1) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(2), batch.column(3)], ["bin", "good", "n"])

    return binned


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Model:
    """A model from the labelled rows outside fold 0; every such row counts, none is sampled.

    Labels that are null or neither 0 nor 1 are left out; several labels of one id count as shares.
    The driver gets sums over statistics, pairs of features and bins, whose number is fixed.
    """
    marked = labels.where(F.col(f"`{label_column}`").isin(0, 1)).groupBy(F.col(f"`{id_column}`").cast("long").alias("_l")).agg(
        F.sum(F.col(f"`{label_column}`").cast("long")).alias("good"), F.count("*").alias("n")
    )
    rows = stats.where(F.col("_fold").isin(*FOLDS)).join(marked, F.col("_id") == F.col("_l"))
    rows = stored(rows.select("_stats", "_fold", "good", "n"), "labelled")
    sums = rows.mapInArrow(_sums, "k int, total long, square long, n long").groupBy("k").agg(
        F.sum("total").alias("total"), F.sum("square").alias("square"), F.sum("n").alias("n")
    )
    sums = sorted(sums.collect())
    none = np.empty(0)
    if not sums or not sums[0].n:
        return Model(none, none, {}, none, none)
    n = sums[0].n
    mean = np.array([r.total / n for r in sums]) * STAT_UNIT
    spread = np.sqrt(np.array([max(0.0, r.square / n - (r.total / n) ** 2) for r in sums])) * STAT_UNIT
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0), {}, none, none)
    parts = rows.mapInArrow(_equations(model), "fold int, i int, j int, v long").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect()
    size = FEATURES + 1
    squares = {f: np.zeros((size, size + 1)) for f in FOLDS}
    for r in parts:
        squares[r.fold][r.i, r.j] = r.v
    total = sum(squares.values())
    for fold in (0, *FOLDS):
        part = total - squares[fold] if fold else total
        upper = np.triu(part[:, :size])
        model.weights[fold] = _solved(upper + np.triu(upper, 1).T, part[:, size])
    bins = rows.mapInArrow(_binned(model), "bin int, good long, n long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    bins = sorted(bins.collect())
    place = np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in bins])
    model.scores, model.chances = monotone(place, np.array([r.good for r in bins], float), np.array([r.n for r in bins], float))
    return model


def _scored(model: Model, accept: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stats = _matrix(batch.column(2))
            score = model.chance(model.raw(stats) if model.weights else np.zeros(len(stats)))
            columns = [batch.column(0), pa.array(batch.column(1).to_numpy() == 0), pa.array(score), pa.array((score >= accept).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "held_out", "score", "predicted"])

    return scored


def scores(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    accept: float = 0.3,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= accept).

    Null texts count as empty and are scored like any text. A row without an id is never held out
    and never learned from; equal ids are scored by their own texts. Without usable labels every
    score is 0.5. Empty tables give no rows. Only the text enters a score, other columns are ignored.
    """
    stats = stored(measured(docs, id_column, text_column), "stats")
    model = fit(stats, labels, id_column, label_column)
    kind = "_id long, held_out boolean, score double, predicted int"
    return stats.mapInArrow(_scored(model, accept), kind).withColumnRenamed("_id", id_column)


def accepted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected; an id goes only if all its rows are rejected."""
    verdicts = scores(docs, labels, id_column, text_column).groupBy(F.col(f"`{id_column}`").alias("__id"))
    rejected = stored(verdicts.agg(F.max("predicted").alias("__best")).where("__best = 0 and __id is not null").select("__id"), "rejected")
    return docs.join(rejected, F.col(f"`{id_column}`") == F.col("__id"), "left_anti")
