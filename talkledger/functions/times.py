"""Times as text and back, speaker and score labels, review clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkledger.functions.text import let, strip


def _whole(value: Column) -> Column:
    return F.floor(value).cast("long")


def _padded(value: Column, width: int = 2) -> Column:
    # lpad alone would cut longer numbers
    text = value.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def minutes_seconds(ms: Column) -> Column:
    """``MM:SS``, minutes unbounded."""
    total = _whole(ms / 1000)
    return F.concat(_padded(_whole(total / 60)), F.lit(":"), _padded(total % 60))


def _parts(ms: Column) -> tuple[Column, Column, Column]:
    total = _whole(ms / 1000)
    return _whole(total / 3600), _whole((total % 3600) / 60), total % 60


def clock(ms: Column) -> Column:
    """``[HH:]MM:SS``."""
    h, m, s = _parts(ms)
    short = F.concat(_padded(m), F.lit(":"), _padded(s))
    return F.when(h > 0, F.concat(_padded(h), F.lit(":"), short)).otherwise(short)


def subtitle_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    h, m, s = _parts(ms)
    return F.concat(
        _padded(h), F.lit(":"), _padded(m), F.lit(":"), _padded(s), F.lit(","), _padded(ms % 1000, 3)
    )


def parse_time(text: Column) -> Column:
    """``MM:SS`` or ``HH:MM:SS`` to ms; anything else is 0."""
    parts = F.transform(
        F.split(strip(text), ":"),
        lambda p: F.when(strip(p).rlike(r"^[+-]?[0-9]+\z"), strip(p)).try_cast("bigint"),
    )

    def ms(p: Column) -> Column:
        first, second, third = (F.get(p, F.lit(i)) for i in range(3))
        return F.when(F.size(p) == 2, (first * 60 + second) * 1000).when(
            F.size(p) == 3, (first * 3600 + second * 60 + third) * 1000
        )

    return F.coalesce(let(parts, ms), F.lit(0))


def speaker_label(speaker: Column) -> Column:
    """P14."""
    return F.concat(F.lit("Speaker "), F.when(speaker >= 0, speaker + 1).otherwise(1).cast("string"))


def score_band(score: Column) -> Column:
    """P15."""
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def or_else(value: Column, other: Column) -> Column:
    """The value unless it is null or 0."""
    return F.when(value.isNull() | (value == 0), other).otherwise(value)


def clip_start(at: Column, lead_ms: int = 5000) -> Column:
    """P12."""
    return F.greatest(at - lead_ms, F.lit(0))


def clip_end(at: Column, end: Column, tail_ms: int = 10_000) -> Column:
    return or_else(end, at) + tail_ms
