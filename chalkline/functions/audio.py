"""Sound samples as arrays of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resampled(samples: Column, source: int = 16_000, target: int = 24_000) -> Column:
    """Samples at another rate by linear interpolation between neighbours; constants stay."""
    n = F.size(samples)
    m = F.floor(n * target / source).cast("int")

    def at(i: Column) -> Column:
        place = i * (F.lit(float(source)) / target)
        low = F.floor(place).cast("int")
        a, b = F.get(samples, low), F.coalesce(F.get(samples, low + 1), F.get(samples, low))
        return F.round(a + (b - a) * (place - low)).cast("int")

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<int>"))


def duration_ms(pcm: Column, rate: int = 16_000) -> Column:
    """Whole milliseconds of 16-bit mono sound."""
    return F.floor(F.floor(F.length(pcm) / 2) * 1000 / rate).cast("long")


def padded(pcm: Column, rate: int = 16_000, frame_ms: int = 10) -> Column:
    """Sound filled up with silence to whole frames."""
    frame = rate * frame_ms // 1000 * 2
    return F.rpad(pcm, (F.ceil(F.length(pcm) / frame) * frame).cast("int"), F.lit(b"\x00"))
