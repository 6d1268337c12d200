"""Joins of two streams in event time: captions with the sound made for them, or without where none came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUDIO = ("published_at", "sound_ms")


def captions_with_audio(captions: DataFrame, audio: DataFrame, within: str = "30 seconds", lateness: str = "10 seconds") -> DataFrame:
    """``captions`` (segment_id, locale, at, ...) each with the ``audio`` (segment_id, locale, published_at, sound_ms) of
    their segment and locale that came within the time after them; null where none did.

    For streams both sides have a watermark and the times bound how long a row is kept: a caption leaves alone as soon
    as no sound can come any more. Captions without segment or locale have no sound; a caption with two has two rows.
    """
    left = captions.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    right = audio.select(
        F.col("segment_id").alias("_segment"), F.col("locale").alias("_locale"), F.col("published_at").cast("timestamp").alias("published_at"), "sound_ms"
    ).withWatermark("published_at", lateness)
    near = F.col("published_at").between(F.col("at"), F.col("at") + F.expr(f"interval {within}"))
    on = (left["segment_id"] == F.col("_segment")) & (left["locale"] == F.col("_locale")) & near
    joined = left.join(right, on, "left")
    return joined.select(*captions.columns, *AUDIO, ((F.unix_millis("published_at") - F.unix_millis("at"))).alias("audio_after_ms"))
