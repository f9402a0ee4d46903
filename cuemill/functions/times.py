"""Media offsets: strings at the edges, whole milliseconds or seconds in between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import strip


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm; hours may have more than two digits."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("bigint")
    return F.concat(
        F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60_000).cast("bigint") % 60), F.lit(":"), two(F.floor(ms / 1000).cast("bigint") % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")
    )


def milliseconds(seconds: Column) -> Column:
    """Seconds as whole milliseconds, the rest cut off."""
    return (seconds * 1000).cast("bigint")


def strict_seconds(text: Column) -> Column:
    """Seconds of just HH:MM:SS; null for anything else."""
    parts = F.split(text, ":", -1)
    n = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(3)]
    return F.when(F.size(parts) == 3, n[0] * 3600 + n[1] * 60 + n[2])


def lenient_seconds(text: Column) -> Column:
    """Seconds of up to three parts read as hours, minutes and seconds from the left; further parts
    are ignored, a part that is no number makes null."""
    parts = F.split(text, ":", -1)
    n = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return n(0) * 3600 + F.when(F.size(parts) > 1, n(1) * 60).otherwise(0) + F.when(F.size(parts) > 2, n(2)).otherwise(0)


def time_range(start: Column, end: Column) -> Column:
    """A range as trimmed strings."""
    return F.struct(strip(start).alias("start"), strip(end).alias("end"))


def _to_seconds(text: Column) -> Column:
    plain = strip(text)
    return F.when(plain.contains("."), F.substring_index(plain, ".", 1)).otherwise(F.substring_index(plain, ",", 1))


def cue_start(timestamps: Column) -> Column:
    """The start in a cue's times, down to the second; times without an arrow are taken as they are."""
    return F.when(timestamps.contains("-->"), _to_seconds(F.substring_index(timestamps, "-->", 1))).otherwise(timestamps)


def cue_end(timestamps: Column) -> Column:
    """The end in a cue's times, down to the second."""
    return F.when(timestamps.contains("-->"), _to_seconds(F.get(F.split(timestamps, "-->"), F.lit(1)))).otherwise(timestamps)
