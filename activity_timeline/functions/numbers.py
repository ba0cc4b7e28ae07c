"""Column expressions for levels, frame numbers and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column, size: int | Column) -> Column:
    """Integer quotient of two non-negative integers."""
    return F.call_function("div", value, size if isinstance(size, Column) else F.lit(size))


def level_db(energy: Column, count: int) -> Column:
    """RMS level in dB of `count` samples whose squares add up to `energy`."""
    return F.lit(20.0) * F.log10(F.sqrt(energy / F.lit(float(count))) + F.lit(1e-10))


def linear_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def seconds_to_frames(seconds: Column, fps: Column) -> Column:
    """Nearest frame number; halves go to the even neighbour."""
    return F.rint(seconds * fps).cast("bigint")


def _near(fps: Column, rate: float) -> Column:
    return F.abs(fps - F.lit(rate)) < F.lit(0.1)


def timebase(fps: Column) -> Column:
    return (F.when(_near(fps, 29.97), F.lit(30))
            .when(_near(fps, 23.976), F.lit(24))
            .otherwise(F.rint(fps).cast("int")))


def ntsc(fps: Column) -> Column:
    return F.when(_near(fps, 29.97) | _near(fps, 23.976), F.lit("TRUE")).otherwise(F.lit("FALSE"))


# Sequences start at one hour, counted without dropped frames.
START_TIMECODE = "01:00:00:00"
TIMECODE_FORMAT = "NDF"


def start_frame(fps: Column) -> Column:
    return seconds_to_frames(F.lit(3600.0), fps)
