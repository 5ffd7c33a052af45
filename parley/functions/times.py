"""Time and frame-number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hms(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS, wrapping at 24 hours."""
    s = F.pmod(F.floor(ms / 1000), F.lit(86400)).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"),
                           F.floor(s % 3600 / 60).cast("int"), s % 60)


def minute_clock(ms: Column) -> Column:
    """Milliseconds as m:ss.mmm with the milliseconds not padded (35008 gives 0:35.8)."""
    minute = F.floor(ms / 60000)
    return F.format_string("%d:%02d.%d", minute, F.floor((ms - minute * 60000) / 1000), ms % 1000)


def hour_clock(seconds: Column) -> Column:
    """Seconds as h:m:ss.ss with hours and minutes not padded."""
    whole = F.floor(seconds)
    rest = seconds % 3600
    return F.format_string("%d:%d:%.2f", F.floor(whole / 3600), F.floor(F.floor(rest) / 60),
                           (rest % 60).cast("double"))


def frame_to_ms(frame: Column, fps: float) -> Column:
    return F.floor(frame * 1000 / F.lit(float(fps))).cast("long")


def ms_to_frame(ms: Column, fps: float) -> Column:
    return F.floor(ms * F.lit(float(fps)) / 1000).cast("long")
