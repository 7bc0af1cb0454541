"""Column builders for caption timecodes, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import group

SRT_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"


def srt_ms(text: Column) -> Column:
    """Milliseconds of H:MM:SS,mmm; null where it is malformed."""
    h, m, s, ms = (group(text, f"^\\s*{SRT_TIME}\\s*$", i).cast("long") for i in range(1, 5))
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    return F.expr("0") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000


def srt_time(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm (SRT), or with a point (VTT); negatives are 0."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *_parts(ms))


def display_time(ms: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    h, m, s, _ = _parts(ms)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def long_time(ms: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%03d", *_parts(ms))


def strict_ms(text: Column) -> Column:
    """[H:]M:SS[.fff]: seconds under 60; minutes under 60 if there are hours; short fractions are padded on the right; else null."""
    pattern = r"^(?:(\d+):)?(\d+):(\d{2})(?:[.,](\d{1,3}))?$"
    h, m, s = (group(text, pattern, i).cast("long") for i in (1, 2, 3))
    fraction = F.rpad(F.coalesce(group(text, pattern, 4), F.lit("")), 3, "0").cast("long")
    good = (s < 60) & (h.isNull() | (m < 60))
    return F.when(good, ((F.coalesce(h, F.lit(0)) * 60 + m) * 60 + s) * 1000 + fraction)
