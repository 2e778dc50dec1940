"""Times, durations, dates, XML escapes, and file names as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hms(ms: Column) -> tuple[Column, Column, Column]:
    seconds = F.floor(ms / 1000).cast("long")
    return (F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), seconds % 60)


def clock(ms: Column) -> Column:
    """HH:MM:SS."""
    return F.format_string("%02d:%02d:%02d", *_hms(ms))


def duration(ms: Column, padded: bool = False) -> Column:
    """h:mm:ss, or m:ss under an hour (mm:ss if padded)."""
    h, m, s = _hms(ms)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d" if padded else "%d:%02d", m, s))


def worded_duration(ms: Column, units: tuple[str, str, str] = ("ч", "мин", "сек")) -> Column:
    h, m, s = _hms(ms)
    hour, minute, second = units
    return (F.when(h > 0, F.format_string(f"%d {hour} %02d {minute} %02d {second}", h, m, s))
            .when(m > 0, F.format_string(f"%d {minute} %02d {second}", m, s)).otherwise(F.format_string(f"%d {second}", s)))


def day(ms: Column) -> Column:
    """dd.MM.yyyy HH:mm in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "dd.MM.yyyy HH:mm")


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_name(title: Column, ms: Column, extension: str = "txt", blank: str = "Interview") -> Column:
    """A title that file systems take, cut to 80 characters, with the time."""
    clean = F.substring(F.regexp_replace(F.trim(title), r'[\\/:*?"<>|]', "_"), 1, 80)
    clean = F.when(F.coalesce(clean, F.lit("")) == "", blank).otherwise(clean)
    return F.concat(clean, F.lit("_"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd_HH-mm"), F.lit("." + extension))
