"""Dates of old systems. Zero means that there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1904 to 1970, days from 1970 to 1978, ticks a second.
MAC_EPOCH, AMIGA_DAYS, TICKS = 2_082_844_800, 2922, 50


def _text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def unix_text(seconds: Column) -> Column:
    return _text(seconds)


def mac_to_unix(seconds: Column) -> Column:
    """Seconds since 1970 of seconds since 1904, not before 1970."""
    return F.greatest(F.nullif(seconds, F.lit(0)) - MAC_EPOCH, F.lit(0))


def mac_text(seconds: Column) -> Column:
    return F.when(seconds != 0, _text(mac_to_unix(seconds)))


def unix_to_mac(seconds: Column) -> Column:
    return seconds + MAC_EPOCH


def amiga_to_unix(days: Column, minutes: Column, ticks: Column) -> Column:
    whole = (days.cast("long") + AMIGA_DAYS) * 86_400 + minutes * 60 + F.floor(ticks / TICKS)
    return F.when((days == 0) & (minutes == 0) & (ticks == 0), F.lit(0).cast("long")).otherwise(whole)


def fat_to_unix(date: Column, time: Column) -> Column:
    """Seconds of a FAT date and time, both packed in 16 bits; null for a date of zero."""
    bits = lambda c, at, n: F.shiftright(c, at).bitwiseAND(F.lit((1 << n) - 1))
    day = F.make_date(bits(date, 9, 7) + 1980, bits(date, 5, 4), bits(date, 0, 5))
    return F.when(date != 0, F.unix_date(day).cast("long") * 86_400 + bits(time, 11, 5) * 3600 + bits(time, 5, 6) * 60 + bits(time, 0, 5) * 2)
