"""Sizes, sectors and geometry as integer column expressions; nothing passes through floating point."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTOR = 512
#: Suffixes of size arguments and their factors.
SUFFIXES = {"": 1, "B": 1, "K": 1024, "KIB": 1024, "M": 1024**2, "MIB": 1024**2, "G": 1024**3, "GIB": 1024**3}
#: Units of displayed sizes, largest first.
UNITS = (("TiB", 1024**4), ("GiB", 1024**3), ("MiB", 1024**2), ("KiB", 1024))
MAX_U64 = (1 << 64) - 1


def parse_size(text: str) -> int:
    """'512K', '1 MiB' and the like in bytes; an error for another suffix, or beyond 64 bits."""
    found = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].upper() not in SUFFIXES:
        raise ValueError(f"not a size: {text!r}")
    if (size := int(found[1]) * SUFFIXES[found[2].upper()]) > MAX_U64:
        raise OverflowError(f"size beyond 64 bits: {text!r}")
    return size


def parse_size_column(text: Column) -> Column:
    """parse_size for a column, as DECIMAL(38,0); null where the text is no size."""
    number, suffix = F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 1), F.upper(F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 2))
    factor = F.lit(None).cast("decimal(12,0)")
    for name, value in SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(value).cast("decimal(12,0)")).otherwise(factor)
    return (F.nullif(number, F.lit("")).cast("decimal(20,0)") * factor).cast("decimal(38,0)")


def align_up(value: Column, unit: int | Column) -> Column:
    """value rounded up to a multiple of unit; unit 0 leaves it."""
    unit = F.lit(unit) if isinstance(unit, int) else unit
    return F.when(unit > 0, value + F.pmod(unit - value % unit, unit)).otherwise(value)


def units(value: Column, unit: int) -> Column:
    """How many units hold a value."""
    return F.floor((value + (unit - 1)) / unit).cast("long")


def format_size(size: Column) -> Column:
    """One decimal of the largest unit, ties to the even digit; bytes below one KiB."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for name, unit in reversed(UNITS):
        ten = size.cast("decimal(24,0)") * 10
        tenths, rest = F.floor(ten / unit).cast("decimal(24,0)"), ten % unit
        up = (2 * rest > unit) | ((2 * rest == unit) & (tenths % 2 == 1))
        tenths = (tenths + F.when(up, 1).otherwise(0)).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))
        out = F.when(size >= unit, text).otherwise(out)
    return out


def format_size_short(size: Column) -> Column:
    """Whole decimal megabytes, or gigabytes from one on, halves rounded up."""
    mega, giga = F.floor((size + 500_000) / 1_000_000), F.floor((size + 500_000_000) / 1_000_000_000)
    return F.when(size >= 1_000_000_000, F.concat(giga.cast("string"), F.lit("GB"))).otherwise(F.concat(mega.cast("string"), F.lit("MB")))


def pick_block_size(volume: Column) -> Column:
    """The smallest power of two from 512 of which 65535 blocks hold the volume."""
    sizes = [SECTOR << k for k in range(24)]
    out = F.lit(sizes[-1])
    for size in reversed(sizes[:-1]):
        out = F.when(F.floor(volume / size) <= 65535, F.lit(size)).otherwise(out)
    return out


def min_plus_20(minimum: Column, original: Column) -> Column:
    """A fifth more than the minimum in whole sectors, never above the original."""
    grown = F.least(minimum + F.floor(minimum / 5), original)
    return F.when(minimum >= original, original).otherwise(F.least(align_up(grown, SECTOR), original))


def restore_size(choice: Column, original: Column, minimum: Column, defragmented: Column, imaged: Column, custom: Column, lba: Column, target: Column) -> Column:
    """Bytes of a restored partition by its choice: original, minimum, custom or fill."""
    least = F.coalesce(defragmented, minimum, F.when(imaged > 0, imaged), original)
    fill = F.when(target > lba * SECTOR, target - lba * SECTOR).otherwise(original)
    return F.when(choice == "minimum", align_up(least, SECTOR)).when(choice == "custom", align_up(custom, SECTOR)).when(choice == "fill", fill).otherwise(original)


def shrink_target(layout_preserving: Column, in_place: Column, defragmented: Column) -> Column:
    return F.when(layout_preserving, F.coalesce(in_place, defragmented)).otherwise(F.coalesce(defragmented, in_place))


def lba_to_chs(lba: Column, heads: Column, sectors: Column) -> Column:
    """struct(cylinder, head, sector); cylinders above 1023 give the largest address, no geometry gives zeros."""
    per = heads * sectors
    cylinder = F.floor(lba / per)
    make = lambda c, h, s: F.struct(c.cast("long").alias("cylinder"), h.cast("long").alias("head"), s.cast("long").alias("sector"))
    zero = make(F.lit(0), F.lit(0), F.lit(0))
    return F.when(per == 0, zero).when(cylinder > 1023, make(F.lit(1023), heads - 1, sectors)).otherwise(make(cylinder, F.floor(lba / sectors) % heads, lba % sectors + 1))


def byte_offset(start_byte: Column, start_lba: Column) -> Column:
    return F.coalesce(start_byte, start_lba * SECTOR)


def free_bytes(total: Column, used: Column) -> Column:
    return F.greatest(total - used, F.lit(0))


def eta_text(seconds: Column) -> Column:
    """Whole seconds as h, m and s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    part = lambda v, unit: F.concat(v.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))
