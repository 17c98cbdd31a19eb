"""Partition tables to one relation. Parsers take a reader of (offset, size) to bytes."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

from platterlake.sources.sniff import EXTENDED, GPT_TYPES, MBR_TYPES

Reader = Callable[[int, int], bytes]
SCHEMA = "image_id string, part_index int, scheme string, type_name string, type_byte int, type_string string, start_lba bigint, start_byte bigint, size_bytes bigint, bootable boolean, is_logical boolean, is_extended boolean"
SECTOR = 512
#: Logical partitions of one chain; a longer chain is an error, not cut.
MAX_LOGICALS = 128


def _row(index, scheme, name, byte, text, start, size, bootable=False, logical=False, unit=SECTOR):
    return (index, scheme, name, byte, text, start, start * unit, size * unit, bootable, logical, byte in EXTENDED and scheme == "mbr")


def _entries(sector: bytes) -> list[tuple[int, int, int, int]]:
    """(status, type, start, sectors) of the four slots of a table."""
    return [(e[0], e[4], *struct.unpack_from("<II", e, 8)) for e in (sector[446 + 16 * k : 462 + 16 * k] for k in range(4))]


def mbr(read: Reader) -> Iterator[tuple]:
    slots = _entries(read(0, SECTOR))
    for k, (status, kind, start, size) in enumerate(slots):
        if kind and size:
            yield _row(k, "mbr", MBR_TYPES.get(kind, f"Type {kind:02X}"), kind, None, start, size, status == 0x80)
    base = next((start for _, kind, start, size in slots if kind in EXTENDED and size), None)
    here, index, seen = base, 4, set()
    while here is not None and here not in seen:
        if len(seen) == MAX_LOGICALS:
            raise ValueError(f"a chain of more than {MAX_LOGICALS} logical partitions")
        seen.add(here)
        sector = read(here * SECTOR, SECTOR)
        if sector[510:512] != b"\x55\xaa":  # a broken chain ends the logical partitions, not the table
            return
        (status, kind, start, size), (_, next_kind, following, _), *_ = _entries(sector)
        if kind and size:
            yield _row(index, "mbr", MBR_TYPES.get(kind, f"Type {kind:02X}"), kind, None, here + start, size, status == 0x80, True)
            index += 1
        here = base + following if next_kind in EXTENDED else None


def gpt(read: Reader) -> Iterator[tuple]:
    header = read(SECTOR, SECTOR)
    if header[:8] != b"EFI PART":
        raise ValueError("the protective table has no GPT behind it")
    at, count, size = struct.unpack_from("<QII", header, 72)
    table, index = read(at * SECTOR, count * size), 0
    for k in range(count):
        entry = table[k * size : (k + 1) * size]
        if len(entry) < 128 or not any(entry[:16]):
            continue
        kind = str(uuid.UUID(bytes_le=entry[:16])).upper()
        first, last, flags = struct.unpack_from("<QQQ", entry, 32)
        name = entry[56:128].decode("utf-16-le", "replace").rstrip("\0")
        yield _row(index, "gpt", GPT_TYPES.get(kind, name or "Unknown"), None, kind, first, last - first + 1, bool(flags & 4))
        index += 1


def apm(read: Reader) -> Iterator[tuple]:
    (unit,) = struct.unpack_from(">H", read(0, SECTOR), 2)
    unit, k, count = unit or SECTOR, 1, 1
    while k <= count:
        entry = read(k * unit, SECTOR)
        if entry[:2] != b"PM":
            return
        count, start, size = struct.unpack_from(">III", entry, 4)
        name, kind = (entry[a : a + 32].split(b"\0")[0].decode("mac_roman") for a in (16, 48))
        (flags,) = struct.unpack_from(">I", entry, 88)
        yield _row(k - 1, "apm", name or kind, None, kind, start, size, bool(flags & 8), unit=unit)
        k += 1


def rdb(read: Reader) -> Iterator[tuple]:
    head = next((b for b in (read(SECTOR * k, SECTOR) for k in range(16)) if b[:4] == b"RDSK"), None)
    if head is None:
        return
    (unit, block), index, seen = (struct.unpack_from(">I", head, 16)[0], struct.unpack_from(">I", head, 28)[0]), 0, set()
    while block != 0xFFFFFFFF and block not in seen:
        seen.add(block)
        part = read(block * unit, 256)
        if part[:4] != b"PART":
            return
        following, flags = struct.unpack_from(">II", part, 16)
        name = part[37 : 37 + part[36]].decode("latin-1")
        surfaces, per_track = struct.unpack_from(">I", part, 140)[0], struct.unpack_from(">I", part, 148)[0]
        low, high = struct.unpack_from(">II", part, 164)
        kind = part[192:195].decode("latin-1") + (f"\\{part[195]}" if part[195] < 32 else chr(part[195]))
        yield _row(index, "rdb", name, None, kind, low * surfaces * per_track, (high - low + 1) * surfaces * per_track, bool(flags & 1), unit=unit)
        block, index = following, index + 1


def sgi(read: Reader) -> Iterator[tuple]:
    head = read(0, SECTOR)
    for k in range(16):
        size, start, kind = struct.unpack_from(">III", head, 312 + 12 * k)
        if size:
            yield _row(k, "sgi", {0: "Volume header", 3: "Raw", 5: "BSD", 6: "Volume", 7: "EFS", 10: "XFS"}.get(kind, f"Type {kind}"), kind, None, start, size)


def ahdi(read: Reader) -> Iterator[tuple]:
    head = read(0, SECTOR)
    for k in range(4):
        flag, kind, start, size = struct.unpack_from(">B3sII", head, 0x1C6 + 12 * k)
        if flag & 1 and size:
            yield _row(k, "ahdi", kind.decode("latin-1"), None, kind.decode("latin-1"), start, size, bool(flag & 0x80))


def x68k(read: Reader) -> Iterator[tuple]:
    table = read(2048, 256)
    for k in range(15):
        name, start, size = struct.unpack_from(">8sII", table, 16 * (k + 1))
        if name.strip(b"\0 ") and size:
            yield _row(k, "x68k", name.decode("shift_jis", "replace").strip("\0 "), None, None, start & 0xFFFFFF, size, not start >> 24, unit=1024)


def write_mbr(rows: list[tuple[int, int, int, bool]], code: bytes = b"") -> bytes:
    """The first sector of up to four (type, start, sectors, bootable)."""
    if len(rows) > 4:
        raise ValueError("a table has four slots")
    slots = b"".join(struct.pack("<B3sB3sII", 0x80 if boot else 0, chs(start), kind, chs(start + size - 1), start, size) for kind, start, size, boot in rows)
    return code[:446].ljust(446, b"\0") + slots.ljust(64, b"\0") + b"\x55\xaa"


def chs(lba: int, heads: int = 255, sectors: int = 63) -> bytes:
    """A packed address of three bytes; the largest one beyond what it can tell."""
    cylinder = lba // (heads * sectors)
    if cylinder > 1023:
        cylinder, head, sector = 1023, heads - 1, sectors
    else:
        head, sector = lba // sectors % heads, lba % sectors + 1
    return bytes([head, sector | cylinder >> 2 & 0xC0, cylinder & 0xFF])


def write_gpt(rows: list[tuple[str, int, int, str]], sectors: int, disk_id: uuid.UUID = uuid.UUID(int=0)) -> tuple[bytes, bytes]:
    """The first 34 and the last 33 sectors of a disk of (type GUID, start, sectors, name), with their checksums."""
    table = b"".join(uuid.UUID(kind).bytes_le + uuid.uuid5(disk_id, str(k)).bytes_le + struct.pack("<QQQ", start, start + size - 1, 0) + name.encode("utf-16-le")[:72].ljust(72, b"\0") for k, (kind, start, size, name) in enumerate(rows))
    table = table.ljust(128 * 128, b"\0")

    def header(here: int, other: int, at: int) -> bytes:
        body = struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, here, other, 34, sectors - 34, disk_id.bytes_le, at, 128, 128, zlib.crc32(table))
        return (body[:16] + struct.pack("<I", zlib.crc32(body)) + body[20:]).ljust(SECTOR, b"\0")

    protective = write_mbr([(0xEE, 1, min(sectors - 1, 0xFFFFFFFF), False)])
    return protective + header(1, sectors - 1, 2) + table, table + header(sectors - 1, 1, sectors - 33)


def check_gpt(read: Reader) -> list[str]:
    """What is wrong with a table's checksums; nothing where it is whole."""
    head, out = read(SECTOR, SECTOR), []
    (size,), (stored,), (at, count, each, crc) = struct.unpack_from("<I", head, 12), struct.unpack_from("<I", head, 16), struct.unpack_from("<QIII", head, 72)
    if zlib.crc32(head[:16] + bytes(4) + head[20:size]) != stored:
        out.append("the header's checksum is wrong")
    if zlib.crc32(read(at * SECTOR, count * each)) != crc:
        out.append("the table's checksum is wrong")
    return out


def write_apm(rows: list[tuple[str, str, int, int]], sectors: int) -> bytes:
    """The driver descriptor and the map of (name, type, start, sectors); the map's own entry comes first."""
    every = [("Apple", "Apple_partition_map", 1, 63), *rows]
    out = struct.pack(">2sHI", b"ER", SECTOR, sectors).ljust(SECTOR, b"\0")
    for name, kind, start, size in every:
        out += struct.pack(">2s2xIII32s32sIII", b"PM", len(every), start, size, name.encode("mac_roman")[:32], kind.encode("mac_roman")[:32], 0, size, 0x33).ljust(SECTOR, b"\0")
    return out.ljust(64 * SECTOR, b"\0")


PARSERS = {"mbr": mbr, "gpt": gpt, "apm": apm, "rdb": rdb, "sgi": sgi, "ahdi": ahdi, "x68k": x68k}


def detect(read: Reader) -> str:
    """The scheme of a disk, in the order in which the rules are tried."""
    head = read(0, 8192)
    if head[:4] == b"\x0b\xe5\xa9\x41":
        return "sgi"
    if head[:2] == b"ER":
        return "apm"
    if any(head[512 * k : 512 * k + 4] == b"RDSK" for k in range(16)):
        return "rdb"
    signed = head[510:512] == b"\x55\xaa"
    if not signed and head[0x1C6:0x1C7] and head[0x1C6] & 1 and head[0x1C7:0x1CA] in (b"GEM", b"BGM", b"RA_"):
        return "ahdi"
    if head[2048:2052] == b"X68K":
        return "x68k"
    if signed and any(kind == 0xEE for _, kind, _, _ in _entries(head)):
        return "gpt"
    return "mbr" if signed and any(kind and size and status in (0, 0x80) for status, kind, _, size in _entries(head)) else "none"


def partitions(read: Reader, size: int) -> Iterator[tuple]:
    """Rows of a disk; a disk without a table is one partition."""
    found = detect(read)
    if found == "none":
        yield (0, "none", "Volume", None, None, 0, 0, size, False, False, False)
    else:
        yield from PARSERS[found](read)
