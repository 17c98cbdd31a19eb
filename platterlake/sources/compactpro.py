"""Compact Pro archives: a directory behind the forks, which are run-length coded; those coded further are not decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from platterlake.functions.dates import MAC_EPOCH
from platterlake.sources.entries import Entry

#: The two bytes that announce a run, and the flags of a file.
FIRST, SECOND = 0x81, 0x82
ENCRYPTED, RESOURCE_LZH, DATA_LZH = 1, 2, 4


def unrun(raw: bytes) -> bytes:
    """81 82 and a count: the byte before them once more, that often less one; a count of zero is the two bytes themselves."""
    out, k = bytearray(), 0
    while k < len(raw):
        if raw[k : k + 2] == b"\x81\x82" and k + 2 < len(raw):
            count = raw[k + 2]
            out += out[-1:] * (count - 1) if count else b"\x81\x82"
            k += 3
        else:
            out.append(raw[k])
            k += 1
    return bytes(out)


def is_compactpro(data) -> bool:
    """By the first byte, and a directory that lies inside and names at least one entry."""
    head = bytes(data[:8])
    if len(head) < 8 or head[0] != 1:
        return False
    at = int.from_bytes(head[4:8], "big")
    table = bytes(data[at : at + 8]) if 8 <= at <= len(data) - 8 else b""
    return len(table) == 8 and 0 < int.from_bytes(table[4:6], "big") and _directory_sum(bytes(data[at:])) == int.from_bytes(table[:4], "big")


def _walk(table: bytes, at: int, count: int, parent: str) -> Iterator[tuple[str, int, bytes]]:
    """(path, where its fields start, fields) of a folder's entries and of all below; the last one's end ends the directory."""
    done = 0
    while done < count:
        size = table[at] & 0x7F
        path = f"{parent}/{table[at + 1 : at + 1 + size].decode('mac_roman').replace('/', ':')}"
        folder, at = table[at] & 0x80, at + 1 + size
        if folder:
            (inner,) = struct.unpack_from(">H", table, at)
            yield path, at + 2, b""
            at += 2
            for found in _walk(table, at, inner, path):
                yield found
                at = found[1] + len(found[2])
            done += inner + 1
        else:
            yield path, at, table[at : at + 45]
            at, done = at + 45, done + 1


def _directory_sum(table: bytes) -> int:
    """The checksum of a directory from its count of entries to its end."""
    try:
        count, comment = struct.unpack_from(">HB", table, 4)
        end = 7 + comment
        for _, at, fields in _walk(table, 7 + comment, count, ""):
            end = at + len(fields)
        return zlib.crc32(table[4:end]) ^ 0xFFFFFFFF
    except (IndexError, struct.error):
        return -1


def compactpro(data: bytes, contents: bool = False) -> Iterator[Entry]:
    """Folders and files in order; a fork that is coded further than by runs, or encrypted, has a null content."""
    at = int.from_bytes(data[4:8], "big")
    table = data[at:]
    count, comment = struct.unpack_from(">HB", table, 4)
    for path, place, fields in _walk(table, 7 + comment, count, ""):
        if not fields:
            yield Entry(path, "directory", 0, at + place)
            continue
        _, start, kind, creator, _, modified, _, crc, flags, rsize, size, rpacked, packed = struct.unpack(">BI4s4sIIHIHIIII", fields)
        when = datetime.fromtimestamp(max(0, modified - MAC_EPOCH), UTC).strftime("%Y-%m-%d %H:%M:%S") if modified else None
        body = None
        if contents and not flags & (ENCRYPTED | DATA_LZH):
            body = unrun(data[start + rpacked : start + rpacked + packed])
            resource = unrun(data[start : start + rpacked]) if not flags & RESOURCE_LZH else None
            if resource is not None and zlib.crc32(resource + body) ^ 0xFFFFFFFF != crc:
                raise ValueError("a file's checksum is wrong")
        yield Entry(path, "file", size, start, when, type_code=kind.decode("mac_roman"), creator_code=creator.decode("mac_roman"), resource_fork_size=rsize, content=body)


def runs(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = 1
        while n < 250 and k + n < len(data) and data[k + n] == data[k]:
            n += 1
        if data[k : k + 2] == b"\x81\x82":
            out += b"\x81\x82\x00"
            k += 2
        elif n > 4:
            out += bytes([data[k], FIRST, SECOND, n])
            k += n
        else:
            out.append(data[k])
            k += 1
    return bytes(out)


def write_compactpro(files: dict[str, bytes | None]) -> bytes:
    """files: {path: bytes or None for a folder}, each folder before what it holds."""
    body, places = b"", {}
    for path, data in files.items():
        if data is not None:
            packed = runs(data)
            places[path] = struct.pack(">BI4s4sIIHIHIIII", 1, 8 + len(body), b"TEXT", b"ttxt", 3786912000, 3786912000, 0, zlib.crc32(data) ^ 0xFFFFFFFF, 0, 0, len(data), 0, len(packed))
            body += packed

    def folder(parent: str) -> tuple[bytes, int]:
        out, count = b"", 0
        for path, data in files.items():
            if path.rpartition("/")[0] == parent:
                raw = path.rpartition("/")[2].encode("mac_roman")
                if data is None:
                    inner, n = folder(path)
                    out += bytes([len(raw) | 0x80]) + raw + struct.pack(">H", n) + inner
                    count += n + 1
                else:
                    out += bytes([len(raw)]) + raw + places[path]
                    count += 1
        return out, count

    entries, count = folder("")
    table = struct.pack(">HB", count, 0) + entries
    return struct.pack(">BBHI", 1, 1, 0, 8 + len(body)) + body + struct.pack(">I", zlib.crc32(table) ^ 0xFFFFFFFF) + table
