"""Resource forks: their maps, and the alias records in them."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def resources(fork: bytes) -> dict[tuple[bytes, int], bytes]:
    """{(type, id): bytes} of a fork; nothing of one that is too short for its own map."""
    out: dict[tuple[bytes, int], bytes] = {}
    if len(fork) < 16:
        return out
    data_at, map_at, _, map_size = struct.unpack_from(">4I", fork)
    table = fork[map_at : map_at + map_size]
    if len(table) < map_size or map_size < 30:
        return out
    (types_at,) = struct.unpack_from(">H", table, 24)
    count = struct.unpack_from(">H", table, types_at)[0] + 1 & 0xFFFF
    for k in range(count):
        if types_at + 10 + 8 * k > len(table):
            break
        kind, more, refs_at = struct.unpack_from(">4sHH", table, types_at + 2 + 8 * k)
        for n in range(more + 1 & 0xFFFF):
            at = types_at + refs_at + 12 * n
            if at + 12 > len(table):
                break
            number, _, place = struct.unpack_from(">hhI", table, at)
            start = data_at + (place & 0xFFFFFF)
            if start + 4 <= len(fork):
                (size,) = struct.unpack_from(">I", fork, start)
                if start + 4 + size <= len(fork):
                    out[kind, number] = fork[start + 4 : start + 4 + size]
    return out


def write_fork(items: dict[tuple[bytes, int], bytes]) -> bytes:
    body, refs, kinds = b"", {}, list(dict.fromkeys(kind for kind, _ in items))
    for (kind, number), data in items.items():
        refs.setdefault(kind, []).append(struct.pack(">hhII", number, -1, len(body), 0))
        body += struct.pack(">I", len(data)) + data
    at, entries = 2 + 8 * len(kinds), b""
    for kind in kinds:
        entries += struct.pack(">4sHH", kind, len(refs[kind]) - 1, at)
        at += 12 * len(refs[kind])
    lists = struct.pack(">H", len(kinds) - 1 & 0xFFFF) + entries + b"".join(r for kind in kinds for r in refs[kind])
    table = bytes(24) + struct.pack(">HH", 28, 28 + len(lists)) + lists
    return struct.pack(">4I", 256, 256 + len(body), len(body), len(table)).ljust(256, b"\0") + body + table


def alias_text(record: bytes) -> str | None:
    """Where an alias leads: the path that it tells, else volume:name; null for a record that is too short."""
    if len(record) < 114:
        return None
    pascal = lambda raw: raw[1 : 1 + min(raw[0], len(raw) - 1)].decode("mac_roman").rstrip("\0")
    volume, target, at = pascal(record[10:38]), pascal(record[50:114]), 150
    while at + 4 <= len(record):
        tag, size = struct.unpack_from(">HH", record, at)
        data = record[at + 4 : at + 4 + size]
        if tag == 0xFFFF or len(data) < size:
            break
        path = data.rstrip(b"\0").decode("utf-8", "replace") if tag == 18 else "".join(chr(b) if b < 128 else "?" for b in data.split(b"\0")[0]) if tag == 2 else ""
        if path:
            return path
        at += 4 + size + (size & 1)
    return f"{volume}:{target}" if volume else target or None


def alias_target(fork: Column) -> Column:
    """alias_text of a fork's first alias record; null where it has none."""

    def each(forks: pd.Series) -> pd.Series:
        def one(raw):
            found = [] if raw is None else [data for (kind, _), data in resources(bytes(raw)).items() if kind == b"alis"]
            return alias_text(found[0]) if found else None

        return pd.Series([one(raw) for raw in forks], dtype=object)

    return F.pandas_udf(each, "string")(fork)


def write_alias(volume: str, target: str, path: str | None = None) -> bytes:
    raw = lambda text, n: (bytes([len(text)]) + text.encode("mac_roman")).ljust(n, b"\0")
    out = bytes(10) + raw(volume, 28) + bytes(12) + raw(target, 64) + bytes(36)
    if path is not None:
        data = path.encode()
        out += struct.pack(">HH", 18, len(data)) + data + bytes(len(data) & 1)
    return out + struct.pack(">HH", 0xFFFF, 0)
