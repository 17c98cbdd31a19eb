"""The journal of HFS+: transactions of sectors that a replay writes back, oldest first."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from platterlake.functions.digests import journal_checksum

SCHEMA = "image_id string, part_index int, seq bigint, sector bigint, bytes binary, good boolean"
MAGIC, NATIVE, KILLED = 0x4A4E4C78, 0x12345678, (1 << 64) - 1
#: Bytes of the journal's header, and of a transaction's, that their checksums cover, and where these stand.
HEADER, LIST, HEADER_SUM, LIST_SUM = 44, 32, 36, 8


def _sum(raw: bytes, at: int) -> int:
    return journal_checksum(raw[:at] + bytes(4) + raw[at + 4 :])


def transactions(data) -> Iterator[tuple[int, int, bytes, bool]]:
    """(seq, sector, bytes, good) of a volume's journal, nothing of a volume without one. A transaction whose checksum is wrong
    comes out with its first sector alone, not good, and is the last."""
    head = data[1024:1536]
    attributes, info = struct.unpack_from(">I", head, 4)[0], struct.unpack_from(">I", head, 12)[0]
    if head[:2] not in (b"H+", b"HX") or not attributes & 0x2000 or not info:
        return
    (block,) = struct.unpack_from(">I", head, 40)
    where = data[info * block : info * block + 52]
    flags, place, size = struct.unpack_from(">I", where)[0], *struct.unpack_from(">QQ", where, 36)
    if not flags & 1:  # it lies on another device
        return
    raw = data[place : place + HEADER]
    order = next((o for o in "<>" if struct.unpack_from(o + "II", raw) == (MAGIC, NATIVE)), None)
    if order is None:
        return
    start, end, total, list_size, stored, sector = struct.unpack_from(order + "QQQIII", raw, 8)
    if _sum(raw, HEADER_SUM) != stored:
        raise ValueError("the journal's header is damaged")

    def read(at: int, count: int) -> tuple[bytes, int]:
        """Bytes of the ring, and the place behind them."""
        out = b""
        while count:
            if at >= total:
                at = sector + at - total
            take = min(count, total - at)
            out += bytes(data[place + at : place + at + take])
            at, count = at + take, count - take
        return out, at if at < total else sector

    seq = 0
    while start != end:
        seq += 1
        head, at = read(start, list_size)
        _, count, used, stored, _ = struct.unpack_from(order + "HHiIi", head)
        blocks = [struct.unpack_from(order + "QI", head, 16 + 16 * k) for k in range(1, min(count, list_size // 16 - 1))]
        if _sum(head[:LIST], LIST_SUM) != stored or used < list_size:
            yield seq, blocks[0][0] if blocks else 0, b"", False
            return
        for number, length in blocks:
            body, at = read(at, length)
            if number != KILLED:
                yield from ((seq, number + k // sector, body[k : k + sector], True) for k in range(0, length, sector))
        _, start = read(start, used)
