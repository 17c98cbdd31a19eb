"""What all drivers yield: entries of a volume, folders before what they hold."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

ALLOCATION = "image_id string, part_index int, fs_type string, block_size bigint, start bigint, blocks bigint, used boolean"
LINKS = "image_id string, part_index int, record string, inode bigint, links bigint, child bigint"
PROBLEMS = "image_id string, part_index int, severity string, code string, message string"
CATALOG = "image_id string, part_index int, record string, cnid bigint, parent bigint, name string, valence bigint"

SCHEMA = (
    "image_id string, part_index int, fs_type string, path string, parent_path string, name string, kind string, size bigint, location bigint, "
    "modified string, mode int, uid int, gid int, dos_attributes int, type_code string, creator_code string, resource_fork_size bigint, symlink_target string, "
    "extents array<struct<start:bigint,blocks:bigint>>, content binary"
)


def unpack_from(shape: str, data, at: int = 0) -> tuple:
    """struct.unpack_from that also takes what only slices like bytes."""
    if isinstance(data, bytes | bytearray | memoryview):
        return struct.unpack_from(shape, data, at)
    return struct.unpack(shape, data[at : at + struct.calcsize(shape)])


def part(data, start: int, size: int) -> bytes:
    return data[start : start + size]


def runs_of_bits(bitmap: bytes, count: int, first: int = 0, high_first: bool = False) -> Iterator[tuple[int, int, bool]]:
    """(start, length, set) of the equal neighbours among a bitmap's first `count` bits, numbered from `first`."""
    now, start = None, 0
    for at in range(0, -(-count // 8), 4096):
        piece = bitmap[at : at + 4096].ljust(min(4096, -(-count // 8) - at), b"\0")
        bits = np.unpackbits(np.frombuffer(piece, np.uint8), bitorder="big" if high_first else "little")[: count - 8 * at]
        edges = np.flatnonzero(np.diff(bits)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(bits)], strict=True):
            if bits[a] != now:
                if now is not None:
                    yield first + start, 8 * at + a - start, bool(now)
                now, start = bits[a], 8 * at + a
    if now is not None and count > start:
        yield first + start, count - start, bool(now)


@dataclass
class Entry:
    path: str
    kind: str
    size: int = 0
    location: int = 0
    modified: str | None = None
    mode: int | None = None
    uid: int | None = None
    gid: int | None = None
    dos_attributes: int | None = None
    type_code: str | None = None
    creator_code: str | None = None
    resource_fork_size: int | None = None
    symlink_target: str | None = None
    extents: list[tuple[int, int]] = field(default_factory=list)
    content: bytes | None = None

    def row(self, image: str, part: int, fs: str) -> tuple:
        parent, _, name = self.path.rpartition("/")
        return (image, part, fs, self.path, parent or "/", name, self.kind, self.size, self.location, self.modified, self.mode, self.uid, self.gid, self.dos_attributes, self.type_code, self.creator_code, self.resource_fork_size, self.symlink_target, self.extents, self.content)


def grouped(numbers: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as (start, length)."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and sum(out[-1]) == n:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out
