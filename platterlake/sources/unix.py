"""Filesystems of Unix systems beside ext: UFS in either byte order, and XFS."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime

from platterlake.sources.entries import Entry

#: What the file type bits of a mode stand for.
KINDS = {0o040000: "directory", 0o100000: "file", 0o120000: "symlink"}


def _when(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d %H:%M:%S")


class _Unix:
    """A tree of inodes from a root: a subclass tells an inode's fields, its extents (first block of the file, place in bytes,
    bytes) and a directory's names."""

    ROOT = 2

    def _content(self, inode: dict) -> bytes:
        if inode.get("inline") is not None:
            return inode["inline"][: inode["size"]]
        out = bytearray(inode["size"])
        for at, place, count in self._extents(inode):
            room = max(0, min(count, inode["size"] - at))
            out[at : at + room] = self.data[place : place + room].ljust(room, b"\0")
        return bytes(out)

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", self.ROOT)], {self.ROOT}
        while todo:
            parent, number = todo.pop()
            for child, name in self._names(self._inode(number)):
                if name in (".", ".."):
                    continue
                inode = self._inode(child)
                kind, path = KINDS.get(inode["mode"] & 0o170000, "special"), f"{parent}/{name}"
                made = Entry(path, kind, 0 if kind == "directory" else inode["size"], child, _when(inode["mtime"]), inode["mode"], inode["uid"], inode["gid"])
                if kind in ("file", "directory") and inode.get("inline") is None:
                    made.extents = [(place // self.unit, -(-count // self.unit)) for _, place, count in self._extents(inode)]
                if kind == "symlink":
                    made.symlink_target = self._content(inode).decode("utf-8", "replace")
                elif kind == "file" and contents:
                    made.content = self._content(inode)
                elif kind == "directory" and child not in seen:
                    seen.add(child)
                    todo.append((path, child))
                yield made


    def links(self) -> Iterator[tuple[str, int, int | None, int | None]]:
        """Every inode that names lead to, with its stored links, and every name: its folder and what it names. A folder that
        stores no names for itself and its parent is given them."""
        todo, seen = [(self.ROOT, self.ROOT)], {self.ROOT}
        while todo:
            number, parent = todo.pop()
            inode = self._inode(number)
            yield "inode", number, inode["links"], None
            if inode["mode"] & 0o170000 != 0o040000:
                continue
            own = list(self._names(inode))
            if not any(name == "." for _, name in own):
                own = [(number, "."), (parent, ".."), *own]
            for child, name in own:
                yield "name", number, None, child
                if name not in (".", "..") and child not in seen:
                    seen.add(child)
                    todo.append((child, number))


class Ufs(_Unix):
    """UFS1 and UFS2: twelve direct blocks and three levels of indirect ones, in fragments."""

    def __init__(self, data):
        self.data = data
        at, self.order, self.wide = next((at, order, magic == 0x19540119) for at in (8192, 65536) for order in "<>" for magic in (0x00011954, 0x19540119) if data[at + 1372 : at + 1376] == struct.pack(order + "I", magic))
        sb = data[at : at + 1376]
        get = lambda place, kind="i": struct.unpack_from(self.order + kind, sb, place)[0]
        self.inodes_at, self.block, self.fragment = get(16), get(48), get(52)
        self.per_group, self.group = get(184), get(188)
        self.skew, self.mask = (0, 0) if self.wide else (get(24), get(28))
        self.unit = self.fragment

    def _get(self, kind: str, raw: bytes, at: int) -> int:
        return struct.unpack_from(self.order + kind, raw, at)[0]

    def _inode(self, n: int) -> dict:
        size, group = 256 if self.wide else 128, n // self.per_group
        start = group * self.group + self.skew * (group & ~self.mask) + self.inodes_at
        raw = self.data[start * self.fragment + n % self.per_group * size : start * self.fragment + (n % self.per_group + 1) * size]
        if self.wide:
            out = {"mode": self._get("H", raw, 0), "links": self._get("H", raw, 2), "uid": self._get("I", raw, 4), "gid": self._get("I", raw, 8), "size": self._get("Q", raw, 16), "mtime": self._get("q", raw, 40), "blocks": struct.unpack_from(self.order + "15q", raw, 112), "raw": raw[112:232]}
        else:
            out = {"mode": self._get("H", raw, 0), "links": self._get("H", raw, 2), "size": self._get("Q", raw, 8), "mtime": self._get("i", raw, 24), "blocks": struct.unpack_from(self.order + "15i", raw, 40), "uid": self._get("I", raw, 112), "gid": self._get("I", raw, 116), "raw": raw[40:100]}
        if out["mode"] & 0o170000 == 0o120000 and out["size"] < len(out["raw"]):
            out["inline"] = out["raw"]
        return out

    def _mapped(self, place: int, level: int, first: int) -> Iterator[tuple[int, int]]:
        if not place:
            return
        if not level:
            yield first, place
            return
        width = 8 if self.wide else 4
        per = self.block // width
        raw = self.data[place * self.fragment : place * self.fragment + self.block]
        for k, child in enumerate(struct.unpack(f"{self.order}{per}{'q' if self.wide else 'i'}", raw)):
            yield from self._mapped(child, level - 1, first + k * per ** (level - 1))

    def _extents(self, inode: dict) -> list[tuple[int, int, int]]:
        per, out, first = self.block // (8 if self.wide else 4), [], 12
        found = [(k, p) for k, p in enumerate(inode["blocks"][:12]) if p]
        for level in (1, 2, 3):
            found += self._mapped(inode["blocks"][11 + level], level, first)
            first += per**level
        for k, place in found:
            at = k * self.block
            if at >= inode["size"]:
                break
            size = min(self.block, -(-(inode["size"] - at) // self.fragment) * self.fragment)
            if out and out[-1][0] + out[-1][2] == at and out[-1][1] + out[-1][2] == place * self.fragment:
                out[-1] = (out[-1][0], out[-1][1], out[-1][2] + size)
            else:
                out.append((at, place * self.fragment, size))
        return out

    def _names(self, inode: dict) -> Iterator[tuple[int, str]]:
        table, at = self._content(inode), 0
        while at + 8 <= len(table):
            child, length, _, size = struct.unpack_from(self.order + "IHBB", table, at)
            if child:
                yield child, table[at + 8 : at + 8 + size].decode("utf-8", "replace")
            at += length or len(table)


class Xfs(_Unix):
    """XFS versions 4 and 5: inodes in groups; files inline, in lists or in trees of extents; directories short, in one block or in many."""

    def __init__(self, data):
        self.data, sb = data, data[:264]
        get = lambda kind, at: struct.unpack_from(">" + kind, sb, at)[0]
        self.block, self.ROOT, self.group = get("I", 4), get("Q", 56), get("I", 84)
        self.version, self.inode_size, self.inode_log, self.group_log, self.folder_log = get("H", 100) & 15, get("H", 104), sb[123], sb[124], sb[192]
        self.typed = bool(get("I", 216) & 1) if self.version == 5 else bool(get("I", 200) & 0x200)
        self.unit = self.block

    def _place(self, block: int) -> int:
        """The byte at which a block starts, whose number holds that of its group."""
        group, inside = block >> self.group_log, block & (1 << self.group_log) - 1
        return (group * self.group + inside) * self.block

    def _inode(self, n: int) -> dict:
        start = self._place(n >> self.inode_log) + (n & (1 << self.inode_log) - 1) * self.inode_size
        raw = self.data[start : start + self.inode_size]
        head = 176 if raw[4] == 3 else 100
        fork = raw[head : head + raw[82] * 8] if raw[82] else raw[head:]
        get = lambda kind, at: struct.unpack_from(">" + kind, raw, at)[0]
        out = {"mode": get("H", 2), "links": get("I", 16) if raw[4] > 1 else get("H", 6), "format": raw[5], "uid": get("I", 8), "gid": get("I", 12), "mtime": get("i", 40), "size": get("Q", 56), "count": get("I", 76), "fork": fork, "number": n}
        if out["format"] == 1:
            out["inline"] = fork
        return out

    def _records(self, raw: bytes, count: int) -> Iterator[tuple[int, int, int]]:
        """(first block of the file, block, blocks): 54, 52 and 21 bits behind a flag."""
        for k in range(count):
            value = int.from_bytes(raw[16 * k : 16 * k + 16], "big")
            if not value >> 127:  # allocated but not written: zeros
                yield value >> 73 & (1 << 54) - 1, value >> 21 & (1 << 52) - 1, value & (1 << 21) - 1

    def _tree(self, block: int, level: int) -> Iterator[tuple[int, int, int]]:
        raw, head = self.data[self._place(block) : self._place(block) + self.block], 72 if self.version == 5 else 24
        (count,) = struct.unpack_from(">H", raw, 6)
        if not level:
            yield from self._records(raw[head:], count)
            return
        most = (self.block - head) // 16
        for k in range(count):
            yield from self._tree(struct.unpack_from(">Q", raw, head + 8 * most + 8 * k)[0], level - 1)

    def _blocks(self, inode: dict) -> list[tuple[int, int, int]]:
        fork = inode["fork"]
        if inode["format"] == 2:
            return list(self._records(fork, inode["count"]))
        if inode["format"] != 3:
            return []
        level, count = struct.unpack_from(">HH", fork)
        most = (len(fork) - 4) // 16
        return [r for k in range(count) for r in self._tree(struct.unpack_from(">Q", fork, 4 + 8 * most + 8 * k)[0], level - 1)]

    def _extents(self, inode: dict) -> list[tuple[int, int, int]]:
        return [(at * self.block, self._place(block), count * self.block) for at, block, count in self._blocks(inode)]

    def _names(self, inode: dict) -> Iterator[tuple[int, str]]:
        if inode["format"] == 1:
            raw = inode["inline"]
            width, at = 8 if raw[1] else 4, 2 + (8 if raw[1] else 4)
            for _ in range(raw[0]):
                size = raw[at]
                after = at + 3 + size + self.typed
                yield int.from_bytes(raw[after : after + width], "big"), raw[at + 3 : at + 3 + size].decode("utf-8", "replace")
                at = after + width
            return
        size = self.block << self.folder_log
        last = (32 << 30) // self.block  # names lie below this place, their hashes above
        pieces: dict[int, bytearray] = {}
        for at, block, count in self._blocks(inode):
            for k in range(count if at < last else 0):
                where = (at + k) * self.block
                piece = pieces.setdefault(where // size, bytearray(size))
                piece[where % size : where % size + self.block] = self.data[self._place(block + k) : self._place(block + k) + self.block]
        for _, raw in sorted(pieces.items()):
            magic, end = bytes(raw[:4]), size
            if magic in (b"XD2B", b"XDB3"):
                end = size - 8 - 8 * struct.unpack_from(">I", raw, size - 8)[0]
            at = 64 if magic in (b"XDB3", b"XDD3") else 16
            while at + 8 < end:
                if raw[at : at + 2] == b"\xff\xff":
                    at += struct.unpack_from(">H", raw, at + 2)[0] or size
                    continue
                number, length = struct.unpack_from(">QB", raw, at)
                yield number, bytes(raw[at + 9 : at + 9 + length]).decode("utf-8", "replace")
                at += -(-(9 + length + self.typed + 2) // 8) * 8


DRIVERS = {"ufs": Ufs, "xfs": Xfs}
