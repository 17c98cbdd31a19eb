"""Filesystems to rows of entries. A driver takes a volume's bytes and yields Entry rows, folders before what they hold."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from platterlake.sources import floppies, unix
from platterlake.sources.entries import SCHEMA, Entry, grouped, part, runs_of_bits, unpack_from  # noqa: F401
from platterlake.sources.sniff import filesystem_of

class Fat:
    """FAT12, FAT16 and FAT32; the width follows from the number of clusters."""

    def __init__(self, data: bytes):
        self.data = data
        sector, self.per_cluster, reserved, fats, roots, small, _, fat16, _, _, _, large, fat32 = unpack_from("<HBHBHHBHHHIII", data, 11)
        per_fat, total = fat16 or fat32, small or large
        self.sector, self.fat_at = sector, reserved * sector
        self.root_at = (reserved + fats * per_fat) * sector
        self.root_size = -(-roots * 32 // sector) * sector
        self.data_at = self.root_at + self.root_size
        self.clusters = (total - self.data_at // sector) // self.per_cluster
        self.bits = 12 if self.clusters < 4085 else 16 if self.clusters < 65525 else 32
        self.root_cluster = unpack_from("<I", data, 44)[0] if self.bits == 32 else 0
        self.cluster = self.per_cluster * sector

    def entry(self, n: int) -> int:
        if self.bits == 12:
            (pair,) = unpack_from("<H", self.data, self.fat_at + n * 3 // 2)
            return pair >> 4 if n & 1 else pair & 0xFFF
        if self.bits == 16:
            return unpack_from("<H", self.data, self.fat_at + 2 * n)[0]
        return unpack_from("<I", self.data, self.fat_at + 4 * n)[0] & 0x0FFFFFFF

    def chain(self, first: int) -> list[int]:
        out, seen, at = [], set(), first
        while 2 <= at < self.clusters + 2 and at not in seen:
            seen.add(at)
            out.append(at)
            at = self.entry(at)
        return out

    def bytes_of(self, clusters: list[int]) -> bytes:
        return b"".join(part(self.data, self.data_at + (c - 2) * self.cluster, self.cluster) for c in clusters)

    @property
    def unit(self) -> int:
        return self.cluster

    def allocation(self) -> Iterator[tuple[int, int, bool]]:
        """Runs of clusters that are used, or free."""
        now, start = None, 2
        for n in range(2, self.clusters + 2):
            used = self.entry(n) != 0
            if used != now:
                if now is not None:
                    yield start, n - start, now
                now, start = used, n
        if now is not None:
            yield start, self.clusters + 2 - start, now

    @staticmethod
    def _time(date: int, time: int) -> str | None:
        if not date:
            return None
        return f"{(date >> 9) + 1980:04}-{date >> 5 & 15:02}-{date & 31:02} {time >> 11:02}:{time >> 5 & 63:02}:{(time & 31) * 2:02}"

    def entries(self, contents: bool) -> Iterator[Entry]:
        root = self.bytes_of(self.chain(self.root_cluster)) if self.bits == 32 else self.data[self.root_at : self.root_at + self.root_size]
        todo, seen = [("", root)], set()
        while todo:
            parent, table = todo.pop()
            long_name: dict[int, str] = {}
            for at in range(0, len(table) - 31, 32):
                slot = table[at : at + 32]
                if slot[0] == 0:
                    break
                attributes = slot[11]
                if slot[0] == 0xE5:
                    long_name = {}
                elif attributes & 0x3F == 0x0F:
                    long_name[slot[0] & 0x1F] = (slot[1:11] + slot[14:26] + slot[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")
                elif attributes & 0x08:
                    long_name = {}
                else:
                    base, ending = (slot[a:b].decode("cp437").rstrip() for a, b in ((0, 8), (8, 11)))
                    base, ending = (x.lower() if slot[12] & bit else x for x, bit in ((base, 0x08), (ending, 0x10)))
                    name = "".join(long_name[k] for k in sorted(long_name)) or base + ("." + ending if ending else "")
                    long_name = {}
                    if base in (".", ".."):
                        continue
                    high, time, date, low, size = unpack_from("<HHHHI", slot, 20)
                    first = low | (high << 16 if self.bits == 32 else 0)
                    clusters = self.chain(first)
                    path = f"{parent}/{name}"
                    made = Entry(path, "directory" if attributes & 0x10 else "file", 0 if attributes & 0x10 else size, first, self._time(date, time), dos_attributes=attributes, extents=grouped(clusters))
                    if attributes & 0x10:
                        if first not in seen:
                            seen.add(first)
                            todo.append((path, self.bytes_of(clusters)))
                    elif contents:
                        made.content = self.bytes_of(clusters)[:size]
                    yield made


class Ext:
    """ext2, ext3 and ext4: block maps and extent trees, read only."""

    def __init__(self, data: bytes):
        self.data, sb = data, data[1024:2048]
        self.block = 1024 << unpack_from("<I", sb, 24)[0]
        (self.per_group,) = unpack_from("<I", sb, 40)
        self.inode_size = unpack_from("<H", sb, 88)[0] if unpack_from("<I", sb, 76)[0] else 128
        self.groups_at = self.block * (1 if self.block > 1024 else 2)
        wide = unpack_from("<I", sb, 96)[0] & 0x80
        self.group_size = max(32, unpack_from("<H", sb, 254)[0]) if wide else 32

    @property
    def unit(self) -> int:
        return self.block

    def allocation(self) -> Iterator[tuple[int, int, bool]]:
        """Runs of blocks, group by group; a group whose bitmap was never written is left out."""
        sb = self.data[1024:2048]
        (total,), (first,), (per,) = unpack_from("<I", sb, 4), unpack_from("<I", sb, 20), unpack_from("<I", sb, 32)
        for group, start in enumerate(range(first, total, per)):
            at = self.groups_at + group * self.group_size
            (bitmap,), (flags,) = unpack_from("<I", self.data, at), unpack_from("<H", self.data, at + 18)
            if self.group_size >= 64:
                bitmap |= unpack_from("<I", self.data, at + 32)[0] << 32
            if not flags & 2:
                yield from runs_of_bits(self.data[bitmap * self.block : (bitmap + 1) * self.block], min(per, total - start), start)

    def inode(self, n: int) -> bytes:
        group, k = divmod(n - 1, self.per_group)
        at = self.groups_at + group * self.group_size
        (table,) = unpack_from("<I", self.data, at + 8)
        if self.group_size >= 64:
            table |= unpack_from("<I", self.data, at + 40)[0] << 32
        at = table * self.block + k * self.inode_size
        return self.data[at : at + self.inode_size]

    def _tree(self, node: bytes) -> Iterator[tuple[int, int, int]]:
        """(first logical block, physical block, blocks) of an extent node and all below it."""
        magic, count, _, depth = unpack_from("<HHHH", node)
        if magic != 0xF30A:
            return
        for k in range(count):
            if depth:
                _, low, high = unpack_from("<IIH", node, 12 * (k + 1))
                yield from self._tree(part(self.data, (high << 32 | low) * self.block, self.block))
            else:
                logical, length, high, low = unpack_from("<IHHI", node, 12 * (k + 1))
                if length <= 32768:  # longer ones are allocated but not written: they read as zeros
                    yield logical, high << 32 | low, length

    def _mapped(self, block: int, level: int, logical: int) -> Iterator[tuple[int, int, int]]:
        if not block:
            return
        if level == 0:
            yield logical, block, 1
            return
        span = (self.block // 4) ** (level - 1)
        for k, child in enumerate(unpack_from(f"<{self.block // 4}I", self.data, block * self.block)):
            yield from self._mapped(child, level - 1, logical + k * span)

    def extents(self, inode: bytes) -> list[tuple[int, int, int]]:
        if unpack_from("<I", inode, 32)[0] & 0x80000:
            return list(self._tree(inode[40:100]))
        out, logical, per = [], 12, self.block // 4
        slots = unpack_from("<15I", inode, 40)
        for k in range(12):
            out.extend(self._mapped(slots[k], 0, k))
        for level in (1, 2, 3):
            out.extend(self._mapped(slots[11 + level], level, logical))
            logical += per**level
        return out

    def content(self, inode: bytes) -> bytes:
        size = unpack_from("<I", inode, 4)[0] | unpack_from("<I", inode, 108)[0] << 32
        out = bytearray(size)
        for logical, physical, length in self.extents(inode):
            part = self.data[physical * self.block : (physical + length) * self.block]
            room = max(0, size - logical * self.block)
            out[logical * self.block : logical * self.block + min(len(part), room)] = part[:room]
        return bytes(out)

    def entries(self, contents: bool) -> Iterator[Entry]:
        from datetime import UTC, datetime

        kinds = {0x4000: "directory", 0x8000: "file", 0xA000: "symlink"}
        todo, seen = [("", 2)], {2}
        while todo:
            parent, n = todo.pop()
            table, at = self.content(self.inode(n)), 0
            while at + 8 <= len(table):
                child, length, name_length = unpack_from("<IHB", table, at)
                name = table[at + 8 : at + 8 + name_length].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
                at += max(8, length)
                if not child or name in (".", ".."):
                    continue
                inode = self.inode(child)
                mode, uid, size, _, _, mtime = unpack_from("<HHIIII", inode)
                gid, kind = unpack_from("<H", inode, 24)[0], kinds.get(mode & 0xF000, "special")
                path = f"{parent}/{name}"
                made = Entry(path, kind, 0 if kind == "directory" else size, child, datetime.fromtimestamp(mtime, UTC).strftime("%Y-%m-%d %H:%M:%S"), mode, uid, gid)
                if kind == "symlink":
                    made.symlink_target = (inode[40 : 40 + size] if size < 60 else self.content(inode)).decode("utf-8", "replace")
                else:
                    made.extents = [(p, k) for _, p, k in self.extents(inode)] if kind != "special" else []
                if kind == "file" and contents:
                    made.content = self.content(inode)
                if kind == "directory" and child not in seen:
                    seen.add(child)
                    todo.append((path, child))
                yield made


class ExFat:
    """exFAT: entry sets of file, stream and name slots; a flag tells contiguous files, which have no chain."""

    def __init__(self, data: bytes):
        self.data = data
        fat, _, heap, self.clusters, self.root = unpack_from("<IIIII", data, 80)
        sector = 1 << data[108]
        self.fat_at, self.heap_at, self.cluster = fat * sector, heap * sector, sector << data[109]

    def chain(self, first: int, size: int | None, contiguous: bool) -> list[int]:
        if contiguous:
            return list(range(first, first + -(-(size or 0) // self.cluster)))
        out, at = [], first
        while 2 <= at < self.clusters + 2 and len(out) <= self.clusters:
            out.append(at)
            (at,) = unpack_from("<I", self.data, self.fat_at + 4 * at)
        return out

    def bytes_of(self, clusters: list[int]) -> bytes:
        return b"".join(part(self.data, self.heap_at + (c - 2) * self.cluster, self.cluster) for c in clusters)

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", self.bytes_of(self.chain(self.root, None, False)))], {self.root}
        while todo:
            parent, table = todo.pop()
            at = 0
            while at + 32 <= len(table) and table[at]:
                if table[at] != 0x85:
                    at += 32
                    continue
                slots = [table[at + 32 * k : at + 32 * k + 32] for k in range(1, table[at + 1] + 1)]
                attributes, modified = unpack_from("<H", table, at + 4)[0], unpack_from("<I", table, at + 12)[0]
                at += 32 * (table[at + 1] + 1)
                stream = next((x for x in slots if x[:1] == b"\xc0"), None)
                if stream is None:
                    continue
                first, size = unpack_from("<IQ", stream, 20)
                name = b"".join(x[2:32] for x in slots if x[:1] == b"\xc1").decode("utf-16-le", "replace")[: stream[3]]
                folder, path = bool(attributes & 0x10), f"{parent}/{name}"
                clusters = self.chain(first, size, bool(stream[1] & 2)) if first else []
                made = Entry(path, "directory" if folder else "file", 0 if folder else size, first, Fat._time(modified >> 16, modified & 0xFFFF), dos_attributes=attributes, extents=grouped(clusters))
                if folder and first not in seen:
                    seen.add(first)
                    todo.append((path, self.bytes_of(clusters)))
                elif not folder and contents:
                    made.content = self.bytes_of(clusters)[:size]
                yield made


class ProDos:
    """ProDOS: linked directory blocks; files are a block, an index of blocks, or an index of indexes."""

    def __init__(self, data: bytes):
        self.data = data

    def _block(self, n: int) -> bytes:
        return self.data[512 * n : 512 * n + 512]

    def _blocks(self, key: int, storage: int) -> list[int]:
        """Blocks of a file in order, 0 for one that is not stored."""
        index = lambda n: [low | high << 8 for low, high in zip(self._block(n)[:256], self._block(n)[256:], strict=True)]
        if storage == 1:
            return [key]
        if storage == 2:
            return index(key)
        return [b for n in index(key)[:128] for b in (index(n) if n else [0] * 256)]

    def _time(self, date: int, time: int) -> str | None:
        if not date:
            return None
        year = (date >> 9) + (1900 if date >> 9 >= 40 else 2000)
        return f"{year:04}-{date >> 5 & 15:02}-{date & 31:02} {time >> 8 & 31:02}:{time & 63:02}:00"

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", 2)], set()
        while todo:
            parent, block = todo.pop()
            while block and block not in seen:
                seen.add(block)
                table = self._block(block)
                (block,) = unpack_from("<H", table, 2)
                for at in range(4, 4 + 13 * 39, 39):
                    slot = table[at : at + 39]
                    storage, length = slot[0] >> 4, slot[0] & 15
                    if storage in (0, 14, 15):
                        continue
                    key, _, low, high = unpack_from("<HHHB", slot, 17)
                    size, path = low | high << 16, f"{parent}/{slot[1 : 1 + length].decode('ascii', 'replace')}"
                    folder = storage == 13
                    blocks = [] if folder or storage > 3 else self._blocks(key, storage)[: -(-size // 512)]
                    made = Entry(path, "directory" if folder else "file", 0 if folder else size, key, self._time(*unpack_from("<HH", slot, 33)), type_code=f"${slot[16]:02X}", extents=grouped([b for b in blocks if b]))
                    if folder:
                        todo.append((path, key))
                    elif contents:
                        made.content = b"".join(self._block(b) if b else bytes(512) for b in blocks)[:size]
                    yield made


class _MacTree:
    """Leaf records of a B-tree file in key order, along the chain of leaf nodes."""

    def __init__(self, data: bytes):
        self.data = data
        (self.size,) = unpack_from(">H", data, 32)
        (self.first,) = unpack_from(">I", data, 24)

    def __iter__(self) -> Iterator[bytes]:
        node, seen = self.first, set()
        while node and node not in seen:
            seen.add(node)
            raw = self.data[node * self.size : (node + 1) * self.size]
            if len(raw) < self.size:
                return
            (count,) = unpack_from(">H", raw, 10)
            places = [unpack_from(">H", raw, self.size - 2 * (k + 1))[0] for k in range(count + 1)]
            for a, b in zip(places, places[1:]):
                yield raw[a:b]
            (node,) = unpack_from(">I", raw)


class _Mac:
    """What both hierarchical Macintosh filesystems share: catalog records to paths."""

    def _bytes(self, extents: list[tuple[int, int]], size: int) -> bytes:
        return b"".join(part(self.data, self.base + a * self.block, n * self.block) for a, n in extents)[:size]

    @property
    def unit(self) -> int:
        return self.block

    @staticmethod
    def _date(seconds: int) -> str | None:
        from datetime import UTC, datetime

        return datetime.fromtimestamp(max(0, seconds - 2_082_844_800), UTC).strftime("%Y-%m-%d %H:%M:%S") if seconds else None

    def entries(self, contents: bool) -> Iterator[Entry]:
        rows = list(self._records())
        homes = {r["id"]: (r["parent"], r["name"]) for r in rows if r["folder"]}

        def path(parent: int, name: str) -> str:
            parts, seen = [name], set()
            while parent in homes and parent != 2 and parent not in seen:
                seen.add(parent)
                parent, above = homes[parent]
                parts.append(above)
            return "/" + "/".join(p.replace("/", ":") for p in reversed(parts))

        for r in sorted((r for r in rows if r["id"] != 2), key=lambda r: (not r["folder"], r["id"])):
            kind = "directory" if r["folder"] else "symlink" if r.get("mode", 0) & 0xF000 == 0xA000 else "file"
            size, extents = r.get("data", (0, []))
            body = self._bytes(extents, size) if kind == "symlink" or (kind == "file" and contents) else None
            yield Entry(
                path(r["parent"], r["name"]), kind, size, r["id"], self._date(r["modified"]), r.get("mode") or None, r.get("uid"), r.get("gid"),
                type_code=r.get("type"), creator_code=r.get("creator"), resource_fork_size=r.get("resource"), extents=extents,
                symlink_target=body.decode("utf-8", "replace") if kind == "symlink" else None, content=body if kind == "file" else None,
            )


class HfsPlus(_Mac):
    """HFS+ and HFSX; forks of more than eight extents continue in the overflow tree."""

    def __init__(self, data: bytes):
        self.data, self.base, head = data, 0, data[1024:1536]
        (self.block,) = unpack_from(">I", head, 40)
        self.more: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        overflow = self._fork(head[192:272], 3, 0)
        if overflow[0]:
            for record in _MacTree(self._bytes(overflow[1], overflow[0])):
                fork, owner, start = unpack_from(">BxII", record, 2)
                self.more.setdefault((owner, fork), []).append((start, *unpack_from(">16I", record, 12)))
        size, extents = self._fork(head[272:352], 4, 0)
        self.catalog = self._bytes(extents, size)

    def allocation(self) -> Iterator[tuple[int, int, bool]]:
        head = self.data[1024:1536]
        size, extents = self._fork(head[112:192], 6, 0)
        return runs_of_bits(self._bytes(extents, size), unpack_from(">I", head, 44)[0], high_first=True)

    def catalog_rows(self) -> Iterator[tuple[str, int, int, str, int | None]]:
        """(record, its number, parent, name, valence) of folders, files and threads; a thread's number is that of its key."""
        for r in _MacTree(self.catalog):
            length, parent, letters = unpack_from(">HIH", r)
            name, at = r[8 : 8 + 2 * letters].decode("utf-16-be", "replace"), 2 + length
            (kind,) = unpack_from(">H", r, at)
            if kind in (1, 2):
                yield ("directory", "file")[kind - 1], unpack_from(">I", r, at + 8)[0], parent, name, unpack_from(">I", r, at + 4)[0] if kind == 1 else None
            elif kind in (3, 4):
                above, size = unpack_from(">IH", r, at + 4)
                yield ("directory thread", "file thread")[kind - 3], parent, above, r[at + 10 : at + 10 + 2 * size].decode("utf-16-be", "replace"), None

    def _fork(self, raw: bytes, owner: int, fork: int) -> tuple[int, list[tuple[int, int]]]:
        size, total, *flat = unpack_from(">Q4xI16I", raw)
        for more in sorted(self.more.get((owner, fork), [])):
            flat += more[1:]
        extents = [(a, n) for a, n in zip(flat[::2], flat[1::2], strict=True) if n]
        return size, extents

    def _records(self) -> Iterator[dict]:
        for r in _MacTree(self.catalog):
            length, parent, letters = unpack_from(">HIH", r)
            name, at = r[8 : 8 + 2 * letters].decode("utf-16-be", "replace"), 2 + length
            (kind,) = unpack_from(">H", r, at)
            if kind not in (1, 2):
                continue
            number, _, modified = unpack_from(">III", r, at + 8)
            uid, gid, mode = unpack_from(">II2xH", r, at + 32)
            row = {"parent": parent, "name": name, "id": number, "folder": kind == 1, "modified": modified, "uid": uid, "gid": gid, "mode": mode}
            if kind == 2:
                row |= {"type": r[at + 48 : at + 52].decode("mac_roman"), "creator": r[at + 52 : at + 56].decode("mac_roman")}
                row |= {"data": self._fork(r[at + 88 : at + 168], number, 0), "resource": self._fork(r[at + 168 : at + 248], number, 0xFF)[0]}
            yield row


class Hfs(_Mac):
    """HFS: three extents a fork, the others in the overflow tree."""

    def __init__(self, data: bytes):
        self.data, head = data, data[1024:1536]
        (self.block,), (first,) = unpack_from(">I", head, 20), unpack_from(">H", head, 28)
        self.base, self.more = first * 512, {}
        size = unpack_from(">I", head, 130)[0]
        if size:
            for record in _MacTree(self._bytes(self._extents(head[134:146], 3, 0), size)):
                fork, owner, start = unpack_from(">BIH", record, 1)
                self.more.setdefault((owner, fork), []).append((start, *unpack_from(">6H", record, 8)))
        self.catalog = self._bytes(self._extents(head[150:162], 4, 0), unpack_from(">I", head, 146)[0])

    def allocation(self) -> Iterator[tuple[int, int, bool]]:
        (bitmap,), (blocks,) = unpack_from(">H", self.data, 1024 + 14), unpack_from(">H", self.data, 1024 + 18)
        return runs_of_bits(self.data[bitmap * 512 : bitmap * 512 + -(-blocks // 8)], blocks, high_first=True)

    def catalog_rows(self) -> Iterator[tuple[str, int, int, str, int | None]]:
        """(record, its number, parent, name, valence) of folders, files and threads; a thread's number is that of its key."""
        for r in _MacTree(self.catalog):
            parent, letters = unpack_from(">IB", r, 2)
            name, at = r[7 : 7 + letters].decode("mac_roman"), r[0] + 1 + (r[0] + 1 & 1)
            if r[at] == 1:
                yield "directory", unpack_from(">I", r, at + 6)[0], parent, name, unpack_from(">H", r, at + 4)[0]
            elif r[at] == 2:
                yield "file", unpack_from(">I", r, at + 20)[0], parent, name, None
            elif r[at] in (3, 4):
                above, size = unpack_from(">IB", r, at + 10)
                yield ("directory thread", "file thread")[r[at] - 3], parent, above, r[at + 15 : at + 15 + size].decode("mac_roman"), None

    def _extents(self, raw: bytes, owner: int, fork: int) -> list[tuple[int, int]]:
        flat = list(unpack_from(">6H", raw))
        for more in sorted(self.more.get((owner, fork), [])):
            flat += more[1:]
        return [(a, n) for a, n in zip(flat[::2], flat[1::2], strict=True) if n]

    def _records(self) -> Iterator[dict]:
        for r in _MacTree(self.catalog):
            parent, letters = unpack_from(">IB", r, 2)
            name, at = r[7 : 7 + letters].decode("mac_roman"), r[0] + 1 + (r[0] + 1 & 1)
            if r[at] == 1:
                number, _, modified = unpack_from(">III", r, at + 6)
                yield {"parent": parent, "name": name, "id": number, "folder": True, "modified": modified}
            elif r[at] == 2:
                (number, size), (rsize,), (modified,) = unpack_from(">I2xI", r, at + 20), unpack_from(">I", r, at + 36), unpack_from(">I", r, at + 48)
                yield {
                    "parent": parent, "name": name, "id": number, "folder": False, "modified": modified, "resource": rsize, "data": (size, self._extents(r[at + 74 : at + 86], number, 0)),
                    "type": r[at + 4 : at + 8].decode("mac_roman"), "creator": r[at + 8 : at + 12].decode("mac_roman"),
                }


@dataclass
class NtfsAttribute:
    kind: int
    name: str
    flags: int
    size: int
    value: bytes | None  # where it lies in the record
    runs: list[tuple[int | None, int]]
    first: int  # cluster of the value


class Ntfs:
    """NTFS: file records of the master table, resident values, run lists and attribute lists; compressed and encrypted values
    have a null content."""

    def __init__(self, data: bytes):
        self.data = data
        sector, per_cluster = unpack_from("<HB", data, 11)
        self.cluster = sector * (per_cluster if per_cluster < 128 else 1 << 256 - per_cluster)
        (mft,) = unpack_from("<Q", data, 48)
        (size,) = unpack_from("<b", data, 64)
        self.record, self.sector = size * self.cluster if size > 0 else 1 << -size, sector
        first = self._fixed(data[mft * self.cluster : mft * self.cluster + self.record])
        self.table = next((a for a in self._attributes(first) if a.kind == 0x80 and not a.name), None)

    def _fixed(self, raw: bytes) -> bytes:
        """A record with the last two bytes of every sector put back from its update sequence."""
        at, count = unpack_from("<HH", raw, 4)
        out = bytearray(raw)
        for k in range(1, count):
            out[k * self.sector - 2 : k * self.sector] = raw[at + 2 * k : at + 2 * k + 2]
        return bytes(out)

    def _runs(self, raw: bytes) -> list[tuple[int | None, int]]:
        """(first cluster, or None for a hole, and clusters)."""
        out, at, place = [], 0, 0
        while at < len(raw) and raw[at]:
            a, b = raw[at] & 15, raw[at] >> 4
            length = int.from_bytes(raw[at + 1 : at + 1 + a], "little")
            place += int.from_bytes(raw[at + 1 + a : at + 1 + a + b], "little", signed=True)
            out.append((place if b else None, length))
            at += 1 + a + b
        return out

    def _attributes(self, record: bytes) -> Iterator["NtfsAttribute"]:
        """Sizes and runs only; no value that lies outside the record is read."""
        (at,) = unpack_from("<H", record, 20)
        while at + 24 <= len(record):
            kind, length, away, letters, name_at, flags = unpack_from("<IIBBHH", record, at)
            if kind == 0xFFFFFFFF or not length:
                return
            name = record[at + name_at : at + name_at + 2 * letters].decode("utf-16-le", "replace")
            if away:
                (first,), (runs_at,), (size,) = unpack_from("<Q", record, at + 16), unpack_from("<H", record, at + 32), unpack_from("<Q", record, at + 48)
                yield NtfsAttribute(kind, name, flags, size, None, self._runs(record[at + runs_at : at + length]), first)
            else:
                size, value_at = unpack_from("<IH", record, at + 16)
                yield NtfsAttribute(kind, name, flags, size, record[at + value_at : at + value_at + size], [], 0)
            at += length

    def _span(self, a: "NtfsAttribute", start: int, size: int) -> bytes:
        """Bytes of a value, of which only the clusters that hold them are read."""
        if a.value is not None:
            return a.value[start : start + size]
        out, at = [], 0
        stop = min(start + size, a.size)
        for c, n in a.runs:
            low, high = max(start, at), min(stop, at + n * self.cluster)
            if low < high:
                out.append(bytes(high - low) if c is None else self.data[c * self.cluster + low - at : c * self.cluster + high - at])
            at += n * self.cluster
        return b"".join(out)

    @property
    def unit(self) -> int:
        return self.cluster

    def allocation(self) -> Iterator[tuple[int, int, bool]]:
        """Runs of clusters by the bitmap that is record 6."""
        raw = self._record(6)
        bitmap = next((a for a in self._all(raw) if a.kind == 0x80 and not a.name), None) if raw else None
        return runs_of_bits(self._span(bitmap, 0, bitmap.size), min(8 * bitmap.size, len(self.data) // self.cluster)) if bitmap else iter(())

    def _record(self, n: int) -> bytes | None:
        raw = self._span(self.table, n * self.record, self.record)
        return self._fixed(raw) if raw[:4] == b"FILE" else None

    def _all(self, raw: bytes) -> list["NtfsAttribute"]:
        """The attributes of a record and of those its list names; runs of one value that several records hold are joined."""
        parts = list(self._attributes(raw))
        index = next((a for a in parts if a.kind == 0x20), None)
        if index is None:
            return parts
        listed, at, homes = self._span(index, 0, index.size), 0, []
        while at + 26 <= len(listed):
            (length,), (home,) = unpack_from("<H", listed, at + 4), unpack_from("<Q", listed, at + 16)
            homes.append(home & (1 << 48) - 1)
            at += length or len(listed)
        for home in dict.fromkeys(homes):
            other = self._record(home)
            if other is not None and other != raw:
                parts += self._attributes(other)
        joined: dict[tuple, NtfsAttribute] = {}
        for a in sorted(parts, key=lambda a: a.first):
            key = (a.kind, a.name, a.value if a.kind == 0x30 else None)
            if a.value is None and key in joined and joined[key].value is None:
                joined[key].runs += a.runs
            else:
                joined.setdefault(key, a)
        return list(joined.values())

    def content(self, a: "NtfsAttribute") -> bytes | None:
        """A value; null where it is compressed or encrypted, which is not followed."""
        return None if a.flags & 0x40FF else self._span(a, 0, a.size)

    def entries(self, contents: bool) -> Iterator[Entry]:
        from datetime import UTC, datetime, timedelta

        found = {}
        for n in range(self.table.size // self.record if self.table else 0):
            raw = self._record(n)
            if raw is None or not unpack_from("<H", raw, 22)[0] & 1 or unpack_from("<Q", raw, 32)[0]:
                continue
            parts = self._all(raw)
            names = sorted((a.value[65] == 2, a.value) for a in parts if a.kind == 0x30)  # names of the DOS space come last
            if names:
                data = next((a for a in parts if a.kind == 0x80 and not a.name), NtfsAttribute(0x80, "", 0, 0, b"", [], 0))
                found[n] = (names[0][1], bool(unpack_from("<H", raw, 22)[0] & 2), data)
        home = lambda v: unpack_from("<Q", v)[0] & (1 << 48) - 1
        text = lambda v: v[66 : 66 + 2 * v[64]].decode("utf-16-le", "replace")

        def path(n: int) -> str | None:
            out, seen = [], set()
            while n != 5:
                if n not in found or n in seen:
                    return None
                seen.add(n)
                out.append(text(found[n][0]))
                n = home(found[n][0])
            return "/" + "/".join(reversed(out))

        for n, (v, folder, data) in sorted(found.items(), key=lambda x: (not x[1][1], x[0])):
            if n < 16 or (where := path(n)) is None:
                continue
            (ticks,), (attributes,) = unpack_from("<Q", v, 16), unpack_from("<I", v, 56)
            when = (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%d %H:%M:%S") if ticks else None
            yield Entry(where, "directory" if folder else "file", 0 if folder else data.size, n, when, dos_attributes=attributes & 0xFFFF, extents=[r for r in data.runs if r[0] is not None], content=None if folder or not contents else self.content(data))


class Cbm:
    """1541 floppies: a directory from track 18, files as linked sectors."""

    def __init__(self, data: bytes):
        self.data = data
        per_track = [21] * 17 + [19] * 7 + [18] * 6 + [17] * 10
        self.starts = [sum(per_track[:t]) for t in range(len(per_track))]

    def _sector(self, track: int, sector: int) -> bytes:
        at = (self.starts[track - 1] + sector) * 256
        return self.data[at : at + 256]

    def _chain(self, track: int, sector: int) -> Iterator[tuple[int, bytes]]:
        seen = set()
        while 0 < track <= len(self.starts) and (track, sector) not in seen:
            seen.add((track, sector))
            raw = self._sector(track, sector)
            yield self.starts[track - 1] + sector, raw
            track, sector = raw[0], raw[1]

    def entries(self, contents: bool) -> Iterator[Entry]:
        for _, table in self._chain(18, 1):
            for k in range(8):
                slot = table[32 * k : 32 * k + 32]
                if slot[2] & 7 and slot[2] & 0x80:
                    blocks = list(self._chain(slot[3], slot[4]))
                    body = b"".join(raw[2 : raw[1] + 1] if raw[0] == 0 else raw[2:] for _, raw in blocks)
                    name = slot[5:21].rstrip(b"\xa0").decode("latin-1").replace("/", ":")
                    yield Entry("/" + name, "file", len(body), blocks[0][0] if blocks else 0, type_code=("DEL", "SEQ", "PRG", "USR", "REL")[min(slot[2] & 7, 4)], extents=grouped([n for n, _ in blocks]), content=body if contents else None)


class AppleDos:
    """DOS 3.3: a chain of catalog sectors, lists of track and sector pairs."""

    def __init__(self, data: bytes):
        self.data = data

    def _sector(self, track: int, sector: int) -> bytes:
        return part(self.data, (track * 16 + sector) * 256, 256)

    def entries(self, contents: bool) -> Iterator[Entry]:
        table, seen = self._sector(17, 0), set()
        while (table[1], table[2]) != (0, 0) and (table[1], table[2]) not in seen:
            seen.add((table[1], table[2]))
            table = self._sector(table[1], table[2])
            for k in range(7):
                slot = table[11 + 35 * k : 46 + 35 * k]
                if slot[0] in (0, 0xFF):
                    continue
                pairs, at, lists = [], (slot[0], slot[1]), set()
                while at != (0, 0) and at not in lists:
                    lists.add(at)
                    raw = self._sector(*at)
                    pairs += [(raw[i], raw[i + 1]) for i in range(12, 256, 2)]
                    at = (raw[1], raw[2])
                while pairs and pairs[-1] == (0, 0):
                    pairs.pop()
                body = b"".join(self._sector(*p) if p != (0, 0) else bytes(256) for p in pairs)
                name = bytes(c & 0x7F for c in slot[3:33]).decode("ascii").rstrip().replace("/", ":")
                kind = {0: "T", 1: "I", 2: "A", 4: "B"}.get(slot[2] & 0x7F, f"${slot[2] & 0x7F:02X}")
                yield Entry("/" + name, "file", len(body), slot[0] * 16 + slot[1], type_code=kind, extents=grouped([t * 16 + x for t, x in pairs if (t, x) != (0, 0)]), content=body if contents else None)


class AcornDfs:
    """Acorn DFS: a catalogue of two sectors, contiguous files; a directory is a letter of the name."""

    def __init__(self, data: bytes):
        self.data = data

    def entries(self, contents: bool) -> Iterator[Entry]:
        for k in range(1, self.data[261] // 8 + 1):
            name, info = self.data[8 * k : 8 * k + 8], self.data[256 + 8 * k : 264 + 8 * k]
            size = info[4] | info[5] << 8 | (info[6] >> 4 & 3) << 16
            start = info[7] | (info[6] & 3) << 8
            path = f"/{chr(name[7] & 0x7F)}.{name[:7].decode('latin-1').rstrip()}"
            yield Entry(path, "file", size, start, extents=[(start, -(-size // 256))], content=self.data[start * 256 : start * 256 + size] if contents else None)


class Mfs:
    """The flat Macintosh filesystem: one directory, allocation map of 12 bits."""

    def __init__(self, data: bytes):
        self.data, mdb = data, data[1024:1536]
        self.files, self.dir_at, self.dir_blocks, self.blocks, self.block = unpack_from(">HHHHI", mdb, 12)
        (self.data_at,) = unpack_from(">H", mdb, 28)

    def _next(self, n: int) -> int:
        at = 1024 + 64 + (n - 2) * 3 // 2
        pair = self.data[at] << 8 | self.data[at + 1]
        return pair & 0xFFF if (n - 2) & 1 else pair >> 4

    def _fork(self, first: int, size: int) -> tuple[list[int], bytes]:
        chain, n = [], first
        while 2 <= n < self.blocks + 2 and len(chain) <= self.blocks:
            chain.append(n)
            n = self._next(n)
        return chain, b"".join(part(self.data, self.data_at * 512 + (n - 2) * self.block, self.block) for n in chain)[:size]

    def entries(self, contents: bool) -> Iterator[Entry]:
        for block in range(self.dir_blocks):
            table, at = part(self.data, (self.dir_at + block) * 512, 512), 0
            while at + 51 <= 512 and table[at] & 0x80:
                kind, creator = table[at + 2 : at + 6], table[at + 6 : at + 10]
                number, first, size = unpack_from(">IHI", table, at + 18)
                (rsize,) = unpack_from(">I", table, at + 34)
                name = table[at + 51 : at + 51 + table[at + 50]].decode("mac_roman")
                chain, data = self._fork(first, size)
                yield Entry("/" + name, "file", size, number, type_code=kind.decode("mac_roman"), creator_code=creator.decode("mac_roman"), resource_fork_size=rsize, extents=grouped(chain), content=data if contents else None)
                at += 51 + table[at + 50]
                at += at & 1


class Iso:
    """ISO 9660, plain names."""

    def __init__(self, data: bytes):
        self.data, self.root = data, data[16 * 2048 + 156 : 16 * 2048 + 190]

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", *unpack_from("<I4xI", self.root, 2))], set()
        while todo:
            parent, start, size = todo.pop()
            table, at = self.data[start * 2048 : start * 2048 + size], 0
            while at < len(table):
                if not table[at]:  # records never cross a sector
                    at = (at // 2048 + 1) * 2048
                    continue
                first, length = unpack_from("<I4xI", table, at + 2)
                name = table[at + 33 : at + 33 + table[at + 32]]
                folder, y = table[at + 25] & 2, table[at + 18 : at + 24]
                at += table[at]
                if name in (b"\0", b"\1"):
                    continue
                path = f"{parent}/{name.decode('latin-1').split(';')[0].rstrip('.')}"
                when = f"{y[0] + 1900:04}-{y[1]:02}-{y[2]:02} {y[3]:02}:{y[4]:02}:{y[5]:02}"
                yield Entry(path, "directory" if folder else "file", 0 if folder else length, first, when, extents=[(first, -(-length // 2048))], content=None if folder or not contents else self.data[first * 2048 : first * 2048 + length])
                if folder and first not in seen:
                    seen.add(first)
                    todo.append((path, first, length))


class Carve:
    """A volume that no driver knows: its runs of printable text.

    limit: bytes scanned for text, None for all; an entry /truncated has the place and the size of what was not scanned.
    """

    def __init__(self, data: bytes, least: int = 64, limit: int | None = None):
        self.data, self.least, self.limit = data, least, limit

    def entries(self, contents: bool) -> Iterator[Entry]:
        yield Entry("/disk", "file", len(self.data))
        for start, size in self.runs():
            yield Entry(f"/text-{start:010x}.txt", "file", size, start, extents=[(start, size)], content=self.data[start : start + size] if contents else None)
        if self.limit is not None and self.limit < len(self.data):
            yield Entry("/truncated", "file", len(self.data) - self.limit, self.limit)

    def runs(self, window: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """(start, size) of the runs, found a window at a time; one that reaches a window's end goes on in the next."""
        return ((a, b - a) for a, b in self._all(window) if b - a >= self.least)

    def _all(self, window: int) -> Iterator[tuple[int, int]]:
        text, total, open_ = re.compile(rb"[\t\n\r -~]+"), len(self.data) if self.limit is None else min(len(self.data), self.limit), None
        for at in range(0, total, window):
            piece, place = self.data[at : min(at + window, total)], 0
            if open_ is not None:
                goes_on = text.match(piece)
                place = goes_on.end() if goes_on else 0
                if place == len(piece):
                    continue
                yield open_, at + place
                open_ = None
            for m in text.finditer(piece, place):
                if m.end() == len(piece):
                    open_ = at + m.start()
                else:
                    yield at + m.start(), at + m.end()
        if open_ is not None:
            yield open_, total


DRIVERS = {"fat": Fat, "exfat": ExFat, "ext": Ext, "ntfs": Ntfs, "prodos": ProDos, "cbmdos": Cbm, "applesdos33": AppleDos, "acorndfs": AcornDfs, "hfs": Hfs, "hfsplus": HfsPlus, "mfs": Mfs, "iso9660": Iso, "carve": Carve, **floppies.DRIVERS, **unix.DRIVERS}


def entries(data, contents: bool = False, limit: int | None = None) -> tuple[str, Iterator[Entry]]:
    """The name of a volume's filesystem and its entries; text runs where no driver reads it, of its first limit bytes or of all."""
    name = filesystem_of(data)
    driver = DRIVERS.get(name or "carve", Carve)
    return name or "carve", (Carve(data, limit=limit) if driver is Carve else driver(data)).entries(contents)


def allocation(data) -> tuple[str, int, Iterator[tuple[int, int, bool]]]:
    """The name of a volume's filesystem, the bytes of its blocks, and (start, blocks, used) in order; nothing where the driver
    reads no map."""
    name = filesystem_of(data)
    driver = DRIVERS.get(name or "carve", Carve)
    if not hasattr(driver, "allocation"):
        return name or "carve", 0, iter(())
    volume = driver(data)
    return name, volume.unit, volume.allocation()


def catalog(data) -> Iterator[tuple[str, int, int, str, int | None]]:
    """The records of a volume's catalog tree; nothing where it has none."""
    driver = DRIVERS.get(filesystem_of(data) or "carve", Carve)
    return driver(data).catalog_rows() if hasattr(driver, "catalog_rows") else iter(())


def links(data) -> Iterator[tuple[str, int, int | None, int | None]]:
    """The inodes and names of a volume of EFS, UFS or XFS; nothing of others."""
    driver = DRIVERS.get(filesystem_of(data) or "carve", Carve)
    return driver(data).links() if hasattr(driver, "links") else iter(())


def problems(data) -> Iterator[tuple[str, str, str]]:
    """What a driver's own checks find wrong; nothing where it has none."""
    driver = DRIVERS.get(filesystem_of(data) or "carve", Carve)
    return driver(data).problems() if hasattr(driver, "problems") else iter(())
