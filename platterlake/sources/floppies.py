"""Small filesystems of home computers: each class takes a volume that slices like bytes and yields its entries."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime

from platterlake.sources.entries import Entry, grouped, unpack_from


class AtariDos:
    """Atari DOS 2: sectors of 128 bytes, the last three of which chain them; a directory of 64 names in sectors 361 to 368."""

    def __init__(self, data):
        self.data = data

    def _sector(self, n: int) -> bytes:
        return self.data[128 * (n - 1) : 128 * n]

    def _file(self, start: int) -> tuple[list[int], bytes]:
        chain, body, n = [], [], start
        while n and n not in chain and len(raw := self._sector(n)) == 128:
            chain.append(n)
            body.append(raw[: min(raw[127] & 0x7F, 125)])
            n = (raw[125] & 3) << 8 | raw[126]
        return chain, b"".join(body)

    def entries(self, contents: bool) -> Iterator[Entry]:
        for k in range(64):
            slot = self._sector(361 + k // 8)[16 * (k % 8) : 16 * (k % 8) + 16]
            if not slot[0]:
                return
            if slot[0] & 0x80 or not slot[0] & 0x40:
                continue
            base, ending = slot[5:13].decode("latin-1").rstrip(), slot[13:16].decode("latin-1").rstrip()
            chain, body = self._file(int.from_bytes(slot[3:5], "little"))
            yield Entry("/" + base + ("." + ending if ending else ""), "file", len(body), chain[0] if chain else 0, extents=grouped(chain), content=body if contents else None)


class RsDos:
    """Color Computer disks: granules of nine sectors, a table of them and a directory on track 17."""

    def __init__(self, data):
        self.data, self.granules = data, len(data) // (18 * 256) * 2 - 2
        self.table = data[(17 * 18 + 1) * 256 : (17 * 18 + 2) * 256]

    def _granule(self, n: int) -> int:
        """The byte at which a granule starts; track 17 holds none."""
        return ((n // 2 + (n // 2 >= 17)) * 18 + n % 2 * 9) * 256

    def entries(self, contents: bool) -> Iterator[Entry]:
        for k in range(72):
            at = (17 * 18 + 2) * 256 + 32 * k
            slot = self.data[at : at + 32]
            if slot[0] == 0xFF:
                return
            if not slot[0]:
                continue
            base, ending = slot[:8].decode("latin-1").rstrip(), slot[8:11].decode("latin-1").rstrip()
            chain, n = [], slot[13]
            while n < self.granules and n not in chain:
                chain.append(n)
                n = self.table[n]
            last = int.from_bytes(slot[14:16], "big")
            tail = (max(0, (n & 0x0F) - 1) * 256 + last) if n >= 0xC0 else 2304
            size = max(0, len(chain) - 1) * 2304 + tail if chain else 0
            body = b"".join(self.data[self._granule(g) : self._granule(g) + 2304] for g in chain)[:size] if contents else None
            yield Entry("/" + base + ("." + ending if ending else ""), "file", size, slot[13], type_code=f"${slot[11]:02X}", extents=grouped(chain), content=body)


class DragonDos:
    """Dragon disks: files as extents of sectors, a directory on track 20 whose entries may continue in others."""

    def __init__(self, data):
        self.data = data
        sides = next(s for s in (1, 2) if data[20 * 18 * s * 256 + 0xFD] == 18 * s)
        self.directory = (20 * 18 * sides + 2) * 256

    def _slot(self, n: int) -> bytes:
        at = self.directory + n // 10 * 256 + n % 10 * 25
        return self.data[at : at + 25]

    def entries(self, contents: bool) -> Iterator[Entry]:
        for k in range(160):
            slot = self._slot(k)
            if slot[0] & 0x08:
                return
            if slot[0] & 0x81:
                continue
            base, ending = slot[1:9].rstrip(b"\0 ").decode("latin-1"), slot[9:12].rstrip(b"\0 ").decode("latin-1")
            extents, part, seen, first, count = [], slot, set(), 12, 4
            while True:
                extents += [(int.from_bytes(part[a : a + 2], "big"), part[a + 2]) for a in range(first, first + 3 * count, 3) if part[a + 2]]
                if not part[0] & 0x20 or part[24] in seen:
                    break
                seen.add(part[24])
                part, first, count = self._slot(part[24]), 1, 7
            sectors = sum(n for _, n in extents)
            size = (sectors - 1) * 256 + (part[24] or 256) if sectors else 0
            body = b"".join(self.data[256 * a : 256 * (a + n)] for a, n in extents)[:size] if contents else None
            yield Entry("/" + base + ("." + ending if ending else ""), "file", size, k, extents=extents, content=body)


class Os9:
    """OS-9: every file has a descriptor of its segments; names end with a letter whose high bit is set."""

    def __init__(self, data):
        self.data = data
        self.sector = len(data) // int.from_bytes(data[0:3], "big")
        self.root = int.from_bytes(data[8:11], "big")

    def _file(self, lsn: int) -> tuple[bytes, int, list[tuple[int, int]]]:
        fd = self.data[lsn * self.sector : (lsn + 1) * self.sector]
        segments = []
        for a in range(16, 256, 5):
            start, count = int.from_bytes(fd[a : a + 3], "big"), int.from_bytes(fd[a + 3 : a + 5], "big")
            if not start or not count:
                break
            segments.append((start, count))
        return fd, int.from_bytes(fd[9:13], "big"), segments

    def _bytes(self, size: int, segments: list[tuple[int, int]]) -> bytes:
        return b"".join(self.data[a * self.sector : (a + n) * self.sector] for a, n in segments)[:size]

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", self.root)], {self.root}
        while todo:
            parent, lsn = todo.pop()
            _, size, segments = self._file(lsn)
            table = self._bytes(size, segments)
            for at in range(0, len(table) - 31, 32):
                slot = table[at : at + 32]
                if not slot[0]:
                    continue
                stop = next((i for i in range(29) if slot[i] & 0x80), 28)
                name = bytes(b & 0x7F for b in slot[: stop + 1]).decode("latin-1")
                child = int.from_bytes(slot[29:32], "big")
                if name in (".", ".."):
                    continue
                fd, length, own = self._file(child)
                folder, path = bool(fd[0] & 0x80), f"{parent}/{name}"
                y, m, d, h, i = fd[3:8]
                when = f"{1900 + y:04}-{m:02}-{d:02} {h:02}:{i:02}:00" if m else None
                yield Entry(path, "directory" if folder else "file", 0 if folder else length, child, when, mode=fd[0] & 0x3F, uid=int.from_bytes(fd[1:3], "big"), extents=own, content=None if folder or not contents else self._bytes(length, own))
                if folder and child not in seen:
                    seen.add(child)
                    todo.append((path, child))


class Affs:
    """Amiga volumes, with or without headers on data blocks: hashed directories of blocks, files as tables of block numbers."""

    BLOCK = 512

    def __init__(self, data):
        self.data, self.fast, self.international = data, bool(data[3] & 1), data[3] > 1
        blocks = len(data) // self.BLOCK
        told = int.from_bytes(data[8:12], "big")
        self.root = next((n for n in (told, blocks // 2) if 1 < n < blocks and self._long(n, 0) == 2 and self._long(n, 127) == 1), blocks // 2)

    def _block(self, n: int) -> bytes:
        return self.data[n * self.BLOCK : (n + 1) * self.BLOCK]

    def _long(self, n: int, k: int) -> int:
        return int.from_bytes(self.data[n * self.BLOCK + 4 * k : n * self.BLOCK + 4 * k + 4], "big", signed=True)

    def _children(self, n: int) -> Iterator[int]:
        seen = set()
        for k in range(6, 78):
            child = self._long(n, k)
            while child > 0 and child not in seen:
                seen.add(child)
                yield child
                child = self._long(child, 124)

    def _blocks(self, header: int) -> list[int]:
        out, n, seen = [], header, set()
        while n > 0 and n not in seen:
            seen.add(n)
            out += [self._long(n, 77 - k) for k in range(min(72, self._long(n, 2)))]
            n = self._long(n, 126)
        return out

    def _content(self, blocks: list[int], size: int) -> bytes:
        if self.fast:
            return b"".join(map(self._block, blocks))[:size]
        return b"".join((raw := self._block(n))[24 : 24 + int.from_bytes(raw[12:16], "big")] for n in blocks)[:size]

    def problems(self) -> Iterator[tuple[str, str, str]]:
        """(severity, code, message): blocks whose words do not add up to zero, names in the wrong chain, wrong parents, loops."""
        todo, seen = [self.root], {self.root}
        while todo:
            folder = todo.pop()
            for slot in range(72):
                n, chain = self._long(folder, 6 + slot), set()
                while n > 0:
                    if n in chain:
                        yield "error", "HashChainLoop", f"block {n}"
                        break
                    chain.add(n)
                    raw = self._block(n)
                    if len(raw) < self.BLOCK or self._long(n, 0) != 2:
                        yield "error", "BadHeaderBlock", f"block {n}"
                        break
                    name = raw[433 : 433 + min(30, raw[432])]
                    h = len(name)
                    for c in name:
                        h = h * 13 + (c - 32 if 97 <= c <= 122 or self.international and 224 <= c <= 254 and c != 247 else c) & 0x7FF
                    if h % 72 != slot:
                        yield "error", "WrongHashChain", f"block {n}"
                    if self._long(n, 125) != folder:
                        yield "error", "WrongParent", f"block {n}"
                    if sum(struct.unpack(">128I", raw)) & 0xFFFFFFFF:
                        yield "error", "BadChecksum", f"block {n}"
                    if self._long(n, 127) == 2 and n not in seen:
                        seen.add(n)
                        todo.append(n)
                    n = self._long(n, 124)
        if sum(struct.unpack(">128I", self._block(self.root))) & 0xFFFFFFFF:
            yield "error", "BadChecksum", f"block {self.root}"

    @staticmethod
    def date(days: int, minutes: int, ticks: int) -> str | None:
        if not (days or minutes or ticks):
            return None
        return datetime.fromtimestamp((days + 2922) * 86_400 + minutes * 60 + ticks // 50, UTC).strftime("%Y-%m-%d %H:%M:%S")

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", self.root)], {self.root}
        while todo:
            parent, folder = todo.pop()
            for n in self._children(folder):
                raw = self._block(n)
                name = raw[433 : 433 + min(30, raw[432])].decode("latin-1").replace("/", ":")
                kind, path = self._long(n, 127), f"{parent}/{name}"
                protect, size = unpack_from(">II", raw, 320)
                when = self.date(*unpack_from(">III", raw, 420))
                if kind == 2:
                    yield Entry(path, "directory", 0, n, when, mode=protect)
                    if n not in seen:
                        seen.add(n)
                        todo.append((path, n))
                elif kind == -3:
                    blocks = self._blocks(n)
                    yield Entry(path, "file", size, n, when, mode=protect, extents=grouped(blocks), content=self._content(blocks, size) if contents else None)
                elif kind == 3:
                    yield Entry(path, "symlink", 0, n, when, symlink_target=raw[24:312].split(b"\0")[0].decode("latin-1"))
                else:
                    yield Entry(path, "special", 0, n, when)


class CpM:
    """CP/M: entries of 32 bytes, each of up to 16 block numbers of one extent of a file.

    Nothing on a disk tells its layout, so it is given: bytes of a block, directory entries, and bytes before the directory.
    """

    def __init__(self, data, block: int = 1024, names: int = 64, start: int = 2 * 26 * 128):
        self.data, self.block, self.names, self.start = data, block, names, start
        self.wide = (len(data) - start) // block > 256

    def entries(self, contents: bool) -> Iterator[Entry]:
        files: dict[tuple[int, str], list[tuple[int, int, list[int]]]] = {}
        for k in range(self.names):
            slot = self.data[self.start + 32 * k : self.start + 32 * k + 32]
            if len(slot) < 32 or slot[0] > 15:
                continue
            letters = bytes(b & 0x7F for b in slot[1:12]).decode("latin-1")
            name = letters[:8].rstrip() + ("." + letters[8:].rstrip() if letters[8:].strip() else "")
            numbers = struct.unpack("<8H", slot[16:]) if self.wide else slot[16:]
            files.setdefault((slot[0], name), []).append(((slot[14] & 63) * 32 + (slot[12] & 31), slot[15], [n for n in numbers if n]))
        for (user, name), parts in files.items():
            parts.sort()
            chain = [n for _, _, blocks in parts for n in blocks]
            extent, records, _ = parts[-1]
            size = extent * 16_384 + records * 128
            body = b"".join(self.data[self.start + n * self.block : self.start + (n + 1) * self.block] for n in chain)[:size] if contents else None
            yield Entry(f"/{user}:{name}" if user else f"/{name}", "file", size, chain[0] if chain else 0, uid=user, extents=grouped(chain), content=body)


class Efs:
    """SGI's first filesystem: inodes of up to twelve extents (more lie in blocks of extents), in cylinder groups."""

    def __init__(self, data):
        self.data = data
        self.first, self.per_group, self.inode_blocks = unpack_from(">iih", data, 512 + 4)

    def _inode(self, n: int) -> bytes:
        group, k = divmod(n, self.inode_blocks * 4)
        at = (self.first + self.per_group * group) * 512 + 128 * k
        return self.data[at : at + 128]

    def _extents(self, inode: bytes) -> list[tuple[int, int, int]]:
        """(first block of the file, block, blocks)."""
        (count,) = unpack_from(">h", inode, 28)
        raw = inode[32 : 32 + 8 * min(count, 12)]
        if count > 12:  # these name blocks full of extents
            (some,) = unpack_from(">I", inode, 36)
            direct = [unpack_from(">II", inode, 32 + 8 * k) for k in range(min(12, some & 0xFFFFFF))]
            raw = b"".join(self.data[512 * (a & 0xFFFFFF) : 512 * ((a & 0xFFFFFF) + (b >> 24))] for a, b in direct)[: 8 * count]
        return sorted((b & 0xFFFFFF, a & 0xFFFFFF, b >> 24) for a, b in struct.iter_unpack(">II", raw))

    def _bytes(self, inode: bytes) -> bytes:
        (size,) = unpack_from(">I", inode, 8)
        out = bytearray(size)
        for logical, block, count in self._extents(inode):
            piece = self.data[512 * block : 512 * (block + count)]
            out[512 * logical : 512 * logical + min(len(piece), max(0, size - 512 * logical))] = piece[: max(0, size - 512 * logical)]
        return bytes(out)

    def links(self) -> Iterator[tuple[str, int, int | None, int | None]]:
        """Every inode that names lead to, with its stored links, and every name: its folder and what it names."""
        todo, seen = [2], {2}
        while todo:
            number = todo.pop()
            inode = self._inode(number)
            mode, stored = unpack_from(">HH", inode)
            yield "inode", number, stored, None
            if mode & 0o170000 != 0o040000:
                continue
            for child, name in self._names(self._bytes(inode)):
                yield "name", number, None, child
                if name not in (".", "..") and child not in seen:
                    seen.add(child)
                    todo.append(child)

    @staticmethod
    def _names(table: bytes) -> Iterator[tuple[int, str]]:
        for at in range(0, len(table) - 511, 512):
            block = table[at : at + 512]
            for place in block[4 : 4 + block[3]] if block[:2] == b"\xbe\xef" else b"":
                if place:
                    child, length = unpack_from(">IB", block, 2 * place)
                    yield child, block[2 * place + 5 : 2 * place + 5 + length].decode("utf-8", "replace")

    def entries(self, contents: bool) -> Iterator[Entry]:
        kinds, todo, seen = {0o040000: "directory", 0o100000: "file", 0o120000: "symlink"}, [("", 2)], {2}
        while todo:
            parent, n = todo.pop()
            for child, name in self._names(self._bytes(self._inode(n))):
                if name in (".", ".."):
                    continue
                inode = self._inode(child)
                mode, _, uid, gid, size, _, mtime = unpack_from(">HHHHIII", inode)
                kind, path = kinds.get(mode & 0o170000, "special"), f"{parent}/{name}"
                when = datetime.fromtimestamp(mtime, UTC).strftime("%Y-%m-%d %H:%M:%S")
                made = Entry(path, kind, 0 if kind == "directory" else size, child, when, mode, uid, gid, extents=[(a, c) for _, a, c in self._extents(inode)] if kind in ("file", "directory") else [])
                if kind == "symlink":
                    made.symlink_target = self._bytes(inode).decode("utf-8", "replace")
                elif kind == "file" and contents:
                    made.content = self._bytes(inode)
                elif kind == "directory" and child not in seen:
                    seen.add(child)
                    todo.append((path, child))
                yield made


class Human68k:
    """X68000 floppies of 1232 KB: sectors of 1024 bytes, a 12-bit table, names of eighteen letters in Shift JIS."""

    def __init__(self, data):
        self.data = data

    def _next(self, n: int) -> int:
        (pair,) = unpack_from("<H", self.data, 1024 + n * 3 // 2)
        return pair >> 4 if n & 1 else pair & 0xFFF

    def _chain(self, n: int) -> list[int]:
        out = []
        while 2 <= n < 1223 and n not in out:
            out.append(n)
            n = self._next(n)
        return out

    def _bytes(self, chain: list[int]) -> bytes:
        return b"".join(self.data[(9 + n) * 1024 : (10 + n) * 1024] for n in chain)

    def entries(self, contents: bool) -> Iterator[Entry]:
        todo, seen = [("", self.data[5 * 1024 : 11 * 1024])], set()
        while todo:
            parent, table = todo.pop()
            for at in range(0, len(table) - 31, 32):
                base, ending, attributes, more, time, date, first, size = struct.unpack("<8s3sB10sHHHI", table[at : at + 32])
                if not base[0]:
                    break
                if base[0] == 0xE5 or attributes & 0x08 or base[:1] == b".":
                    continue
                stem = (base + more.rstrip(b"\0")).decode("shift_jis", "replace").rstrip(" ")
                tail = ending.decode("shift_jis", "replace").rstrip(" ")
                folder, path, chain = bool(attributes & 0x10), f"{parent}/{stem}" + (f".{tail}" if tail else ""), self._chain(first)
                when = f"{(date >> 9) + 1980:04}-{date >> 5 & 15:02}-{date & 31:02} {time >> 11:02}:{time >> 5 & 63:02}:{(time & 31) * 2:02}" if date else None
                yield Entry(path, "directory" if folder else "file", 0 if folder else size, first, when, dos_attributes=attributes, extents=grouped(chain), content=None if folder or not contents else self._bytes(chain)[:size])
                if folder and first not in seen:
                    seen.add(first)
                    todo.append((path, self._bytes(chain)))


DRIVERS = {"efs": Efs, "human68k": Human68k, "ataridos": AtariDos, "rsdos": RsDos, "dragondos": DragonDos, "os9": Os9, "affs": Affs}
