"""Containers to the disks they hold: views of a file where its ranges can be mapped, else decoders of the whole file."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
import zlib

from platterlake.sources.ranged import Chain, Mapped, Pieces, View, open_file

SECTOR = 512


def unzip(data: bytes) -> bytes:
    """The largest member of a zip file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(max(z.infolist(), key=lambda i: i.file_size))


def unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()


def atr(data: bytes) -> bytes:
    """A 16-byte header; the first three sectors of a double-density disk are stored short and read as full ones."""
    (size,) = struct.unpack_from("<H", data, 4)
    body = data[16:]
    if size == 256 and len(body) % 256 == 128:
        return b"".join([*(body[128 * k : 128 * (k + 1)].ljust(256, b"\0") for k in range(3)), body[384:]])
    return body


def msa(data: bytes) -> bytes:
    """Tracks of a fixed length, stored plain or with runs as E5, byte, count."""
    _, sectors, sides, first, last = struct.unpack_from(">HHHHH", data)
    length, at, out = sectors * SECTOR, 10, bytearray()
    for _ in range((last - first + 1) * (sides + 1)):
        (size,) = struct.unpack_from(">H", data, at)
        track, at = data[at + 2 : at + 2 + size], at + 2 + size
        if size == length:
            out += track
            continue
        k, end = 0, len(out) + length
        while k < len(track):
            if track[k] == 0xE5:
                out += track[k + 1 : k + 2] * struct.unpack_from(">H", track, k + 2)[0]
                k += 4
            else:
                out.append(track[k])
                k += 1
        if len(out) != end:
            raise ValueError("a track has the wrong length")
    return bytes(out)


def d88(data: bytes) -> bytes:
    """Sectors of every track in the order of their numbers."""
    out = bytearray()
    for at in struct.unpack_from("<164I", data, 32):
        if not at or at >= len(data):
            continue
        found, count, k = [], struct.unpack_from("<H", data, at + 4)[0], at
        for _ in range(count):
            number, size = data[k + 2], struct.unpack_from("<H", data, k + 14)[0]
            found.append((number, data[k + 16 : k + 16 + size]))
            k += 16 + size
        for _, sector in sorted(found, key=lambda s: s[0]):
            out += sector
    return bytes(out)


def unlz4(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()


def edsk(data: bytes) -> bytes:
    """Tracks of a disk of 8-bit computers, their sectors in the order of their numbers."""
    tracks, sides = data[48], data[49]
    extended, at, out = data[:8] == b"EXTENDED", 256, bytearray()
    (plain,) = struct.unpack_from("<H", data, 50)
    for k in range(tracks * sides):
        size = data[52 + k] * 256 if extended else plain
        if not size:
            continue
        found, place = [], at + 256
        for n in range(data[at + 21]):
            info = data[at + 24 + 8 * n : at + 32 + 8 * n]
            length = (struct.unpack_from("<H", info, 6)[0] if extended else 0) or 128 << info[3]
            found.append((info[2], data[place : place + length]))
            place += length
        for _, body in sorted(found, key=lambda s: s[0]):
            out += body
        at += size
    return bytes(out)


#: The nibbles that five recorded bits of a Commodore disk stand for.
GCR = {0b01010: 0, 0b01011: 1, 0b10010: 2, 0b10011: 3, 0b01110: 4, 0b01111: 5, 0b10110: 6, 0b10111: 7, 0b01001: 8, 0b11001: 9, 0b11010: 10, 0b11011: 11, 0b01101: 12, 0b11101: 13, 0b11110: 14, 0b10101: 15}


def g64(data: bytes) -> bytes:
    """Recorded tracks to sectors: a mark of ten or more ones, then a header or the data block that follows it."""

    def decoded(bits: str, at: int, count: int) -> bytes:
        nibbles = [GCR.get(int(bits[at + 5 * k : at + 5 * k + 5] or "0", 2), 0) for k in range(2 * count)]
        return bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))

    per, out = [21] * 17 + [19] * 7 + [18] * 6 + [17] * 5, bytearray()
    for t, count in enumerate(per, 1):
        (at,) = struct.unpack_from("<I", data, 12 + 8 * (t - 1))
        sectors: dict[int, bytes] = {}
        if at:
            (length,) = struct.unpack_from("<H", data, at)
            bits, current = "".join(f"{b:08b}" for b in data[at + 2 : at + 2 + length]), None
            bits += bits[:4000]  # a track is a circle
            for mark in re.finditer("1{10,}(?=0)", bits):
                kind = decoded(bits, mark.end(), 1)
                if kind == b"\x08":
                    current = decoded(bits, mark.end(), 4)[2]
                elif kind == b"\x07" and current is not None:
                    body = decoded(bits, mark.end(), 257)[1:]
                    if len(body) == 256:
                        sectors.setdefault(current, body)
                    current = None
        out += b"".join(sectors.get(s, bytes(256)) for s in range(count))
    return bytes(out)


#: The 64 disk bytes that record six bits each on Apple disks, in the order of their values; the DOS sectors in the
#: order in which they pass the head; and the DOS sectors that hold a track's ProDOS half blocks.
SIX_BITS = bytes.fromhex("96979A9B9D9E9FA6A7ABACADAEAFB2B3B4B5B6B7B9BABBBCBDBEBFCBCDCECFD3D6D7D9DADBDCDDDEDFE5E6E7E9EAEBECEDEEEFF2F3F4F5F6F7F9FAFBFCFDFEFF")
DOS_ORDER = (0, 7, 14, 6, 13, 5, 12, 4, 11, 3, 10, 2, 9, 1, 8, 15)
PRODOS_ORDER = (0, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 15)


def _apple_track(bits: str) -> dict[int, bytes]:
    """{physical sector: 256 bytes} of a recorded track: address marks, then data fields of 342 disk bytes and a checksum."""
    disk, at = bytearray(), bits.find("1")
    while 0 <= at <= len(bits) - 8:
        disk.append(int(bits[at : at + 8], 2))
        at = bits.find("1", at + 8)
    out, place, values = {}, 0, {b: v for v, b in enumerate(SIX_BITS)}
    while (place := disk.find(b"\xd5\xaa\x96", place)) >= 0:
        odd = disk[place + 3 : place + 11]
        data = disk.find(b"\xd5\xaa\xad", place)
        place += 3
        if len(odd) < 8 or data < 0 or len(raw := disk[data + 3 : data + 346]) < 343 or not all(b in values for b in raw):
            continue
        sector, now, plain = (odd[4] << 1 | 1) & odd[5], 0, []
        for b in raw:
            now ^= values[b]
            plain.append(now)
        if now:  # the checksum leaves nothing
            continue
        low = [(v >> 1 & 1 | v << 1 & 2, v >> 3 & 1 | v >> 1 & 2, v >> 5 & 1 | v >> 3 & 2) for v in plain[:86]]
        out.setdefault(sector, bytes(plain[86 + i] << 2 & 0xFF | low[i % 86][i // 86] for i in range(256)))
    return out


def woz(data: bytes) -> bytes:
    """A 5.25-inch disk of 35 tracks as recorded bits, in the order of DOS sectors."""
    chunks, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunks[name] = at + 8
        at += 8 + size
    if data[chunks[b"INFO"] + 1] != 1:
        raise ValueError("only 5.25-inch disks are decoded")
    out = bytearray()
    for t in range(35):
        index, found = data[chunks[b"TMAP"] + 4 * t], {}
        if index != 0xFF:
            if data[3:4] == b"2":
                start, _, count = struct.unpack_from("<HHI", data, chunks[b"TRKS"] + 8 * index)
                raw = data[start * SECTOR : start * SECTOR + -(-count // 8)]
            else:
                at = chunks[b"TRKS"] + 6656 * index
                (count,) = struct.unpack_from("<H", data, at + 6648)
                raw = data[at : at + -(-count // 8)]
            bits = "".join(f"{b:08b}" for b in raw)[:count]
            found = _apple_track(bits + bits[:8000])  # a track is a circle
        by_dos = {DOS_ORDER[p]: body for p, body in found.items() if p < 16}
        out += b"".join(by_dos.get(s, bytes(256)) for s in range(16))
    return bytes(out)


def prodos_ordered(disk):
    """A 5.25-inch disk in the order of ProDOS blocks where only that order shows a ProDOS volume; else as it is."""
    from platterlake.sources.sniff import filesystem_of

    if len(disk) != 143_360 or filesystem_of(disk) is not None:
        return disk
    raw = bytes(disk[:])
    other = b"".join(raw[t * 4096 + 256 * s : t * 4096 + 256 * s + 256] for t in range(35) for s in PRODOS_ORDER)
    return other if filesystem_of(other) == "prodos" else disk


DECODERS = {"gzip": gzip.decompress, "zstd": unzstd, "zip": unzip, "atr": atr, "msa": msa, "d88": d88, "lz4": unlz4, "edsk": edsk, "g64": g64, "woz": woz}


def name_of(data: bytes, path: str) -> str:
    """The container of a file: by magic bytes, then by the endings of formats that have none."""
    from platterlake.sources.sniff import CONTAINERS

    for name, offset, magic in CONTAINERS:
        key = bytes.fromhex(magic)
        start = offset if offset >= 0 else len(data) + offset
        if start >= 0 and data[start : start + len(key)] == key:
            return name
    ending = path.rsplit(".", 1)[-1].lower()
    return ending if ending in ("d88", "dim") else "raw"


def _vhd_view(data):
    foot = data[len(data) - 512 :]
    (kind,), (size,) = struct.unpack_from(">I", foot, 60), struct.unpack_from(">Q", foot, 48)
    if kind == 2:
        return View(data, 0, size)
    (head,) = struct.unpack_from(">Q", foot, 16)
    table, entries, block = struct.unpack(">Q4xII", data[head + 16 : head + 36])
    skip = -(-(block // SECTOR // 8) // SECTOR) * SECTOR

    def place(k: int):
        (at,) = struct.unpack(">I", data[table + 4 * k : table + 4 * k + 4]) if k < entries else (0xFFFFFFFF,)
        return None if at == 0xFFFFFFFF else (data, at * SECTOR + skip)

    return Mapped(size, block, place)


def _qcow2_view(data):
    backing, bits, size, crypt, entries, table = struct.unpack(">Q4xIQIIQ", data[8:48])
    if crypt or backing:
        raise ValueError("encrypted or backed images are not supported")
    cluster, low = 1 << bits, (1 << 56) - 1 & ~0x1FF

    def place(k: int):
        i, j = divmod(k, cluster // 8)
        (second,) = struct.unpack(">Q", data[table + 8 * i : table + 8 * i + 8]) if i < entries else (0,)
        if not second & low:
            return None
        at = (second & low) + 8 * j
        (entry,) = struct.unpack(">Q", data[at : at + 8])
        if entry >> 62 & 1:
            shift = 62 - (bits - 8)
            start = entry & (1 << shift) - 1
            return zlib.decompressobj(-12).decompress(data[start : start + 2 * cluster], cluster)
        return None if entry & 1 or not entry & low else (data, entry & low)

    return Mapped(size, cluster, place)


def _vmdk_view(data):
    capacity, grain = struct.unpack("<QQ", data[12:28])
    per_table, _, directory = struct.unpack("<IQQ", data[44:64])

    def place(k: int):
        i, j = divmod(k, per_table)
        at = directory * SECTOR + 4 * i
        (table,) = struct.unpack("<I", data[at : at + 4])
        (found,) = struct.unpack("<I", data[table * SECTOR + 4 * j : table * SECTOR + 4 * j + 4]) if table else (0,)
        return (data, found * SECTOR) if found > 1 else None

    return Mapped(capacity * SECTOR, grain * SECTOR, place)


def _described(data, path: str):
    """A text that names a disk's extents, which lie in files beside it: flat, sparse or zeros."""
    pieces, at, home = [], 0, path.rpartition("/")[0]
    beside = lambda name: open_file(f"{home}/{name}" if home else name)
    for count, kind, name, offset in re.findall(r'(?m)^\s*(?:RW|RDONLY|NOACCESS)\s+(\d+)\s+(\w+)(?:\s+"([^"]*)"(?:\s+(\d+))?)?', bytes(data[: 1 << 20]).decode("utf-8", "replace")):
        size = int(count) * SECTOR
        if kind == "ZERO":
            source = None
        elif kind in ("FLAT", "VMFS"):
            source = View(beside(name), int(offset or 0) * SECTOR, size)
        elif kind in ("SPARSE", "VMFSSPARSE"):
            source = _vmdk_view(beside(name))
        else:
            raise ValueError(f"extents of type {kind} are not supported")
        pieces.append((at, size, source))
        at += size
    return Chain(at, pieces)


def _twomg_view(data):
    return View(data, *struct.unpack("<II", data[24:32]))


def _dc42_view(data):
    return View(data, 84, struct.unpack(">I", data[64:68])[0])


def _dmg_view(data):
    """An Apple disk image: a property list tells the pieces, each stored, deflated, bzipped, LZMA, ADC or zeros."""
    import bz2
    import lzma
    import plistlib

    foot = data[len(data) - 512 :]
    (base,), (at, size), (sectors,) = struct.unpack_from(">Q", foot, 24), struct.unpack_from(">QQ", foot, 216), struct.unpack_from(">Q", foot, 492)
    pieces = []
    for table in plistlib.loads(bytes(data[at : at + size]))["resource-fork"]["blkx"]:
        mish = table["Data"]
        (first,), (more,), (count,) = struct.unpack_from(">Q", mish, 8), struct.unpack_from(">Q", mish, 24), struct.unpack_from(">I", mish, 200)
        for k in range(count):
            kind, _, sector, n, where, length = struct.unpack_from(">IIQQQQ", mish, 204 + 40 * k)
            start, where = (first + sector) * SECTOR, base + more + where
            unpack = {1: bytes, 0x80000004: _adc, 0x80000005: zlib.decompress, 0x80000006: bz2.decompress, 0x80000008: lzma.decompress}.get(kind)
            if kind in (0xFFFFFFFF, 0x7FFFFFFE) or not n:
                continue
            if unpack is None and kind not in (0, 2):
                raise ValueError(f"pieces of type {kind:08x} are not supported")
            get = None if unpack is None else lambda unpack=unpack, where=where, length=length, n=n: unpack(bytes(data[where : where + length])).ljust(n * SECTOR, b"\0")
            pieces.append((start, n * SECTOR, get))
    return Pieces(sectors * SECTOR, sorted(pieces, key=lambda p: p[0]))


def _adc(data: bytes) -> bytes:
    """Plain runs, and copies of what came before in two or three bytes."""
    out, k = bytearray(), 0
    while k < len(data):
        b = data[k]
        if b & 0x80:
            n = (b & 0x7F) + 1
            out += data[k + 1 : k + 1 + n]
            k += 1 + n
            continue
        if b & 0x40:
            n, back = (b & 0x3F) + 4, int.from_bytes(data[k + 1 : k + 3], "big")
            k += 3
        else:
            n, back = ((b & 0x3F) >> 2) + 3, (b & 3) << 8 | data[k + 1]
            k += 2
        for _ in range(n):
            out.append(out[-back - 1])
    return bytes(out)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at // 8, -(-(self.at + n) // 8)
        value = int.from_bytes(self.data[first:last], "big") >> last * 8 - self.at - n
        self.at += n
        return value & (1 << n) - 1


def _chd_kinds(bits: _Bits, count: int) -> list[int]:
    """How every hunk is stored: codes whose lengths are run-length coded, then their runs."""
    lengths: list[int] = []
    while len(lengths) < 16:
        n = bits.take(4)
        if n != 1:
            lengths.append(n)
        elif (n := bits.take(4)) == 1:
            lengths.append(1)
        else:
            lengths += [n] * (bits.take(4) + 3)
    codes, first = {}, 0
    for n in range(max(lengths), 0, -1):  # the longest codes have the smallest numbers
        for k in range(16):
            if lengths[k] == n:
                codes[n, first] = k
                first += 1
        first >>= 1

    def code() -> int:
        value = 0
        for n in range(1, 33):
            value = value << 1 | bits.take(1)
            if (n, value) in codes:
                return codes[n, value]
        raise ValueError("a hunk map has an unknown code")

    out, last, again = [], 0, 0
    while len(out) < count:
        if again:
            again -= 1
        elif (kind := code()) == 7:
            again = 2 + code()
        elif kind == 8:
            again = 18 + (code() << 4)
            again += code()
        else:
            last = kind
        out.append(last)
    return out


def _chd_view(data):
    """Compressed hunks of data, version 5: deflated, LZMA, Zstandard, stored, or the same as another hunk."""
    import lzma

    version = struct.unpack(">I", data[12:16])[0]
    if version != 5:
        raise ValueError(f"version {version} of CHD is not supported")
    names = [data[16 + 4 * k : 20 + 4 * k] for k in range(4)]
    size, at, _, hunk, _ = struct.unpack(">QQQII", data[32:64])
    count = -(-size // hunk)
    if names[0] == b"\0\0\0\0":
        def stored(k: int):
            (n,) = struct.unpack(">I", data[at + 4 * k : at + 4 * k + 4])
            return (data, n * hunk) if n else None

        return Mapped(size, hunk, stored)
    length, start, _, length_bits, self_bits, parent_bits, _ = struct.unpack(">I6sHBBBB", data[at : at + 16])
    bits, offset = _Bits(bytes(data[at + 16 : at + 16 + length])), int.from_bytes(start, "big")
    kinds, places, own = _chd_kinds(bits, count), [], 0
    for kind in kinds:
        if kind < 4:
            n = bits.take(length_bits)
            bits.take(16)
            places.append((kind, offset, n))
            offset += n
        elif kind == 4:
            bits.take(16)
            places.append((4, offset, hunk))
            offset += hunk
        elif kind in (5, 9, 10):
            own = bits.take(self_bits) if kind == 5 else own + (kind == 10)
            places.append((5, own, 0))
        else:
            raise ValueError("hunks of a parent image are not supported")

    def lzma_raw(raw: bytes) -> bytes:
        return lzma.decompress(raw, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << max(16, (hunk - 1).bit_length())}])

    unpack = {b"zlib": lambda raw: zlib.decompress(raw, -15), b"lzma": lzma_raw, b"zstd": unzstd}

    def place(k: int):
        kind, where, n = places[k]
        while kind == 5:
            kind, where, n = places[where]
        if kind == 4:
            return (data, where)
        if names[kind] not in unpack:
            raise ValueError(f"hunks of {names[kind]!r} are not supported")
        return unpack[names[kind]](bytes(data[where : where + n]))

    return Mapped(size, hunk, place)


def _partclone_view(data):
    """Used blocks one behind the other, a checksum after every few; a bitmap tells which they are."""
    if data[30:34] != b"0002":
        raise ValueError("only version 2 of partclone images is supported")
    _, total, _, _, block = struct.unpack("<QQQQI", data[52:88])
    mode, check, per = struct.unpack("<HHI", data[96:104])
    start = 110
    bitmap = bytes(data[start : start + -(-total // 8)])
    body, counts, page = start + len(bitmap) + 4, [0], 512
    for k in range(0, len(bitmap), page):
        counts.append(counts[-1] + int.from_bytes(bitmap[k : k + page], "little").bit_count())

    def place(k: int):
        if not bitmap[k // 8] >> k % 8 & 1:
            return None
        first = k // 8 // page
        inside = int.from_bytes(bitmap[first * page : k // 8], "little").bit_count() + (bitmap[k // 8] & (1 << k % 8) - 1).bit_count()
        n = counts[first] + inside
        return (data, body + n * block + (n // per * check if mode and per else 0))

    return Mapped(total * block, block, place)


#: Containers of which ranges are read; all others are small, or compressed as one stream, and are unpacked whole.
VIEWS = {
    "vhd-fixed": _vhd_view, "vhd-dynamic": _vhd_view, "qcow2": _qcow2_view, "vmdk": _vmdk_view, "2mg": _twomg_view, "dc42": _dc42_view,
    "dim": lambda data: View(data, 256, len(data) - 256), "dmg": _dmg_view, "chd": _chd_view, "partclone": _partclone_view,
}


def opened(data, path: str, depth: int = 4):
    """The disk in a file, peeled of nested containers, as something that slices like bytes."""
    for _ in range(depth):
        name = name_of(data, path)
        if name in ("raw", "tar"):
            return prodos_ordered(data)
        if name == "vmdk-text":
            data = _described(data, path)
        elif name in VIEWS:
            data = VIEWS[name](data)
        elif name in DECODERS:
            data = DECODERS[name](bytes(data[:]))
        else:
            raise ValueError(f"cannot read {name} containers: {path}")
        path = path.rsplit(".", 1)[0]
    return prodos_ordered(data)


def flat(data: bytes, path: str) -> bytes:
    """All of the disk's bytes."""
    return bytes(opened(data, path)[:])
