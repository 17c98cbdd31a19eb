"""Small disk images built of given files: what queries and tests read back."""

import struct
import uuid


def fat12(files, label="VOLUME", sectors=2880):
    """A FAT12 floppy; files: {path: bytes or None for a folder}, short upper-case names."""
    per_fat, roots = 9, 224
    boot = bytearray(512)
    boot[:3], boot[3:11] = b"\xeb\x3c\x90", b"MSDOS5.0"
    struct.pack_into("<HBHBHHBHHHII", boot, 11, 512, 1, 1, 2, roots, sectors, 0xF0, per_fat, 18, 2, 0, 0)
    boot[510:512] = b"\x55\xaa"
    fat, data = [0xFF0, 0xFFF], bytearray()

    def store(body):
        if not body:
            return 0
        first, n = len(fat), -(-len(body) // 512)
        fat.extend([*range(first + 1, first + n), 0xFFF])
        data.extend(body.ljust(n * 512, b"\0"))
        return first

    def slot(name, attributes, first, size):
        base, _, ending = name.partition(".")
        return struct.pack("<8s3sBBBHHHHHHHI", base.ljust(8).encode(), ending.ljust(3).encode(), attributes, 0, 0, 0, 0, 0, 0, 0x6000, 0x5A21, first, size)

    def folder(prefix):
        out = bytearray()
        for path, body in files.items():
            parent, _, name = path.rpartition("/")
            if parent == prefix:
                if body is None:
                    inner = folder(path)
                    out += slot(name, 0x10, store(bytes(inner) or bytes(32)), 0)
                else:
                    out += slot(name, 0x20, store(body), len(body))
        return out

    root = slot(label, 0x08, 0, 0) + folder("")
    table = bytearray(per_fat * 512)
    for n, value in enumerate(fat):
        at = n * 3 // 2
        (pair,) = struct.unpack_from("<H", table, at)
        struct.pack_into("<H", table, at, pair | value << 4 if n & 1 else pair & 0xF000 | value)
    disk = bytes(boot) + bytes(table) * 2 + bytes(root).ljust(roots * 32, b"\0") + bytes(data)
    return disk.ljust(sectors * 512, b"\0")


def mbr(parts, size):
    """parts: (type, start sector, volume bytes, active)."""
    disk = bytearray(size)
    for k, (kind, start, volume, active) in enumerate(parts):
        struct.pack_into("<B3xB3xII", disk, 446 + 16 * k, 0x80 if active else 0, kind, start, len(volume) // 512)
        disk[start * 512 : start * 512 + len(volume)] = volume
    disk[510:512] = b"\x55\xaa"
    return bytes(disk)


def gpt(parts, size):
    disk = bytearray(mbr([(0xEE, 1, bytes(0), False)], size))
    struct.pack_into("<II", disk, 446 + 8, 1, size // 512 - 1)
    disk[512:520] = b"EFI PART"
    struct.pack_into("<QII", disk, 512 + 72, 2, 128, 128)
    for k, (guid, start, volume, name) in enumerate(parts):
        entry = uuid.UUID(guid).bytes_le + bytes(15) + b"\1" + struct.pack("<QQQ", start, start + len(volume) // 512 - 1, 0) + name.encode("utf-16-le").ljust(72, b"\0")
        disk[1024 + 128 * k : 1024 + 128 * (k + 1)] = entry
        disk[start * 512 : start * 512 + len(volume)] = volume
    return bytes(disk)


def apm(parts, size):
    disk = bytearray(size)
    struct.pack_into(">2sHI", disk, 0, b"ER", 512, size // 512)
    for k, (name, kind, start, count) in enumerate(parts):
        struct.pack_into(">2s2xIII32s32s", disk, 512 * (k + 1), b"PM", len(parts), start, count, name.encode(), kind.encode())
    return bytes(disk)


def dynamic_vhd(disk, block=1 << 21):
    count = -(-len(disk) // block)
    foot = bytearray(512)
    foot[:8] = b"conectix"
    struct.pack_into(">Q", foot, 16, 512)
    struct.pack_into(">Q", foot, 48, len(disk))
    struct.pack_into(">I", foot, 60, 3)
    head = bytearray(1024)
    head[:8] = b"cxsparse"
    struct.pack_into(">Q4xII", head, 16, 1536, count, block)
    table_size = -(-count * 4 // 512) * 512
    bitmap, at, table, body = -(-(block // 4096) // 512) * 512, 1536 + table_size, [], b""
    for k in range(count):
        part = disk[k * block : (k + 1) * block].ljust(block, b"\0")
        if part.count(0) == len(part):
            table.append(0xFFFFFFFF)
            continue
        table.append((at + len(body)) // 512)
        body += b"\xff" * bitmap + part
    return bytes(foot) + bytes(head) + struct.pack(f">{count}I", *table).ljust(table_size, b"\xff") + body + bytes(foot)


def qcow2(disk, bits=16):
    cluster = 1 << bits
    n = -(-len(disk) // cluster)
    per = cluster // 8
    tables = -(-n // per)
    first, second = cluster, 2 * cluster
    head = struct.pack(">4sIQIIQIIQ", b"QFI\xfb", 2, 0, 0, bits, len(disk), 0, tables, first).ljust(cluster, b"\0")
    body, entries, at = b"", [], second + tables * cluster
    for k in range(n):
        part = disk[k * cluster : (k + 1) * cluster].ljust(cluster, b"\0")
        if part.count(0) == len(part):
            entries.append(0)
        else:
            entries.append(at + len(body) | 1 << 63)
            body += part
    entries += [0] * (tables * per - n)
    return head + struct.pack(f">{tables}Q", *(second + k * cluster | 1 << 63 for k in range(tables))).ljust(cluster, b"\0") + struct.pack(f">{len(entries)}Q", *entries) + body


def msa(disk, sectors=9, sides=1):
    length, out = sectors * 512, b""
    tracks = [disk[i : i + length] for i in range(0, len(disk), length)]
    for t in tracks:
        if t == t[:1] * length:
            packed = b"\xe5" + t[:1] + struct.pack(">H", length)
        else:
            packed = t
        out += struct.pack(">H", len(packed)) + packed
    return struct.pack(">5H", 0x0E0F, sectors, sides, 0, len(tracks) // (sides + 1) - 1) + out


def prodos(files, blocks=280):
    """files: {name: bytes} in the volume directory."""
    disk = bytearray(512 * blocks)
    disk[1024 + 4 : 1024 + 4 + 39] = bytes([0xF3]) + b"VOL".ljust(15, b"\0") + bytes(14) + bytes([0, 39, 13]) + bytes(6)
    free, at = 10, 1024 + 4 + 39
    for name, body in files.items():
        n = max(1, -(-len(body) // 512))
        key, storage = free, 1 if n == 1 else 2
        places = [key] if n == 1 else list(range(key + 1, key + 1 + n))
        for k, place in enumerate(places):
            disk[512 * place : 512 * place + len(body[512 * k : 512 * k + 512])] = body[512 * k : 512 * k + 512]
            if n > 1:
                disk[512 * key + k], disk[512 * key + 256 + k] = place & 255, place >> 8
        free = places[-1] + 1
        disk[at : at + 39] = bytes([storage << 4 | len(name)]) + name.encode().ljust(15, b"\0") + struct.pack("<BHHHB", 4, key, n, len(body) & 0xFFFF, len(body) >> 16) + bytes(15)
        at += 39
    return bytes(disk)


def exfat(files, clusters=200):
    """files: {name: bytes}, contiguous, in the root directory; sectors and clusters of 512 bytes."""
    disk = bytearray(512 * (20 + clusters))
    disk[:11], disk[108], disk[109], disk[510:512] = b"\xeb\x76\x90EXFAT   ", 9, 0, b"\x55\xaa"
    struct.pack_into("<IIIII", disk, 80, 10, 4, 20, clusters, 2)
    table, free = bytearray(), 4
    for name, body in files.items():
        stream = struct.pack("<BBBBHHQIIQ", 0xC0, 3, 0, len(name), 0, 0, len(body), 0, free if body else 0, len(body))
        names = [name[i : i + 15] for i in range(0, len(name), 15)]
        table += struct.pack("<BBHHHIII", 0x85, 1 + len(names), 0, 0x20, 0, 0, 0x5A216000, 0).ljust(32, b"\0") + stream
        table += b"".join(b"\xc1\0" + x.encode("utf-16-le").ljust(30, b"\0") for x in names)
        disk[512 * (18 + free) : 512 * (18 + free) + len(body)] = body
        free += -(-len(body) // 512)
    disk[512 * 20 : 512 * 20 + len(table)] = table
    struct.pack_into("<II", disk, 512 * 10 + 8, 3, 0xFFFFFFFF)
    return bytes(disk)


def _tree(records, size):
    """A B-tree of a header node and one leaf node."""
    head = bytearray(size)
    struct.pack_into(">IIbBHH", head, 0, 0, 0, 1, 0, 3, 0)
    struct.pack_into(">HIIIIH", head, 14, 1, 1, len(records), 1, 1, size)
    leaf, at, places = bytearray(size), 14, []
    struct.pack_into(">IIbBHH", leaf, 0, 0, 0, -1, 1, len(records), 0)
    for r in records:
        places.append(at)
        leaf[at : at + len(r)] = r
        at += len(r)
    for k, place in enumerate([*places, at]):
        struct.pack_into(">H", leaf, size - 2 * (k + 1), place)
    return bytes(head + leaf)


def hfsplus(files, block=4096):
    """files: {path: bytes or None for a folder}, folders first; every file is one extent."""
    ids = {"": 2} | {p: 16 + k for k, p in enumerate(files)}
    first, body, records = 8, b"", []

    def fork(data):
        nonlocal body
        n = -(-len(data) // block)
        start = first + len(body) // block
        body += data.ljust(n * block, b"\0")
        return struct.pack(">QII", len(data), 0, n) + struct.pack(">II", start, n).ljust(64, b"\0")

    def key(parent, name):
        raw = name.encode("utf-16-be")
        return struct.pack(">HIH", 6 + len(raw), parent, len(name)) + raw

    records.append(key(1, "VOLUME") + struct.pack(">HHIIIIIII", 1, 0, 0, 2, 0, 0, 0, 0, 0).ljust(88, b"\0"))
    for path, data in files.items():
        parent, _, name = path.rpartition("/")
        info = struct.pack(">HHIIIIIIIIIBBH", 1 if data is None else 2, 0, 0, ids[path], 0, 3786912000, 0, 0, 0, 501, 20, 0, 0, 0o40755 if data is None else 0o100644)
        records.append(key(ids[parent], name) + (info.ljust(88, b"\0") if data is None else info.ljust(48, b"\0") + b"TEXTttxt".ljust(40, b"\0") + fork(data) + fork(b"")))
    tree = _tree(records, 4096)
    head = bytearray(512)
    head[:2] = b"H+"
    struct.pack_into(">II", head, 40, block, 64)
    head[272:352] = struct.pack(">QII", len(tree), 0, 2) + struct.pack(">II", 4, 2).ljust(64, b"\0")
    disk = bytearray(block * 64)
    disk[1024:1536], disk[4 * block : 4 * block + len(tree)], disk[first * block : first * block + len(body)] = head, tree, body
    return bytes(disk)


def hfs(files, block=512):
    ids = {"": 2} | {p: 16 + k for k, p in enumerate(files)}
    base, first, body, records = 16, 8, b"", []

    def key(parent, name):
        raw = name.encode("mac_roman")
        out = struct.pack(">BBIB", 6 + len(raw), 0, parent, len(raw)) + raw
        return out + bytes(len(out) & 1)

    for path, data in files.items():
        parent, _, name = path.rpartition("/")
        if data is None:
            value = struct.pack(">BBHHIIII", 1, 0, 0, 0, ids[path], 0, 3786912000, 0).ljust(70, b"\0")
        else:
            n = -(-len(data) // block)
            value = bytearray(102)
            value[0], value[4:12] = 2, b"TEXTttxt"
            struct.pack_into(">IHII", value, 20, ids[path], 0, len(data), n * block)
            struct.pack_into(">I", value, 48, 3786912000)
            struct.pack_into(">HH", value, 74, first + len(body) // block, n)
            body += data.ljust(n * block, b"\0")
        records.append(key(ids[parent], name) + bytes(value))
    tree = _tree(records, 1024)
    head = bytearray(512)
    head[:2] = b"BD"
    struct.pack_into(">I", head, 20, block)
    struct.pack_into(">H", head, 28, base)
    struct.pack_into(">IHH", head, 146, len(tree), 1, len(tree) // block)
    disk = bytearray(512 * 200)
    disk[1024:1536] = head
    disk[(base + 1) * 512 : (base + 1) * 512 + len(tree)] = tree
    disk[(base + first) * 512 : (base + first) * 512 + len(body)] = body
    return bytes(disk)


def ext(files, links=(), extents=True, block=1024, blocks=600):
    """One group; files: {path: bytes or None for a folder}, folders first; links: (path, target)."""
    disk = bytearray(block * blocks)
    sb = bytearray(1024)
    struct.pack_into("<IIII", sb, 0, 128, blocks, 0, 0)
    struct.pack_into("<I", sb, 20, 1)
    struct.pack_into("<I", sb, 32, 8192)
    struct.pack_into("<I", sb, 40, 128)
    struct.pack_into("<H", sb, 56, 0xEF53)
    struct.pack_into("<I", sb, 76, 1)
    struct.pack_into("<H", sb, 88, 128)
    disk[1024:2048] = sb
    struct.pack_into("<III", disk, 2048, 3, 4, 5)
    ids = {"": 2} | {p: 12 + k for k, p in enumerate([*files, *(p for p, _ in links)])}
    free = 5 + 128 * 128 // block

    def inode(n, mode, data, target=None):
        nonlocal free
        at, count = 5 * block + 128 * (n - 1), -(-len(data) // block)
        struct.pack_into("<HHIIII", disk, at, mode, 1000, len(target or data), 0, 0, 1704067200)
        struct.pack_into("<H", disk, at + 24, 100)
        if target:
            disk[at + 40 : at + 40 + len(target)] = target
            return
        if extents:
            struct.pack_into("<I", disk, at + 32, 0x80000)
            struct.pack_into("<HHHHIIHHI", disk, at + 40, 0xF30A, 1, 4, 0, 0, 0, count, 0, free)
            start = free
        else:
            start = free + (1 if count > 12 else 0)
            struct.pack_into(f"<{min(12, count)}I", disk, at + 40, *range(start, start + min(12, count)))
            if count > 12:
                struct.pack_into("<I", disk, at + 40 + 48, free)
                struct.pack_into(f"<{count - 12}I", disk, free * block, *range(start + 12, start + count))
        disk[start * block : start * block + len(data)] = data
        free = start + count

    def folder(path):
        parent = path.rpartition("/")[0]
        rows = [(ids[path], "."), (ids.get(parent, 2), "..")] + [(n, p.rpartition("/")[2]) for p, n in ids.items() if p and p.rpartition("/")[0] == path]
        out = b""
        for k, (n, name) in enumerate(rows):
            raw = name.encode()
            length = 8 + -(-len(raw) // 4) * 4 if k < len(rows) - 1 else block - len(out)
            out += struct.pack("<IHBB", n, length, len(raw), 0) + raw.ljust(length - 8, b"\0")
        return out

    inode(2, 0o40755, folder(""))
    for path, data in files.items():
        inode(ids[path], 0o40755 if data is None else 0o100644, folder(path) if data is None else data)
    for path, target in links:
        inode(ids[path], 0o120777, b"", target.encode())
    return bytes(disk)


def ntfs(files, cluster=4096):
    """files: {path: bytes or None for a folder}, folders first; bytes beyond 500 are not resident."""
    ids, record, mft = {"": 5} | {p: 24 + k for k, p in enumerate(files)}, 1024, 4
    count = 24 + len(files)
    table, body, first = bytearray(record * count), b"", 40

    def resident(kind, value, name=""):
        raw = name.encode("utf-16-le")
        at = 24 + -(-len(raw) // 8) * 8
        size = at + -(-len(value) // 8) * 8
        return (struct.pack("<IIBBHHHIHH", kind, size, 0, len(name), 24, 0, 0, len(value), at, 0) + raw.ljust(at - 24, b"\0") + value).ljust(size, b"\0")

    def away(start, size):
        n = -(-size // cluster)
        runs = bytes([0x22]) + struct.pack("<Hh", n, start) + b"\0"
        return struct.pack("<IIBBHHHQQHH4xQQQ", 0x80, 72, 1, 0, 64, 0, 0, 0, n - 1, 64, 0, n * cluster, size, size) + runs.ljust(8, b"\0")

    def put(n, flags, parts):
        raw = bytearray(record)
        raw[:4] = b"FILE"
        struct.pack_into("<HH", raw, 4, 48, 3)
        struct.pack_into("<HH", raw, 20, 56, flags)
        inner = b"".join(parts) + b"\xff\xff\xff\xff"
        raw[56 : 56 + len(inner)] = inner
        raw[48:50] = b"\x07\x00"
        for k in (1, 2):
            raw[48 + 2 * k : 50 + 2 * k] = raw[512 * k - 2 : 512 * k]
            raw[512 * k - 2 : 512 * k] = b"\x07\x00"
        table[n * record : (n + 1) * record] = raw

    put(0, 1, [away(mft, len(table))])
    for path, data in files.items():
        parent, _, name = path.rpartition("/")
        value = struct.pack("<QQQQQQQII", ids[parent], 0, 133485408000000000, 0, 0, 0, 0, 0x20, 0) + bytes([len(name), 1]) + name.encode("utf-16-le")
        parts = [resident(0x30, value)]
        if data is not None and len(data) <= 500:
            parts.append(resident(0x80, data))
        elif data is not None:
            parts.append(away(first + len(body) // cluster, len(data)))
            body += data.ljust(-(-len(data) // cluster) * cluster, b"\0")
        put(ids[path], 3 if data is None else 1, parts)
    disk = bytearray(cluster * 128)
    disk[:11] = b"\xeb\x52\x90NTFS    "
    struct.pack_into("<HB", disk, 11, 512, cluster // 512)
    struct.pack_into("<Q", disk, 48, mft)
    disk[64], disk[510:512] = 0xF6, b"\x55\xaa"
    disk[mft * cluster : mft * cluster + len(table)] = table
    disk[first * cluster : first * cluster + len(body)] = body
    return bytes(disk)


def d64(files):
    disk, per_track = bytearray(174_848), [21] * 17 + [19] * 7 + [18] * 6 + [17] * 10
    at = lambda t, s: (sum(per_track[: t - 1]) + s) * 256
    disk[0x16500:0x16503], disk[0x165A5:0x165A7] = bytes([18, 1, 0x41]), b"2A"
    places = [(t, s) for t in range(1, 36) if t != 18 for s in range(per_track[t - 1])]
    for k, (name, body) in enumerate(files.items()):
        parts = [body[i : i + 254] for i in range(0, len(body), 254)] or [b""]
        own = [places.pop(0) for _ in parts]
        for (t, s), following, part in zip(own, [*own[1:], (0, len(parts[-1]) + 1)], parts):
            disk[at(t, s) : at(t, s) + 2 + len(part)] = bytes(following) + part
        slot = at(18, 1) + 32 * k
        disk[slot + 2 : slot + 21] = bytes([0x82, *own[0]]) + name.encode().ljust(16, b"\xa0")
    disk[at(18, 1) + 1] = 255
    return bytes(disk)


def apple_dos(files):
    disk = bytearray(143_360)
    at = lambda t, s: (t * 16 + s) * 256
    disk[at(17, 0) + 1 : at(17, 0) + 4], disk[at(17, 0) + 0x27] = bytes([17, 15, 3]), 122
    disk[at(17, 0) + 0x34 : at(17, 0) + 0x38] = b"\x23\x10\0\1"
    places = [(t, s) for t in range(3, 17) for s in range(16)]
    for k, (name, body) in enumerate(files.items()):
        index = places.pop(0)
        slot = at(17, 15) + 11 + 35 * k
        disk[slot : slot + 33] = bytes([*index, 4]) + bytes(c | 0x80 for c in name.encode().ljust(30))
        for i in range(0, len(body), 256):
            own = places.pop(0)
            disk[at(*index) + 12 + i // 128 : at(*index) + 14 + i // 128] = bytes(own)
            disk[at(*own) : at(*own) + len(body[i : i + 256])] = body[i : i + 256]
    return bytes(disk)


def acorn_dfs(files):
    disk, start = bytearray(102_400), 2
    disk[261], disk[262], disk[263] = 8 * len(files), 400 >> 8, 400 & 255
    for k, (name, body) in enumerate(files.items(), 1):
        disk[8 * k : 8 * k + 8] = name.encode().ljust(7) + b"$"
        disk[256 + 8 * k : 264 + 8 * k] = bytes([0, 0, 0, 0, len(body) & 255, len(body) >> 8 & 255, (len(body) >> 16 & 3) << 4 | start >> 8, start & 255])
        disk[start * 256 : start * 256 + len(body)] = body
        start += -(-len(body) // 256)
    return bytes(disk)


def atari_dos(files):
    """files: {name: bytes} on a single-density disk."""
    disk = bytearray(720 * 128)
    disk[359 * 128 : 359 * 128 + 5] = b"\2" + struct.pack("<HH", 707, 700)
    n = 10
    for k, (name, body) in enumerate(files.items()):
        pieces = [body[i : i + 125] for i in range(0, len(body), 125)] or [b""]
        base, _, ending = name.partition(".")
        disk[360 * 128 + 16 * k : 360 * 128 + 16 * k + 16] = struct.pack("<BHH8s3s", 0x42, len(pieces), n, base.ljust(8).encode(), ending.ljust(3).encode())
        for i, piece in enumerate(pieces):
            following = n + 1 if i + 1 < len(pieces) else 0
            disk[128 * (n - 1) : 128 * n] = piece.ljust(125, b"\0") + bytes([k << 2 | following >> 8, following & 255, len(piece)])
            n += 1 if n + 1 < 360 else 11  # past the directory
    return bytes(disk)


def rsdos(files):
    """files: {name: bytes} on 35 tracks."""
    disk = bytearray(35 * 18 * 256)
    table, directory, granule = bytearray(b"\xff" * 68), bytearray(b"\xff" * 72 * 32), 0
    for k, (name, body) in enumerate(files.items()):
        base, _, ending = name.partition(".")
        n, last = max(1, -(-len(body) // 2304)), len(body) % 2304 or (2304 if body else 0)
        sectors, rest = (last - 1) // 256 + 1 if last else 1, (last - 1) % 256 + 1 if last else 0
        directory[32 * k : 32 * k + 32] = struct.pack(">8s3sBBBH16x", base.ljust(8).encode(), ending.ljust(3).encode(), 1, 0, granule, rest)
        for i in range(n):
            at = ((granule // 2 + (granule // 2 >= 17)) * 18 + granule % 2 * 9) * 256
            piece = body[2304 * i : 2304 * (i + 1)]
            disk[at : at + len(piece)] = piece
            table[granule] = granule + 1 if i + 1 < n else 0xC0 + sectors
            granule += 1
    disk[(17 * 18 + 1) * 256 : (17 * 18 + 1) * 256 + 68] = table
    disk[(17 * 18 + 2) * 256 : (17 * 18 + 2) * 256 + len(directory)] = directory
    return bytes(disk)


def dragon_dos(files):
    """files: {name: bytes} on 40 tracks of one side; every file is one extent."""
    disk = bytearray(40 * 18 * 256)
    home, lsn = 20 * 18 * 256, 18
    disk[home + 0xFC : home + 0x100] = bytes([40, 18, 255 - 40, 255 - 18])
    for k in range(160):
        at = home + 512 + k // 10 * 256 + k % 10 * 25
        disk[at] = 0x89
        if k < len(files):
            name, body = list(files.items())[k]
            base, _, ending = name.partition(".")
            n = -(-len(body) // 256)
            lsn = 21 * 18 if lsn <= 20 * 18 < lsn + n + 18 else lsn
            disk[at : at + 25] = b"\0" + base.ljust(8, "\0").encode() + ending.ljust(3, "\0").encode() + struct.pack(">HB", lsn, n) + bytes(9) + bytes([len(body) % 256])
            disk[256 * lsn : 256 * lsn + len(body)] = body
            lsn += n
    return bytes(disk)


def os9(files, sectors=630):
    """files: {path: bytes or None for a folder}, folders first; every file is one segment."""
    disk = bytearray(sectors * 256)
    disk[0:3], disk[4:8], disk[8:11] = sectors.to_bytes(3, "big"), struct.pack(">HH", 79, 1), (2).to_bytes(3, "big")
    homes, lsn = {"": 2} | {p: 3 + k for k, p in enumerate(files)}, 3 + len(files)

    def put(fd, attributes, body):
        nonlocal lsn
        n = -(-len(body) // 256)
        disk[256 * fd : 256 * fd + 21] = bytes([attributes, 0, 0, 124, 1, 2, 3, 4, 1]) + struct.pack(">I", len(body)) + bytes(3) + (lsn.to_bytes(3, "big") + struct.pack(">H", n) if n else bytes(5))
        disk[256 * lsn : 256 * lsn + len(body)] = body
        lsn += n

    def name(text):
        raw = text.encode("latin-1")
        return (raw[:-1] + bytes([raw[-1] | 0x80])).ljust(29, b"\0")

    for path in ["", *(p for p, body in files.items() if body is None)]:
        own = b"".join(name(n) + homes[h].to_bytes(3, "big") for n, h in (("..", path.rpartition("/")[0]), (".", path)))
        own += b"".join(name(p.rpartition("/")[2]) + homes[p].to_bytes(3, "big") for p in files if p.rpartition("/")[0] == path)
        put(homes[path], 0xBF, own)
    for path, body in files.items():
        if body is not None:
            put(homes[path], 0x1B, body)
    return bytes(disk)


def affs(files, fast=True, blocks=1760):
    """files: {path: bytes or None for a folder}, folders first."""
    disk, half = bytearray(512 * blocks), blocks // 2
    disk[:4] = b"DOS" + bytes([int(fast)])
    struct.pack_into(">I", disk, 8, half)
    longs = lambda n, k, *v: struct.pack_into(f">{len(v)}i", disk, 512 * n + 4 * k, *v)
    get = lambda n, k: struct.unpack_from(">i", disk, 512 * n + 4 * k)[0]
    longs(half, 0, 2, 0, 0, 72)
    longs(half, 127, 1)
    homes, following = {"": half}, half + 1

    def new():
        nonlocal following
        following += 1
        return following

    def link(folder, n, name):
        h = len(name)
        for c in name.upper().encode("latin-1"):
            h = (h * 13 + c) & 0x7FF
        slot = 6 + h % 72
        longs(n, 124, get(folder, slot))
        longs(folder, slot, n)

    for path, body in files.items():
        parent, _, name = path.rpartition("/")
        n = homes[path] = new()
        longs(n, 0, 2, n)
        raw = name.encode("latin-1")
        disk[512 * n + 432 : 512 * n + 433 + len(raw)] = bytes([len(raw)]) + raw
        longs(n, 105, 1, 2, 150)
        longs(n, 125, homes[parent])
        longs(n, 127, 2 if body is None else -3)
        if body is not None:
            longs(n, 81, len(body))
            room = 512 if fast else 488
            pieces, table = [body[i : i + room] for i in range(0, len(body), room)], n
            for k, piece in enumerate(pieces):
                if k and k % 72 == 0:
                    more = new()
                    longs(table, 126, more)
                    longs(more, 0, 16, more)
                    longs(more, 127, -3)
                    table = more
                at = new()
                head = b"" if fast else struct.pack(">IIIIII", 8, n, k + 1, len(piece), 0, 0)
                disk[512 * at : 512 * at + len(head) + len(piece)] = head + piece
                longs(table, 77 - k % 72, at)
                longs(table, 2, k % 72 + 1)
        link(homes[parent], n, name)
    for n in homes.values():
        longs(n, 5, 0)
        total = sum(struct.unpack_from(">128I", disk, 512 * n))
        struct.pack_into(">I", disk, 512 * n + 20, -total & 0xFFFFFFFF)
    return bytes(disk)


def cpm(files):
    """files: {name: bytes} on a single-density eight-inch disk: blocks of 1024 bytes, 64 names."""
    disk, k, block = bytearray(77 * 26 * 128), 0, 2
    start = 2 * 26 * 128
    disk[start : start + 2048] = b"\xe5" * 2048
    for name, body in files.items():
        base, _, ending = name.partition(".")
        for extent in range(max(1, -(-len(body) // 16_384))):
            piece = body[16_384 * extent : 16_384 * (extent + 1)]
            numbers = list(range(block, block + -(-len(piece) // 1024)))
            block += len(numbers)
            disk[start + 32 * k : start + 32 * k + 32] = b"\0" + base.ljust(8).encode() + ending.ljust(3).encode() + bytes([extent, 0, 0, -(-len(piece) // 128)]) + bytes(numbers).ljust(16, b"\0")
            if numbers:
                disk[start + 1024 * numbers[0] : start + 1024 * numbers[0] + len(piece)] = piece
            k += 1
    return bytes(disk)


def mfs(files, blocks=391, block=1024):
    """files: {name: bytes} in the one directory of a 400 KB disk."""
    disk, table, first = bytearray(400 << 10), [], 2
    data_at = 16
    entries = b""
    for number, (name, body) in enumerate(files.items(), 16):
        n = -(-len(body) // block)
        raw = name.encode("mac_roman")
        entry = struct.pack(">BB4s4s8xIHIIHIIII", 0x80, 0, b"TEXT", b"ttxt", number, first if n else 0, len(body), n * block, 0, 0, 0, 0, 0) + bytes([len(raw)]) + raw
        entries += entry + bytes(len(entry) & 1)
        disk[data_at * 512 + (first - 2) * block : data_at * 512 + (first - 2) * block + len(body)] = body
        table += [*range(first + 1, first + n), 1] if n else []
        first += n
    struct.pack_into(">H", disk, 1024, 0xD2D7)
    struct.pack_into(">HHHHI", disk, 1024 + 12, len(files), 4, 12, blocks, block)
    struct.pack_into(">H", disk, 1024 + 28, data_at)
    bits = "".join(f"{n:012b}" for n in table)
    bits += "0" * (-len(bits) % 8)
    disk[1024 + 64 : 1024 + 64 + len(bits) // 8] = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    disk[4 * 512 : 4 * 512 + len(entries)] = entries  # of at most one block
    return bytes(disk)


def iso9660(files):
    """files: {path: bytes or None for a folder}, folders first."""
    folders, at = ["", *(p for p, b in files.items() if b is None)], 20
    places = {}
    for p in folders:
        places[p], at = at, at + 1
    for p, b in files.items():
        if b is not None:
            places[p], at = at, at + max(1, -(-len(b) // 2048))
    disk = bytearray(at * 2048)

    def record(name, start, size, folder):
        raw = name if isinstance(name, bytes) else name.encode() + b"" if folder else name.encode() + b";1"
        body = struct.pack("<IIII", 0, 0, 0, 0)
        both = lambda v: struct.pack("<I", v) + struct.pack(">I", v)
        body = bytes(2) + both(start) + both(size) + bytes([124, 1, 2, 3, 4, 5, 0]) + bytes([2 if folder else 0, 0, 0]) + struct.pack("<HHB", 1, 256, len(raw)) + raw
        body = body[1:] + bytes(len(body) & 1)
        return bytes([len(body) + 1]) + body

    for p in folders:
        own = record(b"\0", places[p], 2048, True) + record(b"\1", places[p.rpartition("/")[0]], 2048, True)
        own += b"".join(record(q.rpartition("/")[2], places[q], 2048 if b is None else len(b), b is None) for q, b in files.items() if q.rpartition("/")[0] == p)
        disk[places[p] * 2048 : places[p] * 2048 + len(own)] = own
    for p, b in files.items():
        if b is not None:
            disk[places[p] * 2048 : places[p] * 2048 + len(b)] = b
    disk[16 * 2048 : 16 * 2048 + 7] = b"\1CD001\1"
    root = record(b"\0", places[""], 2048, True)
    disk[16 * 2048 + 156 : 16 * 2048 + 156 + len(root)] = root
    return bytes(disk)


def raw_vhd(disk):
    foot = bytearray(512)
    foot[:8] = b"conectix"
    struct.pack_into(">Q", foot, 48, len(disk))
    struct.pack_into(">I", foot, 60, 2)
    return disk + bytes(foot)


def vmdk(disk, grain=128):
    """A sparse extent of one table level."""
    sectors, per = -(-len(disk) // 512), 512
    tables = -(-sectors // (grain * per))
    head = bytearray(512)
    struct.pack_into("<4sIIQQQQIQQQ", head, 0, b"KDMV", 1, 3, sectors, grain, 0, 0, per, 0, 1, 0)
    directory, table_at, at = [], 1 + -(-tables * 4 // 512), 1 + -(-tables * 4 // 512) + tables * (per * 4 // 512)
    body, entries = b"", []
    for t in range(tables):
        directory.append(table_at + t * (per * 4 // 512))
        for j in range(per):
            k = t * per + j
            piece = disk[k * grain * 512 : (k + 1) * grain * 512].ljust(grain * 512, b"\0")
            if piece.count(0) == len(piece):
                entries.append(0)
            else:
                entries.append(at + len(body) // 512)
                body += piece
    return bytes(head) + struct.pack(f"<{tables}I", *directory).ljust((table_at - 1) * 512, b"\0") + struct.pack(f"<{len(entries)}I", *entries) + body


def twomg(disk):
    return struct.pack("<4s4sHHIIIII", b"2IMG", b"TEST", 64, 1, 1, 0, len(disk) // 512, 64, len(disk)).ljust(64, b"\0") + disk


def dc42(disk):
    return (bytes([4]) + b"disk").ljust(64, b"\0") + struct.pack(">IIII", len(disk), 0, 0, 0) + b"\0\0\1\0" + disk


def dmg(disk, sectors=64):
    """A compressed image: pieces of zlib, bzip2, raw and zeros in turn."""
    import bz2
    import plistlib
    import zlib

    body, runs = b"", []
    for k, at in enumerate(range(0, len(disk), sectors * 512)):
        piece = disk[at : at + sectors * 512]
        if piece.count(0) == len(piece):
            kind, packed = 0, b""
        else:
            kind, packed = ((0x80000005, zlib.compress(piece)), (0x80000006, bz2.compress(piece)), (1, piece))[k % 3]
        runs.append(struct.pack(">IIQQQQ", kind, 0, at // 512, len(piece) // 512, len(body), len(packed)))
        body += packed
    runs.append(struct.pack(">IIQQQQ", 0xFFFFFFFF, 0, len(disk) // 512, 0, len(body), 0))
    mish = struct.pack(">4sIQQQ", b"mish", 1, 0, len(disk) // 512, 0).ljust(200, b"\0") + struct.pack(">I", len(runs)) + b"".join(runs)
    plist = plistlib.dumps({"resource-fork": {"blkx": [{"Data": mish, "Name": "disk"}]}})
    koly = bytearray(512)
    koly[:4] = b"koly"
    struct.pack_into(">QQ", koly, 24, 0, len(body))
    struct.pack_into(">QQ", koly, 216, len(body), len(plist))
    struct.pack_into(">Q", koly, 492, len(disk) // 512)
    return body + plist + bytes(koly)


def edsk(disk, tracks=40, sectors=9):
    """One side of sectors of 512 bytes, stored in an interleaved order."""
    order = [*range(1, sectors + 1, 2), *range(2, sectors + 1, 2)]
    size = 256 + sectors * 512
    out = b"EXTENDED CPC DSK File\r\nDisk-Info\r\n".ljust(48, b"\0") + bytes([tracks, 1, 0, 0]) + bytes([size >> 8] * tracks)
    out = out.ljust(256, b"\0")
    for t in range(tracks):
        head = b"Track-Info\r\n".ljust(16, b"\0") + bytes([t, 0, 0, 0, 2, sectors, 0x4E, 0xE5]) + b"".join(bytes([t, 0, 0xC0 + n, 2, 0, 0]) + struct.pack("<H", 512) for n in order)
        out += head.ljust(256, b"\0") + b"".join(disk[(t * sectors + n - 1) * 512 : (t * sectors + n) * 512].ljust(512, b"\0") for n in order)
    return out


#: The five bits that record a nibble on Commodore disks.
GCR = (0b01010, 0b01011, 0b10010, 0b10011, 0b01110, 0b01111, 0b10110, 0b10111, 0b01001, 0b11001, 0b11010, 0b11011, 0b01101, 0b11101, 0b11110, 0b10101)


def g64(disk):
    """The tracks of a 35-track disk as recorded bits."""
    per = [21] * 17 + [19] * 7 + [18] * 6 + [17] * 5
    gcr = lambda raw: "".join(f"{GCR[b >> 4]:05b}{GCR[b & 15]:05b}" for b in raw)
    tracks, at = [], 0
    for t, n in enumerate(per, 1):
        bits = "01010101" * 3
        for s in range(n):
            body = disk[at : at + 256]
            at += 256
            check = 0
            for b in body:
                check ^= b
            bits += "1" * 40 + gcr(bytes([8, s ^ t ^ 0x41 ^ 0x42, s, t, 0x42, 0x41, 15, 15])) + "01010101" * 9 + "1" * 40 + gcr(bytes([7, *body, check, 0, 0])) + "01010101" * 8
        bits += "0" * (-len(bits) % 8)
        tracks.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    offsets, body, at = [], b"", 12 + 84 * 8
    for raw in tracks:
        offsets += [at + len(body), 0]
        body += struct.pack("<H", len(raw)) + raw
    offsets += [0] * (84 - len(offsets))
    return b"GCR-1541\0" + bytes([84]) + struct.pack("<H", 7928) + struct.pack("<84I", *offsets) + struct.pack("<84I", *[3] * 84) + body


def chd(disk, hunk=4096):
    """Version 5; hunks are deflated, stored, or repeat an earlier one."""
    import zlib

    hunks = [disk[i : i + hunk].ljust(hunk, b"\0") for i in range(0, len(disk), hunk)]
    kinds, body, seen, start = [], b"", {}, 124
    bits = ""
    for k, piece in enumerate(hunks):
        if piece in seen:
            kinds.append((5, seen[piece], 0))
            continue
        seen[piece] = k
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        packed = packer.compress(piece) + packer.flush()
        if len(packed) < hunk and k % 5:
            kinds.append((0, len(packed), 0))
            body += packed
        else:
            kinds.append((4, 0, 0))
            body += piece
    for _ in range(16):
        bits += f"{4:04b}"  # all codes have four bits
    for kind, _, _ in kinds:
        bits += f"{kind:04b}"
    for kind, value, _ in kinds:
        bits += f"{value:024b}" + "0" * 16 if kind == 0 else "0" * 16 if kind == 4 else f"{value:016b}"
    bits += "0" * (-len(bits) % 8)
    packed_map = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    header = struct.pack(">8sII4s4s4s4sQQQII", b"MComprHD", 124, 5, b"zlib", b"\0" * 4, b"\0" * 4, b"\0" * 4, len(disk), start + len(body), 0, hunk, 512).ljust(124, b"\0")
    return header + body + struct.pack(">I", len(packed_map)) + start.to_bytes(6, "big") + struct.pack(">HBBBB", 0, 24, 16, 0, 0) + packed_map


def partclone(disk, block=4096, per=3):
    """Version 2: used blocks only, a checksum behind every few of them."""
    import zlib

    blocks = [disk[i : i + block].ljust(block, b"\0") for i in range(0, len(disk), block)]
    used = [b.count(0) != len(b) for b in blocks]
    bitmap = bytearray(-(-len(blocks) // 8))
    for k, u in enumerate(used):
        bitmap[k // 8] |= u << k % 8
    head = b"partclone-image\0" + b"0.3.0".ljust(14, b"\0") + b"0002" + struct.pack("<H", 0xC0DE)
    head += b"RAW".ljust(16, b"\0") + struct.pack("<QQQQI", len(disk), len(blocks), sum(used), sum(used), block)
    head += struct.pack("<IHHHHIBB", 18, 2, 64, 32, 4, per, 1, 1)
    head += struct.pack("<I", zlib.crc32(head))
    body = b""
    for n, piece in enumerate((b for b, u in zip(blocks, used) if u), 1):
        body += piece + (struct.pack("<I", zlib.crc32(piece)) if n % per == 0 else b"")
    return head + bytes(bitmap) + struct.pack("<I", zlib.crc32(bytes(bitmap))) + body


def woz(disk):
    """A disk of DOS sectors as recorded bits, with marks of ten bits between its fields."""
    import zlib

    from platterlake.sources.containers import DOS_ORDER, SIX_BITS

    four = lambda v: bytes([v >> 1 | 0xAA, v | 0xAA])
    bits = lambda raw: "".join(f"{b:08b}" for b in raw)
    gap = lambda n: "1111111100" * n
    tracks = []
    for t in range(35):
        out = gap(20)
        for p in range(16):
            body = disk[t * 4096 + DOS_ORDER[p] * 256 : t * 4096 + DOS_ORDER[p] * 256 + 256]
            low = [0] * 86
            for i, b in enumerate(body):
                low[i % 86] |= (b >> 1 & 1 | b << 1 & 2) << 2 * (i // 86)
            plain, last, coded = low + [b >> 2 for b in body], 0, []
            for v in plain:
                coded.append(SIX_BITS[v ^ last])
                last = v
            coded.append(SIX_BITS[last])
            out += bits(b"\xd5\xaa\x96" + four(254) + four(t) + four(p) + four(254 ^ t ^ p) + b"\xde\xaa\xeb") + gap(5)
            out += bits(b"\xd5\xaa\xad" + bytes(coded) + b"\xde\xaa\xeb") + gap(10)
        tracks.append(out)
    info = (b"\2\1" + bytes(58)).ljust(60, b"\0")
    tmap = bytes(t // 4 if t % 4 == 0 and t < 140 else 0xFF for t in range(160))
    table, body, start = b"", b"", 3
    for out in tracks:
        raw = bytes(int(out[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(out), 8))
        blocks = -(-len(raw) // 512)
        table += struct.pack("<HHI", start, blocks, len(out))
        body += raw.ljust(512 * blocks, b"\0")
        start += blocks
    trks = table.ljust(1280, b"\0") + body
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data
    rest = chunk(b"INFO", info) + chunk(b"TMAP", tmap) + chunk(b"TRKS", trks)
    return b"WOZ2\xff\n\r\n" + struct.pack("<I", zlib.crc32(rest)) + rest


def dos_ordered(disk):
    """A 5.25-inch disk of ProDOS blocks in the order of DOS sectors."""
    from platterlake.sources.containers import PRODOS_ORDER

    out = bytearray(len(disk))
    for t in range(35):
        for k, s in enumerate(PRODOS_ORDER):
            out[t * 4096 + 256 * s : t * 4096 + 256 * s + 256] = disk[t * 4096 + 256 * k : t * 4096 + 256 * k + 256]
    return bytes(out)


def efs(files, blocks=2000):
    """files: {path: bytes or None for a folder}, folders first; one cylinder group, every file one extent or more."""
    disk, group, inodes = bytearray(512 * blocks), 2, 40
    struct.pack_into(">iiihhhhhh", disk, 512, blocks, group, blocks - group, inodes, 16, 1, 1, 0, 0)
    struct.pack_into(">I", disk, 512 + 28, 0x00072959)
    homes, at = {"": 2} | {p: 3 + k for k, p in enumerate(files)}, group + inodes

    def put(n, mode, body, links=1):
        nonlocal at
        extents, first = b"", at
        for logical in range(0, -(-len(body) // 512), 200):
            count = min(200, -(-len(body) // 512) - logical)
            extents += struct.pack(">II", first + logical, count << 24 | logical)
        disk[512 * at : 512 * at + len(body)] = body
        at += -(-len(body) // 512)
        place = 512 * group + 128 * n
        struct.pack_into(">HHHHIIIIIHBB", disk, place, mode, links, 7, 8, len(body), 0, 86_400, 0, 0, len(extents) // 8, 0, 0)
        disk[place + 32 : place + 32 + len(extents)] = extents

    def folder(own):
        raw, offsets, end = bytearray(512), [], 512
        for name, n in own:
            entry = struct.pack(">IB", n, len(name)) + name.encode()
            end -= len(entry) + (len(entry) & 1)
            raw[end : end + len(entry)] = entry
            offsets.append(end // 2)
        raw[: 4 + len(offsets)] = struct.pack(">HBB", 0xBEEF, end // 2, len(offsets)) + bytes(offsets)
        return bytes(raw)

    for path in ["", *(p for p, b in files.items() if b is None)]:
        put(homes[path], 0o040755, folder([(".", homes[path]), ("..", homes[path.rpartition("/")[0]]), *((p.rpartition("/")[2], homes[p]) for p in files if p.rpartition("/")[0] == path)]), 2 + sum(b is None and p.rpartition("/")[0] == path for p, b in files.items()))
    for path, body in files.items():
        if body is not None:
            put(homes[path], 0o100644, body)
    return bytes(disk)


def human68k(files):
    """files: {name: bytes or None for a folder} in the root of a 1232 KB floppy; names of up to eighteen letters."""
    disk, table, at = bytearray(1_261_568), [0xFFE, 0xFFF], 0
    disk[:2] = b"\x60\x3c"
    slots = b""
    for name, body in files.items():
        base, _, ending = name.partition(".")
        n = -(-len(body) // 1024)
        first = len(table) if n else 0
        table += [*range(first + 1, first + n), 0xFFF] if n else []
        disk[11 * 1024 + at : 11 * 1024 + at + len(body)] = body
        at += n * 1024
        raw = base.encode("shift_jis")
        slots += struct.pack("<8s3sB10sHHHI", raw[:8].ljust(8), ending.encode().ljust(3), 0x20, raw[8:18], 0x6000, 0x5A21, first, len(body))
    fat = bytearray(2048)
    for n, value in enumerate(table):
        place = n * 3 // 2
        (pair,) = struct.unpack_from("<H", fat, place)
        struct.pack_into("<H", fat, place, pair | value << 4 if n & 1 else pair & 0xF000 | value)
    disk[1024:3072] = disk[3072:5120] = fat
    disk[5120 : 5120 + len(slots)] = slots
    return bytes(disk)


def ufs(files, wide=True, order="<", block=8192, fragment=1024, fragments=4096):
    """files: {path: bytes or None for a folder}, folders first; one group. wide: UFS2, else UFS1."""
    disk, per, inodes_at = bytearray(fragments * fragment), 64, 80
    sb = 65536 if wide else 8192
    for at, value in ((16, inodes_at), (20, 112), (44, 1), (48, block), (52, fragment), (56, block // fragment), (184, per), (188, fragments), (1372, 0x19540119 if wide else 0x00011954)):
        struct.pack_into(order + "I", disk, sb + at, value)
    homes, following = {"": 2} | {p: 3 + k for k, p in enumerate(files)}, 112

    def new(n):
        nonlocal following
        following += n
        return following - n

    def put(n, mode, body, links=1):
        blocks, own = [0] * 15, []
        raw = body
        for at in range(0, len(raw), block):
            place = new(-(-min(block, len(raw) - at) // fragment))
            disk[place * fragment : place * fragment + len(raw[at : at + block])] = raw[at : at + block]
            own.append(place)
        blocks[: min(12, len(own))] = own[:12]
        if own[12:]:
            blocks[12] = new(block // fragment)
            struct.pack_into(f"{order}{len(own) - 12}{'q' if wide else 'i'}", disk, blocks[12] * fragment, *own[12:])
        at = inodes_at * fragment + n * (256 if wide else 128)
        if wide:
            struct.pack_into(order + "HHIIIQQqqq", disk, at, mode, links, 7, 8, block, len(body), 0, 0, 86_400, 0)
            struct.pack_into(order + "15q", disk, at + 112, *blocks)
        else:
            struct.pack_into(order + "HHIQ", disk, at, mode, links, 0, len(body))
            struct.pack_into(order + "i", disk, at + 24, 86_400)
            struct.pack_into(order + "15i", disk, at + 40, *blocks)
            struct.pack_into(order + "II", disk, at + 112, 7, 8)

    def folder(own):
        out = b""
        for k, (name, n) in enumerate(own):
            raw = name.encode()
            size = -(-(8 + len(raw) + 1) // 4) * 4
            out += struct.pack(order + "IHBB", n, size if k + 1 < len(own) else 512 - len(out), 0, len(raw)) + raw.ljust(size - 8, b"\0")
        return out.ljust(512, b"\0")

    for path in ["", *(p for p, b in files.items() if b is None)]:
        put(homes[path], 0o040755, folder([(".", homes[path]), ("..", homes[path.rpartition("/")[0]]), *((p.rpartition("/")[2], homes[p]) for p in files if p.rpartition("/")[0] == path)]), 2 + sum(b is None and p.rpartition("/")[0] == path for p, b in files.items()))
    for path, body in files.items():
        if body is not None:
            put(homes[path], 0o100644, body)
    return bytes(disk)


def xfs(files, version=5, block=4096, group=512, short=True):
    """files: {path: bytes or None for a folder}, folders first; one group. short: folders within their inodes, else in a block."""
    size, log = 512, 9
    disk = bytearray(block * group)
    per, head = block // size, 176 if version == 5 else 100
    first = 8  # the block of the first inodes
    homes = {"": first * per} | {p: first * per + 1 + k for k, p in enumerate(files)}
    struct.pack_into(">4sIQ", disk, 0, b"XFSB", block, group)
    struct.pack_into(">Q", disk, 56, homes[""])
    struct.pack_into(">II", disk, 84, group, 1)
    struct.pack_into(">HHHH", disk, 100, version, 512, size, per)
    disk[120:125] = bytes([12, 9, log, 3, 9])
    if version == 5:
        struct.pack_into(">I", disk, 216, 1)
    typed, following = version == 5, first + 16

    def put(n, mode, form, body, length, links=1):
        at = n // per * block + n % per * size
        struct.pack_into(">HHBBHII", disk, at, 0x494E, mode, 3 if version == 5 else 2, form, 0, 7, 8)
        struct.pack_into(">I", disk, at + 16, links)
        struct.pack_into(">i", disk, at + 40, 86_400)
        struct.pack_into(">Q", disk, at + 56, length)
        struct.pack_into(">I", disk, at + 76, len(body) // 16 if form == 2 else 0)
        disk[at + head : at + head + len(body)] = body

    def extents(body):
        nonlocal following
        out, count = b"", -(-len(body) // block)
        disk[following * block : following * block + len(body)] = body
        at = 0
        while at < count:  # in pieces of two blocks
            n = min(2, count - at)
            out += (at << 73 | (following + at) << 21 | n).to_bytes(16, "big")
            at += n
        following += count
        return out

    for path in ["", *(p for p, b in files.items() if b is None)]:
        own = [(p.rpartition("/")[2].encode(), homes[p]) for p in files if p.rpartition("/")[0] == path]
        up, links = homes[path.rpartition("/")[0]], 2 + sum(b is None and p.rpartition("/")[0] == path for p, b in files.items())
        if short:
            body = struct.pack(">BBI", len(own), 0, up) + b"".join(bytes([len(n), 0, 0]) + n + (b"\1" if typed else b"") + struct.pack(">I", i) for n, i in own)
            put(homes[path], 0o040755, 1, body, len(body), links)
        else:
            raw = (b"XDB3" if version == 5 else b"XD2B").ljust(64 if version == 5 else 16, b"\0")
            for name, number in [(b".", homes[path]), (b"..", up), *own]:
                entry = struct.pack(">QB", number, len(name)) + name + (b"\1" if typed else b"")
                raw += entry.ljust(-(-(len(entry) + 2) // 8) * 8, b"\0")
            leaves = 8 * (len(own) + 2) + 8
            raw += struct.pack(">HH", 0xFFFF, block - leaves - len(raw))
            put(homes[path], 0o040755, 2, extents(raw.ljust(block - 8, b"\0") + struct.pack(">II", len(own) + 2, 0)), block, links)
    for path, body in files.items():
        if body is not None:
            put(homes[path], 0o100644, 2, extents(body), len(body))
    return bytes(disk)


def journaled(writes, bad=(), order="<", blocks=256, start=None):
    """An HFS+ volume of 4096-byte blocks whose journal holds transactions, each a list of (sector, 512 bytes); those whose
    number is in bad are damaged. start: where in the ring the oldest one begins."""
    from platterlake.sources.journal import HEADER_SUM, LIST, LIST_SUM, MAGIC, NATIVE, _sum

    disk, sector, list_size, total, place = bytearray(4096 * blocks), 512, 4096, 64 << 10, 64 << 10
    disk[1024:1026] = b"H+"
    struct.pack_into(">I", disk, 1024 + 4, 0x2000)
    struct.pack_into(">I", disk, 1024 + 12, 2)
    struct.pack_into(">II", disk, 1024 + 40, 4096, blocks)
    struct.pack_into(">I", disk, 2 * 4096, 1)
    struct.pack_into(">QQ", disk, 2 * 4096 + 36, place, total)
    first = at = sector if start is None else start

    def put(raw: bytes) -> None:
        nonlocal at
        for k in range(0, len(raw), sector):
            if at >= total:
                at = sector
            disk[place + at : place + at + sector] = raw[k : k + sector]
            at += sector

    for number, some in enumerate(writes, 1):
        head = bytearray(list_size)
        struct.pack_into(order + "HHiIi", head, 0, 255, len(some) + 1, list_size + sector * len(some), 0, 0)
        for k, (n, _) in enumerate(some, 1):
            struct.pack_into(order + "QII", head, 16 + 16 * k, n, sector, 0)
        struct.pack_into(order + "I", head, LIST_SUM, _sum(bytes(head[:LIST]), LIST_SUM) ^ (number in bad))
        put(bytes(head) + b"".join(body for _, body in some))
    end = at if at < total else sector
    head = bytearray(struct.pack(order + "IIQQQIII", MAGIC, NATIVE, first, end, total, list_size, 0, sector))
    struct.pack_into(order + "I", head, HEADER_SUM, _sum(bytes(head), HEADER_SUM))
    disk[place : place + len(head)] = head
    return bytes(disk)
