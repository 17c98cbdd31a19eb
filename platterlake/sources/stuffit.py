"""StuffIt archives up to version 4: stored, run-length coded and Huffman coded forks, in folders."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime

from platterlake.functions.dates import MAC_EPOCH
from platterlake.sources.entries import Entry

HEAD, ENTRY = 22, 112


def crc16(data: bytes) -> int:
    """The reflected CRC of polynomial 8005, by which headers and forks are checked."""
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    return crc


def unrun(raw: bytes) -> bytes:
    """A byte, 90 and a count; 90 and zero is the byte 90 itself."""
    out, k = bytearray(), 0
    while k < len(raw):
        if raw[k] != 0x90 or k + 1 == len(raw):
            out.append(raw[k])
            k += 1
        else:
            out += b"\x90" if not raw[k + 1] else out[-1:] * (raw[k + 1] - 1)
            k += 2
    return bytes(out)


def unhuffman(raw: bytes, size: int) -> bytes:
    """A tree, in which a set bit and eight more are a leaf, then codes."""
    at = 0

    def bit() -> int:
        nonlocal at
        at += 1
        return raw[(at - 1) // 8] >> 7 - (at - 1) % 8 & 1

    def tree():
        if bit():
            return sum(bit() << 7 - k for k in range(8))
        left = tree()
        return left, tree()

    root, out = tree(), bytearray()
    while len(out) < size:
        node = root
        while isinstance(node, tuple):
            node = node[bit()]
        out.append(node)
    return bytes(out)


#: How forks are coded, by number.
METHODS = {0: lambda raw, size: raw, 1: lambda raw, size: unrun(raw), 3: unhuffman}


def is_stuffit(data) -> bool:
    return bytes(data[:4]) == b"SIT!" and bytes(data[10:14]) == b"rLau"


def _fork(raw: bytes, method: int, size: int, crc: int) -> bytes | None:
    """A fork; null where its coding is not known, an error where it is damaged."""
    if method not in METHODS:
        return None
    out = METHODS[method](raw, size)[:size]
    if crc16(out) != crc:
        raise ValueError("a fork's checksum is wrong")
    return out


def stuffit(data: bytes, contents: bool = False) -> Iterator[Entry]:
    """Files and folders in order; a file whose coding is not known has a null content."""
    at, folders = HEAD, [""]
    while at + ENTRY <= len(data):
        head = data[at : at + ENTRY]
        if crc16(head[:110]) != struct.unpack_from(">H", head, 110)[0]:
            raise ValueError("an entry's checksum is wrong")
        resource_method, data_method = head[0] & 0x7F, head[1] & 0x7F
        name = head[3 : 3 + min(63, head[2])].decode("mac_roman").replace("/", ":")
        kind, creator = (head[a : a + 4].decode("mac_roman") for a in (66, 70))
        (modified,) = struct.unpack_from(">I", head, 80)
        rsize, size, rpacked, packed, _, crc = struct.unpack_from(">IIIIHH", head, 84)
        at += ENTRY
        when = datetime.fromtimestamp(max(0, modified - MAC_EPOCH), UTC).strftime("%Y-%m-%d %H:%M:%S") if modified else None
        if data_method == 33:
            folders.pop()
        elif data_method == 32 or resource_method == 32:
            folders.append(f"{folders[-1]}/{name}")
            yield Entry(folders[-1], "directory", 0, at, when)
        else:
            body = _fork(data[at + rpacked : at + rpacked + packed], data_method, size, crc) if contents else None
            yield Entry(f"{folders[-1]}/{name}", "file", size, at + rpacked, when, type_code=kind, creator_code=creator, resource_fork_size=rsize, content=body)
            at += rpacked + packed


def write_stuffit(files: dict[str, bytes | None], method: int = 0) -> bytes:
    """files: {path: bytes or None for a folder}, each folder before what it holds."""
    out, open_ = b"", ""

    def entry(name: str, kind: int, body: bytes = b"", packed: bytes = b"") -> bytes:
        raw = name.encode("mac_roman")[:63]
        head = struct.pack(">BBB63s4s4sHIIIIIIHH6x", kind if kind > 31 else 0, kind, len(raw), raw, b"TEXT", b"ttxt", 0, 3786912000, 3786912000, 0, len(body), 0, len(packed), 0, crc16(body))
        return head + struct.pack(">H", crc16(head)) + packed

    for path, body in files.items():
        parent, _, name = path.rpartition("/")
        while open_ and not (parent == open_ or parent.startswith(open_ + "/")):
            out += entry(open_.rpartition("/")[2], 33)
            open_ = open_.rpartition("/")[0]
        if body is None:
            out += entry(name, 32)
            open_ = path
        else:
            out += entry(name, method, body, {0: lambda b: b, 1: runs, 3: huffman}[method](body))
    while open_:
        out += entry(open_.rpartition("/")[2], 33)
        open_ = open_.rpartition("/")[0]
    return struct.pack(">4sHI4sBxIH", b"SIT!", len(files), HEAD + len(out), b"rLau", 1, 0, 0) + out


def runs(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = 1
        while n < 255 and k + n < len(data) and data[k + n] == data[k]:
            n += 1
        out += bytes([data[k]]) + (b"\0" if data[k] == 0x90 else b"")
        if n > 3:
            out += bytes([0x90, n])
        else:
            n = 1
        k += n
    return bytes(out)


def huffman(data: bytes) -> bytes:
    import heapq
    from collections import Counter

    heap = [(n, b, b) for b, n in sorted(Counter(data).items())] or [(1, 0, 0)]
    heapq.heapify(heap)
    serial = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
        serial += 1
    codes: dict[int, str] = {}

    def walk(node, code: str) -> str:
        if not isinstance(node, tuple):
            codes[node] = code
            return f"1{node:08b}"
        return "0" + walk(node[0], code + "0") + walk(node[1], code + "1")

    bits = walk(heap[0][2], "") + "".join(codes[b] for b in data)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
