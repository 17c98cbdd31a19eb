"""Archives to entries: tar, MacBinary, BinHex and AppleDouble here, StuffIt and Compact Pro in modules of their own."""

from __future__ import annotations

import binascii
import gzip
import io
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

from platterlake.functions.digests import crc16
from platterlake.sources import compactpro, stuffit
from platterlake.sources.entries import Entry

#: The letters of BinHex in the order of their six bits.
BINHEX = "!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"


def peeled(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        from platterlake.sources.containers import unzstd

        return unzstd(data)
    return data


def is_tar(data) -> bool:
    """By the first block, of which no more is unpacked."""
    head = data[:4096]
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, 512)
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            head = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data[: 1 << 18]))).read(512)
        except zstandard.ZstdError:
            return False
    return head[257:262] == b"ustar"


def safe(path: str) -> list[str] | None:
    """Components of a relative path that stays in its folder."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return None if path.startswith("/") or ".." in parts or not parts else parts


def tar(data: bytes, contents: bool = False) -> Iterator[Entry]:
    """Members in order, without sidecars of forks and names that leave the folder."""
    with tarfile.open(fileobj=io.BytesIO(peeled(data))) as archive:
        for m in archive:
            parts = safe(m.name)
            if parts is None or parts[-1].startswith("._"):
                continue
            kind = "directory" if m.isdir() else "symlink" if m.issym() else "file" if m.isreg() else "special"
            body = archive.extractfile(m).read() if contents and m.isreg() else None
            yield Entry("/" + "/".join(parts), kind, m.size, m.offset_data, mode=m.mode, uid=m.uid, gid=m.gid, symlink_target=m.linkname or None, content=body)


def write_tar(rows: list[Entry]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as archive:
        for e in rows:
            info = tarfile.TarInfo(e.path.lstrip("/"))
            info.type = {"directory": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE}.get(e.kind, tarfile.REGTYPE)
            info.size, info.mode = len(e.content or b""), e.mode if e.mode is not None else 0o755 if e.kind == "directory" else 0o644
            info.linkname = e.symlink_target or ""
            archive.addfile(info, io.BytesIO(e.content or b""))
    return out.getvalue()


def is_macbinary(data) -> bool:
    return len(data) >= 128 and data[0] == 0 and data[74] == 0 and 1 <= data[1] <= 63 and crc16(data[:124]) == struct.unpack(">H", data[124:126])[0]


def macbinary(data: bytes, contents: bool = False) -> Iterator[Entry]:
    size, rsize = struct.unpack_from(">II", data, 83)
    text = [data[a : a + 4].decode("mac_roman") for a in (65, 69)]
    yield Entry("/" + data[2 : 2 + data[1]].decode("mac_roman"), "file", size, 128, type_code=text[0], creator_code=text[1], resource_fork_size=rsize, content=data[128 : 128 + size] if contents else None)


def write_macbinary(name: str, kind: bytes, creator: bytes, data: bytes, resource: bytes = b"") -> bytes:
    head = bytearray(128)
    raw = name.encode("mac_roman")[:63]
    head[1], head[2 : 2 + len(raw)], head[65:69], head[69:73], head[122], head[123] = len(raw), raw, kind, creator, 129, 129
    struct.pack_into(">II", head, 83, len(data), len(resource))
    struct.pack_into(">H", head, 124, crc16(bytes(head[:124])))
    pad = lambda b: b + bytes(-len(b) % 128)
    return bytes(head) + pad(data) + pad(resource)


def _unpacked(raw: bytes) -> bytes:
    """Runs are a byte, 90 and a count; 90 and zero is the byte 90 itself."""
    return re.sub(rb"(?s)\x90\x00|(.)\x90([^\x00])", lambda m: b"\x90" if m[1] is None else m[1] * m[2][0], raw)


def binhex(data: bytes, contents: bool = False) -> Iterator[Entry]:
    """One file of two forks in seven-bit letters; an error where a part's checksum is wrong."""
    text = re.search(rb":([^:]*):", data[data.index(b"(This file must be converted with BinHex") :])[1]
    value = bytes(BINHEX.index(chr(c)) for c in text if chr(c) not in "\r\n\t ")
    bits = "".join(f"{v:06b}" for v in value)
    raw = _unpacked(int(bits[: len(bits) // 8 * 8] or "0", 2).to_bytes(len(bits) // 8, "big"))
    head = 1 + raw[0] + 1 + 4 + 4 + 2 + 4 + 4
    kind, creator, _, size, rsize = struct.unpack_from(">4s4sHII", raw, raw[0] + 2)
    parts, at = [], 0
    for n in (head, size, rsize):
        part, (crc,) = raw[at : at + n], struct.unpack_from(">H", raw, at + n)
        if crc16(part) != crc and binascii.crc_hqx(part, 0) != crc:
            raise ValueError("a checksum is wrong")
        parts.append(part)
        at += n + 2
    yield Entry("/" + raw[1 : 1 + raw[0]].decode("mac_roman"), "file", size, 0, type_code=kind.decode("mac_roman"), creator_code=creator.decode("mac_roman"), resource_fork_size=rsize, content=parts[1] if contents else None)


def write_binhex(name: str, kind: bytes, creator: bytes, data: bytes, resource: bytes = b"") -> bytes:
    raw = name.encode("mac_roman")
    head = bytes([len(raw)]) + raw + b"\0" + struct.pack(">4s4sHII", kind, creator, 0, len(data), len(resource))
    body = b"".join(p + struct.pack(">H", crc16(p)) for p in (head, data, resource)).replace(b"\x90", b"\x90\x00")
    bits = "".join(f"{b:08b}" for b in body)
    bits += "0" * (-len(bits) % 6)
    text = ":" + "".join(BINHEX[int(bits[i : i + 6], 2)] for i in range(0, len(bits), 6)) + ":"
    return ("(This file must be converted with BinHex 4.0)\n\n" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + "\n").encode()


def appledouble(data: bytes) -> dict[int, bytes]:
    """Parts of a fork sidecar by their number: 2 is the resource fork, 9 the Finder's data."""
    magic, count = struct.unpack_from(">I20xH", data)[0], struct.unpack_from(">H", data, 24)[0]
    if magic != 0x00051607:
        raise ValueError("not an AppleDouble file")
    found = (struct.unpack_from(">III", data, 26 + 12 * k) for k in range(count))
    return {n: data[at : at + size] for n, at, size in found}


def write_appledouble(finder: bytes, resource: bytes) -> bytes:
    at = 26 + 2 * 12
    head = struct.pack(">II16xH", 0x00051607, 0x00020000, 2)
    return head + struct.pack(">III", 9, at, len(finder)) + struct.pack(">III", 2, at + len(finder), len(resource)) + finder + resource


def kind_of(data) -> str | None:
    if is_tar(data):
        return "tar"
    if b"(This file must be converted with BinHex" in data[:4096]:
        return "binhex"
    if is_macbinary(data):
        return "macbinary"
    if stuffit.is_stuffit(data):
        return "stuffit"
    if compactpro.is_compactpro(data):
        return "compactpro"
    return None


READERS = {"tar": tar, "binhex": binhex, "macbinary": macbinary, "stuffit": stuffit.stuffit, "compactpro": compactpro.compactpro}
