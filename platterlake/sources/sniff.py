"""What a range of bytes is: ordered rules over its first bytes, one conditional expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Containers by magic bytes at an offset; negative offsets count from the end.
CONTAINERS = (
    ("gzip", 0, "1F8B"), ("zstd", 0, "28B52FFD"), ("lz4", 0, "04224D18"), ("zip", 0, "504B0304"), ("chd", 0, "4D436F6D70724844"),
    ("qcow2", 0, "514649FB"), ("vmdk", 0, "4B444D56"), ("vmdk-text", 0, "23204469736B2044657363726970746F7246696C65"), ("vhd-dynamic", 0, "636F6E6563746978"), ("vhd-fixed", -512, "636F6E6563746978"),
    ("2mg", 0, "32494D47"), ("woz", 0, "574F5A31"), ("woz", 0, "574F5A32"), ("dmg", -512, "6B6F6C79"), ("atr", 0, "9602"), ("msa", 0, "0E0F"),
    ("edsk", 0, "455854454E444544"), ("edsk", 0, "4D56202D20435043"), ("partclone", 0, "70617274636C6F6E652D696D61676500"), ("g64", 0, "4743522D31353431"), ("ghost", 0, "FEEF"), ("stuffit", 0, "53495421"), ("stuffit5", 0, "5374756666497420"),
    ("dc42", 82, "0100"), ("tar", 257, "7573746172"),
)
#: Partition schemes in the order in which they are tried.
SCHEMES = ("sgi", "apm", "rdb", "ahdi", "x68k", "none", "gpt", "mbr")
#: Names of partition type bytes.
MBR_TYPES = {
    0x01: "FAT12", 0x04: "FAT16", 0x05: "Extended", 0x06: "FAT16", 0x07: "NTFS/exFAT/HPFS", 0x0B: "FAT32", 0x0C: "FAT32", 0x0E: "FAT16",
    0x0F: "Extended", 0x11: "Hidden FAT12", 0x14: "Hidden FAT16", 0x1B: "Hidden FAT32", 0x82: "Linux swap", 0x83: "Linux", 0x85: "Extended",
    0x8E: "Linux LVM", 0xA5: "FreeBSD", 0xA6: "OpenBSD", 0xA9: "NetBSD", 0xAF: "HFS", 0xEE: "GPT protective", 0xEF: "EFI system", 0xFD: "Linux RAID",
}
#: Names of GPT type GUIDs.
GPT_TYPES = {
    "C12A7328-F81F-11D2-BA4B-00A0C93EC93B": "EFI system", "EBD0A0A2-B9E5-4433-87C0-68B6B72699C7": "Basic data", "E3C9E316-0B5C-4DB8-817D-F92DF00215AE": "Microsoft reserved",
    "0FC63DAF-8483-4772-8E79-3D69D8477DE4": "Linux", "0657FD6D-A4AB-43C4-84E5-0933C84B4F4F": "Linux swap", "E6D6D379-F507-44C2-A23C-068F2A7D6D8D": "Linux LVM",
    "48465300-0000-11AA-AA11-00306543ECAC": "HFS+", "7C3457EF-0000-11AA-AA11-00306543ECAC": "APFS", "21686148-6449-6E6F-744E-656564454649": "BIOS boot",
}
EXTENDED = (0x05, 0x0F, 0x85)


def at(data: Column, offset: int, size: int) -> Column:
    """Bytes of a binary column as hexadecimal text."""
    return F.hex(F.substring(data, offset + 1, size) if offset >= 0 else F.substring(F.substring(data, offset, -offset), 1, size))


def number(data: Column, offset: int, size: int, big: bool = True) -> Column:
    """An unsigned number of up to seven bytes."""
    return sum((F.conv(at(data, offset + i, 1), 16, 10).cast("long") * (1 << 8 * (size - 1 - i if big else i)) for i in range(1, size)), F.conv(at(data, offset, 1), 16, 10).cast("long") * (1 << 8 * (size - 1 if big else 0)))


class ColumnView:
    """A volume's first bytes, and its size, as columns; what lies beyond the bytes is null and satisfies nothing."""

    def __init__(self, data: Column, size: Column):
        self.data, self.size = data, size

    def u(self, offset, size: int, big: bool = True) -> Column:
        one = lambda i: F.conv(F.hex(F.substring(self.data, (offset if isinstance(offset, Column) else F.lit(offset)) + i + 1, F.lit(1))), 16, 10).cast("long")
        return sum((one(i) * (1 << 8 * (size - 1 - i if big else i)) for i in range(1, size)), one(0) * (1 << 8 * (size - 1 if big else 0)))

    def has(self, offset: int, *magics: str) -> Column:
        return at(self.data, offset, len(magics[0]) // 2).isin(*magics)

    def among(self, value: Column, *values) -> Column:
        return value.isin(*values)

    def not_(self, condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    def every(self, offset: int, count: int, test) -> Column:
        return F.octet_length(self.data).cast("long").__ge__(offset + count) & F.forall(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: self.u(i + offset, 1)), test)

    def some(self, offset: int, count: int, test) -> Column:
        return F.exists(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: self.u(i + offset, 1)), test)


class BytesView:
    """The same of bytes, or of anything that slices like them."""

    def __init__(self, data):
        self.data, self.size = data, len(data)

    def u(self, offset: int, size: int, big: bool = True) -> int:
        """-1 beyond the end."""
        raw = self.data[offset : offset + size] if offset >= 0 else b""
        return int.from_bytes(raw, "big" if big else "little") if len(raw) == size else -1

    def has(self, offset: int, *magics: str) -> bool:
        return self.data[offset : offset + len(magics[0]) // 2].hex().upper() in magics

    def among(self, value: int, *values) -> bool:
        return value in values

    def not_(self, condition: bool) -> bool:
        return not condition

    def every(self, offset: int, count: int, test) -> bool:
        raw = self.data[offset : offset + count]
        return len(raw) == count and all(test(b) for b in raw)

    def some(self, offset: int, count: int, test) -> bool:
        return any(test(b) for b in self.data[offset : offset + count])


def _fat(v):
    good = v.has(0, "EB", "E9") if isinstance(v, BytesView) else at(v.data, 0, 1).isin("EB", "E9")
    return good & v.among(v.u(11, 2, False), 512, 1024, 2048, 4096) & v.among(v.u(13, 1), *(1 << k for k in range(8))) & (v.u(14, 2, False) > 0) & v.among(v.u(16, 1), 1, 2)


def _cbm(v):
    """Image sizes of the drives, and where their header sector lies."""
    small = lambda at: (v.u(at, 1) == 18) & (v.u(at + 1, 1) > 0) & (v.u(at + 1, 1) < 19) & (v.u(at + 2, 1) == 0x41) & (v.u(at + 0xA5, 1) == 0x32) & (v.u(at + 0xA6, 1) >= 0x41) & (v.u(at + 0xA6, 1) <= 0x5A)
    d64 = v.among(v.size, 174_848, 175_531, 196_608, 197_376, 349_696, 351_062) & small(0x16500)
    d81 = (v.size == 819_200) & (v.u(0x61800, 1) == 40) & (v.u(0x61801, 1) > 0) & (v.u(0x61802, 1) == 0x44) & v.has(0x61819, "3344")
    d80 = v.among(v.size, 533_248, 1_066_496) & (v.u(0x44E00, 1) == 38) & (v.u(0x44E02, 1) == 0x43) & v.has(0x44E1B, "3243")
    return d64 | d81 | d80


def _atari(v):
    at_, total = 359 * 128, v.u(359 * 128 + 1, 2, False)
    fits = ((v.size == 92_160) & (total < 720)) | ((v.size == 133_120) & (total < 1040))
    return fits & (v.u(at_, 1) == 2) & (total >= 700) & (v.u(at_ + 3, 2, False) <= total)


def _dragon(v):
    """The directory track ends its first sector with the numbers of tracks and sectors, and their complements."""

    def sided(sides: int):
        at_ = 20 * 18 * sides * 256
        tracks, sectors = v.u(at_ + 0xFC, 1), v.u(at_ + 0xFD, 1)
        return (sectors == 18 * sides) & (tracks > 20) & (tracks + v.u(at_ + 0xFE, 1) == 255) & (sectors + v.u(at_ + 0xFF, 1) == 255) & (v.size == tracks * (18 * sides * 256))

    return sided(1) | sided(2)


def _dfs(v):
    files, total = v.u(261, 1), (v.u(262, 1) % 4) * 256 + v.u(263, 1)
    return v.among(v.size, 102_400, 204_800) & (files % 8 == 0) & (files <= 248) & (total * 256 == v.size)


def _os9(v):
    total, bitmap, cluster, root = v.u(0, 3), v.u(4, 2), v.u(6, 2), v.u(8, 3)

    def sized(sector: int):
        fd = root * sector
        first, count = v.u(fd + 16, 3), v.u(fd + 19, 2)
        bits = ((cluster == 0) & (bitmap * 8 >= total)) | ((cluster > 0) & (bitmap * 8 * cluster >= total))
        folder = (v.u(fd, 1) >= 128) & (v.u(fd + 9, 4) > 0) & (v.u(fd + 9, 4) % 32 == 0)
        return (total > 0) & (total * sector == v.size) & (bitmap > 0) & bits & (root > 0) & (root < total) & folder & (first > 0) & (count > 0) & (first + count <= total)

    return sized(256) | sized(512)


def _rsdos(v):
    """Only the granule table, and the first slot of the directory, are looked at."""

    def sized(tracks: int):
        granules, fat, slot = 2 * tracks - 2, (17 * 18 + 1) * 256, (17 * 18 + 2) * 256
        valid = v.every(fat, granules, lambda b: (b == 0xFF) | (b < granules) | ((b >= 0xC0) & (b <= 0xC9)))
        named = v.every(slot, 11, lambda b: (b >= 0x20) & (b < 0x7F)) & (v.u(slot + 13, 1) < granules)
        return (v.size == tracks * 18 * 256) & valid & (v.among(v.u(slot, 1), 0xFF, 0) | named)

    return sized(35) | sized(40)


def _adfs(v):
    """A disc record in the boot block, or at byte 4."""
    record = lambda at_: (v.u(at_, 1) >= 8) & (v.u(at_, 1) <= 11) & (v.u(at_ + 1, 1) >= 1) & (v.u(at_ + 2, 1) >= 1) & (v.u(at_ + 3, 1) >= 0) & (v.u(at_ + 3, 1) <= 3) & (v.u(at_ + 4, 1) >= v.u(at_, 1) + 3) & (v.u(at_ + 9, 1) >= 1) & v.has(at_ + 52, "0000000000000000")
    return record(0xDC0) | record(4)


def _microdrive(v):
    """Exactly 255 sectors of 686 bytes, zeros (one byte may differ), a mark and a printable name."""
    quiet = v.has(0, "00" * 10)
    for k in range(10):
        quiet = quiet | (v.has(0, "00" * k) & v.has(k + 1, "00" * (9 - k)) if 0 < k < 9 else v.has(1 if k == 0 else 0, "00" * 9))
    name = v.every(14, 10, lambda b: ((b >= 0x20) & (b <= 0x7E)) | (b == 0)) & v.some(14, 10, lambda b: (b >= 0x21) & (b <= 0x7E))
    return (v.size == 255 * 686) & quiet & v.some(10, 3, lambda b: b == 0xFF) & name


#: What tells the filesystem of a volume, in the order in which it is asked; the first that holds decides.
RULES = (
    ("iso9660", lambda v: v.has(16 * 2048 + 1, "4344303031")),
    ("ntfs", lambda v: v.has(3, "4E54465320202020")), ("exfat", lambda v: v.has(3, "4558464154202020")), ("fat", _fat), ("xfs", lambda v: v.has(0, "58465342")),
    ("hfsplus", lambda v: v.has(1024, "4244") & v.has(1148, "482B")), ("hfs", lambda v: v.has(1024, "4244")), ("hfsplus", lambda v: v.has(1024, "482B", "4858")),
    ("mfs", lambda v: v.has(1024, "D2D7")), ("ext", lambda v: v.has(1080, "53EF")),
    ("prodos", lambda v: (v.u(1028, 1) >= 0xF0) & (v.u(1024 + 35, 1) == 39) & (v.u(1024 + 36, 1) == 13)), ("efs", lambda v: v.has(540, "00072959", "0007295A")),
    ("affs", lambda v: v.has(0, "444F53") & (v.u(3, 1) >= 0) & (v.u(3, 1) <= 7)), ("btrfs", lambda v: v.has(65600, "5F42485266535F4D")),
    ("reiserfs", lambda v: v.has(65588, "5265497345723246", "5265497345724673", "5265497345723346")), ("ufs", lambda v: v.has(9564, "00011954", "54190100", "19540119", "19015419") | v.has(66908, "00011954", "54190100", "19540119", "19015419")),
    ("jfs", lambda v: v.has(32768, "4A465331")),
    ("applesdos33", lambda v: (v.size == 143_360) & v.has(0x11001, "110F") & (v.u(0x11003, 1) >= 1) & (v.u(0x11003, 1) <= 4) & (v.u(0x11027, 1) == 122) & v.has(0x11034, "23100001")),
    ("cbmdos", _cbm), ("ataridos", _atari), ("dragondos", _dragon), ("acorndfs", _dfs), ("os9", _os9), ("rsdos", _rsdos), ("qdos", lambda v: v.has(0, "514C5741")), ("adfs", _adfs),
    ("human68k", lambda v: (v.size == 1_261_568) & v.has(0, "603C", "601C") & v.has(1024, "FEFFFF")), ("andos", lambda v: v.has(0x1F8, "414E444F53") | v.has(0x1B0, "414E444F53") | v.has(0xE0, "414E444F53") | v.has(0, "414E444F53")), ("qdos_mdv", _microdrive),
)
#: Bytes that decide every rule but those of whole floppies, and of which the largest has these.
HEAD, LARGEST_FLOPPY = 70_000, 1_066_496


def filesystem(data: Column, size: Column | None = None) -> Column:
    """The filesystem of a volume by its first bytes and its size (that of the bytes where none is given); null where no rule fits."""
    view = ColumnView(data, F.octet_length(data).cast("long") if size is None else size)
    out = F.lit(None).cast("string")
    for name, rule in reversed(RULES):
        out = F.when(rule(view), name).otherwise(out)
    return out


def filesystem_of(data) -> str | None:
    """The same of bytes."""
    view = BytesView(data)
    return next((name for name, rule in RULES if rule(view)), None)


def _plausible_fat(data: Column) -> Column:
    return _fat(ColumnView(data, F.octet_length(data).cast("long")))


def container(data: Column, path: Column) -> Column:
    """The container of a file by its bytes; by the ending where it has none; else raw."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.when(ending.isin("d88", "dim"), ending).otherwise("raw")
    for name, offset, magic in reversed(CONTAINERS):
        out = F.when(at(data, offset, len(magic) // 2) == magic, name).otherwise(out)
    return out


def scheme(data: Column) -> Column:
    """The partition scheme of a disk's first 64 KiB."""
    signed = at(data, 510, 2) == "55AA"
    rdb = F.lit(False)
    for sector in range(16):
        rdb |= at(data, 512 * sector, 4) == "5244534B"
    rules = {
        "sgi": at(data, 0, 4) == "0BE5A941", "apm": at(data, 0, 2) == "4552", "rdb": rdb,
        "ahdi": ~signed & (number(data, 0x1C6, 1).bitwiseAND(F.lit(1)) == 1) & at(data, 0x1C7, 3).isin("47454D", "42474D", "52415F"),
        "x68k": at(data, 2048, 4) == "5836384B", "none": filesystem(data).isNotNull() & ~(signed & (number(data, 450, 1) != 0) & ~_plausible_fat(data)),
        "gpt": signed & (number(data, 450, 1) == 0xEE), "mbr": signed,
    }
    out = F.lit("unknown")
    for name in reversed(SCHEMES):
        out = F.when(rules[name], name).otherwise(out)
    return out
