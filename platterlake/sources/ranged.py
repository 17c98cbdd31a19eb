"""Byte sources that are read a range at a time. All of them slice like bytes, so drivers need not know which they have."""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

#: Schemes that pyarrow's filesystems read, and the names by which they know them.
KNOWN = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs"}


class Source:
    """What slices like bytes; a subclass reads."""

    def __len__(self) -> int:
        raise NotImplementedError

    def read(self, start: int, size: int) -> bytes:
        raise NotImplementedError

    def __getitem__(self, key):
        if isinstance(key, slice):
            start, stop, step = key.indices(len(self))
            if step != 1:
                raise ValueError("only plain ranges are read")
            return self.read(start, stop - start) if stop > start else b""
        place = key + len(self) if key < 0 else key
        if not 0 <= place < len(self):
            raise IndexError(key)
        return self.read(place, 1)[0]


class File(Source):
    """A file by its size and a function that reads a range of it; blocks that were read last are kept."""

    BLOCK, KEPT = 1 << 16, 128

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]):
        self.size, self.fetch, self.kept = size, fetch, OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _block(self, n: int) -> bytes:
        if n in self.kept:
            self.kept.move_to_end(n)
        else:
            self.kept[n] = self.fetch(n * self.BLOCK, min(self.BLOCK, self.size - n * self.BLOCK))
            if len(self.kept) > self.KEPT:
                self.kept.popitem(last=False)
        return self.kept[n]

    def read(self, start: int, size: int) -> bytes:
        if size > self.BLOCK * self.KEPT // 4:
            return self.fetch(start, size)
        first, last = start // self.BLOCK, (start + size - 1) // self.BLOCK
        whole = b"".join(map(self._block, range(first, last + 1)))
        return whole[start - first * self.BLOCK : start - first * self.BLOCK + size]


class View(Source):
    """A range of another source, or of bytes."""

    def __init__(self, data, start: int, size: int):
        self.data, self.start, self.size = data, start, max(0, min(size, len(data) - start))

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, size: int) -> bytes:
        return bytes(self.data[self.start + start : self.start + start + size])


class Mapped(Source):
    """A disk of equal units, of which each is found by `unit_of` only when it is read; a unit that is not stored is zeros."""

    def __init__(self, size: int, unit: int, unit_of: Callable[[int], bytes | tuple[object, int] | None]):
        self.size, self.unit, self.unit_of, self.last = size, unit, unit_of, (None, b"")

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, size: int) -> bytes:
        out, stop = [], start + size
        while start < stop:
            n, skip = divmod(start, self.unit)
            take = min(self.unit - skip, stop - start)
            found = self.last[1] if self.last[0] == n else self.unit_of(n)
            if isinstance(found, bytes):  # one that had to be unpacked
                self.last = (n, found)
                piece = found[skip : skip + take]
            else:
                piece = b"" if found is None else bytes(found[0][found[1] + skip : found[1] + skip + take])
            out.append(piece.ljust(take, b"\0"))
            start += take
        return b"".join(out)


class Chain(Source):
    """A disk of sources one behind the other: (start, size, source or None for zeros)."""

    def __init__(self, size: int, parts: list[tuple[int, int, Source | None]]):
        self.size, self.parts, self.starts = size, parts, [p[0] for p in parts]

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, size: int) -> bytes:
        out, stop = [], start + size
        while start < stop:
            first, length, source = self.parts[bisect_right(self.starts, start) - 1]
            take = min(first + length, stop) - start
            out.append(bytes(take) if source is None else source[start - first : start - first + take].ljust(take, b"\0"))
            start += take
        return b"".join(out)


class Pieces(Source):
    """A disk of pieces of any size: (start, size, function that gives the piece's bytes or None for zeros), in order."""

    def __init__(self, size: int, pieces: list[tuple[int, int, Callable[[], bytes] | None]]):
        self.size, self.pieces, self.starts, self.last = size, pieces, [p[0] for p in pieces], (None, b"")

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, size: int) -> bytes:
        out, stop = [], start + size
        while start < stop:
            k = bisect_right(self.starts, start) - 1
            first, length, get = self.pieces[k] if k >= 0 else (0, 0, None)
            if start >= first + length:  # a gap
                following = self.starts[k + 1] if k + 1 < len(self.starts) else self.size
                out.append(bytes(min(following, stop) - start))
                start = min(following, stop)
                continue
            if self.last[0] != k:
                self.last = (k, get() if get else bytes(length))
            out.append(self.last[1][start - first : min(length, stop - first)])
            start = min(first + length, stop)
        return b"".join(out)


def reachable(path: str) -> bool:
    """Whether ranges of a path can be read without Spark."""
    return urlsplit(path).scheme in ("", "file", *KNOWN)


def open_file(path: str) -> File:
    """A file of a local or shared folder, or of an object store or HDFS by pyarrow."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        handle = open(unquote(parts.path) if parts.scheme else path, "rb")
        size = handle.seek(0, 2)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path.replace(f"{parts.scheme}:", f"{KNOWN[parts.scheme]}:", 1))
        handle = store.open_input_file(inner)
        size = handle.size()

    def fetch(start: int, count: int) -> bytes:
        handle.seek(start)
        return handle.read(count)

    return File(size, fetch)
