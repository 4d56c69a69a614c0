"""7z archives: headers of properties, folders of coders, and substreams that files are cut from."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from gneiss.formats import codecs
from gneiss.formats.readers import KINDS, Entry, reader

MAGIC = b"7z\xbc\xaf'\x1c"

#: Property numbers of the header.
END, HEADER, STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, CODER_SIZE, COUNT, EMPTY, EMPTY_FILE, NAMES, MTIME, ATTRIBUTES, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 21, 23

#: Methods by their numbers.
METHODS = {b"\0": "copy", b"\x03\x01\x01": "lzma", b"\x21": "lzma2", b"\x03": "delta", b"\x04\x01\x08": "deflate", b"\x04\x02\x02": "bzip2", b"\x03\x03\x01\x03": "x86", b"\x04": "x86", b"\x03\x03\x05\x01": "arm", b"\x07": "arm", b"\x03\x03\x07\x01": "armt", b"\x08": "armt", b"\x03\x03\x02\x05": "ppc", b"\x05": "ppc", b"\x04\xf7\x11\x01": "zstd"}
_BRANCH = {"x86": lzma.FILTER_X86, "arm": lzma.FILTER_ARM, "armt": lzma.FILTER_ARMTHUMB, "ppc": lzma.FILTER_POWERPC}


class Bytes:
    """A header, read from front to back."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the header is cut")
        self.at += n
        return self.raw[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """A number whose first byte's leading ones say how many bytes follow."""
        first = self.byte()
        n = next((k for k in range(8) if not first & 0x80 >> k), 8)
        low = int.from_bytes(self.take(n), "little")
        return low | ((first & (0x7F >> n)) << 8 * n if n < 8 else 0)

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if d else None for d in self.defined(n)]


@dataclass
class Folder:
    coders: list[tuple[str, int, int, bytes]] = field(default_factory=list)
    binds: list[tuple[int, int]] = field(default_factory=list)
    packed: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None

    def size(self) -> int:
        """What the folder's last coder gives out."""
        inner = {o for _, o in self.binds}
        return next(s for k, s in enumerate(self.sizes) if k not in inner)


@dataclass
class Streams:
    start: int = 0
    packed: list[int] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)
    parts: list[list[int]] = field(default_factory=list)
    crcs: list[list[int | None]] = field(default_factory=list)


def _folder(b: Bytes) -> Folder:
    out, ins, outs = Folder(), 0, 0
    for _ in range(b.number()):
        flags = b.byte()
        method = b.take(flags & 15)
        n_in, n_out = (b.number(), b.number()) if flags & 0x10 else (1, 1)
        properties = b.take(b.number()) if flags & 0x20 else b""
        out.coders.append((METHODS.get(method, method.hex()), n_in, n_out, properties))
        ins, outs = ins + n_in, outs + n_out
    out.binds = [(b.number(), b.number()) for _ in range(outs - 1)]
    n = ins - len(out.binds)
    bound = {i for i, _ in out.binds}
    out.packed = [next(k for k in range(ins) if k not in bound)] if n == 1 else [b.number() for _ in range(n)]
    return out


def _streams(b: Bytes) -> Streams:
    s, kind = Streams(), b.number()
    if kind == PACK:
        s.start, n = b.number(), b.number()
        while (kind := b.number()) != END:
            if kind == SIZE:
                s.packed = [b.number() for _ in range(n)]
            elif kind == CRC:
                b.digests(n)
        kind = b.number()
    if kind == UNPACK:
        if b.number() != FOLDER:
            raise ValueError("no folders")
        n = b.number()
        if b.byte():
            raise ValueError("folders elsewhere")
        s.folders = [_folder(b) for _ in range(n)]
        if b.number() != CODER_SIZE:
            raise ValueError("no sizes")
        for f in s.folders:
            f.sizes = [b.number() for _ in range(sum(c[2] for c in f.coders))]
        while (kind := b.number()) != END:
            if kind == CRC:
                for f, crc in zip(s.folders, b.digests(n), strict=True):
                    f.crc = crc
        kind = b.number()
    counts = [1] * len(s.folders)
    s.parts, s.crcs = [[f.size()] for f in s.folders], [[f.crc] for f in s.folders]
    if kind == SUBSTREAMS:
        kind = b.number()
        if kind == COUNT:
            counts, kind = [b.number() for _ in s.folders], b.number()
        s.parts = []
        for f, n in zip(s.folders, counts, strict=True):
            own = [b.number() for _ in range(n - 1)] if kind == SIZE else []
            s.parts.append([*own, f.size() - sum(own)] if n else [])
        if kind == SIZE:
            kind = b.number()
        s.crcs = [[f.crc] if n == 1 and f.crc is not None else [None] * n for f, n in zip(s.folders, counts, strict=True)]
        if kind == CRC:
            unknown = [(i, k) for i, own in enumerate(s.crcs) for k, c in enumerate(own) if c is None]
            for (i, k), crc in zip(unknown, b.digests(len(unknown)), strict=True):
                s.crcs[i][k] = crc
            kind = b.number()
        if kind != END or b.number() != END:
            raise ValueError("the streams don't end")
    return s


def _decode(coder: str, properties: bytes, raw: bytes, size: int) -> bytes:
    if coder == "copy":
        return raw[:size]
    if coder == "lzma":
        code, dictionary = properties[0], struct.unpack_from("<I", properties, 1)[0]
        return codecs.raw_lzma(raw, [{"id": lzma.FILTER_LZMA1, "lc": code % 9, "lp": code // 9 % 5, "pb": code // 45, "dict_size": max(dictionary, 4096)}], size)
    if coder == "lzma2":
        bits = properties[0]
        dictionary = 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << bits // 2 + 11
        return codecs.raw_lzma(raw, [{"id": lzma.FILTER_LZMA2, "dict_size": min(dictionary, (3 << 30) // 2)}], size)
    if coder == "deflate":
        return zlib.decompress(raw, -15)
    if coder == "bzip2":
        return bz2.decompress(raw)
    if coder == "zstd":
        return codecs.decompress("zstd", raw, size)
    if coder == "delta" or coder in _BRANCH:
        # liblzma knows these only before a compressor: the bytes go through an LZMA2 stream of their own
        own = {"id": lzma.FILTER_DELTA, "dist": properties[0] + 1} if coder == "delta" else {"id": _BRANCH[coder]}
        stored = lzma.compress(raw, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
        return codecs.raw_lzma(stored, [own, {"id": lzma.FILTER_LZMA2, "preset": 0}], size)
    raise ValueError(f"unknown coder {coder}")


def _unpacked(f: Folder, data: bytes, packed: list[tuple[int, int]]) -> bytes:
    """A folder's output: its coders from the packed stream on, each fed by the one that it is bound to."""
    if any(c[1] != 1 or c[2] != 1 for c in f.coders):
        raise ValueError("coders of several streams")
    (at, size), k = packed[0], f.packed[0]
    raw, feeds = data[at : at + size], {o: i for i, o in f.binds}
    while True:
        coder, _, _, properties = f.coders[k]
        raw = _decode(coder, properties, raw, f.sizes[k])
        if k not in feeds:
            return raw
        k = feeds[k]


def _places(s: Streams) -> Iterator[tuple[Folder, list[tuple[int, int]]]]:
    at, k = 32 + s.start, 0
    for f in s.folders:
        own = []
        for _ in f.packed:
            own.append((at, s.packed[k]))
            at, k = at + s.packed[k], k + 1
        yield f, own


def header(data: bytes) -> Bytes | None:
    """The archive's header, unpacked, from HEADER's number on; None for an archive without files."""
    if data[:6] != MAGIC or zlib.crc32(data[12:32]) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("no 7z start header")
    offset, size, crc = struct.unpack_from("<QQI", data, 12)
    raw = data[32 + offset : 32 + offset + size]
    if not size:
        return None
    if zlib.crc32(raw) != crc:
        raise ValueError("the header is damaged")
    b = Bytes(raw)
    kind = b.number()
    for _ in range(4):
        if kind != ENCODED:
            break
        s = _streams(b)
        (f, own), *_ = _places(s)
        b = Bytes(_unpacked(f, data, own))
        kind = b.number()
    if kind != HEADER:
        raise ValueError("no header")
    return b


def _files(b: Bytes) -> list[dict]:
    n = b.number()
    files: list[dict] = [{} for _ in range(n)]
    while (kind := b.number()) != END:
        own = Bytes(b.take(b.number()))
        if kind == EMPTY:
            for f, e in zip(files, own.bits(n), strict=True):
                f["empty"] = e
        elif kind == EMPTY_FILE:
            bare = [f for f in files if f.get("empty")]
            for f, e in zip(bare, own.bits(len(bare)), strict=True):
                f["file"] = e
        elif kind == NAMES and not own.byte():
            names = own.raw[own.at :].decode("utf-16-le", "surrogatepass").split("\0")
            for f, name in zip(files, names, strict=False):
                f["name"] = name
        elif kind in (MTIME, ATTRIBUTES):
            known = own.defined(n)
            if not own.byte():
                for f, d in zip(files, known, strict=True):
                    if d:
                        f[kind] = struct.unpack("<Q", own.take(8))[0] if kind == MTIME else struct.unpack("<I", own.take(4))[0]
    return files


@reader("7z")
def sevenzip(data: bytes) -> Iterator[Entry]:
    """The archive's entries in order; a folder that can't be unpacked leaves its files without bytes."""
    b = header(data)
    if b is None:
        return
    s, files, kind = Streams(), [], b.number()
    while kind != END:
        if kind == STREAMS:
            s = _streams(b)
        elif kind == FILES:
            files = _files(b)
        else:
            b.take(b.number())
        kind = b.number()

    def bodies() -> Iterator[tuple[bytes | None, list[str]]]:
        for (f, own), parts, crcs in zip(_places(s), s.parts, s.crcs, strict=True):
            try:
                raw, why = _unpacked(f, data, own), None
            except (ValueError, lzma.LZMAError, zlib.error, OSError, EOFError) as e:
                raw, why = None, str(e)
            at = 0
            for size, crc in zip(parts, crcs, strict=True):
                body = None if raw is None else raw[at : at + size]
                at += size
                bad = body is not None and (len(body) != size or crc is not None and zlib.crc32(body) != crc)
                yield body, [f"7z-folder: {why}"] if body is None else ["7z-crc-mismatch"] if bad else []

    streams = bodies()
    for f in files:
        attributes = f.get(ATTRIBUTES, 0)
        mode = attributes >> 16 if attributes & 0x8000 else 0
        folder = f.get("empty") and not f.get("file") or attributes & 0x10
        body, notes = (None if folder else b"", []) if f.get("empty") else next(streams, (None, ["7z-no-stream"]))
        kind = "directory" if folder else KINDS.get(mode & 0o170000, "regular")
        mtime = (f[MTIME] - 116444736000000000) // 10_000_000 if MTIME in f else None
        target = body.decode("utf-8", "surrogateescape") if kind == "symlink" and body else None
        yield Entry(f.get("name", ""), kind, None if kind == "symlink" else body, mode & 0o7777 if mode else None, mtime=mtime, link_target=target, diagnostics=notes)
