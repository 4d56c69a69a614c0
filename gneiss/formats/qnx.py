"""QNX6, with the snapshot before the current one, and the QNX image filesystem."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from gneiss.formats import codecs, lzo
from gneiss.formats.readers import KINDS, Entry, reader

HOLE = 0xFFFFFFFF


def _table(width: int = 256) -> list[int]:
    out = []
    for k in range(width):
        x = k << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        out.append(x)
    return out


_CRC = _table()


def crc_be(raw: bytes) -> int:
    """CRC-32, most significant bit first, initial value 0."""
    crc = 0
    for b in raw:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def up(n: int, to: int) -> int:
    return -(-n // to) * to


class Snapshot:
    """A QNX6 superblock and the tree that it reaches."""

    def __init__(self, data: bytes, at: int, order: str):
        self.data, self.o = data, order
        magic, crc = struct.unpack_from(order + "II", data, at)
        self.sound = magic == 0x68191122 and crc_be(data[at + 8 : at + 512]) == crc
        (self.serial,) = struct.unpack_from(order + "Q", data, at + 8)
        self.block, self.inodes, self.free, self.blocks, _ = struct.unpack_from(order + "5I", data, at + 48)
        if magic != 0x68191122 or self.block & (self.block - 1) or not 512 <= self.block <= 65536 or not self.blocks:
            raise ValueError("no qnx6 superblock")
        self.start, self.bits = up(0x3000, self.block), (self.block // 4).bit_length() - 1
        root = lambda k: (*struct.unpack_from(order + "Q16I", data, at + 72 + 80 * k), data[at + 72 + 80 * k + 72])
        self.table, self.long = root(0), root(2)
        self.held: dict[int, bytes] = {}

    @property
    def second(self) -> int:
        return self.start + self.blocks * self.block

    def read(self, number: int) -> bytes:
        if number == HOLE or number >= self.blocks:
            return bytes(self.block)
        at = self.start + number * self.block
        return self.data[at : at + self.block].ljust(self.block, b"\0")

    def place(self, pointers: tuple[int, ...], levels: int, n: int) -> int:
        """The block that holds a file's block n."""
        shift = self.bits * levels
        index = n >> shift
        if index >= 16:
            return HOLE
        at = pointers[index]
        while shift and at != HOLE:
            shift -= self.bits
            (at,) = struct.unpack_from(self.o + "I", self.read(at), 4 * (n >> shift & (1 << self.bits) - 1))
        return at

    def content(self, size: int, pointers: tuple[int, ...], levels: int) -> bytes:
        if levels > 5 or size > max(len(self.data), 1 << 28):
            raise ValueError("a file beyond the image")
        return b"".join(self.read(self.place(pointers, levels, n)) for n in range(up(size, self.block) // self.block))[:size]

    def inode(self, number: int) -> tuple | None:
        """(size, uid, gid, mtime, mode, pointers, levels, status) of an inode, None beyond the table."""
        if not 0 < number <= self.inodes:
            return None
        size, *pointers, levels = self.table
        at = (number - 1) * 128
        if at + 128 > size:
            return None
        raw = self.read(self.place(tuple(pointers), levels, at // self.block))[at % self.block :][:128]
        length, uid, gid, _, mtime = struct.unpack_from(self.o + "QIIII", raw)
        (mode,) = struct.unpack_from(self.o + "H", raw, 32)
        return length, uid, gid, mtime, mode, struct.unpack_from(self.o + "16I", raw, 36), raw[100], raw[101]

    def name(self, raw: bytes) -> bytes | None:
        if raw[4] == 0xFF:
            (index,) = struct.unpack_from(self.o + "I", raw, 8)
            _, *pointers, levels = self.long
            record = self.read(self.place(tuple(pointers), levels, index))
            (n,) = struct.unpack_from(self.o + "H", record)
            return record[2 : 2 + n] if 0 < n <= 510 else None
        return raw[5 : 5 + raw[4]] if 1 <= raw[4] <= 27 else None

    def walk(self) -> Iterator[tuple[str, int, tuple]]:
        """(path, inode number, inode) of all entries, depth first, in the order of the directories."""

        def below(number: int, base: str, above: frozenset[int]) -> Iterator[tuple[str, int, tuple]]:
            x = self.inode(number)
            if x is None:
                return
            raw = self.content(x[0], x[5], x[6])
            for at in range(0, len(raw) - 31, 32):
                (child,) = struct.unpack_from(self.o + "I", raw, at)
                name = self.name(raw[at : at + 32]) if child else None
                own = self.inode(child) if name not in (None, b".", b"..") else None
                if own is None:
                    continue
                path = base + name.decode("utf-8", "surrogateescape")
                yield path, child, own
                if own[4] & 0o170000 == 0o040000 and child not in above:
                    yield from below(child, f"{path}/", above | {child})

        yield from below(1, "", frozenset({1}))

    def entry(self, path: str, number: int, x: tuple, **more) -> Entry:
        size, uid, gid, mtime, mode, pointers, levels, _ = x
        kind, body, target = KINDS.get(mode & 0o170000, "regular"), None, None
        if kind == "regular":
            body = self.content(size, pointers, levels)
        elif kind == "symlink":
            target = self.content(size, pointers, levels).decode("utf-8", "surrogateescape")
        return Entry(path, kind, body, mode & 0o7777, uid, gid, mtime, target, number, **more)


def snapshots(data: bytes, at: int = 0) -> list[Snapshot]:
    """The image's snapshots, the current one first: sound ones, then by serial."""
    order = "<" if data[at + 8192 : at + 8196] == b"\x22\x11\x19\x68" else ">"
    image, out = data[at:] if at else data, []
    first = Snapshot(image, 8192, order)
    out.append(first)
    try:
        out.append(Snapshot(image, first.second, order))
    except (ValueError, struct.error):
        pass
    return sorted(out, key=lambda s: (s.sound, s.serial), reverse=True)


@reader("qnx6")
def qnx6(data: bytes) -> Iterator[Entry]:
    """The current snapshot's tree; what the one before it holds besides, as deleted or superseded entries; freed inodes under lost+found."""
    now, *before = snapshots(data)
    live, numbers = {}, {1}
    for path, number, x in now.walk():
        live[path] = x
        numbers.add(number)
        yield now.entry(path, number, x)
    for old in before:
        if not old.sound or old.serial == now.serial:
            continue
        for path, number, x in old.walk():
            numbers.add(number)
            if path not in live:
                yield old.entry(path, number, x, deleted=True, version=1, extra={"serial": str(old.serial)})
            elif x[4] & 0o170000 == 0o100000 and x != live[path]:
                yield old.entry(path, number, x, superseded=True, version=1, extra={"serial": str(old.serial)})
    for number in range(1, min(now.inodes, 1 << 20) + 1):
        x = now.inode(number) if number not in numbers else None
        if x is not None and x[7] == 2 and x[4] & 0o170000 == 0o100000 and x[0]:
            yield now.entry(f"lost+found/#{number}", number, x, deleted=True)


# --- the image filesystem -------------------------------------------------------------------------

#: How the image after the startup code is packed.
PACKED = {0: None, 1: "zlib", 2: "lzo", 3: "ucl", 4: "lz4"}


def startup(data: bytes, at: int = 0) -> dict | None:
    """The startup header's fields, or None where its fixed fields don't hold."""
    order = "<" if data[at : at + 4] == b"\xeb\x7e\xff\0" else ">"
    signature, version = struct.unpack_from(order + "IH", data, at)
    (size,) = struct.unpack_from(order + "H", data, at + 8)
    zeros = struct.unpack_from(order + "HIII", data, at + 50)
    if signature != 0x00FF7EEB or version != 1 or size != 256 or any(zeros[:1]) or any(zeros[1:3]):
        return None
    head, stored, _, whole = struct.unpack_from(order + "IIII", data, at + 32)
    return {"order": order, "machine": struct.unpack_from(order + "H", data, at + 10)[0], "startup": head, "stored": stored, "imagefs": whole, "packed": PACKED.get(data[at + 6] >> 2 & 7, "unknown")}


def word_sum(raw: bytes, order: str) -> int:
    raw = raw[: len(raw) // 4 * 4]
    return sum(struct.unpack(f"{order}{len(raw) // 4}I", raw)) & 0xFFFFFFFF


def image_of(data: bytes, head: dict) -> bytes:
    """The image filesystem's bytes, unpacked."""
    raw = data[head["startup"] : head["stored"]]
    kind = head["packed"]
    if kind is None:
        return raw
    if kind == "zlib":
        return codecs.decompress("gzip", raw)
    unpack = {"lzo": lzo.lzo1x, "ucl": lzo.nrv2b, "lz4": codecs.lz4_block}.get(kind)
    if unpack is None:
        raise ValueError("an unknown packing")
    out, at = [], 0
    while at + 2 <= len(raw) and (n := int.from_bytes(raw[at : at + 2], "big")):
        out.append(unpack(raw[at + 2 : at + 2 + n], 1 << 16))
        at += 2 + n
    return b"".join(out)


@reader("qnx-ifs")
def qnx_ifs(data: bytes) -> Iterator[Entry]:
    """The files of a boot image, in the order in which it lists them."""
    head = startup(data)
    if head is None:
        raise ValueError("no startup header")
    image = image_of(data, head)
    if image[:7] != b"imagefs":
        raise ValueError("no image filesystem")
    o = ">" if image[7] & 1 else "<"
    size, end, at = struct.unpack_from(o + "III", image, 8)
    mount = image[88:at].split(b"\0")[0].decode("utf-8", "surrogateescape").strip("/")
    base = f"{mount}/" if mount else ""
    text = lambda a: image[a : image.index(b"\0", a)].decode("utf-8", "surrogateescape")
    while at + 24 <= end:
        n, _, ino, mode, gid, uid, mtime = struct.unpack_from(o + "HHIIIII", image, at)
        if not n:
            break
        number, kind = ino & 0x1FFFFFFF, {0o050000: "named"}.get(mode & 0o170000, KINDS.get(mode & 0o170000, "regular"))
        if number:
            path, body, target = None, None, None
            if kind == "regular":
                where, length = struct.unpack_from(o + "II", image, at + 24)
                path, body = text(at + 32), image[where : where + length]
            elif kind == "symlink":
                skip, _ = struct.unpack_from(o + "HH", image, at + 24)
                path, target = text(at + 28), text(at + 28 + skip)
            else:
                path = text(at + 24 if kind == "directory" else at + 32)
            if path:
                yield Entry(base + path, kind, body, mode & 0o7777, uid, gid, mtime, target, number)
        at += n
    if word_sum(image[:size], o):
        yield Entry("", "diagnostic", diagnostics=["qnx-ifs-image-checksum"])
