"""SquashFS 4: a read-only tree of compressed blocks, tables of 8 KiB metadata blocks, tails shared in fragments."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

from gneiss.formats import codecs, lzo
from gneiss.formats.readers import Entry, reader

CODECS = ("gzip", "lzma", "lzo", "xz", "lz4", "zstd")
META = 8192

_KINDS = {1: "directory", 2: "regular", 3: "symlink", 4: "block", 5: "char", 6: "fifo", 7: "socket"}


def unpacked(codec: str, raw: bytes, most: int) -> bytes:
    """A block as the filesystem holds it."""
    if codec == "gzip":
        return codecs.decompress("zlib", raw, most)
    if codec == "xz":
        return codecs._run(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ).decompress(raw, most))
    if codec == "lzma":
        return codecs._run(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(raw, most))
    if codec == "lz4":
        return codecs.lz4_block(raw, most)
    if codec == "lzo":
        return lzo.lzo1x(raw, most)
    return codecs.decompress("zstd", raw, most)


class Image:
    """The superblock and tables of an image, read as they are needed."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = next((o for o in (("<", ">") if data[:4] in (b"hsqs", b"shsq") else (">", "<")) if struct.unpack_from(o + "H", data, 28)[0] == 4), None)
        if data[:4] not in (b"hsqs", b"sqsh", b"shsq", b"qshs") or self.order is None:
            raise ValueError("no squashfs 4")
        self.inodes, _, self.block, self.fragments, codec, log, self.flags, self.ids, _, _ = struct.unpack_from(self.order + "IIIIHHHHHH", data, 4)
        self.root, self.used, self.id_at, _, self.inode_at, self.dir_at, self.fragment_at, _ = struct.unpack_from(self.order + "8Q", data, 32)
        if not 12 <= log <= 20 or self.block != 1 << log or not 1 <= codec <= 6:
            raise ValueError("a block size or codec that does not exist")
        self.codec = CODECS[codec - 1]
        self.held: dict[int, tuple[bytes, int]] = {}
        self.owners = self.table(self.id_at, self.ids, "I")
        self.fragment = self.table(self.fragment_at, self.fragments, "QII") if self.fragments else []
        self.tails: dict[int, bytes] = {}

    def meta(self, at: int) -> tuple[bytes, int]:
        """A metadata block and where the next one begins."""
        if at not in self.held:
            (head,) = struct.unpack_from(self.order + "H", self.data, at)
            raw = self.data[at + 2 : at + 2 + (head & 0x7FFF)]
            if len(raw) < head & 0x7FFF or len(self.held) > 4096:
                self.held.clear()
            self.held[at] = (raw if head & 0x8000 else unpacked(self.codec, raw, META), at + 2 + (head & 0x7FFF))
        return self.held[at]

    def stream(self, at: int, offset: int) -> Iterator[bytes]:
        """What a table holds from a place in one of its blocks on."""
        while at < len(self.data) - 1:
            block, at = self.meta(at)
            yield block[offset:]
            offset = 0

    def read(self, start: int, reference: int, size: int) -> bytes:
        """``size`` bytes at a reference into the table at ``start``."""
        out = b""
        for part in self.stream(start + (reference >> 16), reference & 0xFFFF):
            out += part
            if len(out) >= size:
                return out[:size]
        raise ValueError("a table is cut")

    def table(self, at: int, n: int, form: str) -> list:
        """The n records of a table that a list of block places leads to."""
        width = struct.calcsize(self.order + form)
        per, out = META // width, []
        for k, where in enumerate(struct.unpack_from(f"{self.order}{-(-n // per)}Q", self.data, at)):
            block = self.meta(where)[0]
            out += [struct.unpack_from(self.order + form, block, i * width) for i in range(min(per, n - k * per))]
        return [x[0] for x in out] if len(form) == 1 else out

    def inode(self, reference: int) -> dict:
        o = self.order
        kind, mode, uid, gid, mtime, number = struct.unpack(o + "HHHHII", self.read(self.inode_at, reference, 16))
        x = {"kind": _KINDS[kind - 7 if kind > 7 else kind], "mode": mode & 0o7777, "uid": self.owners[uid], "gid": self.owners[gid], "mtime": mtime, "number": number, "links": 1}
        get = lambda form, at=16: struct.unpack(o + form, self.read(self.inode_at, reference, at + struct.calcsize(o + form))[at:])
        if kind == 1:
            x["block"], x["links"], x["size"], x["offset"], _ = get("IIHHI")
        elif kind == 8:
            x["links"], x["size"], x["block"], _, _, x["offset"], _ = get("IIIIHHI")
        elif kind in (2, 9):
            if kind == 2:
                (start, fragment, offset, size), at = get("IIII"), 32
            else:
                (start, size, _, x["links"], fragment, offset, _), at = get("QQQIIII"), 56
            if size > max(len(self.data), 1 << 20) * codecs.MAX_RATIO:
                raise ValueError("a file beyond all ratios")
            n = size // self.block if fragment != 0xFFFFFFFF else -(-size // self.block)
            x |= {"start": start, "fragment": fragment, "offset": offset, "size": size, "blocks": get(f"{n}I", at) if n else ()}
        elif kind in (3, 10):
            x["links"], n = get("II")
            x["target"] = self.read(self.inode_at, reference, 24 + n)[24:]
        return x

    def content(self, x: dict) -> tuple[bytes, list[str]]:
        """A file's bytes; a block that can't be read counts as zeros and is told."""
        out, at, notes = bytearray(), x["start"], []
        for k, word in enumerate(x["blocks"]):
            want = min(self.block, x["size"] - k * self.block)
            size = word & 0xFFFFFF
            raw, at = self.data[at : at + size], at + size
            try:
                part = bytes(want) if not size else raw if word >> 24 & 1 else unpacked(self.codec, raw, self.block)
            except codecs.CodecError as e:
                part, notes = b"", [f"squashfs-block: {e}"]
            out += part[:want].ljust(want, b"\0")
        if x["fragment"] != 0xFFFFFFFF:
            if x["fragment"] not in self.tails:
                start, word, _ = self.fragment[x["fragment"]]
                raw = self.data[start : start + (word & 0xFFFFFF)]
                if len(self.tails) > 16:
                    self.tails.clear()
                self.tails[x["fragment"]] = raw if word >> 24 & 1 else unpacked(self.codec, raw, self.block)
            want = x["size"] % self.block
            out += self.tails[x["fragment"]][x["offset"] : x["offset"] + want].ljust(want, b"\0")
        return bytes(out), notes

    def children(self, x: dict) -> Iterator[tuple[str, int]]:
        """(name, inode reference) of a directory's entries, in order."""
        if x["size"] <= 3:
            return
        raw, at = self.read(self.dir_at, x["block"] << 16 | x["offset"], x["size"] - 3), 0
        while at + 12 <= len(raw):
            count, start, _ = struct.unpack_from(self.order + "III", raw, at)
            at += 12
            for _ in range(min(count, 255) + 1):
                offset, _, _, size = struct.unpack_from(self.order + "HhHH", raw, at)
                yield raw[at + 8 : at + 9 + size].decode("utf-8", "surrogateescape"), start << 16 | offset
                at += 9 + size


@reader("squashfs")
def squashfs(data: bytes) -> Iterator[Entry]:
    """The tree in order of names; the root itself is no entry."""
    image = Image(data)

    def walk(x: dict, base: str, above: frozenset[int]) -> Iterator[Entry]:
        for name, reference in image.children(x):
            path = base + name
            try:
                child = image.inode(reference)
                body, notes = image.content(child) if child["kind"] == "regular" else (None, [])
            except (codecs.CodecError, ValueError, struct.error, IndexError, KeyError, zlib.error) as e:
                yield Entry(path, "diagnostic", diagnostics=[f"squashfs-inode: {e}"])
                continue
            target = child["target"].decode("utf-8", "surrogateescape") if "target" in child else None
            yield Entry(path, child["kind"], body, child["mode"], child["uid"], child["gid"], child["mtime"], target, child["number"], diagnostics=notes)
            if child["kind"] == "directory" and child["number"] not in above:
                yield from walk(child, f"{path}/", above | {child["number"]})

    root = image.inode(image.root)
    yield from walk(root, "", frozenset({root["number"]}))
