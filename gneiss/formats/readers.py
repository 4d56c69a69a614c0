"""Container and filesystem readers: one blob becomes rows of entries, with their bytes.

Each reader is a function (bytes) -> iterator of Entry, registered by format. A reader that meets
damage yields what it has and a diagnostic entry; it never takes the task down.
"""

from __future__ import annotations

import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from gneiss.formats import codecs, structures


@dataclass
class Entry:
    path: str
    kind: str = "regular"
    content: bytes | None = None
    mode: int | None = None
    uid: int | None = None
    gid: int | None = None
    mtime: int | None = None
    link_target: str | None = None
    inode: int | None = None
    deleted: bool = False
    superseded: bool = False
    version: int | None = None
    extra: dict[str, str] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)


#: The LZMA parameters of JFFS2.
JFFS2_LZMA = [{"id": lzma.FILTER_LZMA1, "lc": 0, "lp": 0, "pb": 0, "dict_size": 0x2000}]

Reader = Callable[[bytes], Iterator[Entry]]
REGISTRY: dict[str, Reader] = {}

#: The file types of a mode's upper bits.
KINDS = {0o010000: "fifo", 0o020000: "char", 0o040000: "directory", 0o060000: "block", 0o100000: "regular", 0o120000: "symlink", 0o140000: "socket"}


def reader(*names: str):
    def add(f: Reader) -> Reader:
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return add


def read(kind: str, data: bytes) -> Iterator[Entry]:
    """A blob's entries; what breaks the reader ends the listing with a diagnostic."""
    f = REGISTRY.get(kind)
    if f is None:
        yield Entry("", "diagnostic", diagnostics=[f"analyze-no-reader: {kind}"])
        return
    try:
        yield from f(data)
    except Exception as e:
        yield Entry("", "diagnostic", diagnostics=[f"{kind}-damaged: {type(e).__name__}: {e}"])


@reader("tar")
def tar(data: bytes) -> Iterator[Entry]:
    kinds = {tarfile.DIRTYPE: "directory", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block", tarfile.FIFOTYPE: "fifo"}
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        for m in t:
            body = t.extractfile(m).read() if m.isreg() else None
            yield Entry(m.name, kinds.get(m.type, "regular"), body, m.mode, m.uid, m.gid, int(m.mtime), m.linkname or None)


@reader("zip")
def zip_(data: bytes) -> Iterator[Entry]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            mode = m.external_attr >> 16
            kind = "directory" if m.is_dir() else KINDS.get(mode & 0o170000, "regular")
            try:
                body, notes = (None if m.is_dir() else z.read(m)), []
            except Exception as e:
                body, notes = None, [f"zip-member: {e}"]
            yield Entry(m.filename.rstrip("/"), kind, None if kind == "symlink" else body, mode & 0o7777 if mode else None, link_target=body.decode() if kind == "symlink" and body else None, diagnostics=notes)


def cpio_members(data: bytes, at: int = 0, most: int = 200000) -> tuple[list[Entry], int]:
    """The members up to and with the trailer, and where they end."""
    out: list[Entry] = []
    while len(out) < most:
        magic = data[at : at + 6]
        if magic in (b"070701", b"070702"):
            f = [int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
            ino, mode, uid, gid, mtime, size, named = f[0], f[1], f[2], f[3], f[5], f[6], f[11]
            name_at = at + 110
            body_at = at + -(-(110 + named) // 4) * 4
            end = body_at + -(-size // 4) * 4
        elif magic == b"070707":
            octal = lambda a, n, at=at: int(data[at + a : at + a + n], 8)
            ino, mode, uid, gid, mtime, named, size = octal(12, 6), octal(18, 6), octal(24, 6), octal(30, 6), octal(48, 11), octal(59, 6), octal(65, 11)
            name_at, body_at = at + 76, at + 76 + named
            end = body_at + size
        else:
            break
        if end > len(data) + 3 or not named:
            break
        name = data[name_at : name_at + named - 1].decode("utf-8", "surrogateescape")
        kind, body = KINDS.get(mode & 0o170000, "regular"), data[body_at : body_at + size]
        out.append(Entry(name, kind, body if kind == "regular" else None, mode & 0o7777, uid, gid, mtime, body.decode("latin-1") if kind == "symlink" else None, ino))
        at = end
        if name == "TRAILER!!!":
            break
    return out, at


@reader("cpio")
def cpio(data: bytes) -> Iterator[Entry]:
    for e in cpio_members(data)[0]:
        if e.path != "TRAILER!!!":
            yield e


@reader("ar")
def ar(data: bytes) -> Iterator[Entry]:
    at, long_names = 8, b""
    while at + 60 <= len(data) and data[at + 58 : at + 60] == b"`\n":
        name, size = data[at : at + 16].rstrip(), int(data[at + 48 : at + 58])
        body = data[at + 60 : at + 60 + size]
        if name == b"//":
            long_names = body
        elif name not in (b"/", b"/SYM64/", b"__.SYMDEF"):
            if name.startswith(b"#1/"):  # the name stands before the content
                n = int(name[3:])
                name, body = body[:n].rstrip(b"\0"), body[n:]
            elif name.startswith(b"/") and name[1:].isdigit():
                name = long_names[int(name[1:]) :].split(b"\n")[0].rstrip(b"/")
            else:
                name = name.removesuffix(b"/")
            number = lambda a, n, base=10, at=at: int(data[at + a : at + a + n].strip() or b"0", base)
            yield Entry(name.decode("utf-8", "surrogateescape"), "regular", body, number(40, 8, 8) & 0o7777, number(28, 6), number(34, 6), number(16, 12))
        at += 60 + size + size % 2




def _stream(kind: str) -> Reader:
    def run(data: bytes) -> Iterator[Entry]:
        body, used = codecs.stream(kind, data)
        yield Entry("payload", "regular", body, extra={"consumed": str(used)})

    return run


REGISTRY.update({k: _stream(k) for k in ("gzip", "xz", "lzma", "bzip2", "lz4", "zstd")})


@reader("uimage")
def uimage(data: bytes) -> Iterator[Entry]:
    (size,), kind, codec = struct.unpack_from(">I", data, 12), data[30], data[31]
    body = data[64 : 64 + size]
    packed = {1: "gzip", 2: "bzip2", 3: "lzma", 5: "lz4", 6: "zstd"}.get(codec)
    if kind == 4:  # several images: their sizes, then the images
        sizes, at = [], 0
        while at + 4 <= len(body) and (n := struct.unpack_from(">I", body, at)[0]):
            sizes.append(n)
            at += 4
        at += 4
        for k, n in enumerate(sizes):
            yield Entry(f"image{k}", "regular", body[at : at + n])
            at += -(-n // 4) * 4
    else:
        yield Entry("payload", "regular", codecs.decompress(packed, body) if packed else body)


@reader("fit", "dtb")
def fit(data: bytes) -> Iterator[Entry]:
    for n in structures.fdt(data):
        parts = n.path.split("/")
        if len(parts) == 3 and parts[1] == "images" and "data" in n.properties:
            text = lambda k, n=n: n.properties.get(k, b"").rstrip(b"\0").decode("latin-1")
            yield Entry(parts[2], "regular", n.properties["data"], extra={k: text(k) for k in ("type", "compression", "arch", "description") if text(k)})


@reader("android-boot", "android-vendor-boot")
def android_boot(data: bytes) -> Iterator[Entry]:
    if data[:8] == b"VNDRBOOT":
        version, page, _, _, ramdisk = struct.unpack_from("<IIIII", data, 8)
        head, dtb = struct.unpack_from("<II", data, 2096)
        parts = [("", head), ("vendor_ramdisk", ramdisk), ("dtb", dtb)]
    else:
        kernel, _, ramdisk, _, second, _, _, page, version = struct.unpack_from("<IIIIIIIII", data, 8)
        if 3 <= version <= 4:
            kernel, ramdisk = struct.unpack_from("<II", data, 8)
            page, parts = 4096, [("", 1580), ("kernel", kernel), ("ramdisk", ramdisk)]
        else:
            dtbo, _ = struct.unpack_from("<IQ", data, 1632)
            dtb = struct.unpack_from("<I", data, 1648)[0] if version == 2 else 0
            parts = [("", 1), ("kernel", kernel), ("ramdisk", ramdisk), ("second", second), ("recovery_dtbo", dtbo if version in (1, 2) else 0), ("dtb", dtb)]
    at = 0
    for name, size in parts:
        if name and size:
            yield Entry(name, "regular", data[at : at + size])
        at += -(-size // page) * page


@reader("android-sparse")
def android_sparse(data: bytes) -> Iterator[Entry]:
    _, _, head, chunk_head, block, blocks, chunks = struct.unpack_from("<HHHHIII", data, 4)
    if blocks * block > max(1 << 30, len(data) * codecs.MAX_RATIO):
        raise codecs.CodecError("the image grows beyond its limit")
    out, at = [], head
    for _ in range(chunks):
        kind, _, n, total = struct.unpack_from("<HHII", data, at)
        body = data[at + chunk_head : at + total]
        out.append({0xCAC1: lambda: body[: n * block], 0xCAC2: lambda: body[:4] * (n * block // 4), 0xCAC3: lambda: b"\0" * (n * block)}.get(kind, lambda: b"")())
        at += total
    yield Entry("image", "regular", b"".join(out))


@reader("ubi")
def ubi(data: bytes) -> Iterator[Entry]:
    """Volumes: of each logical block the copy with the highest sequence number; older copies as superseded entries."""
    step = next(1 << n for n in range(12, 23) if data[1 << n : (1 << n) + 4] == b"UBI#")
    blocks: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
    for at in range(0, len(data) - step + 1, step):
        if data[at : at + 4] != b"UBI#":
            continue
        vid, start = struct.unpack_from(">II", data, at + 16)
        if data[at + vid : at + vid + 4] != b"UBI!":
            continue
        kind, volume, lnum, size = data[at + vid + 5], *struct.unpack_from(">II", data, at + vid + 8), struct.unpack_from(">I", data, at + vid + 20)[0]
        (order,) = struct.unpack_from(">Q", data, at + vid + 40)
        body = data[at + start : at + step]
        blocks.setdefault(volume, {}).setdefault(lnum, []).append((order, body[:size] if kind == 2 and size else body))
    width = max((len(b) for v in blocks.values() for c in v.values() for _, b in c), default=0)
    for volume, own in sorted(blocks.items()):
        if volume >= 0x7FFFEFFF:
            continue
        parts = [max(own[k], key=lambda x: x[0])[1] if k in own else b"\xff" * width for k in range(max(own) + 1)]
        yield Entry(f"volume{volume}", "regular", b"".join(parts))
        for lnum, copies in sorted(own.items()):
            for order, body in sorted(copies, key=lambda x: x[0])[:-1]:
                yield Entry(f"volume{volume}", "regular", body, superseded=True, version=order, extra={"lnum": str(lnum)})


@reader("romfs")
def romfs(data: bytes) -> Iterator[Entry]:
    def name_end(at):
        return -(-(data.index(b"\0", at) + 1) // 16) * 16

    def walk(at, base, seen):
        while at and at not in seen and at + 16 <= len(data):
            seen.add(at)
            nxt, info, size, _ = struct.unpack_from(">IIII", data, at)
            kind = nxt & 7
            name = data[at + 16 : data.index(b"\0", at + 16)].decode("utf-8", "surrogateescape")
            path, body_at = f"{base}{name}", name_end(at + 16)
            if name not in (".", ".."):
                kinds = ("hardlink", "directory", "regular", "symlink", "block", "char", "socket", "fifo")
                body = data[body_at : body_at + size]
                yield Entry(path, kinds[kind], body if kind == 2 else None, 0o755 if nxt & 8 else 0o644, link_target=body.decode("latin-1") if kind == 3 else None, inode=at)
                if kind == 1:
                    yield from walk(info, f"{path}/", seen)
            at = nxt & ~15

    yield from walk(name_end(16), "", set())


@reader("cramfs")
def cramfs(data: bytes) -> Iterator[Entry]:
    o = "<" if data[:4] == b"\x45\x3d\xcd\x28" else ">"

    def inode(at):
        a, b, c = struct.unpack_from(o + "III", data, at)
        if o == "<":
            return a & 0xFFFF, a >> 16, b & 0xFFFFFF, b >> 24, (c & 63) * 4, (c >> 6) * 4
        return a >> 16, a & 0xFFFF, b >> 8, b & 0xFF, (c >> 26) * 4, (c & 0x3FFFFFF) * 4

    def content(off, size):
        n = -(-size // 4096)
        ends = struct.unpack_from(f"{o}{n}I", data, off)
        at, out = off + 4 * n, []
        for k, end in enumerate(ends):
            want = min(4096, size - 4096 * k)
            out.append(zlib.decompress(data[at:end]) if end > at else b"\0" * want)
            at = end
        return b"".join(out)

    def walk(off, size, base):
        at = off
        while at < off + size:
            mode, uid, length, gid, named, body = inode(at)
            path = base + data[at + 12 : at + 12 + named].rstrip(b"\0").decode("utf-8", "surrogateescape")
            kind = KINDS.get(mode & 0o170000, "regular")
            raw = content(body, length) if kind in ("regular", "symlink") and length else b""
            yield Entry(path, kind, raw if kind == "regular" else None, mode & 0o7777, uid, gid, link_target=raw.decode("latin-1") if kind == "symlink" else None)
            if kind == "directory" and length:
                yield from walk(body, length, f"{path}/")
            at += 12 + named

    _, _, size, _, _, off = inode(64)
    yield from walk(off, size, "")


@reader("fat")
def fat(data: bytes) -> Iterator[Entry]:
    """FAT12/16/32 with long names; deleted entries with their bytes read contiguously."""
    sector, cluster, reserved, tables, roots, small, _, fat16 = struct.unpack_from("<HBHBHHBH", data, 11)
    large, fat32 = struct.unpack_from("<II", data, 32)
    table, sectors = fat16 or fat32, small or large
    first = reserved + tables * table
    start = first + -(-roots * 32 // sector)
    bits = 32 if not fat16 else 12 if (sectors - start) // cluster < 4085 else 16
    chain_at, width = reserved * sector, sector * cluster

    def following(k):
        if bits == 12:
            v = struct.unpack_from("<H", data, chain_at + k * 3 // 2)[0]
            return v >> 4 if k & 1 else v & 0xFFF
        return struct.unpack_from("<H" if bits == 16 else "<I", data, chain_at + k * bits // 8)[0] & (0xFFFF if bits == 16 else 0x0FFFFFFF)

    def block(k):
        at = start * sector + (k - 2) * width
        return data[at : at + width]

    def chain(k):
        out, seen = [], set()
        while 2 <= k < {12: 0xFF7, 16: 0xFFF7, 32: 0x0FFFFFF7}[bits] and k not in seen:
            seen.add(k)
            out.append(block(k))
            k = following(k)
        return b"".join(out)

    def walk(raw, base, depth=0):
        long: dict[int, str] = {}
        lost: list[str] = []  # parts of deleted long names: their numbers are gone, their order, last part first, is not
        for at in range(0, len(raw) - 31, 32):
            e = raw[at : at + 32]
            if e[0] == 0:
                break
            if e[11] == 0x0F:
                part = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")
                if e[0] != 0xE5:
                    long[e[0] & 0x1F] = part
                else:
                    lost.insert(0, part)
                continue
            gone = e[0] == 0xE5
            name = "".join(lost if gone else (long[k] for k in sorted(long)))
            long, lost = {}, []
            if e[11] & 8:
                continue
            stem, tail = (b"_" + e[1:8] if gone else e[:8]).decode("cp437").rstrip(), e[8:11].decode("cp437").rstrip()
            name = name or stem + ("." + tail if tail else "")
            if name in (".", ".."):
                continue
            k, (size,) = struct.unpack_from("<H", e, 26)[0] | struct.unpack_from("<H", e, 20)[0] << 16 * (bits == 32), struct.unpack_from("<I", e, 28)
            path = base + name
            if e[11] & 16:
                yield Entry(path, "directory", deleted=gone)
                if not gone and depth < 64:
                    yield from walk(chain(k), f"{path}/", depth + 1)
            else:
                at_ = start * sector + (k - 2) * width
                body = (data[at_ : at_ + size] if k >= 2 else b"") if gone else chain(k)[:size]
                yield Entry(path, "regular", body, deleted=gone, diagnostics=["fat-deleted-contiguous"] if gone else [])

    root = chain(struct.unpack_from("<I", data, 44)[0]) if bits == 32 else data[first * sector : start * sector]
    yield from walk(root, "")


@reader("jffs2")
def jffs2(data: bytes) -> Iterator[Entry]:
    """Live files under all their names, older states of each inode as superseded entries, unlinked names as deleted ones.

    A write longer than a page is several nodes: the states within one are told as partial. Nodes whose checksums fail
    don't count; data of a codec that is not known read as zeros and are told.
    """
    from gneiss.formats import lzo
    from gneiss.formats.validators import _crc0

    o = "<" if data[:2] == b"\x85\x19" else ">"
    dirents, nodes, at, bad = [], {}, 0, 0
    while at + 12 <= len(data):
        magic, kind, size, crc = struct.unpack_from(o + "HHII", data, at)
        if magic != 0x1985 or size < 12 or _crc0(data[at : at + 8]) != crc:
            at += 4
            continue
        if kind == 0xE001 and size >= 40:
            parent, version, ino, mtime = struct.unpack_from(o + "IIII", data, at + 12)
            n, (node_crc, name_crc) = data[at + 28], struct.unpack_from(o + "II", data, at + 32)
            name = data[at + 40 : at + 40 + n]
            if _crc0(data[at : at + 32]) == node_crc and _crc0(name) == name_crc:
                dirents.append((parent, name.decode("utf-8", "surrogateescape"), version, ino, mtime))
            else:
                bad += 1
        elif kind == 0xE002 and size >= 68:
            ino, version, mode, uid, gid, isize, _, mtime, ctime, off, csize, dsize = struct.unpack_from(o + "IIIHHIIIIIII", data, at + 12)
            data_crc, node_crc = struct.unpack_from(o + "II", data, at + 60)
            raw = data[at + 68 : at + 68 + csize]
            if _crc0(data[at : at + 60]) == node_crc and _crc0(raw) == data_crc:
                nodes.setdefault(ino, []).append((version, mode, uid, gid, isize, mtime, off, dsize, data[at + 56], raw, ctime))
            else:
                bad += 1
        at += -(-size // 4) * 4

    def unpacked(codec, raw, size):
        return {0: lambda: raw, 1: lambda: b"\0" * size, 2: lambda: codecs.rtime(raw, size), 6: lambda: zlib.decompress(raw), 7: lambda: lzo.lzo1x(raw, size), 8: lambda: codecs.raw_lzma(raw, JFFS2_LZMA, size)}[codec]()

    def states(log):
        """(node, bytes, notes) after each node of an inode's log, oldest first."""
        out, notes = bytearray(), []
        for n in log:
            _, mode, _, _, isize, _, off, size, codec, raw, _ = n
            if isize > max(len(data) * codecs.MAX_RATIO, 1 << 20):
                raise ValueError("a file beyond all ratios")
            if size:
                try:
                    part = unpacked(codec, raw, size)
                except (KeyError, zlib.error, codecs.CodecError) as e:
                    part, notes = b"", [f"jffs2-data: {type(e).__name__} {e}"]
                out += b"\0" * (off - len(out))
                out[off : off + size] = part[:size].ljust(size, b"\0")
            del out[isize:]
            out += b"\0" * (isize - len(out))
            yield n, bytes(out) if mode & 0o170000 in (0o100000, 0o120000) else b"", list(notes)

    def within(log):
        """The numbers of nodes whose write goes on in the next one: data that start where the former end, at the same times, in a file not shorter."""
        out, extent, before = set(), 0, None
        for k, (_, _, _, _, isize, mtime, off, size, _, _, ctime) in enumerate(log):
            if before and size and before[0] and off == extent and (mtime, ctime) == before[1:3] and isize >= before[3]:
                out.add(k)
            extent = max(extent, off + size) if size else min(extent, isize)
            before = (size, mtime, ctime, isize)
        return out

    newest: dict[tuple[int, str], tuple] = {}
    for d in dirents:
        key = (d[0], d[1])
        if key not in newest or newest[key][2] < d[2]:
            newest[key] = d
    live: dict[int, list[tuple[int, str]]] = {}
    for (parent, name), d in sorted(newest.items(), key=lambda x: x[1][2]):
        if d[3]:
            live.setdefault(d[3], []).append((parent, name))
    last = {d[3]: (d[0], d[1]) for d in sorted(dirents, key=lambda d: d[2]) if d[3]}

    def path(place, depth=0):
        parent, name = place
        where = live.get(parent, [last[parent]] if parent in last else [])
        if parent in (0, 1) or not where or depth > 64:
            return name
        return f"{path(where[0], depth + 1)}/{name}"

    for ino in sorted(last):
        gone = ino not in live
        places = [last[ino]] if gone else live[ino]
        log = sorted(nodes.get(ino, []), key=lambda x: x[0])
        if not log:
            yield Entry(path(places[0]), "directory" if any(d[0] == ino for d in dirents) else "regular", inode=ino, deleted=gone)
        partial = within(log)
        for k, (n, body, notes) in reversed(list(enumerate(states(log), 1))):
            version, mode, uid, gid, _, mtime, *_ = n
            kind = KINDS.get(mode & 0o170000, "regular")
            extra = {"partial": "true"} if k in partial else {}
            yield Entry(path(places[0]), kind, body if kind == "regular" else None, mode & 0o7777, uid, gid, mtime, body.decode("latin-1") if kind == "symlink" else None, ino, gone, k < len(log), version, extra, notes)
        for place in places[1:]:
            yield Entry(path(place), "hardlink", link_target=path(places[0]), inode=ino)
    if bad:
        yield Entry("", "diagnostic", diagnostics=[f"jffs2-bad-node: {bad}"])


@reader("gpt", "mbr")
def partitions(data: bytes) -> Iterator[Entry]:
    """The partitions of a table as entries; one that only shields a newer table is left out, one beyond the end is cut."""
    from gneiss.formats.validators import partition_rows

    for index, start, size, kind, name in partition_rows(data):
        body = data[start : start + size]
        notes = ["partition-past-end"] if len(body) < size else []
        yield Entry(f"p{index}" + (f"-{name}" if name else ""), "regular", body, extra={"start": str(start), "type": kind}, diagnostics=notes)


@reader("ext2", "ext3", "ext4", "ext")
def ext(data: bytes) -> Iterator[Entry]:
    """Extents and block maps; names left in directory slack and freed inodes as deleted entries, with the bytes their map still reaches."""
    first, log = struct.unpack_from("<II", data, 1024 + 20)
    (per_group,), (features,) = struct.unpack_from("<I", data, 1024 + 40), struct.unpack_from("<I", data, 1024 + 96)
    total, revision, block = struct.unpack_from("<I", data, 1024)[0], struct.unpack_from("<I", data, 1024 + 76)[0], 1024 << log
    width = struct.unpack_from("<H", data, 1024 + 88)[0] if revision else 128
    wide = bool(features & 0x80)
    step = struct.unpack_from("<H", data, 1024 + 254)[0] if wide else 32

    def node(ino):
        group, k = divmod(ino - 1, per_group)
        at = (first + 1) * block + group * step
        table = struct.unpack_from("<I", data, at + 8)[0] | (struct.unpack_from("<I", data, at + 40)[0] << 32 if wide and step >= 64 else 0)
        at = table * block + k * width
        return data[at : at + width]

    def extents(raw, depth=0):
        """(first block in the file, blocks, block on disk or 0 for zeros) of an extent tree's node."""
        magic, n, _, level = struct.unpack_from("<HHHH", raw, 0)
        if magic != 0xF30A or depth > 6:
            return
        for at in range(12, 12 + 12 * n, 12):
            if level:
                _, low, high = struct.unpack_from("<IIH", raw, at)
                where = low | high << 32
                yield from extents(data[where * block : (where + 1) * block], depth + 1)
            else:
                begin, count, high, low = struct.unpack_from("<IHHI", raw, at)
                yield begin, count - 32768 if count > 32768 else count, 0 if count > 32768 else low | high << 32

    def mapped(raw, blocks):
        """The same for a map of 12 direct blocks and three levels of indirect ones."""
        fan, at = block // 4, 12
        for k, where in enumerate(struct.unpack_from("<12I", raw, 0)):
            yield k, 1, where

        def below(where, level, at):
            if where and at < blocks and (where + 1) * block <= len(data):
                for k, x in enumerate(struct.unpack_from(f"<{fan}I", data, where * block)):
                    if level:
                        yield from below(x, level - 1, at + k * fan**level)
                    else:
                        yield at + k, 1, x

        for level, where in enumerate(struct.unpack_from("<3I", raw, 48)):
            yield from below(where, level, at)
            at += fan ** (level + 1)

    def content(raw, size):
        (flags,) = struct.unpack_from("<I", raw, 32)
        if flags & 0x10000000:
            return raw[40 : 40 + min(size, 60)]
        runs, out = extents(raw[40:100]) if flags & 0x80000 else mapped(raw[40:100], -(-size // block)), bytearray(size)
        for begin, count, where in runs:
            if where and begin * block < size:
                got = data[where * block : (where + count) * block][: size - begin * block]
                out[begin * block : begin * block + len(got)] = got
        return bytes(out)

    def entry(path, ino, raw, deleted=False):
        mode, uid, low = struct.unpack_from("<HHI", raw, 0)
        (mtime,), (gid,) = struct.unpack_from("<I", raw, 16), struct.unpack_from("<H", raw, 24)
        kind, size = KINDS.get(mode & 0o170000, "regular"), low | (struct.unpack_from("<I", raw, 108)[0] << 32 if mode & 0o170000 == 0o100000 else 0)
        notes, body, target = [], None, None
        if size > max(len(data), 1 << 28):
            notes, size = [f"ext-size: {size}"], 0
        if kind == "regular":
            body = content(raw, size)
        elif kind == "symlink":
            target = (raw[40 : 40 + size] if size < 60 and not struct.unpack_from("<I", raw, 32)[0] & 0x80000 else content(raw, size)).decode("utf-8", "surrogateescape")
        own = struct.unpack_from("<HH", raw, 120)
        return Entry(path, kind, body, mode & 0o7777, uid | own[0] << 16, gid | own[1] << 16, mtime, target, ino, deleted, diagnostics=notes)

    def names(raw):
        """(inode, name, in slack) of a directory's entries; slack is searched in steps of four bytes."""
        for base in range(0, len(raw), block):
            at, end = base, min(base + block, len(raw))
            while at + 8 <= end:
                ino, span, n = struct.unpack_from("<IHB", raw, at)
                if span < 8 or at + span > end:
                    break
                if ino and n:
                    yield ino, raw[at + 8 : at + 8 + n], False
                spare, stop = at + (8 + -(-n // 4) * 4 if ino else 8), at + span
                while spare + 12 <= stop:
                    gone, span_, n_, kind = struct.unpack_from("<IHBB", raw, spare)
                    name = raw[spare + 8 : spare + 8 + n_]
                    if 0 < gone <= total and n_ and 1 <= kind <= 7 and span_ % 4 == 0 and 8 + n_ <= span_ <= block and spare + 8 + n_ <= stop and not set(name) & {0, 47}:
                        yield gone, name, True
                        spare += 8 + -(-n_ // 4) * 4
                    else:
                        spare += 4
                at += span

    seen, lost = {2: ""}, []

    def walk(ino, base, depth=0):
        raw = node(ino)
        for child, name, slack in names(content(raw, min(struct.unpack_from("<I", raw, 4)[0], len(data)))):
            path = base + name.decode("utf-8", "surrogateescape")
            if name in (b".", b"..") or child > total:
                continue
            if slack:
                lost.append((child, path))
            elif child in seen:
                yield Entry(path, "hardlink", link_target=seen[child], inode=child)
            else:
                seen[child] = path
                made = entry(path, child, node(child))
                yield made
                if made.kind == "directory" and depth < 64:
                    yield from walk(child, f"{path}/", depth + 1)

    yield from walk(2, "")
    for ino, path in [*lost, *((k, f"inode-{k}") for k in range(11, total + 1))]:
        raw = node(ino)
        if ino not in seen and len(raw) >= 128 and struct.unpack_from("<H", raw, 0)[0] & 0o170000 in KINDS and struct.unpack_from("<I", raw, 20)[0]:
            seen[ino] = path
            yield entry(path, ino, raw, True)


#: Where a super partition's geometry and its copy lie, and the two magics.
SUPER_GEOMETRY, SUPER_MAGIC, SUPER_TABLES = (4096, 8192), 0x616C4467, 0x414C5030


@reader("android-super", "super")
def android_super(data: bytes) -> Iterator[Entry]:
    """One entry per logical partition of the first slot, its extents in order; damaged tables give way to their copies."""

    def sound(raw, at):
        return hashlib.sha256(raw[:at] + bytes(32) + raw[at + 32 :]).digest() == raw[at : at + 32]

    for where in SUPER_GEOMETRY:
        magic, size = struct.unpack_from("<II", data, where)
        if magic == SUPER_MAGIC and 52 <= size <= 4096 and sound(data[where : where + size], 8):
            most, slots = struct.unpack_from("<II", data, where + 40)
            break
    else:
        raise ValueError("no sound geometry")
    base, notes = SUPER_GEOMETRY[-1] + 4096, []
    for at in (base, base + most * slots):
        magic, major, _, size = struct.unpack_from("<IHHI", data, at)
        head, (length,) = data[at : at + size], struct.unpack_from("<I", data, at + 44)
        tables = data[at + size : at + size + length]
        if magic == SUPER_TABLES and major == 10 and size >= 128 and sound(head, 12) and hashlib.sha256(tables).digest() == head[48:80]:
            break
        notes = ["super-backup-tables"]
    else:
        raise ValueError("no sound tables")

    def rows(k, form):
        start, n, width = struct.unpack_from("<III", head, 80 + 12 * k)
        return [struct.unpack_from(form, tables, start + i * width) for i in range(n)]

    extents, groups = rows(1, "<QIQI"), rows(2, "<36sIQ")
    for name, flags, first, n, group in rows(0, "<36sIIII"):
        parts, own = [], list(notes)
        for sectors, target, sector, device in extents[first : first + n]:
            if target == 0 and device == 0:
                parts.append(data[sector * 512 : (sector + sectors) * 512])
                if len(parts[-1]) < sectors * 512:
                    own.append("super-extent-past-end")
            elif target == 1 and sectors * 512 <= max(len(data), 1 << 28):
                parts.append(bytes(sectors * 512))
            else:
                own.append("super-extent-elsewhere")
        extra = {"attributes": str(flags), "extents": str(n)}
        if group < len(groups):
            extra["group"] = groups[group][0].rstrip(b"\0").decode("utf-8", "replace")
        yield Entry(name.rstrip(b"\0").decode("utf-8", "surrogateescape"), "regular", b"".join(parts), extra=extra, diagnostics=own)
