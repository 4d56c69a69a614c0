"""Images made from rows: what readers read, written. Queries and tests build archives, filesystems and tables with these."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from gneiss.formats.validators import _crc0, _crc_be, crc_ubi


@dataclass
class File:
    """A file to be written: names hold one folder at most."""

    name: str
    body: bytes
    mode: int = 0o644
    uid: int = 0
    gid: int = 0
    mtime: int = 0


Builder = Callable[[list[File]], bytes]
REGISTRY: dict[str, Builder] = {}


def builder(*names: str):
    def add(f: Builder) -> Builder:
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return add


def _pad(raw: bytes, to: int, fill: bytes = b"\0") -> bytes:
    return raw + fill * (-len(raw) % to)


def folders(files: list[File]) -> dict[str, list[File]]:
    """Files by folder, the root as the empty name, in order of names."""
    out: dict[str, list[File]] = {"": []}
    for f in sorted(files, key=lambda f: f.name):
        folder, _, _ = f.name.rpartition("/")
        out.setdefault(folder, []).append(f)
    return out


# --- archives -----------------------------------------------------------------------------------


@builder("tar")
def tar(files: list[File]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for f in files:
            info = tarfile.TarInfo(f.name)
            info.size, info.mode, info.uid, info.gid, info.mtime = len(f.body), f.mode, f.uid, f.gid, f.mtime
            t.addfile(info, io.BytesIO(f.body))
    return out.getvalue()


@builder("cpio")
def cpio(files: list[File]) -> bytes:
    def member(f: File, ino: int, mode: int) -> bytes:
        name = f.name.encode() + b"\0"
        fields = (ino, mode, f.uid, f.gid, 1, f.mtime, len(f.body), 0, 0, 0, 0, len(name), 0)
        return _pad(_pad(b"070701" + b"".join(b"%08x" % x for x in fields) + name, 4) + f.body, 4)

    return b"".join(member(f, k + 1, f.mode | 0o100000) for k, f in enumerate(files)) + member(File("TRAILER!!!", b""), 0, 0)


@builder("cpio-odc")
def cpio_odc(files: list[File]) -> bytes:
    def member(f: File, ino: int, mode: int) -> bytes:
        name = f.name.encode() + b"\0"
        return b"070707%06o%06o%06o%06o%06o%06o%06o%011o%06o%011o" % (0, ino & 0o777777, mode, f.uid, f.gid, 1, 0, f.mtime, len(name), len(f.body)) + name + f.body

    return b"".join(member(f, k + 1, f.mode | 0o100000) for k, f in enumerate(files)) + member(File("TRAILER!!!", b""), 0, 0)


@builder("ar")
def ar(files: list[File]) -> bytes:
    """Long names stand in a table of their own."""
    out, table = [], b""
    for f in files:
        name = f.name.encode()
        if len(name) > 15:
            field, table = b"/%d" % len(table), table + name + b"/\n"
        else:
            field = name + b"/"
        out.append(_pad(field.ljust(16) + b"%-12d%-6d%-6d%-8o%-10d`\n" % (f.mtime, f.uid, f.gid, f.mode | 0o100000, len(f.body)) + f.body, 2, b"\n"))
    names = _pad(b"//".ljust(48) + b"%-10d`\n" % len(table) + table, 2, b"\n") if table else b""
    return b"!<arch>\n" + names + b"".join(out)


@builder("zip")
def zip_(files: list[File], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for f in files:
            info = zipfile.ZipInfo(f.name)
            info.compress_type, info.create_system, info.external_attr = method, 3, (f.mode | 0o100000) << 16
            z.writestr(info, f.body)
    return out.getvalue()


# --- streams ------------------------------------------------------------------------------------


def lz4_block(raw: bytes) -> bytes:
    """A block of literals and matches of four bytes and more, found by the last place of each four bytes."""
    out, seen, at, done = bytearray(), {}, 0, 0

    def sequence(literals: bytes, back: int, n: int) -> None:
        out.append(min(len(literals), 15) << 4 | (min(n - 4, 15) if n else 0))
        for rest, more in ((len(literals) - 15, False), (n - 19, True)):
            if more:
                out.extend(literals)
                if not n:
                    return
                out.extend(struct.pack("<H", back))
            if rest >= 0:
                out.extend(b"\xff" * (rest // 255) + bytes([rest % 255]))

    while at + 12 < len(raw):
        key = raw[at : at + 4]
        back = at - seen.get(key, at)
        seen[key] = at
        if 0 < back < 65536:
            n = 4
            while at + n < len(raw) - 5 and raw[at + n] == raw[at + n - back]:
                n += 1
            sequence(raw[done:at], back, n)
            at += n
            done = at
        else:
            at += 1
    sequence(raw[done:], 0, 0)
    return bytes(out)


def lz4_frame(raw: bytes) -> bytes:
    """A frame of independent blocks; checksums are left out but for the header's byte, which readers skip."""
    parts = [raw[k : k + 65536] for k in range(0, len(raw), 65536)]
    blocks = [min((lz4_block(p), False), (p, True), key=lambda x: len(x[0])) for p in parts]
    return b"\x04\x22\x4d\x18\x60\x40\x82" + b"".join(struct.pack("<I", len(b) | stored << 31) + b for b, stored in blocks) + bytes(4)


def zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(raw)


STREAMS: dict[str, Callable[[bytes], bytes]] = {
    "gzip": lambda x: gzip.compress(x, 6, mtime=0), "xz": lzma.compress, "lzma": lambda x: lzma.compress(x, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20}]),
    "bzip2": bz2.compress, "lz4": lz4_frame, "zstd": zstd,
}


# --- firmware containers ------------------------------------------------------------------------


def uimage(body: bytes, name: str = "", kind: int = 2, codec: int = 0) -> bytes:
    head = bytearray(struct.pack(">IIIIIII", 0x27051956, 0, 0, len(body), 0, 0, zlib.crc32(body)) + bytes([5, 2, kind, codec]) + name.encode()[:32].ljust(32, b"\0"))
    head[4:8] = struct.pack(">I", zlib.crc32(bytes(head)))
    return bytes(head) + body


@builder("uimage")
def uimage_multi(files: list[File]) -> bytes:
    """Several images in one: their sizes, a zero, then the images."""
    sizes = b"".join(struct.pack(">I", len(f.body)) for f in files) + bytes(4)
    return uimage(sizes + b"".join(_pad(f.body, 4) for f in files), kind=4)


def fdt(tree: list) -> bytes:
    """A flattened device tree of (name, properties, children)."""
    names, places = bytearray(), {}

    def place(name: str) -> int:
        if name not in places:
            places[name] = len(names)
            names.extend(name.encode() + b"\0")
        return places[name]

    def node(name: str, properties: dict[str, bytes], children: list) -> bytes:
        out = struct.pack(">I", 1) + _pad(name.encode() + b"\0", 4)
        for key, value in properties.items():
            out += struct.pack(">III", 3, len(value), place(key)) + _pad(value, 4)
        return out + b"".join(node(*c) for c in children) + struct.pack(">I", 2)

    body = node(*tree) + struct.pack(">I", 9)
    at = 56 + len(body)
    return struct.pack(">10I", 0xD00DFEED, at + len(names), 56, at, 40, 17, 16, 0, len(names), len(body)) + bytes(16) + body + bytes(names)


@builder("fit")
def fit(files: list[File]) -> bytes:
    images = [(f.name.replace("/", "_"), {"data": f.body, "type": b"kernel\0", "arch": b"arm\0"}, []) for f in files]
    return fdt(("", {"description": b"made\0"}, [("images", {}, images), ("configurations", {}, [])]))


def android_boot(kernel: bytes, ramdisk: bytes, second: bytes = b"", page: int = 2048) -> bytes:
    head = b"ANDROID!" + struct.pack("<10I", len(kernel), 0, len(ramdisk), 0, len(second), 0, 0, page, 0, 0)
    return _pad(head.ljust(1648, b"\0"), page) + _pad(kernel, page) + _pad(ramdisk, page) + _pad(second, page)


def android_boot_3(kernel: bytes, ramdisk: bytes) -> bytes:
    head = b"ANDROID!" + struct.pack("<IIII4II", len(kernel), len(ramdisk), 0, 1580, 0, 0, 0, 0, 3)
    return _pad(head.ljust(1580, b"\0"), 4096) + _pad(kernel, 4096) + _pad(ramdisk, 4096)


def android_vendor_boot(ramdisk: bytes, dtb: bytes, page: int = 2048) -> bytes:
    head = b"VNDRBOOT" + struct.pack("<5I", 3, page, 0, 0, len(ramdisk)) + bytes(2048 + 20)
    head = head[:2096].ljust(2096, b"\0") + struct.pack("<II", 2112, len(dtb))
    return _pad(head.ljust(2112, b"\0"), page) + _pad(ramdisk, page) + _pad(dtb, page)


def android_sparse(raw: bytes, block: int = 4096) -> bytes:
    """Blocks of one repeated word as fill or, where it is zero, as holes; the rest raw. The image ends on a whole block."""
    raw, chunks = _pad(raw, block), []
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        kind = 0xCAC3 if not any(part) else 0xCAC2 if part == part[:4] * (block // 4) else 0xCAC1
        body = {0xCAC1: part, 0xCAC2: part[:4], 0xCAC3: b""}[kind]
        chunks.append(struct.pack("<HHII", kind, 0, 1, 12 + len(body)) + body)
    return struct.pack("<IHHHHIIII", 0xED26FF3A, 1, 0, 28, 12, block, len(raw) // block, len(chunks), 0) + b"".join(chunks)


def _signed(raw: bytes, at: int) -> bytes:
    return raw[:at] + hashlib.sha256(raw).digest() + raw[at + 32 :]


@builder("android-super")
def android_super(files: list[File]) -> bytes:
    """A logical partition per file, whole sectors, after the geometry and both tables."""
    most, slots = 65536, 1
    sector, extents, partitions, body = (12288 + 2 * most) // 512, [], [], b""
    for k, f in enumerate(files):
        data = _pad(f.body, 512)
        extents.append(struct.pack("<QIQI", len(data) // 512, 0, sector + len(body) // 512, 0))
        partitions.append(struct.pack("<36sIIII", f.name.replace("/", "_").encode(), 1, k, 1, 0))
        body += data
    tables, places = b"", b""
    for part, width in ((partitions, 52), (extents, 24), ([struct.pack("<36sIQ", b"default", 0, 0)], 48), ([], 64)):
        places += struct.pack("<III", len(tables), len(part), width)
        tables += b"".join(part)
    head = struct.pack("<IHHI32sI32s", 0x414C5030, 10, 0, 128, bytes(32), len(tables), hashlib.sha256(tables).digest()) + places
    whole = (_signed(head, 12) + tables).ljust(most, b"\0")
    geometry = _signed(struct.pack("<II32sIII", 0x616C4467, 52, bytes(32), most, slots, 4096), 8).ljust(4096, b"\0")
    return bytes(4096) + geometry * 2 + whole * 2 + body


def ubi(volumes: list[bytes], peb: int = 16384, older: dict[tuple[int, int], bytes] | None = None) -> bytes:
    """Physical blocks of 16 KiB: header, volume header, data; ``older`` gives former contents of (volume, block)."""
    start, out, order = 128, [], 0
    room = peb - start

    def block(volume: int, lnum: int, data: bytes) -> bytes:
        nonlocal order
        order += 1
        ec = b"UBI#" + bytes([1, 0, 0, 0]) + struct.pack(">QIII", 1, 64, start, 7) + bytes(32)
        vid = b"UBI!" + bytes([1, 1, 0, 0]) + struct.pack(">II", volume, lnum) + bytes(4) + struct.pack(">IIII", 0, 0, 0, 0) + bytes(4) + struct.pack(">Q", order) + bytes(12)
        head = ec + struct.pack(">I", crc_ubi(ec)) + vid + struct.pack(">I", crc_ubi(vid))
        return head + data.ljust(room, b"\xff")

    for (volume, lnum), data in (older or {}).items():
        out.append(block(volume, lnum, data))
    for volume, data in enumerate(volumes):
        for lnum, at in enumerate(range(0, max(1, len(data)), room)):
            out.append(block(volume, lnum, data[at : at + room]))
    return b"".join(out)


# --- filesystems --------------------------------------------------------------------------------


@builder("romfs")
def romfs(files: list[File]) -> bytes:
    tree, out = folders(files), bytearray()

    def header(at: int, kind: int, info: int, size: int, name: bytes) -> bytes:
        return struct.pack(">IIII", kind, info, size, 0) + _pad(name + b"\0", 16)

    out += b"-rom1fs-" + bytes(8) + _pad(b"made\0", 16)
    links: list[int] = []

    def entry(kind: int, name: str, body: bytes) -> int:
        at = len(out)
        out.extend(header(at, kind, 0, len(body), name.encode()) + _pad(body, 16))
        return at

    def chain(items: list[int]) -> None:
        for a, b in zip(items, [*items[1:], 0], strict=True):
            (word,) = struct.unpack_from(">I", out, a)
            struct.pack_into(">I", out, a, b | word & 15)

    for folder in sorted(x for x in tree if x):
        at = entry(1 | 8, folder, b"")
        own = [entry(2, f.name.rpartition("/")[2], f.body) for f in tree[folder]]
        chain(own)
        struct.pack_into(">I", out, at + 4, own[0] if own else 0)
        links.append(at)
    links += [entry(2, f.name, f.body) for f in tree[""]]
    chain(links)
    for at in [x for x in range(32, len(out), 16) if x in set(links)]:
        end = at + 16
        total = sum(struct.unpack_from(">4I", out, at)) + sum(struct.unpack_from(">4I", out, end))
        struct.pack_into(">I", out, at + 12, -total & 0xFFFFFFFF)
    out += bytes(-len(out) % 1024)
    struct.pack_into(">I", out, 8, len(out))
    head = out[: min(512, len(out))]
    struct.pack_into(">I", out, 12, -sum(struct.unpack(f">{len(head) // 4}I", head)) & 0xFFFFFFFF)
    return bytes(out)


@builder("cramfs")
def cramfs(files: list[File]) -> bytes:
    tree = folders(files)
    names = sorted(x for x in tree if x)

    def inode(mode: int, uid: int, size: int, gid: int, name: bytes, off: int) -> bytes:
        padded = _pad(name, 4)
        return struct.pack("<III", mode | (uid & 0xFFFF) << 16, size | (gid & 255) << 24, len(padded) // 4 | (off // 4) << 6) + padded

    width = lambda name: 12 + -(-len(name.encode()) // 4) * 4
    base = lambda f: f.name.rpartition("/")[2]
    root_size = sum(map(width, names)) + sum(width(f.name) for f in tree[""])
    places, at = {}, 76 + root_size
    for n in names:
        places[n] = at
        at += sum(width(base(f)) for f in tree[n])
    data, where = bytearray(), {}
    for f in files:
        if f.body:
            where[f.name] = at + len(data)
            blocks = [zlib.compress(f.body[k : k + 4096]) for k in range(0, len(f.body), 4096)]
            end, ends = at + len(data) + 4 * len(blocks), []
            for b in blocks:
                end += len(b)
                ends.append(end)
            data += struct.pack(f"<{len(ends)}I", *ends) + b"".join(blocks)
            data += bytes(-len(data) % 4)
    node = lambda f: inode(f.mode | 0o100000, f.uid, len(f.body), f.gid, base(f).encode(), where.get(f.name, 0))
    folder = lambda n: inode(0o40755, 0, sum(width(base(f)) for f in tree[n]), 0, n.encode(), places[n])
    listing = sorted([(n, folder(n)) for n in names] + [(f.name, node(f)) for f in tree[""]])
    body = b"".join(x for _, x in listing) + b"".join(node(f) for n in names for f in tree[n]) + bytes(data)
    size = -(-(76 + len(body)) // 4096) * 4096
    root = inode(0o40755, 0, root_size, 0, b"", 76)
    head = bytearray(struct.pack("<IIII", 0x28CD3D45, size, 3, 0) + b"Compressed ROMFS" + struct.pack("<IIII", 0, 0, size // 4096, len(files) + len(names) + 1) + b"made".ljust(16, b"\0") + root)
    out = (bytes(head) + body).ljust(size, b"\0")
    return out[:32] + struct.pack("<I", zlib.crc32(out)) + out[36:]


def fat(files: list[File], bits: int = 12, gone: frozenset[str] = frozenset()) -> bytes:
    """FAT12, 16 or 32 of 512-byte clusters with long names; files in ``gone`` are deleted, their clusters free."""
    tree, chains, area = folders(files), [0, 0], bytearray()

    def store(body: bytes, free: bool = False) -> int:
        n = -(-len(body) // 512)
        if not n:
            return 0
        first = len(chains)
        chains.extend([0] * n if free else [*range(first + 1, first + n), -1])
        area.extend(body.ljust(n * 512, b"\0"))
        return first

    def rows(name: str, number: int, first: int, size: int, folder: bool, deleted: bool) -> bytes:
        short = (b"F%07d" % number) + b"   "
        check = 0
        for c in short:
            check = ((check & 1) << 7) + (check >> 1) + c & 0xFF
        units = _pad((name + "\0").encode("utf-16-le"), 26, b"\xff") if len(name) % 13 else name.encode("utf-16-le")
        parts = [units[k : k + 26] for k in range(0, len(units), 26)]
        out = b""
        for k in range(len(parts), 0, -1):
            p = parts[k - 1]
            out += bytes([k | (64 if k == len(parts) else 0)]) + p[:10] + b"\x0f\0" + bytes([check]) + p[10:22] + b"\0\0" + p[22:]
        out += short + bytes([16 if folder else 32, 0, 0, 0, 0, 0, 0, 0, 0]) + struct.pack("<HHHHI", first >> 16, 0, 0, first & 0xFFFF, size)
        return b"".join(b"\xe5" + out[k + 1 : k + 32] for k in range(0, len(out), 32)) if deleted else out

    def listing(own: list[File], start: int, more: bytes = b"") -> bytes:
        out = more
        for k, f in enumerate(own):
            out += rows(f.name.rpartition("/")[2], start + k, store(f.body, f.name in gone), len(f.body), False, f.name in gone)
        return out

    sub = b""
    for k, n in enumerate(sorted(x for x in tree if x)):
        dots = b"".join(d.ljust(11) + bytes([16]) + bytes(20) for d in (b".", b".."))
        sub += rows(n, 9_000_000 + k, store(listing(tree[n], 1000 * (k + 1), dots) + bytes(32)), 0, True, False)
    root = listing(tree[""], 0, sub) + bytes(32)
    root_at = store(root) if bits == 32 else 0
    roots = 0 if bits == 32 else -(-len(root) // 512) * 16
    least = {12: 16, 16: 4100, 32: 16}[bits]
    chains += [0] * max(0, least - len(chains))
    if bits == 12 and len(chains) > 4000:
        raise ValueError("too much for FAT12")
    ends = {12: 0xFFF, 16: 0xFFFF, 32: 0x0FFFFFFF}[bits]
    values = [ends if c == -1 else c for c in chains]
    values[:2] = [ends & ~7, ends]
    if bits == 12:
        table = bytearray(-(-len(values) * 3 // 2) + 2)
        for k, v in enumerate(values):
            at = k * 3 // 2
            table[at] |= v << 4 & 0xF0 if k & 1 else v & 255
            table[at + 1] |= v >> 4 if k & 1 else v >> 8
    else:
        table = bytearray(struct.pack(f"<{len(values)}{'H' if bits == 16 else 'I'}", *values))
    table = _pad(bytes(table), 512)
    reserved = 32 if bits == 32 else 1
    sectors = reserved + 2 * len(table) // 512 + roots * 32 // 512 + len(chains) - 2
    small = sectors if sectors < 65536 and bits != 32 else 0
    boot = b"\xeb\x3c\x90made 1.0" + struct.pack("<HBHBHHBHHHII", 512, 1, reserved, 2, roots, small, 0xF8, 0 if bits == 32 else len(table) // 512, 63, 255, 0, 0 if small else sectors)
    if bits == 32:
        boot += struct.pack("<IHHIHH", len(table) // 512, 0, 0, root_at, 1, 6) + bytes(12)
    boot += b"\x80\0\x29" + struct.pack("<I", 7) + b"MADE       " + b"FAT%d   " % bits
    boot = boot.ljust(510, b"\0") + b"\x55\xaa"
    head = boot.ljust(reserved * 512, b"\0") + table * 2 + (root.ljust(roots * 32, b"\0") if roots else b"")
    return head + bytes(area).ljust((len(chains) - 2) * 512, b"\0")


builder("fat12")(lambda files: fat(files, 12 if sum(len(f.body) for f in files) < 1 << 20 else 16))
builder("fat16")(lambda files: fat(files, 16))
builder("fat32")(lambda files: fat(files, 32))


def jffs2_node(kind: int, body: bytes) -> bytes:
    """A node with both header checksums as the kernel computes them."""
    head = struct.pack("<HHI", 0x1985, kind, 12 + len(body))
    return _pad(head + struct.pack("<I", _crc0(head)) + body, 4, b"\xff")


def jffs2_inode(ino: int, version: int, mode: int, f: File, size: int, off: int, part: bytes, codec: int) -> bytes:
    raw = zlib.compress(part) if codec == 6 else part
    fixed = struct.pack("<IIIHHIIIIIIIBBH", ino, version, mode, f.uid, f.gid, size, f.mtime, f.mtime, f.mtime, off, len(raw), len(part), codec, codec, 0)
    head = struct.pack("<HHI", 0x1985, 0xE002, 68 + len(raw))
    head += struct.pack("<I", _crc0(head))
    return _pad(head + fixed + struct.pack("<II", _crc0(raw), _crc0(head + fixed)) + raw, 4, b"\xff")


def jffs2_dirent(parent: int, version: int, ino: int, name: str, mtime: int = 0, kind: int = 8) -> bytes:
    raw = name.encode()
    fixed = struct.pack("<IIIIBBH", parent, version, ino, mtime, len(raw), kind, 0)
    head = struct.pack("<HHI", 0x1985, 0xE001, 40 + len(raw))
    head += struct.pack("<I", _crc0(head))
    return _pad(head + fixed + struct.pack("<II", _crc0(head + fixed), _crc0(raw)) + raw, 4, b"\xff")


def jffs2_log(states: list[list[File]]) -> bytes:
    """A log of several states of a tree, one after the other: files not in a later state are unlinked, changed ones written again."""
    out, numbers, versions, last, entries = [jffs2_node(0x2003, b"")], {"": 1}, {}, {}, 0
    for state in states:
        now = {f.name: f for f in state}
        for name in sorted(set(last) - set(now)):
            folder, _, base = name.rpartition("/")
            entries += 1
            out.append(jffs2_dirent(numbers[folder], entries, 0, base))
        for f in sorted(state, key=lambda f: f.name):
            folder, _, base = f.name.rpartition("/")
            if folder not in numbers:
                entries, numbers[folder] = entries + 1, len(numbers) + 1
                out.append(jffs2_dirent(1, entries, numbers[folder], folder, kind=4))
                out.append(jffs2_inode(numbers[folder], 1, 0o40755, File(folder, b""), 0, 0, b"", 0))
            if f.name not in last:
                entries, numbers[f.name] = entries + 1, len(numbers) + 1
                out.append(jffs2_dirent(numbers[folder], entries, numbers[f.name], base, f.mtime))
            if f.name in last and last[f.name].body == f.body:
                continue
            ino = numbers[f.name]
            for at in range(0, max(1, len(f.body)), 4096):
                versions[ino] = versions.get(ino, 0) + 1
                part = f.body[at : at + 4096]
                out.append(jffs2_inode(ino, versions[ino], f.mode | 0o100000, f, len(f.body), at, part, 6 if len(part) > 64 else 0))
        last = now
    return _pad(b"".join(out), 65536, b"\xff")


builder("jffs2")(lambda files: jffs2_log([files]))


@builder("ext4")
def ext4(files: list[File]) -> bytes:
    return ext(files, True)


@builder("ext2")
def ext2(files: list[File]) -> bytes:
    return ext(files, False)


def ext(files: list[File], extents: bool, block: int = 1024) -> bytes:
    """One group of 1 KiB blocks: files as one extent each, or as block maps of two levels."""
    tree = folders(files)
    names = sorted(x for x in tree if x)
    inodes = -(-(11 + len(files) + len(names)) // 8) * 8
    width = 128
    table_at, table_blocks = 5, -(-inodes * width // block)
    data, base, table = bytearray(), table_at + table_blocks, bytearray(inodes * width)

    def store(body: bytes) -> int:
        at = base + len(data) // block
        data.extend(_pad(body, block))
        return at

    def mapped(body: bytes) -> bytes:
        if extents:
            n = -(-len(body) // block)
            at = store(body) if n else 0
            return struct.pack("<HHHHI", 0xF30A, 1 if n else 0, 4, 0, 0) + (struct.pack("<IHHI", 0, n, 0, at) if n else b"").ljust(48, b"\0")
        at = store(body)
        blocks = list(range(at, at + -(-len(body) // block)))
        fan = block // 4
        direct, rest = blocks[:12] + [0] * (12 - len(blocks[:12])), blocks[12:]
        single = store(struct.pack(f"<{len(rest[:fan])}I", *rest[:fan])) if rest else 0
        rest, double = rest[fan:], 0
        if rest:
            leaves = [store(struct.pack(f"<{len(rest[k:k + fan])}I", *rest[k : k + fan])) for k in range(0, len(rest), fan)]
            double = store(struct.pack(f"<{len(leaves)}I", *leaves))
        return struct.pack("<15I", *direct, single, double, 0)

    def inode(number: int, mode: int, f: File, links: int) -> None:
        raw = struct.pack("<HHIIIIIHHII", mode, f.uid, len(f.body), f.mtime, f.mtime, f.mtime, 0, f.gid, links, -(-len(f.body) // 512), 0x80000 if extents else 0)
        raw = raw.ljust(40, b"\0") + mapped(f.body)
        table[(number - 1) * width : number * width] = raw.ljust(width, b"\0")

    def directory(own: list[tuple[int, str, int]]) -> bytes:
        out, part = b"", b""
        for k, (number, name, kind) in enumerate(own):
            raw = name.encode()
            size = 8 + -(-len(raw) // 4) * 4
            more = 8 + -(-len(own[k + 1][1].encode()) // 4) * 4 if k + 1 < len(own) else 0
            if not more or len(part) + size + more > block:
                size = block - len(part)
            part += (struct.pack("<IHBB", number, size, len(raw), kind) + raw).ljust(size, b"\0")
            if len(part) == block:
                out, part = out + part, b""
        return out

    numbers, top = {}, 11
    for f in files:
        top += 1
        numbers[f.name] = top
        inode(top, f.mode | 0o100000, f, 1)
    listing = [(2, ".", 2), (2, "..", 2)]
    for n in names:
        top += 1
        inode(top, 0o40755, File(n, directory([(top, ".", 2), (2, "..", 2)] + [(numbers[f.name], f.name.rpartition("/")[2], 1) for f in tree[n]])), 2)
        listing.append((top, n, 2))
    inode(2, 0o40755, File("", directory(listing + [(numbers[f.name], f.name, 1) for f in tree[""]])), 2)
    blocks = base + len(data) // block
    sb = struct.pack("<IIIIIIIIIIIII", inodes, blocks, 0, 0, 0, 1, 0, 0, 8192 * 8, 8192 * 8, inodes, 0, 0)
    sb += struct.pack("<HHHHHHIIIIHH", 0, 0xFFFF, 0xEF53, 1, 1, 0, 0, 0, 0, 1, 0, 0) + struct.pack("<IHH", 11, width, 0) + struct.pack("<III", 0, 0x42 if extents else 2, 0)
    out = bytes(1024) + sb.ljust(1024, b"\0") + struct.pack("<III", 3, 4, table_at).ljust(block, b"\0") + bytes(2 * block)
    return out + bytes(table).ljust(table_blocks * block, b"\0") + bytes(data)


# --- partition tables, headers ------------------------------------------------------------------


def mbr(parts: list[tuple[int, int, int]]) -> bytes:
    """(type, first sector, sectors) of up to four partitions."""
    rows = b"".join(struct.pack("<B3xB3xII", 0, *p) for p in parts).ljust(64, b"\0")
    return bytes(446) + rows + b"\x55\xaa"


def gpt(parts: list[tuple[str, int, int]], sector: int = 512) -> bytes:
    """The header and 128 entries of (name, first, last), from the sector after the first on."""
    rows = b"".join(hashlib.md5(b"type").digest() + hashlib.md5(n.encode()).digest() + struct.pack("<QQQ", a, b, 0) + n.encode("utf-16-le")[:72].ljust(72, b"\0") for n, a, b in parts).ljust(128 * 128, b"\0")
    head = bytearray(b"EFI PART" + struct.pack("<IIIIQQQQ", 0x10000, 92, 0, 0, 1, 0, 34, 0) + hashlib.md5(b"disk").digest() + struct.pack("<QIII", 2, 128, 128, zlib.crc32(rows)))
    head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)))
    return bytes(sector) + bytes(head).ljust(sector, b"\0") + rows


def elf32(section: bytes, name: str = ".modinfo", machine: int = 40) -> bytes:
    """A relocatable file with one section besides its names."""
    names = b"\0" + name.encode() + b"\0.names\0"
    head = b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 1, machine, 1, 0, 0, 52 + len(section) + len(names), 0, 52, 0, 0, 40, 3, 2)
    table = bytes(40) + struct.pack("<10I", 1, 1, 0, 0, 52, len(section), 0, 0, 0, 0) + struct.pack("<10I", len(name) + 2, 3, 0, 0, 52 + len(section), len(names), 0, 0, 0, 0)
    return head + section + names + table


def luks1(payload_sectors: int) -> bytes:
    head = b"LUKS\xba\xbe" + struct.pack(">H", 1) + b"aes".ljust(32, b"\0") + b"xts-plain64".ljust(32, b"\0") + b"sha256".ljust(32, b"\0") + struct.pack(">II", payload_sectors, 32)
    return head.ljust(168, b"\0") + b"00000000-0000-0000-0000-000000000007".ljust(40, b"\0") + bytes(384)


def luks2(size: int) -> bytes:
    """A header of ``size`` bytes, as long as it says."""
    return (b"LUKS\xba\xbe" + struct.pack(">HQ", 2, size)).ljust(size, b"\0")


def verity(blocks: int, block: int = 4096) -> bytes:
    return (b"verity\0\0" + struct.pack("<II", 1, 1) + bytes(16) + b"sha256".ljust(32, b"\0") + struct.pack("<IIQ", block, block, blocks)).ljust(512, b"\0")


# --- lzo, ucl, lzop -----------------------------------------------------------------------------


def matches(raw: bytes, far: int, least: int = 4) -> list[tuple[bytes, int, int]]:
    """(literals, distance, length) of a greedy parse by the last place of each ``least`` bytes; the last has no match."""
    out, seen, at, done = [], {}, 0, 0
    while at + least <= len(raw):
        key = raw[at : at + least]
        back = at - seen.get(key, at)
        seen[key] = at
        if 0 < back <= far:
            n = least
            while at + n < len(raw) and raw[at + n] == raw[at + n - back]:
                n += 1
            out.append((raw[done:at], back, n))
            at += n
            done = at
        else:
            at += 1
    return [*out, (raw[done:], 0, 0)]


def lzo1x(raw: bytes) -> bytes:
    """An LZO1X block: literal runs, and matches within 16 KiB."""
    out = bytearray()

    def run_on(n: int) -> bytes:
        """The bytes that carry a length on."""
        return b"\0" * ((n - 1) // 255) + bytes([(n - 1) % 255 + 1])

    def literals(part: bytes) -> None:
        n = len(part)
        if not out and 0 < n <= 238:
            out.append(17 + n)
        elif n <= 3:
            out[-2] |= n  # in the low bits of the match before
        else:
            out.extend(bytes([n - 3]) if n <= 18 else b"\0" + run_on(n - 18))
        out.extend(part)

    for part, back, n in matches(raw, 16384):
        if part:
            literals(part)
        if n:
            out.extend(bytes([32 + n - 2]) if n - 2 <= 31 else b"\x20" + run_on(n - 2 - 31))
            out.extend(struct.pack("<H", (back - 1) << 2))
    return bytes(out) + b"\x11\0\0"


def nrv2b(raw: bytes) -> bytes:
    """An NRV2B block, bits in bytes, highest first."""
    out, places = bytearray(), [0, 0]  # where the current byte of bits stands, and how many are free in it

    def bit(x: int) -> None:
        if not places[1]:
            places[0], places[1] = len(out), 8
            out.append(0)
        places[1] -= 1
        out[places[0]] |= x << places[1]

    def number(n: int) -> None:
        digits = bin(n)[3:]
        for k, d in enumerate(digits):
            bit(int(d))
            bit(k + 1 == len(digits))

    last = 1
    for part, back, n in matches(raw, 0xD000):
        for c in part:
            bit(1)
            out.append(c)
        if n:
            bit(0)
            if back == last:
                number(2)
            else:
                number((back - 1 >> 8) + 3)
                out.append(back - 1 & 255)
            last, rest = back, n - 1 - (back > 0xD00)
            bit(0 if rest > 3 else rest >> 1)
            bit(0 if rest > 3 else rest & 1)
            if rest > 3:
                number(rest - 2)
    bit(0)
    number(0x1000002)
    return bytes(out) + b"\xff"


def lzop(files: list[File], block: int = 65536) -> bytes:
    """A member per file, with checksums of the plain bytes; blocks that don't shrink are stored."""
    out = b""
    for f in files:
        name = f.name.encode()[:255]
        head = struct.pack(">HHHBBIIIIB", 0x1040, 0x20A0, 0x0940, 1, 5, 0x1, f.mode | 0o100000, f.mtime, 0, len(name)) + name
        out += b"\x89LZO\0\r\n\x1a\n" + head + struct.pack(">I", zlib.adler32(head))
        for at in range(0, len(f.body), block):
            part = f.body[at : at + block]
            packed = min(part, lzo1x(part), key=len)  # equal lengths mean stored
            out += struct.pack(">III", len(part), len(packed), zlib.adler32(part)) + packed
        out += bytes(4)
    return out


# --- squashfs -----------------------------------------------------------------------------------


def _squash(codec: str) -> Callable[[bytes], bytes]:
    alone = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20}]
    return {
        "gzip": zlib.compress, "xz": lzma.compress, "lzma": lambda x: lzma.compress(x, lzma.FORMAT_ALONE, filters=alone), "lz4": lz4_block, "lzo": lzo1x, "zstd": zstd,
    }[codec]


def squashfs(files: list[File], codec: str = "gzip", block: int = 16384) -> bytes:
    """SquashFS 4: whole blocks, tails in one fragment where they fit, tables in metadata blocks."""
    press, tree = _squash(codec), folders(files)
    body, tail, tails = bytearray(), bytearray(), []
    fragments: list[tuple[int, int]] = []

    def packed(part: bytes) -> tuple[bytes, int]:
        small = press(part)
        return (small, len(small)) if len(small) < len(part) else (part, len(part) | 1 << 24)

    def flush() -> None:
        if tail:
            raw, size = packed(bytes(tail))
            fragments.append((96 + len(body), size))
            body.extend(raw)
            tail.clear()

    placed = {}
    for f in files:
        start, sizes = 96 + len(body), []
        whole = len(f.body) // block * block
        for at in range(0, whole, block):
            part = f.body[at : at + block]
            raw, size = packed(part) if any(part) else (b"", 0)
            sizes.append(size)
            body.extend(raw)
        rest = f.body[whole:]
        where = (0xFFFFFFFF, 0)
        if rest:
            if len(tail) + len(rest) > block:
                flush()
            where = (len(fragments), len(tail))
            tail.extend(rest)
        placed[f.name] = (start, where, sizes)
    flush()

    class Table:
        """Records in metadata blocks; a place is (block's offset, offset in the block)."""

        def __init__(self):
            self.out, self.now = bytearray(), bytearray()

        def place(self) -> tuple[int, int]:
            return len(self.out), len(self.now)

        def put(self, raw: bytes) -> None:
            self.now.extend(raw)
            while len(self.now) >= 8192:
                self.cut(8192)

        def cut(self, n: int) -> None:
            part = bytes(self.now[:n])
            del self.now[:n]
            small = press(part)
            raw, head = (small, len(small)) if len(small) < len(part) else (part, len(part) | 0x8000)
            self.out.extend(struct.pack("<H", head) + raw)

        def done(self) -> bytes:
            if self.now:
                self.cut(len(self.now))
            return bytes(self.out)

    owners = sorted({0, *(f.uid for f in files), *(f.gid for f in files)})
    inodes, listings, number, refs = Table(), Table(), 0, {}
    names = sorted(x for x in tree if x)
    for f in sorted(files, key=lambda f: f.name):
        start, (fragment, offset), sizes = placed[f.name]
        number += 1
        refs[f.name] = (*inodes.place(), number, 2)
        inodes.put(struct.pack("<HHHHII", 2, f.mode, owners.index(f.uid), owners.index(f.gid), f.mtime, number) + struct.pack("<IIII", start, fragment, offset, len(f.body)) + struct.pack(f"<{len(sizes)}I", *sizes))

    def listing(items: list[tuple[str, str]]) -> tuple[int, int, int]:
        """Writes (name, key into refs) and returns where, and the size as inodes tell it."""
        at, raw, run = listings.place(), b"", []

        def flush_run() -> None:
            nonlocal raw
            if run:
                block_at, base = refs[run[0][1]][0], refs[run[0][1]][2]
                raw += struct.pack("<III", len(run) - 1, block_at, base)
                for name, key in run:
                    _, offset, own, kind = refs[key]
                    raw += struct.pack("<HhHH", offset, own - base, kind, len(name.encode()) - 1) + name.encode()
                run.clear()

        for name, key in sorted(items):
            if run and (refs[key][0] != refs[run[0][1]][0] or len(run) == 256 or abs(refs[key][2] - refs[run[0][1]][2]) > 30000):
                flush_run()
            run.append((name, key))
        flush_run()
        listings.put(raw)
        return *at, len(raw) + 3

    total = len(files) + len(names) + 1
    for n in names:
        at, offset, size = listing([(f.name.rpartition("/")[2], f.name) for f in tree[n]])
        number += 1
        refs[f"/{n}"] = (*inodes.place(), number, 1)
        wide = size > 0xFFFF
        head = struct.pack("<HHHHII", 8 if wide else 1, 0o755, owners.index(0), owners.index(0), 0, number)
        inodes.put(head + (struct.pack("<IIIIHHI", 2, size, at, total, 0, offset, 0xFFFFFFFF) if wide else struct.pack("<IIHHI", at, 2, size, offset, total)))
    at, offset, size = listing([(n, f"/{n}") for n in names] + [(f.name, f.name) for f in tree[""]])
    number += 1
    root = inodes.place()
    wide = size > 0xFFFF
    inodes.put(struct.pack("<HHHHII", 8 if wide else 1, 0o755, owners.index(0), owners.index(0), 0, number) + (struct.pack("<IIIIHHI", 2, size, at, total, 0, offset, 0xFFFFFFFF) if wide else struct.pack("<IIHHI", at, 2, size, offset, total)))

    out = bytearray(96) + body
    places = {}

    def table(name: str, rows: list[bytes]) -> None:
        width = len(rows[0]) if rows else 1
        starts = []
        for k in range(0, len(rows), 8192 // width):
            part = b"".join(rows[k : k + 8192 // width])
            starts.append(len(out))
            out.extend(struct.pack("<H", len(part) | 0x8000) + part)
        places[name] = len(out)
        out.extend(struct.pack(f"<{len(starts)}Q", *starts))

    places["inodes"] = len(out)
    out += inodes.done()
    places["listings"] = len(out)
    out += listings.done()
    table("fragments", [struct.pack("<QII", at, size, 0) for at, size in fragments])
    table("owners", [struct.pack("<I", x) for x in owners])
    none = 0xFFFFFFFFFFFFFFFF
    codec_number = ("gzip", "lzma", "lzo", "xz", "lz4", "zstd").index(codec) + 1
    out[:96] = b"hsqs" + struct.pack("<IIIIHHHHHH", total, 0, block, len(fragments), codec_number, block.bit_length() - 1, 0, len(owners), 4, 0) + struct.pack("<8Q", root[0] << 16 | root[1], len(out), places["owners"], none, places["inodes"], places["listings"], places["fragments"] if fragments else none, none)
    return _pad(bytes(out), 4096)


builder("squashfs")(lambda files: squashfs(files, "gzip"))


# --- ubifs --------------------------------------------------------------------------------------


def ubifs(states: list[list[File]], journal: bool = True, leb: int = 16384) -> bytes:
    """A volume whose index holds the first state; later states are in the journal, or, without one, in the index as well.

    Nodes are written in order, so that former states of a file, and unlinked ones, stay on the medium.
    """
    sequence, numbers, lebs, at, index = 0, {"": 1}, [b"", b"", b"", b""], [], {}
    main: list[bytes] = [b""]

    def made(kind: int, body: bytes) -> bytes:
        nonlocal sequence
        sequence += 1
        size = 24 + len(body)
        head = struct.pack("<QIBB2x", sequence, size, kind, 0)
        return struct.pack("<II", 0x06101831, crc_ubi(head + body)) + head + body

    def put(raw: bytes) -> tuple[int, int, int]:
        """Appends a node to the main area; returns its place in blocks from the area's start."""
        if len(main[-1]) + -(-len(raw) // 8) * 8 > leb:
            main.append(b"")
        where = (len(main) - 1, len(main[-1]), len(raw))
        main[-1] += _pad(raw, 8)
        return where

    def key(ino: int, kind: int, low: int) -> bytes:
        return struct.pack("<II", ino, kind << 29 | low)

    def inode(ino: int, mode: int, f: File, links: int = 1) -> None:
        body = key(ino, 0, 0) + bytes(8) + struct.pack("<QQQQQ", 0, len(f.body), f.mtime, f.mtime, f.mtime) + struct.pack("<IIIIIIIIIIII", 0, 0, 0, links, f.uid, f.gid, mode, 0, 0, 0, 0, 0)
        note(key(ino, 0, 0), made(0, body + struct.pack("<IH", 0, 0) + bytes(26)))

    pending: list[tuple[bytes, tuple[int, int, int]]] = []

    def note(k: bytes, raw: bytes) -> None:
        pending.append((k, put(raw)))

    def name(parent: int, ino: int, text: str, folder: bool) -> None:
        raw = text.encode()
        low = zlib.crc32(raw) & 0x1FFFFFFF
        note(key(parent, 2, low), made(2, key(parent, 2, low) + bytes(8) + struct.pack("<QBBHI", ino, 0, 1 if folder else 0, len(raw), 0) + raw + b"\0"))

    last: dict[str, File] = {}
    marks = []
    for state in states:
        now = {f.name: f for f in state}
        if not marks:
            inode(1, 0o40755, File("", b""), 2)
        for gone in sorted(set(last) - set(now)):
            folder, _, base = gone.rpartition("/")
            name(numbers[folder], 0, base, False)
            inode(numbers[gone], last[gone].mode | 0o100000, last[gone], 0)
        for f in sorted(state, key=lambda f: f.name):
            folder, _, base = f.name.rpartition("/")
            if folder not in numbers:
                numbers[folder] = 64 + len(numbers)
                inode(numbers[folder], 0o40755, File(folder, b""), 2)
                name(1, numbers[folder], folder, True)
            if f.name in last and last[f.name].body == f.body:
                continue
            fresh = f.name not in last
            numbers.setdefault(f.name, 64 + len(numbers))
            ino = numbers[f.name]
            for k in range(0, len(f.body), 4096):
                part = f.body[k : k + 4096]
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed = [(part, 0), (z.compress(part) + z.flush(), 2), (lzo1x(part), 1)][k // 4096 % 3]
                raw, codec = packed if len(packed[0]) < len(part) else (part, 0)
                note(key(ino, 1, k // 4096), made(1, key(ino, 1, k // 4096) + bytes(8) + struct.pack("<IHH", len(part), codec, len(raw)) + raw))
            inode(ino, f.mode | 0o100000, f)
            if fresh:
                name(numbers[folder], ino, base, False)
        last = now
        marks.append(len(pending))
        if journal and len(marks) == 1:
            main.append(b"")  # buds begin on a block of their own
    first_bud = max((w[0] for _, w in pending[: marks[0]]), default=0) + 1
    main_at = 8
    kept = pending[: marks[0]] if journal else pending
    for k, where in kept:
        index[k] = where
    index = {k: v for k, v in index.items()}
    buds = range(first_bud, len(main)) if journal and len(marks) > 1 else range(0)

    def idx(rows: list[tuple[bytes, tuple[int, int, int]]], level: int) -> bytes:
        return made(9, struct.pack("<HH", len(rows), level) + b"".join(struct.pack("<III", w[0] + main_at, w[1], w[2]) + k for k, w in rows))

    main.append(b"")
    rows = sorted(index.items(), key=lambda x: struct.unpack("<II", x[0]))
    level = 0
    while True:
        parts = [rows[k : k + 8] for k in range(0, len(rows), 8)] or [[]]
        rows = [(p[0][0] if p else bytes(8), put(idx(p, level))) for p in parts]
        if len(rows) == 1:
            break
        level += 1
    (_, (root, offset, size)), = rows
    log = made(10, struct.pack("<Q", 1)) + b"".join(made(8, struct.pack("<III", k + main_at, 0, 0) + bytes(28)) for k in buds)
    count = main_at + len(main)
    sb = bytes(2) + bytes([0, 0]) + struct.pack("<IIII", 0, 8, leb, count) + struct.pack("<I", count) + bytes(8) + struct.pack("<IIIII", 2, 1, 1, 1, 8) + bytes(4) + struct.pack("<III", 4, 2, 0)
    super_ = made(6, sb.ljust(4096 - 24, b"\0"))
    master = made(7, (struct.pack("<QQIIIII", 1000, 1, 0, 3, root + main_at, offset, size)).ljust(488, b"\0"))
    lebs = [super_, master, master, log, b"", b"", b"", b"", *main]
    return b"".join(x.ljust(leb, b"\xff") for x in lebs)


builder("ubifs")(lambda files: ubifs([files]))


# --- yaffs2 -------------------------------------------------------------------------------------


def yaffs2(states: list[list[File]], page: int = 2048, at: int = 0) -> bytes:
    """Chunks of 2 KiB and 64 spare bytes; a file's data, then its header, as a live system writes them."""
    from gneiss.formats.yaffs import parity

    spare, out, numbers, order = page // 32, [], {"": 1}, 0

    def chunk(number: int, block: int, size: int, body: bytes) -> None:
        nonlocal order
        order += 1
        raw = struct.pack("<4I", 0x1000 + order // 64, number, block, size)
        column, line, inverse = parity(raw)
        own = bytes(at) + raw + struct.pack("<B3xII", column, line & 0xFFFFFFFF, inverse)
        out.append(body.ljust(page, b"\xff") + own.ljust(spare, b"\xff"))

    def header(number: int, kind: int, parent: int, name: str, f: File, mode: int) -> None:
        raw = struct.pack("<IIH", kind, parent, 0xFFFF) + name.encode()[:255].ljust(256, b"\0")
        raw = raw.ljust(268, b"\xff") + struct.pack("<IIIIIIIi", mode, f.uid, f.gid, f.mtime, f.mtime, f.mtime, len(f.body) if kind == 1 else 0xFFFFFFFF, -1) + bytes(160)
        chunk(number, 0, 0xFFFF, raw.ljust(512, b"\xff"))

    last: dict[str, File] = {}
    for state in states:
        now = {f.name: f for f in state}
        for gone in sorted(set(last) - set(now)):
            header(numbers[gone], 1, 4, "deleted", last[gone], last[gone].mode | 0o100000)
        for f in sorted(state, key=lambda f: f.name):
            folder, _, base = f.name.rpartition("/")
            if folder not in numbers:
                numbers[folder] = 256 + len(numbers)
                header(numbers[folder], 3, 1, folder, File(folder, b""), 0o40755)
            if f.name in last and last[f.name].body == f.body:
                continue
            numbers.setdefault(f.name, 256 + len(numbers))
            for k in range(0, len(f.body), page):
                part = f.body[k : k + page]
                chunk(numbers[f.name], k // page + 1, len(part), part)
            header(numbers[f.name], 1, numbers[folder], base, f, f.mode | 0o100000)
        last = now
    return b"".join(out)


builder("yaffs2")(lambda files: yaffs2([files]))


# --- qnx ----------------------------------------------------------------------------------------


def qnx6(before: list[File], now: list[File], block: int = 1024) -> bytes:
    """Two snapshots with blocks of their own; the second superblock holds the older one."""
    blocks: list[bytes] = []
    fan = block // 4

    def store(body: bytes) -> tuple[bytes, int]:
        """A file's 16 pointers and levels."""
        at = [len(blocks) + k for k in range(-(-len(body) // block))]
        blocks.extend(body[k : k + block].ljust(block, b"\0") for k in range(0, len(body), block))
        levels = 0
        while len(at) > 16:
            up = [at[k : k + fan] for k in range(0, len(at), fan)]
            at = [len(blocks) + k for k in range(len(up))]
            blocks.extend(struct.pack(f"<{len(x)}I", *x).ljust(block, b"\xff") for x in up)
            levels += 1
        return struct.pack("<16I", *at, *[0xFFFFFFFF] * (16 - len(at))), levels

    def snapshot(files: list[File], serial: int) -> bytes:
        tree, inodes, long = folders(files), {}, []

        def inode(number: int, mode: int, f: File, body: bytes, status: int = 3) -> None:
            pointers, levels = store(body)
            inodes[number] = (struct.pack("<QIIIIIIHH", len(body), f.uid, f.gid, 0, f.mtime, f.mtime, f.mtime, mode, 0) + pointers + bytes([levels, status])).ljust(128, b"\0")

        def row(number: int, name: str) -> bytes:
            raw = name.encode()
            if len(raw) <= 27:
                return struct.pack("<IB", number, len(raw)) + raw.ljust(27, b"\0")
            long.append((struct.pack("<H", len(raw)) + raw).ljust(block, b"\0"))
            return (struct.pack("<IB3xII", number, 0xFF, len(long) - 1, 0)).ljust(32, b"\0")

        top = 1
        numbers = {}
        for f in files:
            top += 1
            numbers[f.name] = top
            inode(top, f.mode | 0o100000, f, f.body)
        listing = row(1, ".") + row(1, "..")
        for n in sorted(x for x in tree if x):
            top += 1
            inode(top, 0o40755, File(n, b""), row(top, ".") + row(1, "..") + b"".join(row(numbers[f.name], f.name.rpartition("/")[2]) for f in tree[n]))
            listing += row(top, n)
        inode(1, 0o40755, File("", b""), listing + b"".join(row(numbers[f.name], f.name) for f in tree[""]), 1)
        table = b"".join(inodes[k] for k in sorted(inodes))
        root = lambda body: (struct.pack("<Q", len(body)) + (x := store(body))[0] + bytes([x[1]])).ljust(80, b"\0")
        roots = root(table) + root(b"") + root(b"".join(long))
        return struct.pack("<QIIIHH", serial, 0, 0, 0x302, 4, 3) + bytes(16) + struct.pack("<II", block, top) + struct.pack("<I", 0) + b"COUNT---" + struct.pack("<I", 0) + roots

    old, new = snapshot(before, 15), snapshot(now, 16)

    def finished(raw: bytes) -> bytes:
        body = raw.replace(b"COUNT---", struct.pack("<II", len(blocks), 0), 1).ljust(504, b"\0")
        return struct.pack("<II", 0x68191122, _crc_be(body)) + body

    start = -(-0x3000 // block) * block
    return bytes(8192) + finished(new).ljust(start - 8192, b"\0") + b"".join(blocks) + finished(old).ljust(-(-0x1000 // block) * block, b"\0")


builder("qnx6")(lambda files: qnx6(files, files))


def qnx_ifs(files: list[File], packed: str = "ucl") -> bytes:
    """A boot image mounted at /proc/boot, its image plain, or in blocks of up to 64 KiB."""
    entries, names = b"", sorted({f.name.rpartition("/")[0] for f in files} - {""})
    size = lambda raw: -(-len(raw) // 4) * 4
    mount = b"/proc/boot\0"
    dir_at = -(-(88 + len(mount)) // 4) * 4

    def entry(ino: int, mode: int, f: File, body: bytes) -> bytes:
        raw = struct.pack("<HHIIIII", size(bytes(24) + body), 0, ino, mode, f.gid, f.uid, f.mtime) + body
        return _pad(raw, 4)

    heads = [entry(1, 0o40755, File("", b""), b"\0")] + [entry(2 + k, 0o40755, File(n, b""), n.encode() + b"\0") for k, n in enumerate(names)]
    width = sum(map(len, heads)) + sum(len(entry(0, 0, f, bytes(8) + f.name.encode() + b"\0")) for f in files) + 4
    at, bodies = dir_at + width, b""
    for k, f in enumerate(files):
        heads.append(entry(100 + k, f.mode | 0o100000, f, struct.pack("<II", at + len(bodies), len(f.body)) + f.name.encode() + b"\0"))
        bodies += _pad(f.body, 4)
    entries = b"".join(heads) + bytes(4)
    whole = dir_at + len(entries) + len(bodies) + 4
    image = b"imagefs\x02" + struct.pack("<III", whole, dir_at + len(entries) - 4, dir_at) + bytes(16) + bytes(4) + bytes(4) + bytes(40) + bytes(4) + mount
    image = image.ljust(dir_at, b"\0") + entries + bodies
    image += struct.pack("<I", -sum(struct.unpack(f"<{len(image) // 4}I", image)) & 0xFFFFFFFF)
    codes = {"none": 0, "zlib": 1, "lzo": 2, "ucl": 3, "lz4": 4}
    press = {"lzo": lzo1x, "ucl": nrv2b, "lz4": lz4_block}.get(packed)
    if press:
        # a block's length has two bytes, so it holds less than 64 KiB packed
        blocks = [press(image[k : k + 32768]) for k in range(0, len(image), 32768)]
        body = _pad(b"".join(struct.pack(">H", len(b)) + b for b in blocks) + b"\0\0", 4)
        body += struct.pack("<I", -sum(struct.unpack(f"<{len(body) // 4}I", body)) & 0xFFFFFFFF)
    else:
        body = gzip.compress(image, mtime=0) if packed == "zlib" else image
    head = b"\xeb\x7e\xff\0" + struct.pack("<HBBHH", 1, codes[packed] << 2, 0, 256, 40) + struct.pack("<IIIIIIIII", 0, 0, 0, 0, 0, 512, 512 + len(body), 0, len(image))
    start = head.ljust(508, b"\0")
    start += struct.pack("<I", -sum(struct.unpack("<127I", start)) & 0xFFFFFFFF)
    return start + body


builder("qnx-ifs")(lambda files: qnx_ifs(files))


# --- 7z -----------------------------------------------------------------------------------------


def _number(n: int) -> bytes:
    for k in range(8):
        if n < 1 << 7 * (k + 1):
            first = (0xFF << 8 - k) & 0xFF | n >> 8 * k
            return bytes([first]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


@builder("7z")
def sevenzip(files: list[File], filters: str = "lzma2", encoded: bool = True) -> bytes:
    """One solid folder, the header itself packed as well; empty files have no stream."""
    full = [f for f in files if f.body]
    plain = b"".join(f.body for f in full)

    def press(raw: bytes) -> tuple[bytes, bytes]:
        """The packed bytes and the folder that says how."""
        if filters == "lzma":
            own = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}]
            return lzma.compress(raw, lzma.FORMAT_RAW, filters=own), b"\x01\x23\x03\x01\x01" + _number(5) + bytes([(2 * 5 + 0) * 9 + 3]) + struct.pack("<I", 1 << 20)
        own = [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]
        if filters == "x86":
            chain = [{"id": lzma.FILTER_X86}, *own]
            # the branch converter gives the file, and takes what the compressor gives
            return lzma.compress(raw, lzma.FORMAT_RAW, filters=chain), b"\x02\x04\x03\x03\x01\x03\x21\x21\x01\x10" + b"\0\x01"
        if filters == "copy":
            return raw, b"\x01\x01\0"
        return lzma.compress(raw, lzma.FORMAT_RAW, filters=own), b"\x01\x21\x21" + _number(1) + bytes([16])

    def info(at: int, packed: bytes, folder: bytes, size: int, crc: int | None, more: bytes = b"") -> bytes:
        coders = folder[0]
        out = b"\x06" + _number(at) + _number(1) + b"\x09" + _number(len(packed)) + b"\0\x07\x0b" + _number(1) + b"\0" + folder + b"\x0c" + _number(size) * coders
        return out + (b"\x0a\x01" + struct.pack("<I", crc) if crc is not None else b"") + b"\0" + more + b"\0"

    body = b""
    streams = b""
    if full:
        body, folder = press(plain)
        sizes = b"".join(_number(len(f.body)) for f in full[:-1])
        parts = b"\x08\x0d" + _number(len(full)) + (b"\x09" + sizes if len(full) > 1 else b"") + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(f.body)) for f in full) + b"\0"
        streams = b"\x04" + info(0, body, folder, len(plain), None, parts)

    def bits(flags: list[bool]) -> bytes:
        out = bytearray(-(-len(flags) // 8))
        for k, x in enumerate(flags):
            out[k // 8] |= (0x80 >> k % 8) * x
        return bytes(out)

    def prop(kind: int, raw: bytes) -> bytes:
        return bytes([kind]) + _number(len(raw)) + raw

    empty = [not f.body for f in files]
    named = b"\0" + b"".join((f.name + "\0").encode("utf-16-le") for f in files)
    props = (prop(14, bits(empty)) + prop(15, bits([True] * sum(empty))) if any(empty) else b"") + prop(17, named)
    props += prop(20, b"\x01\0" + b"".join(struct.pack("<Q", f.mtime * 10_000_000 + 116444736000000000) for f in files))
    props += prop(21, b"\x01\0" + b"".join(struct.pack("<I", (f.mode | 0o100000) << 16 | 0x8000) for f in files))
    head = b"\x01" + streams + b"\x05" + _number(len(files)) + props + b"\0" + b"\0"
    if encoded:
        own = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}]
        packed = lzma.compress(head, lzma.FORMAT_RAW, filters=own)
        folder = b"\x01\x23\x03\x01\x01" + _number(5) + bytes([93]) + struct.pack("<I", 1 << 16)
        outer = b"\x17" + info(len(body), packed, folder, len(head), zlib.crc32(head))
        body, head = body + packed, outer
    start = struct.pack("<QQI", len(body), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf'\x1c\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + head


# --- kernels ------------------------------------------------------------------------------------


def kallsyms(symbols: list[tuple[int, str, str]], mode: str = "relative", word: int = 4, order: str = "<", markers: int | None = None) -> bytes:
    """A kernel's symbol table: addresses, count, names packed by a few tokens, markers, tokens and their index."""
    texts = [t + n for _, t, n in symbols]
    used = set("".join(texts)) | set("0123456789")
    spare = [k for k in range(256) if chr(k) not in used and k > 0]
    tokens = [chr(k) if chr(k) in used else "" for k in range(256)]
    for k, t in zip(spare, ("__", "init", "sys_", "module", "_t"), strict=False):
        tokens[k] = t
    whole = [(t, k) for k, t in enumerate(tokens) if len(t) > 1]

    def packed(text: str) -> bytes:
        out = bytearray()
        while text:
            t, k = next(((t, k) for t, k in whole if text.startswith(t)), (text[0], ord(text[0])))
            out.append(k)
            text = text[len(t) :]
        head = bytes([len(out)]) if len(out) < 128 else bytes([len(out) & 0x7F | 0x80, len(out) >> 7])
        return head + bytes(out)

    names, places = bytearray(), []
    for k, text in enumerate(texts):
        if k % 256 == 0:
            places.append(len(names))
        names += packed(text)
    form, base = "I" if word == 4 else "Q", symbols[0][0] if symbols else 0
    pad = lambda raw, to: raw + bytes(-len(raw) % to)
    if mode == "absolute":
        out = b"".join(struct.pack(order + form, a) for a, _, _ in symbols)
    else:
        value = (lambda a: a - base) if mode == "relative" else (lambda a: (base - 1 - a) & 0xFFFFFFFF)
        out = pad(b"".join(struct.pack(order + "I", value(a)) for a, _, _ in symbols), word) + struct.pack(order + form, base)
    out += pad(struct.pack(order + "I", len(symbols)), word)
    out += pad(bytes(names), word) + b"".join(struct.pack(order + ("I" if (markers or word) == 4 else "Q"), x) for x in places)
    table = b"".join(t.encode("latin-1") + b"\0" for t in tokens)
    index, at = [], 0
    for t in tokens:
        index.append(at)
        at += len(t) + 1
    return bytes(64) + b"\1" * 64 + bytes(-128 % 16) + out + pad(table, word) + struct.pack(order + "256H", *index)
