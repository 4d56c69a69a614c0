"""Validators: what stands at a signature's hit, how sure that is, how far it reaches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from gneiss.formats import codecs

MAGIC, STRUCTURAL, CONSISTENT, VERIFIED = 25, 60, 85, 99


@dataclass
class Finding:
    offset: int
    format: str
    confidence: int = MAGIC
    size: int = 0
    attrs: dict[str, str] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)


Validator = Callable[[object, bytes, int], Finding | None]
REGISTRY: dict[str, Validator] = {}


def validator(*names: str):
    def add(f: Validator) -> Validator:
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return add


def validate(signature, data: bytes, at: int) -> Finding | None:
    """The finding at a hit. Without a validator the magic is all that is known; a validator that fails says so and keeps the hit out."""
    if signature.validator is None:
        return Finding(at, signature.format)
    check = REGISTRY.get(signature.validator)
    if check is None:
        return Finding(at, signature.format, diagnostics=["validator-missing"])
    try:
        return check(signature, data, at)
    except (struct.error, IndexError, UnicodeDecodeError, codecs.CodecError, OverflowError, ValueError):
        return None


def evidence(signature, at: int) -> str:
    m = signature.magic
    shown = f'"{m.decode()}"' if all(0x20 <= b < 0x7F for b in m) else m.hex()
    return f"magic {shown} at 0x{at:x}"


def _cut(f: Finding, data: bytes) -> Finding:
    """Sizes beyond the end are clamped."""
    room = len(data) - f.offset
    if f.size > room:
        f.attrs["claimed_size"] = str(f.size)
        f.diagnostics.append("size-clamped")
        f.size = room
    return f


def _e(signature) -> str:
    return ">" if signature.endian == "big" else "<"


@validator("squashfs")
def squashfs(s, data, at):
    order = "<" if data[at : at + 4] in (b"hsqs", b"shsq") else ">"
    inodes, _, block, fragments, codec, log, _, _, major, minor = struct.unpack_from(order + "IIIIHHHHHH", data, at + 4)
    if major != 4:
        return Finding(at, "squashfs", STRUCTURAL if 1 <= major <= 3 else MAGIC, attrs={"version": f"{major}.{minor}"})
    (used,) = struct.unpack_from(order + "Q", data, at + 40)
    if block != 1 << log or not 4096 <= block <= 1 << 20 or not 1 <= codec <= 6 or used < 96:
        return None
    names = ("gzip", "lzma", "lzo", "xz", "lz4", "zstd")
    f = Finding(at, "squashfs", CONSISTENT, -(-used // 4096) * 4096, {"version": f"{major}.{minor}", "compression": names[codec - 1], "block_size": str(block), "inodes": str(inodes), "fragments": str(fragments)})
    return _cut(f, data)


@validator("jffs2")
def jffs2(s, data, at):
    order, end, nodes = _e(s), at, 0
    gap = s.extra.get("max_gap", 131072)
    cursor, mark = at, b"\x85\x19" if order == "<" else b"\x19\x85"
    while cursor + 12 <= len(data) and cursor - end <= gap:
        magic, kind, size, crc = struct.unpack_from(order + "HHII", data, cursor)
        if magic == 0x1985 and size >= 12 and _crc0(data[cursor : cursor + 8]) == crc:
            nodes += 1
            end = cursor + -(-size // 4) * 4
            cursor = end
        elif nodes:
            # the next place that may hold a node, in steps of four
            cursor = data.find(mark, cursor + 1, end + gap + 2)
            while cursor >= 0 and (cursor - end) % 4:
                cursor = data.find(mark, cursor + 1, end + gap + 2)
            if cursor < 0:
                break
        else:
            return None
    return _cut(Finding(at, "jffs2", VERIFIED if nodes else MAGIC, end - at, {"nodes": str(nodes)}), data)


def _crc0(raw: bytes) -> int:
    """CRC-32 with initial value and final xor 0."""
    return zlib.crc32(raw, 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc_ubi(raw: bytes) -> int:
    """CRC-32 with initial value -1 and no final xor."""
    return zlib.crc32(raw) ^ 0xFFFFFFFF


@validator("ubi")
def ubi(s, data, at):
    def header(k):
        return data[k : k + 4] == b"UBI#" and len(data) >= k + 64 and struct.unpack_from(">I", data, k + 60)[0] == crc_ubi(data[k : k + 60])

    if not header(at):
        return None
    peb = next((1 << n for n in range(12, 23) if header(at + (1 << n))), None)
    if peb is None:
        return Finding(at, "ubi", STRUCTURAL, attrs={"blocks": "1"})
    n = 0
    while header(at + n * peb):
        n += 1
    return Finding(at, "ubi", VERIFIED, n * peb, {"peb_size": str(peb), "blocks": str(n)})


@validator("ubifs")
def ubifs(s, data, at):
    magic, crc, _, size, kind = struct.unpack_from("<IIQIB", data, at)
    if kind != 6 or size < 4096 or crc_ubi(data[at + 8 : at + size]) != crc:
        return None
    (leb_size, leb_count) = struct.unpack_from("<II", data, at + 24 + 16)
    (min_io, leb_size, leb_count) = struct.unpack_from("<III", data, at + 32)
    return _cut(Finding(at, "ubifs", VERIFIED, leb_size * leb_count, {"leb_size": str(leb_size), "leb_count": str(leb_count)}), data)


@validator("ext")
def ext(s, data, at):
    sb = at + 1024
    inodes, blocks = struct.unpack_from("<II", data, sb)
    log, = struct.unpack_from("<I", data, sb + 24)
    per_group, = struct.unpack_from("<I", data, sb + 32)
    compat, incompat, ro = struct.unpack_from("<III", data, sb + 92)
    if log > 6 or not per_group or not inodes or not blocks:
        return None
    if incompat & 0x80:
        blocks |= struct.unpack_from("<I", data, sb + 0x150)[0] << 32
    kind = "ext4" if incompat & 0x2C0 else "ext3" if compat & 4 else "ext2"
    label = data[sb + 120 : sb + 136].split(b"\0")[0].decode("latin-1")
    return _cut(Finding(at, kind, CONSISTENT, blocks << (10 + log), {"block_size": str(1024 << log), "inodes": str(inodes), "volume_name": label}), data)


@validator("cramfs")
def cramfs(s, data, at):
    order = _e(s)
    size, flags = struct.unpack_from(order + "II", data, at + 4)
    crc, edition, blocks, files = struct.unpack_from(order + "IIII", data, at + 32)
    if data[at + 16 : at + 32] != b"Compressed ROMFS" or size < 76:
        return None
    f = _cut(Finding(at, "cramfs", CONSISTENT, size, {"files": str(files), "blocks": str(blocks)}), data)
    body = bytearray(data[at : at + size])
    body[32:36] = b"\0" * 4
    if flags & 1 and len(body) == size and zlib.crc32(bytes(body)) == crc:
        f.confidence = VERIFIED
    return f


@validator("ar")
def ar(s, data, at):
    cursor, members = at + 8, 0
    while cursor + 60 <= len(data) and data[cursor + 58 : cursor + 60] == b"`\n" and members < s.extra.get("max_members", 200000):
        size = int(data[cursor + 48 : cursor + 58].split()[0])
        members += 1
        cursor += 60 + size + size % 2
    return _cut(Finding(at, "ar", VERIFIED if members >= 2 else CONSISTENT if members else STRUCTURAL, cursor - at, {"members": str(members)}), data)


@validator("fat")
def fat(s, data, at):
    sector, cluster, reserved, tables, roots, small, media, fat16 = struct.unpack_from("<HBHBHHBH", data, at + 11)
    (large, fat32) = struct.unpack_from("<II", data, at + 32)
    if sector not in (512, 1024, 2048, 4096) or cluster & (cluster - 1) or not cluster or not 1 <= tables <= 2 or not reserved or media < 0xF0:
        return None
    sectors, table = small or large, fat16 or fat32
    clusters = (sectors - reserved - tables * table - -(-roots * 32 // sector)) // cluster
    kind = "fat32" if not fat16 else "fat12" if clusters < 4085 else "fat16"
    return _cut(Finding(at, "fat", CONSISTENT, sectors * sector, {"variant": kind, "cluster_bytes": str(cluster * sector), "sectors": str(sectors)}), data)


@validator("romfs")
def romfs(s, data, at):
    (size,) = struct.unpack_from(">I", data, at + 8)
    if size < 32:
        return None
    head = data[at : at + min(512, size)]
    head += b"\0" * (-len(head) % 4)
    good = sum(struct.unpack(f">{len(head) // 4}I", head)) & 0xFFFFFFFF == 0
    name = data[at + 16 : at + 16 + s.extra.get("max_name_len", 256)].split(b"\0")[0]
    return _cut(Finding(at, "romfs", VERIFIED if good else STRUCTURAL, size, {"volume_name": name.decode("latin-1")}), data)


@validator("cpio")
def cpio(s, data, at):
    from gneiss.formats import readers

    entries, end = readers.cpio_members(data, at, s.extra.get("max_entries", 200000))
    if not entries:
        return None
    return Finding(at, "cpio", CONSISTENT if entries[-1].path == "TRAILER!!!" else STRUCTURAL, end - at, {"entries": str(len(entries))})


@validator("tar")
def tar(s, data, at):
    cursor, entries = at, 0
    while cursor + 512 <= len(data):
        head = data[cursor : cursor + 512]
        if head == b"\0" * 512:
            cursor += 1024 if data[cursor + 512 : cursor + 1024] == b"\0" * 512 else 512
            break
        stored = int(head[148:156].split(b"\0")[0].strip() or b"0", 8)
        if sum(head[:148]) + sum(head[156:]) + 8 * 32 != stored:
            break
        size = int.from_bytes(head[125:136], "big") if head[124] & 0x80 else int(head[124:136].split(b"\0")[0].strip() or b"0", 8)
        entries += 1
        cursor += 512 + -(-size // 512) * 512
    return _cut(Finding(at, "tar", VERIFIED, cursor - at, {"entries": str(entries)}), data) if entries else None


@validator("zip")
def zip_(s, data, at):
    end = data.find(b"PK\x05\x06", at)
    if end < 0:
        return Finding(at, "zip", STRUCTURAL)
    entries, size, start = struct.unpack_from("<HII", data, end + 10)
    (comment,) = struct.unpack_from("<H", data, end + 20)
    if end - size - start > at:
        return None  # a member of an archive that begins earlier
    good = data[end - size : end - size + 4] == b"PK\x01\x02" or not entries
    return _cut(Finding(at, "zip", CONSISTENT if good else STRUCTURAL, end + 22 + comment - at, {"entries": str(entries)}), data)


@validator("7z")
def sevenzip(s, data, at):
    crc, off, size, _ = struct.unpack_from("<IQQI", data, at + 8)
    if zlib.crc32(data[at + 12 : at + 32]) != crc:
        return None
    (check,) = struct.unpack_from("<I", data, at + 28)
    good = zlib.crc32(data[at + 32 + off : at + 32 + off + size]) == check
    f = Finding(at, "7z", CONSISTENT if good else STRUCTURAL, 32 + off + size, {"version": f"{data[at + 6]}.{data[at + 7]}"}, [] if good else ["7z-header-undecodable"])
    return _cut(f, data)


@validator("uimage")
def uimage(s, data, at):
    head = bytearray(data[at : at + 64])
    crc, _, size, load, entry, body = struct.unpack_from(">IIIIII", head, 4)
    head[4:8] = b"\0" * 4
    if len(head) < 64 or zlib.crc32(bytes(head)) != crc:
        return None
    whole = zlib.crc32(data[at + 64 : at + 64 + size]) == body
    f = Finding(at, "uimage", VERIFIED if whole else CONSISTENT, 64 + size, {"name": head[32:].split(b"\0")[0].decode("latin-1"), "load": hex(load), "entry": hex(entry), "type": str(head[30]), "compression": str(head[31])})
    return _cut(f, data)


@validator("dtb", "fit")
def dtb(s, data, at):
    from gneiss.formats import structures

    nodes = structures.fdt(data[at:])
    is_fit = any(n.path == "/images" for n in nodes)
    if is_fit != (s.validator == "fit"):
        return None
    (size,) = struct.unpack_from(">I", data, at + 4)
    root = nodes[0].properties if nodes else {}
    attrs = {"nodes": str(len(nodes)), "model": root.get("model", b"").rstrip(b"\0").decode("latin-1")}
    return _cut(Finding(at, s.format, VERIFIED if is_fit else CONSISTENT, size, attrs), data)


@validator("android-boot")
def android_boot(s, data, at):
    if s.format == "android-vendor-boot":
        version, page, _, _, ramdisk = struct.unpack_from("<IIIII", data, at + 8)
        (head, dtb_size) = struct.unpack_from("<II", data, at + 2096)
        sizes = [head, ramdisk, dtb_size]
    else:
        kernel, _, ramdisk, _, second, _, _, page, version = struct.unpack_from("<IIIIIIIII", data, at + 8)
        if version >= 3:
            kernel, ramdisk = struct.unpack_from("<II", data, at + 8)
            page, sizes = 4096, [1580, kernel, ramdisk]
        else:
            sizes = [1648, kernel, ramdisk, second]
    if page not in (2048, 4096, 8192, 16384) or version > 4 and version != page:
        return None
    total = sum(-(-n // page) * page for n in sizes)
    return _cut(Finding(at, s.format, CONSISTENT, total, {"header_version": str(version), "page_size": str(page)}), data)


@validator("android-sparse")
def android_sparse(s, data, at):
    major, _, head, chunk_head, block, blocks, chunks = struct.unpack_from("<HHHHIII", data, at + 4)
    if major != 1 or head < 28 or chunk_head < 12 or not block or block % 4:
        return None
    cursor, seen = at + head, 0
    for _ in range(chunks):
        kind, _, n, total = struct.unpack_from("<HHII", data, cursor)
        if kind not in (0xCAC1, 0xCAC2, 0xCAC3, 0xCAC4) or total < chunk_head:
            return None
        seen += n if kind != 0xCAC4 else 0
        cursor += total
    return _cut(Finding(at, "android-sparse", CONSISTENT if seen == blocks else STRUCTURAL, cursor - at, {"block_size": str(block), "blocks": str(blocks), "chunks": str(chunks)}), data)


@validator("mbr")
def mbr(s, data, at):
    entries = []
    for k in range(4):
        flag, kind, start, size = struct.unpack_from("<B3xB3xII", data, at + 446 + 16 * k)
        if flag not in (0, 0x80):
            return None
        if kind:
            if not start or not size:
                return None
            entries.append(f"{k}:{start * 512}:{size * 512}:0x{kind:02x}" + (":boot" if flag else ""))
    return Finding(at, "mbr", CONSISTENT, 512, {"partitions": ";".join(entries)}) if entries else None


@validator("gpt")
def gpt(s, data, at):
    sector = s.magic_offset
    head = data[at + sector : at + sector + 92]
    size, crc = struct.unpack_from("<II", head, 12)
    blank = head[:16] + b"\0" * 4 + head[20:]
    good = size == 92 and zlib.crc32(blank) == crc
    entries_at, count, width = struct.unpack_from("<QII", head, 72)
    if count > s.extra.get("max_entries", 1024) or width < 128:
        return None
    table = data[at + entries_at * sector : at + entries_at * sector + count * width]
    good = good and zlib.crc32(table) == struct.unpack_from("<I", head, 88)[0]
    rows = []
    for k in range(min(count, len(table) // width)):
        kind, own = table[k * width : k * width + 16], table[k * width + 16 : k * width + 32]
        if any(kind):
            first, last, flags = struct.unpack_from("<QQQ", table, k * width + 32)
            name = table[k * width + 56 : k * width + 128].decode("utf-16-le", "replace").split("\0")[0]
            rows.append(f"{k}:{first * sector}:{(last - first + 1) * sector}:{guid(kind)}:{guid(own)}:{name}")
    f = Finding(at, "gpt", VERIFIED if good else STRUCTURAL, entries_at * sector + count * width, {"partitions": ";".join(rows), "disk_guid": guid(head[56:72]), "sector": str(sector)})
    return _cut(f, data)


def partition_rows(data: bytes) -> list[tuple[int, int, int, str, str]]:
    """(index, start, size, type, name) of the entries of a table at the start of a blob: the newer one where both are there."""
    from gneiss.operators.discovery import builtin

    found = [validate(s, data, 0) for s in builtin() if s.format in ("gpt", "mbr") and data[s.magic_offset : s.magic_offset + len(s.magic)] == s.magic]
    best = next((f for k in ("gpt", "mbr") for f in found if f and f.format == k), None)
    out = []
    for item in (best.attrs["partitions"].split(";") if best else []):
        parts = item.split(":", 5)
        if len(parts) >= 4 and parts[3] != "0xee":
            out.append((int(parts[0]), int(parts[1]), int(parts[2]), parts[3], parts[5] if len(parts) > 5 else ""))
    return out


def guid(raw: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", raw)
    return f"{a:08x}-{b:04x}-{c:04x}-{raw[8:10].hex()}-{raw[10:16].hex()}"


@validator("gzip", "xz", "lzma", "bzip2", "lz4", "zstd")
def compressed(s, data, at):
    most = min(s.extra.get("max_payload", 1 << 32), (len(data) - at) * s.extra.get("max_ratio", codecs.MAX_RATIO))
    payload, used = codecs.stream(s.validator, data[at:], most)
    return Finding(at, s.format, CONSISTENT, used, {"payload_bytes": str(len(payload))})


@validator("elf")
def elf(s, data, at):
    from gneiss.formats import structures

    e = structures.elf(data[at:])
    return _cut(Finding(at, "elf", CONSISTENT, e.end, {"class": str(e.bits), "endian": e.endian, "machine": e.machine, "type": str(e.kind)}), data) if e else None


@validator("luks")
def luks(s, data, at):
    (version,) = struct.unpack_from(">H", data, at + 6)
    if version == 1:
        (start,) = struct.unpack_from(">I", data, at + 104)
        text = lambda a, n: data[at + a : at + a + n].split(b"\0")[0].decode("latin-1")
        return _cut(Finding(at, "luks", CONSISTENT, start * 512, {"version": "1", "cipher": f"{text(8, 32)}-{text(40, 32)}", "hash": text(72, 32), "uuid": text(168, 40)}), data)
    (size,) = struct.unpack_from(">Q", data, at + 8)
    return _cut(Finding(at, "luks", CONSISTENT, size, {"version": str(version)}), data) if version == 2 and 4096 <= size <= s.extra.get("max_json", 1 << 22) else None


@validator("verity")
def verity(s, data, at):
    version, kind = struct.unpack_from("<II", data, at + 8)
    block, hashed, n = struct.unpack_from("<IIQ", data, at + 64)
    if version != 1 or kind > 1 or block & (block - 1) or hashed & (hashed - 1) or not block or not hashed:
        return None
    algorithm = data[at + 32 : at + 64].split(b"\0")[0].decode("latin-1")
    width = {"sha1": 20, "sha256": 32, "sha512": 64}.get(algorithm)
    levels, rows = 0, n
    while width and rows > 1:
        rows = -(-rows * (1 << (width - 1).bit_length()) // hashed)
        levels += rows
    return _cut(Finding(at, "dm-verity", CONSISTENT, hashed * (1 + levels), {"algorithm": algorithm, "data_blocks": str(n)}), data)


@validator("lzop")
def lzop(s, data, at):
    """Block lengths stand in the stream, so a member's end is found without unpacking."""
    from gneiss.formats import lzo

    first = lzo.member(data, at)
    attrs = {"method": str(first.method), "name": first.name}
    if not first.sound:
        return Finding(at, "lzop", MAGIC, 0, attrs, ["lzop-header-checksum-mismatch"])
    end, members = first.end, 1
    while end is not None and data[end : end + 9] == lzo.MAGIC:
        end, members = lzo.member(data, end).end, members + 1
    if end is None:
        return Finding(at, "lzop", STRUCTURAL, 0, attrs | {"extent": "unknown"})
    return Finding(at, "lzop", CONSISTENT, end - at, attrs | {"members": str(members)})


@validator("qnx6")
def qnx6(s, data, at):
    """Sized so that the second superblock lies inside; the sound one with the higher serial is the current one."""
    from gneiss.formats import qnx

    found = qnx.snapshots(data, at)
    now, first = found[0], qnx.Snapshot(data[at:], 8192, _e(s))
    size = first.second + qnx.up(0x1000, first.block)
    f = Finding(at, "qnx6", VERIFIED if now.sound else STRUCTURAL, size, {"block_size": str(now.block), "inodes": str(now.inodes), "serial": str(now.serial), "snapshots": str(len(found))})
    f.diagnostics += ["qnx6-superblock-bad-crc"] * any(not x.sound for x in found) + ["qnx6-superblock-single"] * (len(found) == 1)
    return _cut(f, data)


def _crc_be(raw: bytes) -> int:
    """CRC-32, most significant bit first, initial value 0."""
    from gneiss.formats import qnx

    return qnx.crc_be(raw)


@validator("android_super")
def android_super(s, data, at):
    import hashlib

    geometry = data[at + 4096 : at + 4096 + 52]
    size, checksum, metadata, slots, block = struct.unpack_from("<I32sIII", geometry, 4)
    blank = geometry[:8] + b"\0" * 32 + geometry[40:52]
    good = size == 52 and hashlib.sha256(blank).digest() == checksum
    return Finding(at, "android-super", VERIFIED if good else STRUCTURAL, 0, {"metadata_bytes": str(metadata), "slots": str(slots), "block_size": str(block)})


@validator("yaffs2")
def yaffs2(s, data, at):
    """The grid of chunks whose tags verify against their own checksum; nothing else can pass for it."""
    from gneiss.formats import yaffs

    grid = yaffs.find_grid(data, at)
    if grid is None:
        return None
    start, end, headers = yaffs.extent(data, at, grid)
    chunks = (end - start) // grid.step
    if chunks < 4 or not headers:
        return None
    return Finding(start, "yaffs2", VERIFIED, end - start, {"chunk": str(grid.page), "spare": str(grid.spare), "tags": str(grid.at), "chunks": str(chunks), "headers": str(headers)})


@validator("qnx-ifs")
def qnx_ifs(s, data, at):
    """The header's fixed fields keep out stray magics; the sum over the image's words is its checksum."""
    from gneiss.formats import qnx

    head = qnx.startup(data, at)
    if head is None:
        return None
    attrs = {"machine": str(head["machine"]), "compression": head["packed"] or "none", "startup_size": str(head["startup"])}
    if head["startup"] < 256 or head["startup"] % 4 or head["startup"] > head["stored"]:
        return Finding(at, "qnx-ifs", MAGIC, 0, attrs, ["qnx-ifs-bad-startup-size"])
    body = data[at + head["startup"] : at + head["stored"]]
    whole = at + head["stored"] <= len(data)
    sound = whole and head["packed"] != "zlib" and not qnx.word_sum(body, head["order"])
    return _cut(Finding(at, "qnx-ifs", VERIFIED if sound else CONSISTENT if whole else STRUCTURAL, head["stored"], attrs), data)
