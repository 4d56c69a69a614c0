"""The reader of super partitions on an image made by hand."""

import hashlib
import struct

from gneiss.formats import readers


def signed(raw: bytes, at: int) -> bytes:
    return raw[:at] + hashlib.sha256(raw).digest() + raw[at + 32 :]


def image() -> bytearray:
    extents = [struct.pack("<QIQI", *x) for x in ((2, 0, 200, 0), (1, 1, 0, 0), (1, 0, 300, 0), (4, 0, 5, 1))]
    partitions = [struct.pack("<36sIIII", *x) for x in ((b"system_a", 1, 0, 3, 1), (b"vendor_a", 1, 3, 1, 0), (b"empty_b", 0, 4, 0, 0))]
    groups = [struct.pack("<36sIQ", x, 0, 0) for x in (b"default", b"main_a")]
    tables, places = b"", b""
    for part, width in ((partitions, 52), (extents, 24), (groups, 48), ([], 64)):
        places += struct.pack("<III", len(tables), len(part), width)
        tables += b"".join(part)
    head = struct.pack("<IHHI32sI32s", readers.SUPER_TABLES, 10, 0, 128, bytes(32), len(tables), hashlib.sha256(tables).digest()) + places
    geometry = signed(struct.pack("<II32sIII", readers.SUPER_MAGIC, 52, bytes(32), 4096, 2, 4096), 8)
    out = bytearray(512 * 400)
    out[4096 : 4096 + 52] = out[8192 : 8192 + 52] = geometry
    whole = signed(head, 12) + tables
    for at in (12288, 12288 + 2 * 4096):
        out[at : at + len(whole)] = whole
    out[200 * 512 : 202 * 512], out[300 * 512 : 301 * 512] = b"a" * 1024, b"b" * 512
    return out


def test_super():
    whole = image()
    system, vendor, empty = readers.read("android-super", bytes(whole))
    assert (system.path, system.content) == ("system_a", b"a" * 1024 + bytes(512) + b"b" * 512)
    assert (system.extra["group"], system.diagnostics) == ("main_a", [])
    assert (vendor.content, vendor.diagnostics, empty.content) == (b"", ["super-extent-elsewhere"], b"")
    whole[4096 + 41] ^= 1
    whole[12288 + 130] ^= 1
    again = list(readers.read("android-super", bytes(whole)))
    assert [e.content for e in again] == [system.content, b"", b""] and again[0].diagnostics == ["super-backup-tables"]
    whole[12288 + 2 * 4096 + 130] ^= 1
    assert [e.kind for e in readers.read("android-super", bytes(whole))] == ["diagnostic"]
