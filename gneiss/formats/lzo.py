"""LZO1X and NRV2B blocks, and the lzop file format, from their published descriptions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from gneiss.formats.codecs import CodecError
from gneiss.formats.readers import Entry, reader


def _copy(out: bytearray, back: int, n: int, most: int) -> None:
    """n bytes from ``back`` bytes ago; they may overlap what is being written."""
    if not 0 < back <= len(out) or len(out) + n > most:
        raise CodecError("a back reference outside the block")
    if back >= n:
        start = len(out) - back
        out += out[start : start + n]
    else:
        piece = bytes(out[-back:])
        out += (piece * (n // back + 1))[:n]


def lzo1x(data: bytes, most: int) -> bytes:
    """An LZO1X block of at most ``most`` bytes, up to its end mark."""
    out, at, literals = bytearray(), 0, 0

    def byte() -> int:
        nonlocal at
        if at >= len(data):
            raise CodecError("the block is cut")
        at += 1
        return data[at - 1]

    def longer(n: int, base: int) -> int:
        """A length that goes on in further bytes where its own bits are zero."""
        if n:
            return n
        while not (x := byte()):
            base += 255
        return base + x

    def take(n: int) -> None:
        nonlocal at
        if at + n > len(data) or len(out) + n > most:
            raise CodecError("literals beyond the block")
        out.extend(data[at : at + n])
        at += n

    first = byte()
    if first >= 18:
        take(first - 17)
        literals, code = min(first - 17, 4), byte()
    else:
        code = first
    while True:
        if code < 16 and not literals:
            take(longer(code, 15) + 3)
            literals, code = 4, byte()
            continue
        if code < 16:
            n, back = (2, 1) if literals < 4 else (3, 2049)
            back += (byte() << 2) + (code >> 2)
            after = code & 3
        elif code < 64:
            near = code >= 32
            n = longer(code & (31 if near else 7), 31 if near else 7) + 2
            low = byte() | byte() << 8
            back = (low >> 2) + 1 if near else 16384 + ((code & 8) << 11) + (low >> 2)
            if not near and back == 16384:
                return bytes(out)
            after = low & 3
        else:
            n = 3 + (code >> 5 & 1) if code < 128 else 5 + (code >> 5 & 3)
            back = (byte() << 3) + (code >> 2 & 7) + 1
            after = code & 3
        _copy(out, back, n, most)
        take(after)
        literals, code = after, byte()


def nrv2b(data: bytes, most: int) -> bytes:
    """An NRV2B block with bits in bytes, highest first."""
    out, at, bits, left, last = bytearray(), 0, 0, 0, 1

    def byte() -> int:
        nonlocal at
        if at >= len(data):
            raise CodecError("the block is cut")
        at += 1
        return data[at - 1]

    def bit() -> int:
        nonlocal bits, left
        if not left:
            bits, left = byte(), 8
        left -= 1
        return bits >> left & 1

    def number() -> int:
        n = 1
        while True:
            n = n * 2 + bit()
            if bit():
                return n

    while True:
        while bit():
            if len(out) >= most:
                raise CodecError("literals beyond the block")
            out.append(byte())
        high = number()
        if high == 2:
            back = last
        else:
            back = (high - 3) * 256 + byte()
            if back == 0xFFFFFFFF:
                return bytes(out)
            back = last = back + 1
        n = bit() * 2
        n += bit()
        if not n:
            n = number() + 2
        _copy(out, back, n + 1 + (back > 0xD00), most)


MAGIC = b"\x89LZO\0\r\n\x1a\n"

#: The flags of checksums, extra fields and filters in an lzop header.
ADLER_D, ADLER_C, EXTRA, CRC_D, CRC_C, FILTER, CRC_HEAD = 0x1, 0x2, 0x40, 0x100, 0x200, 0x800, 0x1000


@dataclass
class Member:
    name: str
    method: int
    mode: int
    mtime: int
    sound: bool
    end: int | None = None
    blocks: list[tuple[int, int, int, list[int]]] = field(default_factory=list)


def member(data: bytes, at: int) -> Member:
    """An lzop member's header and block places; end is None where the blocks don't reach their terminator."""
    if data[at : at + 9] != MAGIC:
        raise ValueError("no lzop member")
    (version,) = struct.unpack_from(">H", data, at + 9)
    cursor, later = at + 13, version >= 0x0940
    if later:
        cursor += 2
    method = data[cursor]
    cursor += 2 if later else 1
    (flags,) = struct.unpack_from(">I", data, cursor)
    cursor += 8 if flags & FILTER else 4
    mode, mtime = struct.unpack_from(">II", data, cursor)
    cursor += 12 if later else 8
    size = data[cursor]
    name = data[cursor + 1 : cursor + 1 + size].decode("utf-8", "surrogateescape")
    cursor += 1 + size
    head = data[at + 9 : cursor]
    (check,) = struct.unpack_from(">I", data, cursor)
    cursor += 4
    out = Member(name, method, mode, mtime, check == (zlib.crc32(head) if flags & CRC_HEAD else zlib.adler32(head)))
    if flags & EXTRA:
        cursor += 8 + struct.unpack_from(">I", data, cursor)[0]
    while cursor + 4 <= len(data):
        (plain,) = struct.unpack_from(">I", data, cursor)
        if not plain:
            out.end = cursor + 4
            break
        if cursor + 8 > len(data):
            break
        (packed,) = struct.unpack_from(">I", data, cursor + 4)
        own = [f for f in (ADLER_D, CRC_D) if flags & f]
        more = [f for f in (ADLER_C, CRC_C) if flags & f] if packed < plain else []
        checks = list(struct.unpack_from(f">{len(own)}I", data, cursor + 8))
        body = cursor + 8 + 4 * (len(own) + len(more))
        if packed > plain or body + packed > len(data):
            break
        out.blocks.append((body, packed, plain, [c if f == CRC_D else -c - 1 for f, c in zip(own, checks, strict=True)]))
        cursor = body + packed
    return out


def payload(data: bytes, m: Member) -> tuple[bytes, list[str]]:
    """A member's bytes; a damaged block ends them with a diagnostic."""
    out, notes = bytearray(), []
    for at, packed, plain, checks in m.blocks:
        raw = data[at : at + packed]
        try:
            body = raw if packed == plain else zlib.decompress(raw) if m.method == 128 else lzo1x(raw, plain)
        except (CodecError, zlib.error) as e:
            return bytes(out), [f"lzop-block-damaged: {e}"]
        if len(body) != plain or any(c != (zlib.crc32(body) if c >= 0 else -zlib.adler32(body) - 1) for c in checks):
            notes = ["lzop-checksum-mismatch"]
        out += body
    return bytes(out), notes + ([] if m.end is not None else ["lzop-truncated"])


@reader("lzop")
def lzop(data: bytes) -> Iterator[Entry]:
    members, at = [], 0
    while at is not None and data[at : at + 9] == MAGIC:
        members.append(member(data, at))
        at = members[-1].end
    if not members:
        raise ValueError("no lzop member")
    for k, m in enumerate(members):
        body, notes = payload(data, m)
        extra = {"name": m.name} if m.name else {}
        yield Entry("payload" if len(members) == 1 else f"payload{k}", "regular", body, m.mode & 0o7777, mtime=m.mtime, extra=extra, diagnostics=notes if m.sound else ["lzop-header-checksum-mismatch", *notes])
