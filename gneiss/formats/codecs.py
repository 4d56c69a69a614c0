"""Codecs: whole buffers, streams with their consumed length, and a guard against bombs."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

#: Fixed value: how many times its input a stream may grow.
MAX_RATIO = 1000


class CodecError(ValueError):
    pass


def stream(kind: str, data: bytes, most: int | None = None) -> tuple[bytes, int]:
    """The decoded payload and how many bytes of ``data`` it took."""
    limit = most if most is not None else max(1 << 16, len(data) * MAX_RATIO)
    if kind in ("gzip", "zlib", "deflate"):
        d = zlib.decompressobj({"gzip": 31, "zlib": 15, "deflate": -15}[kind])
        out = _run(lambda: d.decompress(data, limit + 1))
        if not d.eof:
            raise CodecError("the stream has no end" if len(out) <= limit else "the stream grows beyond its limit")
        return _within(out, limit), len(data) - len(d.unused_data)
    if kind == "bzip2":
        b = bz2.BZ2Decompressor()
        out = _run(lambda: b.decompress(data, limit + 1))
        return _ended(b, out, limit), len(data) - len(b.unused_data)
    if kind in ("xz", "lzma"):
        x = lzma.LZMADecompressor(lzma.FORMAT_XZ if kind == "xz" else lzma.FORMAT_ALONE, memlimit=1 << 30)
        out = _run(lambda: x.decompress(data, limit + 1))
        return _ended(x, out, limit), len(data) - len(x.unused_data)
    if kind == "zstd":
        import zstandard

        z = zstandard.ZstdDecompressor().decompressobj()
        out = _run(lambda: z.decompress(data))
        if not z.eof:
            raise CodecError("the stream has no end")
        return _within(out, limit), len(data) - len(z.unused_data)
    if kind == "lz4":
        return lz4_frame(data, limit)
    raise CodecError(f"unknown codec {kind}")


def _run(f):
    try:
        return f()
    except Exception as e:
        raise CodecError(str(e)) from e


def _within(out: bytes, limit: int) -> bytes:
    if len(out) > limit:
        raise CodecError("the stream grows beyond its limit")
    return out


def _ended(d, out: bytes, limit: int) -> bytes:
    _within(out, limit)
    if not d.eof:
        raise CodecError("the stream has no end")
    return out


def decompress(kind: str, data: bytes, most: int | None = None) -> bytes:
    return stream(kind, data, most)[0]


def exact(kind: str, data: bytes, size: int) -> bytes:
    out = decompress(kind, data, size)
    if len(out) != size:
        raise CodecError(f"{len(out)} bytes instead of {size}")
    return out


def raw_lzma(data: bytes, filters: list[dict], size: int) -> bytes:
    """A raw chain of filters, as 7z holds them."""
    return _run(lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size))


def lz4_block(data: bytes, most: int, before: bytes = b"") -> bytes:
    """One block: literals and back references, which may reach into what came before."""
    out, at, base = bytearray(before), 0, len(before)
    try:
        while at < len(data):
            token = data[at]
            at += 1
            n = token >> 4
            if n == 15:
                while True:
                    n += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            if at + n > len(data):
                raise CodecError("literals beyond the block")
            out += data[at : at + n]
            at += n
            if at >= len(data):
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            n = token & 15
            if n == 15:
                while True:
                    n += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            n += 4
            if not 0 < back <= len(out) or len(out) - base + n > most:
                raise CodecError("a back reference outside the block")
            start = len(out) - back
            for k in range(n):
                out.append(out[start + k])
    except IndexError as e:
        raise CodecError("the block is cut") from e
    return bytes(out[base:])


def lz4_frame(data: bytes, most: int) -> tuple[bytes, int]:
    """A frame: header, blocks, end mark; checksums are skipped."""
    if data[:4] != b"\x04\x22\x4d\x18" or len(data) < 7:
        raise CodecError("no lz4 frame")
    flags, at = data[4], 6
    at += 8 * bool(flags & 8) + 4 * bool(flags & 1) + 1
    out = b""
    while True:
        if at + 4 > len(data):
            raise CodecError("the frame is cut")
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if not size:
            return out, at + 4 * bool(flags & 4)
        n = size & 0x7FFFFFFF
        block = data[at : at + n]
        if len(block) < n:
            raise CodecError("the frame is cut")
        out += block if size >> 31 else lz4_block(block, most - len(out), b"" if flags & 32 else out[-65536:])
        if len(out) > most:
            raise CodecError("the stream grows beyond its limit")
        at += n + 4 * bool(flags & 16)


def rtime(data: bytes, size: int) -> bytes:
    """JFFS2's rtime: a byte, and how many bytes after its last occurrence to repeat."""
    last, out, at = [0] * 256, bytearray(), 0
    while len(out) < size:
        if at + 2 > len(data):
            raise CodecError("the data are cut")
        value, repeat = data[at], data[at + 1]
        at += 2
        out.append(value)
        back, last[value] = last[value], len(out)
        for _ in range(min(repeat, size - len(out))):
            out.append(out[back])
            back += 1
    return bytes(out)
