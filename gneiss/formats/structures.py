"""Structures that validators and readers share: device trees, ELF headers, DER."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: ELF machine numbers.
MACHINES = {2: "sparc", 3: "x86", 8: "mips", 20: "ppc", 21: "ppc64", 22: "s390", 40: "arm", 42: "sh", 43: "sparc64", 50: "ia64", 62: "x86-64", 94: "xtensa", 183: "aarch64", 195: "arc", 243: "riscv", 258: "loongarch"}


@dataclass
class FdtNode:
    path: str
    properties: dict[str, bytes] = field(default_factory=dict)


def fdt(data: bytes, most: int = 65536) -> list[FdtNode]:
    """The nodes of a flattened device tree, depth first; ValueError if it is none."""
    magic, total, structs, strings, _, version = struct.unpack_from(">IIIIII", data)
    if magic != 0xD00DFEED or not 16 <= version <= 17 or structs >= total or strings >= total:
        raise ValueError("no device tree")
    out: list[FdtNode] = []
    stack: list[FdtNode] = []
    at = structs
    while True:
        (token,) = struct.unpack_from(">I", data, at)
        at += 4
        if token == 1:
            end = data.index(b"\0", at)
            name = data[at:end].decode("latin-1")
            at += -(-(end + 1 - at) // 4) * 4
            base = stack[-1].path if stack else ""
            node = FdtNode("/" if not stack else f"{base.rstrip('/')}/{name}")
            out.append(node)
            stack.append(node)
            if len(out) > most or len(stack) > 64:
                raise ValueError("the tree is too large")
        elif token == 2:
            if not stack:
                raise ValueError("an end without a node")
            stack.pop()
        elif token == 3:
            size, name_at = struct.unpack_from(">II", data, at)
            end = data.index(b"\0", strings + name_at)
            if not stack or at + 8 + size > len(data):
                raise ValueError("a property outside the tree")
            stack[-1].properties[data[strings + name_at : end].decode("latin-1")] = data[at + 8 : at + 8 + size]
            at += 8 + -(-size // 4) * 4
        elif token == 9:
            return out
        elif token != 4:
            raise ValueError("an unknown token")


@dataclass
class Elf:
    bits: int
    endian: str
    kind: int
    machine: str
    end: int
    sections: dict[str, bytes]


def elf(data: bytes) -> Elf | None:
    """An ELF file's header, sections by name, and the furthest byte that its headers and sections reach."""
    if data[:4] != b"\x7fELF" or data[4] not in (1, 2) or data[5] not in (1, 2):
        return None
    o, wide = "<>"[data[5] - 1], data[4] == 2
    kind, machine = struct.unpack_from(o + "HH", data, 16)
    if wide:
        ph, sh, _, eh, phsize, phn, shsize, shn, names = struct.unpack_from(o + "QQIHHHHHH", data, 32)
    else:
        ph, sh, _, eh, phsize, phn, shsize, shn, names = struct.unpack_from(o + "IIIHHHHHH", data, 28)
    end, raw = max(eh, ph + phsize * phn, sh + shsize * shn), []
    for k in range(phn):
        if wide:
            _, off, _, _, size = struct.unpack_from(o + "4xIQQQQ", data, ph + k * phsize)
        else:
            off, _, _, size = struct.unpack_from(o + "IIII", data, ph + k * phsize + 4)
        end = max(end, off + size)
    for k in range(shn):
        if sh + (k + 1) * shsize > len(data):
            break
        form = o + ("IIQQQQ" if wide else "IIIIII")
        name, what, _, _, off, size = struct.unpack_from(form, data, sh + k * shsize)
        raw.append((name, what, off, size))
        if what != 8:
            end = max(end, off + size)
    sections = {}
    if names < len(raw):
        table = data[raw[names][2] : raw[names][2] + raw[names][3]]
        for name, what, off, size in raw:
            sections.setdefault(table[name:].split(b"\0")[0].decode("latin-1"), data[off : off + size] if what != 8 else b"")
    return Elf(64 if wide else 32, "little" if o == "<" else "big", kind, MACHINES.get(machine, str(machine)), end, sections)


def der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """(tag, content, end) of one DER element."""
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            raise ValueError("a length without bound")
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > len(data):
        raise ValueError("the element is cut")
    return tag, data[at : at + size], at + size


def der_items(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, content, at = der(data, at)
        out.append((tag, content))
    return out


def oid(content: bytes) -> str:
    parts, n = [content[0] // 40, content[0] % 40], 0
    for b in content[1:]:
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(n)
            n = 0
    return ".".join(map(str, parts))
