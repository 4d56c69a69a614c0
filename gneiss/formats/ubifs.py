"""UBIFS in a reassembled volume: superblock, newest master node, index, journal, and what older nodes still tell."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from gneiss.formats import codecs, lzo
from gneiss.formats.readers import KINDS, Entry, reader

MAGIC, BLOCK = 0x06101831, 4096

#: Node types, key types and codecs.
INO, DATA, DENT, XENT, TRUN, SB, MST, REF, IDX, CS = 0, 1, 2, 3, 4, 6, 7, 8, 9, 10
CODECS = ("none", "lzo", "zlib", "zstd")
ROOT = 1


@dataclass
class Node:
    sqnum: int
    kind: int
    raw: bytes
    at: int


def node(data: bytes, at: int) -> Node | None:
    """The node at a place, if its magic, length and checksum hold."""
    from gneiss.formats.validators import crc_ubi

    if at + 24 > len(data):
        return None
    magic, crc, sqnum, size, kind = struct.unpack_from("<IIQIB", data, at)
    if magic != MAGIC or not 24 <= size <= len(data) - at or crc_ubi(data[at + 8 : at + size]) != crc:
        return None
    return Node(sqnum, kind, data[at : at + size], at)


def key(raw: bytes, at: int = 24) -> tuple[int, int, int]:
    """(inode, key type, block or hash)."""
    ino, word = struct.unpack_from("<II", raw, at)
    return ino, word >> 29, word & 0x1FFFFFFF


@dataclass
class State:
    """What a set of nodes adds up to; later nodes win by sequence number."""

    inodes: dict[int, Node] = field(default_factory=dict)
    blocks: dict[int, dict[int, Node]] = field(default_factory=lambda: defaultdict(dict))
    names: dict[tuple[int, bytes], Node] = field(default_factory=dict)

    def apply(self, n: Node) -> None:
        def newer(old: Node | None) -> bool:
            return old is None or old.sqnum <= n.sqnum

        if n.kind == INO and newer(self.inodes.get(key(n.raw)[0])):
            self.inodes[key(n.raw)[0]] = n
        elif n.kind == DATA:
            ino, _, block = key(n.raw)
            if newer(self.blocks[ino].get(block)):
                self.blocks[ino][block] = n
        elif n.kind == DENT:
            name = (key(n.raw)[0], dent(n)[2])
            if newer(self.names.get(name)):
                self.names[name] = n
        elif n.kind == TRUN:
            (ino,), (size,) = struct.unpack_from("<I", n.raw, 24), struct.unpack_from("<Q", n.raw, 48)
            for block in [b for b, x in self.blocks[ino].items() if b >= -(-size // BLOCK) and x.sqnum < n.sqnum]:
                del self.blocks[ino][block]


def dent(n: Node) -> tuple[int, int, bytes]:
    """(inode, type, name) of a directory entry."""
    (ino,) = struct.unpack_from("<Q", n.raw, 40)
    (size,) = struct.unpack_from("<H", n.raw, 50)
    return ino, n.raw[49], n.raw[56 : 56 + size]


class Volume:
    def __init__(self, data: bytes):
        self.data = data
        sb = node(data, 0)
        if sb is None or sb.kind != SB:
            raise ValueError("no sound superblock")
        self.min_io, self.leb, self.count = struct.unpack_from("<III", sb.raw, 32)
        (self.log_lebs,) = struct.unpack_from("<I", sb.raw, 56)
        if self.leb < 4096 or self.leb % 8:
            raise ValueError("a block size that does not exist")
        self.notes: list[str] = []

    def lebs(self) -> range:
        return range(0, len(self.data), self.leb)

    def in_leb(self, number: int, offset: int = 0) -> Iterator[Node]:
        """The nodes of an erase block from a place on, up to the first that is not sound."""
        at, end = number * self.leb + offset, (number + 1) * self.leb
        while at + 24 <= min(end, len(self.data)):
            n = node(self.data, at)
            if n is None:
                return
            yield n
            at += -(-len(n.raw) // 8) * 8
            while at + 4 <= end and self.data[at : at + 4] == b"\0\0\0\0":
                at += 8

    def master(self) -> Node:
        found = [n for k in (1, 2) for n in self.in_leb(k) if n.kind == MST]
        if not found:
            raise ValueError("no sound master node")
        return max(found, key=lambda n: (struct.unpack_from("<Q", n.raw, 32)[0], n.sqnum))

    def leaves(self, lnum: int, offset: int, seen: set[int]) -> Iterator[Node]:
        """The leaf nodes that the index reaches."""
        at = lnum * self.leb + offset
        n = node(self.data, at)
        if n is None or n.kind != IDX or at in seen:
            self.notes.append("ubifs-bad-index-node")
            return
        seen.add(at)
        count, level = struct.unpack_from("<HH", n.raw, 24)
        for k in range(count):
            below, where, _ = struct.unpack_from("<III", n.raw, 28 + 20 * k)
            if level:
                yield from self.leaves(below, where, seen)
            else:
                leaf = node(self.data, below * self.leb + where)
                if leaf is None:
                    self.notes.append("ubifs-bad-node")
                else:
                    yield leaf

    def committed(self) -> State:
        """The index's state with the journal replayed on it."""
        m = self.master()
        (commit,) = struct.unpack_from("<Q", m.raw, 32)
        log, root, offset = struct.unpack_from("<III", m.raw, 44)
        state = State()
        for n in self.leaves(root, offset, set()):
            state.apply(n)
        refs, started = [], False
        for k in range(self.log_lebs):
            for n in self.in_leb(3 + (log - 3 + k) % max(1, self.log_lebs)):
                if n.kind == CS:
                    started = struct.unpack_from("<Q", n.raw, 24)[0] == commit
                elif n.kind == REF and started:
                    refs.append(struct.unpack_from("<II", n.raw, 24))
        if not started:
            self.notes.append("ubifs-journal-unreplayed")
        later = [n for lnum, start in refs for n in self.in_leb(lnum, start)]
        for n in sorted(later, key=lambda n: n.sqnum):
            state.apply(n)
        return state

    def sweep(self) -> list[Node]:
        """All sound inode, data and name nodes on the medium, oldest first."""
        out, raw = [], struct.pack("<I", MAGIC)
        at = self.data.find(raw)
        while at >= 0:
            n = node(self.data, at) if at % 8 == 0 else None
            if n is not None and n.kind in (INO, DATA, DENT, TRUN):
                out.append(n)
            at = self.data.find(raw, at + 1)
        return sorted(out, key=lambda n: n.sqnum)


def block_of(n: Node) -> bytes:
    """A data node's bytes."""
    size, codec, _ = struct.unpack_from("<IHH", n.raw, 40)
    raw, size = n.raw[48:], min(size, BLOCK)
    kind = CODECS[codec] if codec < len(CODECS) else "unknown"
    if kind == "none":
        return raw[:size]
    if kind == "lzo":
        return lzo.lzo1x(raw, size)
    return codecs.decompress("deflate" if kind == "zlib" else kind, raw, size)


def _entry(volume: Volume, path: str, ino: int, n: Node, blocks: dict[int, Node], **more) -> Entry:
    _, size = struct.unpack_from("<QQ", n.raw, 40)
    (mtime,) = struct.unpack_from("<Q", n.raw, 72)
    uid, gid, mode, _, inline = struct.unpack_from("<IIIII", n.raw, 96)
    kind, body, target, notes = KINDS.get(mode & 0o170000, "regular"), None, None, []
    if kind == "symlink":
        target = n.raw[160 : 160 + inline].decode("utf-8", "surrogateescape")
    elif kind == "regular":
        if size > max(len(volume.data) * codecs.MAX_RATIO, 1 << 20):
            raise ValueError("a file beyond all ratios")
        out = bytearray(size)
        for block, d in blocks.items():
            at = block * BLOCK
            if at < size:
                try:
                    part = block_of(d)[: size - at]
                    out[at : at + len(part)] = part
                except codecs.CodecError as e:
                    notes = [f"ubifs-data: {e}"]
        body = bytes(out)
    return Entry(path, kind, body, mode & 0o7777, uid, gid, mtime, target, ino, diagnostics=notes, **more)


@reader("ubifs")
def ubifs(data: bytes) -> Iterator[Entry]:
    """The tree as a mount would show it; then unlinked files and earlier states, from nodes that still lie on the medium."""
    volume = Volume(data)
    state = volume.committed()
    paths: dict[int, str] = {}

    def walk(parent: int, base: str, depth: int = 0) -> Iterator[Entry]:
        own = sorted((name[1], n) for name, n in state.names.items() if name[0] == parent)
        for raw, n in own:
            ino, _, _ = dent(n)
            found = state.inodes.get(ino)
            if not ino or found is None:
                continue
            path = base + raw.decode("utf-8", "surrogateescape")
            if ino in paths and struct.unpack_from("<I", found.raw, 104)[0] & 0o170000 != 0o040000:
                yield Entry(path, "hardlink", link_target=paths[ino], inode=ino)
                continue
            paths[ino] = path
            made = _entry(volume, path, ino, found, state.blocks.get(ino, {}))
            yield made
            if made.kind == "directory" and depth < 64:
                yield from walk(ino, f"{path}/", depth + 1)

    yield from walk(ROOT, "")
    yield from _history(volume, state, paths)
    if volume.notes:
        yield Entry("", "diagnostic", diagnostics=sorted(set(volume.notes)))


def _history(volume: Volume, state: State, paths: dict[int, str]) -> Iterator[Entry]:
    nodes = volume.sweep()
    inodes, blocks, names = defaultdict(list), defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for n in nodes:
        if n.kind == INO:
            inodes[key(n.raw)[0]].append(n)
        elif n.kind == DATA:
            blocks[key(n.raw)[0]][key(n.raw)[2]].append(n)
        elif n.kind == DENT:
            names[key(n.raw)[0], dent(n)[2]].append(n)
    gone: dict[int, tuple[str, int]] = {}
    where = dict(paths)
    for (parent, raw), own in sorted(names.items(), key=lambda x: x[1][0].sqnum):
        ino = dent(own[0])[0]
        if ino and ino not in where:
            above = where.get(parent) if parent != ROOT else ""
            if above is not None:
                where[ino] = f"{above}/{raw.decode('utf-8', 'surrogateescape')}".lstrip("/")
    for (_, _), own in names.items():
        if dent(own[-1])[0] == 0 and len(own) > 1:
            ino = dent(own[-2])[0]
            if ino and ino not in paths:
                gone[ino] = (where.get(ino, f"lost+found/#{ino}"), own[-1].sqnum)
    for ino in sorted(inodes):
        if ino == ROOT:
            continue
        live = state.inodes.get(ino) if ino in paths else None
        path, until = (paths[ino], None) if live else gone.get(ino, (f"lost+found/#{ino}", None))
        own = [n for n in inodes[ino] if until is None or n.sqnum <= until]
        # deleting an inode writes it once more with no links
        own = [n for n in own if struct.unpack_from("<I", n.raw, 92)[0] or live is not None]
        for k, n in enumerate(own, 1):
            if live is not None and n.sqnum == live.sqnum:
                continue
            held = {b: fit[-1] for b, all_ in blocks[ino].items() if (fit := [x for x in all_ if x.sqnum <= n.sqnum])}
            extra = {"newer_than_live": "true"} if live is not None and n.sqnum > live.sqnum else {"name_lost": "true"} if live is None and ino not in gone else {}
            yield _entry(volume, path, ino, n, held, deleted=live is None, superseded=live is not None or k < len(own), version=k, extra=extra)
