"""The symbol table that a kernel image carries for its own messages: names packed by tokens, markers, and addresses."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Fixed value: the digits' tokens stand next to each other, as each letter is its own token.
DIGITS = b"".join(b"%d\0" % k for k in range(10))
ZERO = ord("0")


@dataclass
class Table:
    symbols: list[tuple[int | None, str, str]]
    word: int
    order: str
    mode: str | None
    base: int | None = None


def token_table(data: bytes, at: int) -> tuple[int, list[bytes], int, str] | None:
    """(start, tokens, end of the index, byte order) of the table whose digits stand at ``at``; its index proves it."""
    start = at
    for _ in range(ZERO + 1):
        start = data.rfind(b"\0", 0, start)
        if start < 0:
            return None
    for first in (start + 1, *range(start + 2, start + 10)):
        tokens, cursor = [], first
        for _ in range(256):
            end = data.find(b"\0", cursor)
            if end < 0 or end - cursor > 64:
                break
            tokens.append(data[cursor:end])
            cursor = end + 1
        if len(tokens) < 256:
            continue
        places = [0]
        for t in tokens[:-1]:
            places.append(places[-1] + len(t) + 1)
        for order in "<>":
            for index in range(cursor, cursor + 9):
                if data[index : index + 512] == struct.pack(f"{order}256H", *places):
                    return first, tokens, index + 512, order
    return None


def _chain(data: bytes, end: int, word: int, order: str) -> tuple[int, list[int]] | None:
    """The markers that end at ``end``: words that fall to zero, from the last one back."""
    form, out, at = order + ("I" if word == 4 else "Q"), [], end
    while at >= word:
        at -= word
        (x,) = struct.unpack_from(form, data, at)
        if out and x >= out[-1] or x > len(data):
            return None
        out.append(x)
        if x == 0:
            return at, out[::-1]
    return None


def _lengths(data: bytes, at: int, n: int, end: int, markers: list[int]) -> list[tuple[int, int]] | None:
    """(place, length) of the n packed names from ``at`` on, if every 256th agrees with its marker."""
    out, start = [], at
    for k in range(n):
        if k % 256 == 0 and at - start != markers[k // 256]:
            return None
        if at >= end:
            return None
        size, at = data[at], at + 1
        if size & 0x80:  # a long name's length has a second byte
            size, at = size & 0x7F | data[at] << 7, at + 1
        if not size or at + size > end:
            return None
        out.append((at, size))
        at += size
    return out if end - at < 16 and not any(data[at:end]) else None


def _names(data: bytes, start: int, word: int, order: str) -> tuple[int, int, list[tuple[int, int]]] | None:
    """(where the count stands, a pointer's width, places of the names) before a token table.

    The recorded count is needed, not only checked; it is aligned as pointers are, so the gap behind it tells their width.
    """
    for pad in range(0, word + 1):
        if any(data[start - pad : start]):
            break
        found = _chain(data, start - pad, word, order)
        if found is None:
            continue
        at, markers = found
        most = len(markers) * 256
        # the names begin so far before the markers as the last marker and up to 256 names after it take
        for first in range(at - markers[-1] - 1, max(0, at - markers[-1] - 256 * 130 - 16), -1):
            for gap in (4, 8):
                if first < gap:
                    continue
                (n,) = struct.unpack_from(order + "I", data, first - gap)
                if most - 256 < n <= most and not any(data[first - gap + 4 : first]):
                    places = _lengths(data, first, n, at, markers)
                    if places:
                        return first - gap, gap, places
    return None


def _addresses(data: bytes, count_at: int, n: int, word: int, order: str) -> tuple[str, int | None, list[int]] | None:
    """(mode, base, addresses) of the array before the count: relative forms first, since their base stands where an absolute address would."""
    limit = 1 << 8 * word
    form = "I" if word == 4 else "Q"

    def good(values: list[int]) -> bool:
        return all(a <= b for a, b in zip(values, values[1:], strict=False)) and limit // 2 <= values[-1] < limit and 0 <= values[0]

    for pad in range(0, 9, 4):
        end = count_at - pad
        if end < word or any(data[end:count_at]):
            break
        (base,) = struct.unpack_from(order + form, data, end - word)
        for gap in (0, 4):
            at = end - word - gap - 4 * n
            if at < 0 or gap and any(data[end - word - gap : end - word]):
                continue
            raw = struct.unpack_from(f"{order}{n}I", data, at)
            if base >= limit // 2 and good(values := [base + x for x in raw]):
                return "relative", base, values
            signed = struct.unpack_from(f"{order}{n}i", data, at)
            if base >= limit // 2 and good(values := [x if x >= 0 else base - 1 - x for x in signed]):
                return "relative-percpu", base, values
        at = end - word * n
        if at >= 0 and good(values := list(struct.unpack_from(f"{order}{n}{form}", data, at))):
            return "absolute", None, values
    return None


def decode(data: bytes) -> Table | None:
    """The symbols of a kernel image in the table's order; addresses are None where only the names can be read."""
    at = data.find(DIGITS)
    while at >= 0:
        found = token_table(data, at)
        if found:
            start, tokens, _, order = found
            for word in (4, 8):
                names = _names(data, start, word, order)
                if names is None:
                    continue
                count_at, width, places = names
                full = [b"".join(tokens[b] for b in data[a : a + n]) for a, n in places]
                own = _addresses(data, count_at, len(full), width, order)
                rows = [(own[2][k] if own else None, t[:1].decode("latin-1"), t[1:].decode("latin-1")) for k, t in enumerate(full)]
                return Table(rows, width, order, own[0] if own else None, own[1] if own else None)
        at = data.find(DIGITS, at + 1)
    return None


def listing(table: Table) -> str:
    """The table as nm shows it: address, type letter and name by line; the address is blank where it is not known."""
    width = 16 if table.word == 8 else 8
    return "".join(f"{a:0{width}x} {t} {n}\n" if a is not None else f"{'':{width}} {t} {n}\n" for a, t, n in table.symbols)
