"""Images whose 16- or 32-bit words lie in reverse: detection from samples, and the corrected bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.text import swap_words

#: Magics that say that a view is the right one, and weaker signs of code.
STRONG = (
    b"\x7fELF", b"\x27\x05\x19\x56", b"hsqs", b"sqsh", b"\x85\x19\x01\xe0", b"\x85\x19\x02\xe0", b"\x85\x19\x03\x20", b"\x19\x85\xe0\x01", b"\x19\x85\xe0\x02", b"\x19\x85\x20\x03", b"UBI#", b"\x31\x18\x10\x06",
    b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", b"\x04\x22\x4d\x18", b"\x89LZO\x00\r\n\x1a\n", b"1AY&SY", b"7z\xbc\xaf\x27\x1c", b"PK\x03\x04", b"070701", b"070702", b"070707", b"ustar", b"\xd0\x0d\xfe\xed", b"\x45\x3d\xcd\x28",
    b"\x28\xcd\x3d\x45", b"-rom1fs-", b"\x03\x00\x00\x00\x01\x00\x00\x00\xff\xff", b"\x68\x19\x11\x22", b"\x22\x11\x19\x68", b"\xeb\x7e\xff\x00", b"EFI PART", b"LUKS\xba\xbe", b"verity\x00\x00", b"\x3a\xff\x26\xed",
    b"ANDROID!", b"VNDRBOOT", b"U-Boot", b"Linux version", b"-----BEGIN",
)
WEAK = (b"\x1f\x8b\x08",)

#: Magics that prose or numbers hold by chance once their words are reversed: they count with what must follow them.
FOLLOWED = {
    b"ustar": re.compile(rb"ustar(?:\0|  \0)"), b"070701": re.compile(rb"070701[0-9A-Fa-f]{24}"), b"070702": re.compile(rb"070702[0-9A-Fa-f]{24}"), b"070707": re.compile(rb"070707[0-7]{24}"),
}
NOP, BRANCH = 0xE1A00000, 0xEA00
WINDOW, BUDGET = 1 << 16, 64 << 20
STRONG_POINTS, LEAST_POINTS, LEAST_RATIO = 8, 8, 2

_RUNS, _SHAPE = re.compile(rb"[\x20-\x7e\t\n\r]{6,}"), re.compile(rb"[A-Z][a-z]")


def _ambiguous() -> frozenset[bytes]:
    """Magics whose own swap is another one: they can't tell the views apart."""
    def images(m: bytes) -> set[bytes]:
        return {swap_words(m, w) for w in (2, 4) if len(m) % w == 0}

    return frozenset(m for m in STRONG if images(m) & (set(STRONG) - {m}))


AMBIGUOUS = _ambiguous()


def scores(view: bytes) -> tuple[int, int, int]:
    """(structure, text, magics that can tell the views apart) of a view's window."""
    hits = {m: view.count(m) for m in STRONG}
    hits |= {m: len(whole.findall(view)) for m, whole in FOLLOWED.items() if hits[m]}
    words = np.frombuffer(view[: len(view) // 4 * 4], "<u4")
    strong = sum(hits.values()) + int((words == NOP).sum())
    weak = sum(view.count(m) for m in WEAK) + int((words >> 16 == BRANCH).sum())
    runs = _RUNS.findall(view)
    text = len(runs) + sum(len(_SHAPE.findall(r)) for r in runs)
    return STRONG_POINTS * strong + weak, text, sum(n for m, n in hits.items() if m not in AMBIGUOUS)


def windows(size: int, budget: int = BUDGET) -> list[int]:
    """All windows within the budget, else as many spread evenly over the image, aligned."""
    total, most = -(-size // WINDOW), max(1, budget // WINDOW)
    return [k * WINDOW for k in range(total)] if total <= most else [k * size // most // WINDOW * WINDOW for k in range(most)]


def detect(raw: bytes, budget: int = BUDGET) -> tuple[int, int, str]:
    """(width of the words that lie in reverse or 0, confidence, why)."""
    total = {w: [0, 0, 0] for w in (0, 2, 4)}
    places = windows(len(raw), budget)
    for at in places:
        part = raw[at : at + WINDOW]
        for w in total:
            for k, x in enumerate(scores(swap_words(part, w) if w else part)):
                total[w][k] += x
    shown = ", ".join(f"{'raw' if not w else f'swap{8 * w}'} {a}/{b}" for w, (a, b, _) in total.items())
    if total[0][2]:
        return 0, 0, f"the raw view has magics of its own: {shown}"
    basis = 0 if any(t[0] for t in total.values()) else 1
    a, b = (total[2][basis], total[2][1]), (total[4][basis], total[4][1])
    if a == b:
        return 0, 0, f"both swaps score alike: {shown}"
    best = 2 if a > b else 4
    score, own = total[best][basis], total[0][basis]
    if score < LEAST_POINTS or score < LEAST_RATIO * own:
        return 0, 0, f"too little tells the views apart: {shown}"
    ratio = score / max(own, 1) if own else float("inf")
    tier = lambda x, steps: max(t for least, t in steps if x >= least)
    sure = min(tier(ratio, ((2, 60), (4, 85), (8, 99))), tier(score, ((8, 60), (32, 85), (128, 99))))
    return best, sure, f"{'structure' if basis == 0 else 'text'}: {shown} in {sum(min(WINDOW, len(raw) - p) for p in places)} bytes"


def detected(c: Column) -> Column:
    """struct(width, confidence, evidence) of a binary column."""
    kind = pa.struct([("width", pa.int32()), ("confidence", pa.int32()), ("evidence", pa.string())])

    def run(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else dict(zip(("width", "confidence", "evidence"), detect(x), strict=True)) for x in raw.to_pylist()], kind)

    return F.arrow_udf(run, "struct<width:int,confidence:int,evidence:string>")(c.cast("binary"))


def corrected(c: Column, width: Column) -> Column:
    """The bytes with each word of ``width`` bytes turned; as they are for width 0. A tail shorter than a word stays."""

    def run(raw: pa.Array, widths: pa.Array) -> pa.Array:
        return pa.array([x if x is None or not w else swap_words(x, w) for x, w in zip(raw.to_pylist(), widths.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(c.cast("binary"), width.cast("int"))
