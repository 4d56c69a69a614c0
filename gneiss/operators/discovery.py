"""Discovery: signatures searched in chunks, hits validated, aligned, capped and resolved."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.formats import validators
from gneiss.operators import intervals
from gneiss.sources.builtin import SIGNATURES

CATEGORIES = ("filesystem", "container", "partition-table", "compressed", "crypto", "other")
MAX_HITS = 1_000_000


class SignatureError(ValueError):
    pass


@dataclass(frozen=True)
class Signature:
    name: str
    format: str
    category: str
    magic: bytes
    magic_offset: int = 0
    alignment: int = 1
    endian: str | None = None
    validator: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


def builtin() -> list[Signature]:
    return [Signature(*row) for row in SIGNATURES]


def load_toml(text: str, known: list[Signature] = ()) -> list[Signature]:
    """known and the file's signatures; a bad file adds nothing and raises."""
    out = list(known)
    keys = {"name", "format", "category", "magic", "hex", "magic_offset", "alignment", "endian", "validator", "description", "references"}
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SignatureError(str(e)) from e
    for s in doc.get("signature", []):
        if ("magic" in s) == ("hex" in s):
            raise SignatureError(f"{s.get('name')}: either magic or hex")
        try:
            magic = s["magic"].encode() if "magic" in s else bytes.fromhex("".join(s["hex"].split()))
        except ValueError as e:
            raise SignatureError(f"{s.get('name')}: {e}") from e
        if len(magic) < 2 or not s.get("name") or not s.get("format") or s.get("category") not in CATEGORIES:
            raise SignatureError(f"{s.get('name')}: name, format, a known category and two bytes of magic are needed")
        if any(x.name == s["name"] for x in out):
            raise SignatureError(f"{s['name']}: the name is taken")
        out.append(Signature(s["name"], s["format"], s["category"], magic, s.get("magic_offset", 0), s.get("alignment", 1), s.get("endian"), s.get("validator"), {k: v for k, v in s.items() if k not in keys}))
    return out


def overlap(signatures: list[Signature]) -> int:
    """Bytes that a chunk must hold beyond its core, so that no hit is lost at its end."""
    return max(len(s.magic) for s in signatures) - 1


def places(data: bytes, magic: bytes, end: int | None = None, start: int = 0) -> Iterator[int]:
    """All places of a magic from ``start`` that start before ``end``, overlapping ones too, at the speed of a byte search."""
    stop = len(data) if end is None else min(len(data), end + len(magic) - 1)
    at = data.find(magic, start, stop)
    while at >= 0:
        yield at
        at = data.find(magic, at + 1, stop)


#: Bytes of a page that is looked at as a whole.
PAGE = 4096


def busy(data: bytes, reach: int) -> list[tuple[int, int]]:
    """Spans outside of which no magic of up to ``reach`` bytes can lie, but for magics of one byte throughout.

    Left out is the inside of runs of pages that hold one byte only; a magic that touches another byte begins or
    ends within ``reach`` of a run's end.
    """
    words = np.frombuffer(data, "<u8", len(data) // PAGE * (PAGE // 8)).reshape(-1, PAGE // 8)
    first = words[:, 0]
    quiet = (first == (first & 0xFF) * 0x0101010101010101) & (words[:, -1] == first)
    quiet[quiet] = (words[quiet] == first[quiet, None]).all(axis=1)
    edges = np.flatnonzero(np.concatenate(([True], (quiet[1:] != quiet[:-1]) | (quiet[1:] & (first[1:] != first[:-1])), [True]))) if len(first) else np.zeros(0, int)
    out, start = [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        inner = (a * PAGE + reach - 1 if a else 0, b * PAGE - reach + 1 if b * PAGE < len(data) else len(data))
        if quiet[a] and inner[0] < inner[1]:
            out.append((start, inner[0]))
            start = inner[1]
    out.append((start, len(data)))
    return [x for x in out if x[0] < x[1]]


def magic_hits(chunks: DataFrame, signatures: list[Signature]) -> DataFrame:
    """(source_id, signature, offset): all places of all magics in chunks (source_id, chunk_off, core_len, content).

    A hit belongs to the chunk in whose core its magic starts, so overlaps count none twice. The
    offset is where the structure starts; negative ones and misaligned ones are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, names, offsets = [], [], []
            for source, base, core, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in signatures:
                    for place in places(data, s.magic, core):
                        at = base + place - s.magic_offset
                        if at >= 0 and at % s.alignment == 0:
                            sources.append(source)
                            names.append(s.name)
                            offsets.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64())], ["source_id", "signature", "offset"])

    return chunks.select("source_id", "chunk_off", "core_len", "content").mapInArrow(run, "source_id string, signature string, offset long")


_FOUND = "image_id string, offset long, size long, confidence int, format string, category string, signature string, evidence string, attrs string, diagnostics string"


def scan(blobs: DataFrame, signatures: list[Signature] | None = None, max_hits: int = MAX_HITS) -> DataFrame:
    """Findings of blobs (source_id, content), resolved: kept ones have a null owner, absorbed ones their owner's place.

    Blobs are rows of bounded size (binaryFile's limit is 2 GiB); larger images come as chunks through magic_hits.
    An image's finds are known where its bytes are, so they are resolved there, without a shuffle. Of an image with more than ``max_hits`` finds
    the first stay, and the last of them says scan-hit-limit.
    """
    signatures = signatures if signatures is not None else builtin()
    schema = f"{_FOUND}, place long, owner long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = findings_of(data or b"", signatures)
                if len(found) > max_hits:
                    found = found[:max_hits]
                    found[-1][1].diagnostics.append("scan-hit-limit")
                owners = intervals.owners([intervals.Find(f.offset, f.size, f.confidence, f.format, s.category) for s, f, _ in found])
                rows = [(source, f.offset, f.size, f.confidence, f.format, s.category, s.name, said, json.dumps(f.attrs), json.dumps(f.diagnostics), k, owners[k]) for k, (s, f, said) in enumerate(found)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = blobs.select("source_id", F.col("content").cast("binary")).mapInArrow(run, schema)
    return found.withColumns({"attrs": F.from_json("attrs", "map<string,string>"), "diagnostics": F.from_json("diagnostics", "array<string>")})


def findings_of(data: bytes, signatures: list[Signature]) -> list[tuple[Signature, validators.Finding, str]]:
    """The validated hits of all signatures in an image, in the total order of finds, with the text of their evidence."""
    found = []
    spans = busy(data, max((len(s.magic) for s in signatures), default=1))
    for s in signatures:
        end = -1
        whole = [(0, len(data))] if len(set(s.magic)) == 1 else spans
        for place in (p for a, b in whole for p in places(data, s.magic, b - len(s.magic) + 1, a)):
            at = place - s.magic_offset
            if at < 0 or at % s.alignment or at < end:
                continue
            f = validators.validate(s, data, at)
            if f is None:
                continue
            if f.confidence >= 85 and f.size and f.offset == at:
                end = at + f.size
            found.append((s, f, validators.evidence(s, place)))
    return sorted(found, key=lambda x: (x[1].offset, -x[1].confidence, -x[1].size, x[0].name, x[1].format))
