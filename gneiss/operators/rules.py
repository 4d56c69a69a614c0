"""Rule packs and the sweep: every rule against every item, validated, capped and ordered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions.text import glob_regex, quote_bytes
from gneiss.sources.builtin import PACKS

#: The caps, and how much of a match and its surroundings is quoted.
MAX_ITEM_BYTES, HITS_PER_RULE, MAX_HITS = 64 << 20, 64, 100_000
MATCH_QUOTE, CONTEXT_BYTES, CONTEXT_QUOTE = 160, 40, 400
SEVERITIES = ("info", "low", "medium", "high", "critical")
KINDS = ("regex", "literal", "hex", "glob-path")

#: The letters' numbers in a vehicle identification number, and the weights of its places.
VIN_VALUES = {c: int(c) for c in "0123456789"} | dict(zip("ABCDEFGH", range(1, 9), strict=True)) | dict(zip("JKLMN", range(1, 6), strict=True)) | {"P": 7, "R": 9} | dict(zip("STUVWXYZ", range(2, 10), strict=True))
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)

_HITS = "pack string, rule string, category string, severity string, node string, path string, offset long, match string, context string, item long, by_path boolean"


class RuleError(ValueError):
    """A pack that is refused as a whole; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Rule:
    pack: str
    id: str
    category: str
    kind: str
    pattern: str
    validate: str | None
    severity: str
    in_files: bool = True
    in_regions: bool = True
    description: str = ""


def vin_ok(match: bytes) -> bool:
    """The check digit of a VIN; no real one is more than half the same character."""
    v = match.decode("latin-1").upper()
    if len(v) != 17 or any(c not in VIN_VALUES for c in v):
        return False
    check = sum(VIN_VALUES[c] * w for c, w in zip(v, VIN_WEIGHTS, strict=True)) % 11
    return v[8] == ("X" if check == 10 else str(check)) and 2 * max(map(v.count, set(v))) <= 17


def luhn_ok(match: bytes) -> bool:
    """Luhn's check over the digits of a match: twelve at least, not one digit throughout."""
    d = [c - 48 for c in match if 48 <= c < 58]
    if len(d) < 12 or len(set(d)) == 1:
        return False
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0


def mac_ok(match: bytes) -> bool:
    """Six octets that are neither all 00 nor all ff."""
    octets = re.findall(rb"[0-9A-Fa-f]{2}", match)
    return len(octets) == 6 and len({o.lower() for o in octets} - {b"00"}) > 0 and {o.lower() for o in octets} != {b"ff"}


VALIDATORS = {"vin-checksum": vin_ok, "luhn": luhn_ok, "mac-not-broadcast": mac_ok}


def hex_regex(pattern: str) -> str:
    """Bytes in hex, spaces ignored, ?? or ** for any byte."""
    digits = re.sub(r"\s", "", pattern)
    if not digits or len(digits) % 2:
        raise ValueError("hex needs whole bytes")
    out = []
    for k in range(0, len(digits), 2):
        byte = digits[k : k + 2]
        out.append(r"[\x00-\xff]" if byte in ("??", "**") else f"\\x{int(byte, 16):02x}")
    return "".join(out)


def compiled(rule: Rule) -> re.Pattern:
    source = {"regex": str, "literal": re.escape, "hex": hex_regex, "glob-path": glob_regex}[rule.kind](rule.pattern)
    if rule.kind == "regex" and re.search(r"\([^()]*[+*]\)[+*]", source):
        raise ValueError("nested unbounded repetition")
    return re.compile(source.encode("latin-1") if rule.kind != "glob-path" else source)


def required(rule: Rule) -> bytes:
    """The longest run of bytes that every match of a rule holds; empty where none can be told.

    A run ends at anything that may vary. Alternatives, classes and optional parts are left out, and so are patterns
    that ignore case, so what is returned is never too much.
    """
    if rule.kind == "literal":
        return rule.pattern.encode("latin-1")
    if rule.kind == "glob-path":
        return b""
    runs, now = [], bytearray()

    def walk(items) -> None:
        nonlocal now
        for op, value in items:
            name = str(op)
            if name == "LITERAL" and value < 256:
                now.append(value)
                continue
            if name == "SUBPATTERN" and not value[1]:
                walk(value[3])
                continue
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                walk(value[2])  # once at least; what follows need not touch it
            elif name == "ATOMIC_GROUP":
                walk(value)
            if name != "AT" or value is None:
                runs.append(bytes(now))
                now = bytearray()

    source = hex_regex(rule.pattern) if rule.kind == "hex" else rule.pattern
    parsed = re._parser.parse(source.encode("latin-1"))
    if parsed.state.flags & re.IGNORECASE:
        return b""
    walk(parsed)
    return max([*runs, bytes(now)], key=len)


def parse_pack(text: str) -> list[Rule]:
    """The rules of a YAML pack; one bad rule refuses the pack."""
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError("rules-bad-yaml", str(e)) from e
    if not isinstance(doc, dict):
        raise RuleError("rules-bad-yaml", "no mapping")
    if not doc.get("pack"):
        raise RuleError("rules-no-name", "a pack needs a name")
    if doc.get("version") != 1:
        raise RuleError("rules-bad-version", str(doc.get("version")))
    if not isinstance(doc.get("rules"), list) or not doc["rules"]:
        raise RuleError("rules-no-rules", doc["pack"])
    out: list[Rule] = []
    for r in doc["rules"]:
        if not isinstance(r, dict):
            raise RuleError("rules-bad-rule", str(r))
        name = r.get("id")
        if not name:
            raise RuleError("rules-no-id", str(r))
        if any(x.id == name for x in out):
            raise RuleError("rules-duplicate-id", name)
        if not r.get("pattern"):
            raise RuleError("rules-no-pattern", name)
        if r.get("kind", "regex") not in KINDS:
            raise RuleError("rules-bad-kind", name)
        if r.get("severity", "info") not in SEVERITIES:
            raise RuleError("rules-bad-severity", name)
        if r.get("validate") not in (None, *VALIDATORS):
            raise RuleError("rules-bad-validate", name)
        scope = r.get("scope", ["files", "regions"])
        if not isinstance(scope, list) or set(scope) - {"files", "regions"}:
            raise RuleError("rules-bad-scope", name)
        if not scope:
            raise RuleError("rules-empty-scope", name)
        rule = Rule(doc["pack"], name, r.get("category", ""), r.get("kind", "regex"), r["pattern"], r.get("validate"), r.get("severity", "info"), "files" in scope, "regions" in scope, r.get("description", ""))
        try:
            compiled(rule)
        except (re.error, ValueError) as e:
            raise RuleError("rules-bad-pattern", f"{name}: {e}") from e
        out.append(rule)
    return out


def builtin(*packs: str) -> list[Rule]:
    return [Rule(p, *r[:6], "files" in r[6], "regions" in r[6]) for p in (packs or PACKS) for r in PACKS[p]]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    schema = "ord int, pack string, id string, category string, kind string, pattern string, validate string, severity string, in_files boolean, in_regions boolean, description string"
    return spark.createDataFrame([(k, r.pack, r.id, r.category, r.kind, r.pattern, r.validate, r.severity, r.in_files, r.in_regions, r.description) for k, r in enumerate(rules)], schema)


def scan_bytes(rule: Rule, pattern: re.Pattern, data: bytes, most: int | None = HITS_PER_RULE) -> Iterator[tuple[int, bytes]]:
    """(offset, match) of a rule's kept matches: successive, the next from the end of the last, also of one that failed its check; the first ``most``, or all for None."""
    check, at, kept = VALIDATORS.get(rule.validate), 0, 0
    while (most is None or kept < most) and at <= len(data) and (m := pattern.search(data, at)):
        if check is None or check(m[0]):
            kept += 1
            yield m.start(), m[0]
        at = m.start() + max(len(m[0]), 1)


def sweep(items: DataFrame, rules: list[Rule], max_hits: int | None = MAX_HITS, max_item_bytes: int | None = MAX_ITEM_BYTES, per_rule: int | None = HITS_PER_RULE) -> DataFrame:
    """All hits of ``rules`` in ``items`` (item long, node, path string, content binary, region boolean), in order.

    ``item`` is the encounter order. Paths are matched before contents, and only for files. The first
    ``max_hits`` hits in encounter order stay, and the first ``per_rule`` of a rule in an item; contents
    are read up to ``max_item_bytes``. These are the limits of an interactive scan: None lifts each. One pass over the items with all patterns compiled once
    a worker; a pattern runs only over contents that hold the bytes which every match of it holds. The only shuffle is
    that of capped hits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(r, compiled(r), required(r)) for r in rules]
        for batch in batches:
            out: list[tuple] = []
            for item, node, path, content, region in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r, p, _ in ready:
                    if r.kind == "glob-path" and not region and p.match(path or ""):
                        out.append((r.pack, r.id, r.category, r.severity, node, path, 0, quote_bytes((path or "").encode(), MATCH_QUOTE), "", item, True))
                data = (content or b"")[:max_item_bytes]
                for r, p, held in ready:
                    if r.kind != "glob-path" and (r.in_regions if region else r.in_files) and held in data:
                        for at, found in scan_bytes(r, p, data, per_rule):
                            around = data[max(0, at - CONTEXT_BYTES) : at + len(found) + CONTEXT_BYTES]
                            out.append((r.pack, r.id, r.category, r.severity, node, path, at, quote_bytes(found, MATCH_QUOTE), quote_bytes(around, CONTEXT_QUOTE), item, False))
            columns = list(zip(*out, strict=True)) if out else [()] * 11
            kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _HITS.split(", ")])

    hits = items.select("item", "node", "path", F.col("content").cast("binary"), "region").mapInArrow(run, _HITS)
    return capped(hits, max_hits)


def capped(hits: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` hits in encounter order; for None all, in no order, as nothing depends on it then."""
    order = ["item", F.col("by_path").desc(), "offset", "pack", "rule"]
    return hits if most is None else hits.orderBy(*order).limit(most)


def limit_diagnostic(hits: DataFrame, most: int | None) -> str | None:
    """The reference's warning where a sweep's hits reach its limit; none without a limit."""
    if most is None or hits.count() < most:
        return None
    return f"the sweep reached max_hits_total ({most}) and stopped; raise it, or narrow the packs, to see the rest"


def final_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy("pack", "rule", "node", "path", "offset").select("pack", "rule", "category", "severity", "node", "path", "offset", "match", "context")


def summary(hits: DataFrame) -> DataFrame:
    """(by, value, hits): counts by rule, category and severity in one pass."""
    by = F.when(F.grouping("rule") == 0, "rule").when(F.grouping("category") == 0, "category").otherwise("severity")
    sets = hits.groupingSets([["rule"], ["category"], ["severity"]], "rule", "category", "severity")
    return sets.agg(by.alias("by"), F.coalesce("rule", "category", "severity").alias("value"), F.count("*").alias("hits")).select("by", "value", "hits")


def select_files(entries: DataFrame) -> DataFrame:
    """Entries that a sweep reads: regular, written, not empty; deleted and superseded ones included."""
    return entries.where("kind = 'regular' AND written AND bytes > 0")


def select_regions(nodes: DataFrame, sources: list[str]) -> DataFrame:
    """Unclaimed regions that a sweep reads: not erased, not random, of the image or a corrected view."""
    what = F.coalesce(F.col("attrs")["entropy_class"], F.lit(""))
    return nodes.where((F.col("kind") == "region") & (F.col("location.length") > 0) & F.col("location.source_id").isin(sources) & ~what.isin("erased", "random"))


def luhn_column(c: Column) -> Column:
    """luhn_ok for a string column, without Python: no UDF, and stricter than luhn_check about digits and repeats."""
    d = F.split(F.regexp_replace(c, "[^0-9]", ""), "")
    d = F.filter(d, lambda x: x != "")
    total = F.aggregate(
        F.transform(F.reverse(d), lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise((2 * x.cast("int")) - 9 * (x.cast("int") > 4).cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return (F.size(d) >= 12) & (F.size(F.array_distinct(d)) > 1) & (total % 10 == 0)


def first_per_group(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
