"""Records that extractors read from files: certificates and keys, kernel modules, kernels.

An extractor is a function (path, bytes) -> Found, chosen by a test of the path and the first bytes; all
that apply run, in the order of their names. Files are rows of bounded size, so a task holds one at a time.
"""

from __future__ import annotations

import re
from base64 import b64decode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.formats import kallsyms, structures
from gneiss.functions.text import sanitize_bytes
from gneiss.operators import summaries

HEAD = 256

#: The limits on a file's bytes, a run's records and the bytes of files that extractors make.
MOST_BYTES, MOST_RECORDS, MOST_FILE_BYTES = 16 << 20, 100_000, 64 << 20

#: Folders of certificates that come with a system.
TRUST_STORES = ("etc/ssl/certs/", "usr/share/ca-certificates/", "etc/ca-certificates/", "etc/pki/tls/certs/", "system/etc/security/cacerts/")

#: Object identifiers of name parts, key types, curves and signatures.
NAME_PARTS = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "1.2.840.113549.1.9.1": "emailAddress", "0.9.2342.19200300.100.1.25": "DC", "0.9.2342.19200300.100.1.1": "UID"}
KEY_TYPES = {"1.2.840.113549.1.1.1": "rsa", "1.2.840.10045.2.1": "ec", "1.3.101.112": "ed25519", "1.3.101.113": "ed448", "1.2.840.10040.4.1": "dsa", "1.2.840.113549.1.3.1": "dh"}
CURVE_BITS = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.10": 256, "1.3.132.0.33": 224}
SIGNATURES = {
    "1.2.840.113549.1.1.4": "RSA-MD5", "1.2.840.113549.1.1.5": "RSA-SHA1", "1.2.840.113549.1.1.10": "RSASSA-PSS", "1.2.840.113549.1.1.11": "RSA-SHA256", "1.2.840.113549.1.1.12": "RSA-SHA384", "1.2.840.113549.1.1.13": "RSA-SHA512",
    "1.2.840.10045.4.1": "ecdsa-with-SHA1", "1.2.840.10045.4.3.2": "ecdsa-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.2.840.10045.4.3.4": "ecdsa-with-SHA512", "1.3.101.112": "ED25519", "1.3.101.113": "ED448",
}
WEAK_BITS = 2048

_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----(.*?)-----END \1-----", re.DOTALL)


@dataclass
class Found:
    """What an extractor read: records (kind, path, severity, identity, fields) and diagnostics (severity, code, message)."""

    records: list[tuple[str, str, str, str, dict[str, str]]] = field(default_factory=list)
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)


def pem_blocks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(label, DER) of the blocks that decode; encrypted ones are left out."""
    for m in _PEM.finditer(data):
        body = m[2]
        if b"ENCRYPTED" in body or b"ENCRYPTED" in m[1]:
            continue
        if b":" in body:
            body = body.split(b"\n\n", 1)[-1]
        try:
            yield m[1].decode(), b64decode(b"".join(body.split()), validate=True)
        except ValueError:
            continue


def _bits(number: bytes) -> int:
    return int.from_bytes(number, "big").bit_length()


def _key(algorithm: bytes, inner: bytes) -> tuple[str, int]:
    """A key's type and bits from its algorithm identifier; ``inner`` is the key itself."""
    parts = structures.der_items(algorithm)
    kind = KEY_TYPES.get(structures.oid(parts[0][1]), "other")
    if kind == "rsa":
        numbers = structures.der_items(structures.der(inner)[1])
        return kind, _bits(numbers[1 if len(numbers) > 2 else 0][1])
    if kind == "ec":
        return kind, CURVE_BITS.get(structures.oid(parts[1][1]), 0) if len(parts) > 1 and parts[1][0] == 6 else 0
    if kind in ("dsa", "dh") and len(parts) > 1:
        return kind, _bits(structures.der_items(parts[1][1])[0][1])
    return kind, {"ed25519": 256, "ed448": 456}.get(kind, 0)


def name_line(content: bytes) -> str:
    """A distinguished name as text, the last part first, special characters escaped."""
    out = []
    for _, relative in structures.der_items(content):
        parts = []
        for _, pair in structures.der_items(relative):
            (_, what), (tag, value) = structures.der_items(pair)[:2]
            label = structures.oid(what)
            text = value.decode("utf-16-be" if tag == 0x1E else "latin-1" if tag == 0x14 else "utf-8", "backslashreplace")
            text = re.sub(r'([,+"\\<>;])', r"\\\1", text)
            text = re.sub(r"^([ #])|( )$", r"\\\1\2", text)
            parts.append(f"{NAME_PARTS.get(label, label)}={text}")
        out.append("+".join(parts))
    return sanitize_bytes(",".join(reversed(out)).encode())[:300]


def _time(tag: int, value: bytes) -> datetime:
    text = value.decode("ascii")
    if tag == 0x17:  # two digits of the year, from 1950 to 2049
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return datetime.strptime(text, "%Y%m%d%H%M%SZ")


def _shown(t: datetime) -> str:
    return f"{t:%b} {t.day:2d} {t:%H:%M:%S} {t.year} GMT"


def certificate(der: bytes) -> tuple[dict[str, str], bool]:
    """The fields of a certificate, and whether its dates contradict each other."""
    (_, body), (_, algorithm) = structures.der_items(structures.der(der)[1])[:2]
    items = structures.der_items(body)
    version = items.pop(0) if items[0][0] == 0xA0 else None
    issuer, dates, subject, key = (items[k][1] for k in (2, 3, 4, 5))
    begin, end = (_time(*x) for x in structures.der_items(dates)[:2])
    (_, key_algorithm), (_, key_bits) = structures.der_items(key)[:2]
    kind, bits = _key(key_algorithm, key_bits[1:])
    extensions = {}
    for tag, content in items[6:]:
        if tag == 0xA3:
            for _, one in structures.der_items(structures.der(content)[1]):
                parts = structures.der_items(one)
                extensions[structures.oid(parts[0][1])] = parts[-1][1]
    constraints = structures.der_items(structures.der(extensions["2.5.29.19"])[1]) if "2.5.29.19" in extensions else []
    ca = (constraints[:1] and constraints[0] == (1, b"\xff")) or (version is None and subject == issuer)
    names = [sanitize_bytes(v) for t, v in structures.der_items(structures.der(extensions["2.5.29.17"])[1]) if t == 0x82] if "2.5.29.17" in extensions else []
    signature = structures.oid(structures.der_items(algorithm)[0][1])
    fields = {
        "fingerprint": sha256(der).hexdigest(), "subject": name_line(subject), "issuer": name_line(issuer), "not_before": _shown(begin), "not_after": _shown(end),
        "self_signed": str(subject == issuer).lower(), "key_type": kind, "signature": SIGNATURES.get(signature, signature), "ca": str(bool(ca)).lower(),
    }
    if bits:
        fields["key_bits"] = str(bits)
    if names:
        fields["dns_names"] = ",".join(names)
    return fields, end < begin


def private_key(label: str, der: bytes) -> tuple[str, int]:
    """A private key's type and bits; nothing of the key itself."""
    items = structures.der_items(structures.der(der)[1])
    if label == "PRIVATE KEY":
        return _key(items[1][1], items[2][1])
    if label == "EC PRIVATE KEY":
        return "ec", next((CURVE_BITS.get(structures.oid(structures.der(v)[1]), 0) for t, v in items if t == 0xA0), 0)
    return label.split()[0].lower(), _bits(items[1][1])


def read_certificates(path: str, data: bytes) -> Found:
    """A record per certificate, one for a trust store's folder, and one per private key, whose material is not kept."""
    out, store, good, never, first = Found(), any(d in path for d in TRUST_STORES), 0, 0, ""
    for label, der in pem_blocks(data):
        try:
            if label in ("CERTIFICATE", "X509 CERTIFICATE", "TRUSTED CERTIFICATE"):
                fields, wrong = certificate(der)
                good, never, first = good + 1, never + wrong, first or fields["subject"]
                if not store:
                    out.records.append(("certificate", path, "warning" if wrong else "info", fields["fingerprint"], fields))
                    if wrong:
                        out.diagnostics.append(("warning", "artifact-certificate-expired", f"'{path}': {fields['subject']} is not valid after {fields['not_after']}"))
            elif label in ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY"):
                kind, bits = private_key(label, der)
                out.records.append(("private-key", path, "warning", "", {"key_type": kind, "note": "the key itself is not recorded"} | ({"key_bits": str(bits)} if bits else {})))
                out.diagnostics.append(("warning", "artifact-private-key-present", f"'{path}' holds an unencrypted {kind} private key"))
                if kind in ("rsa", "dsa", "dh") and 0 < bits < WEAK_BITS:
                    out.diagnostics.append(("info", "artifact-weak-key", f"'{path}': the {kind} key has {bits} bits"))
        except (ValueError, IndexError):
            continue
    if store and good:
        fields = {"certificates": str(good), "expired_by_own_dates": str(never), "first_subject": first, "note": "a trust store: counted, not listed"}
        out.records.append(("certificate-bundle", path.rpartition("/")[0] or path, "info", "", fields))
    if not good and not out.records:
        out.diagnostics.append(("info", "artifact-certificate-unparsable", f"'{path}' holds no certificate or key that can be read"))
    return out


def module_info(section: bytes) -> dict[str, list[str]]:
    """All values of each key of a module's NUL-separated key=value items."""
    out: dict[str, list[str]] = {}
    for item in section.split(b"\0"):
        key, equals, value = item.partition(b"=")
        if equals:
            out.setdefault(key.decode("latin-1"), []).append(sanitize_bytes(value)[:300])
    return out


def _elf(data: bytes):
    try:
        return structures.elf(data)
    except (ValueError, IndexError, structures.struct.error):
        return None


def read_module(path: str, data: bytes) -> Found:
    """A kernel module's own description, how much it claims to drive, and whether it stands under another kernel's release.

    The release is compared by leading digits and dots of the version magic with the whole folder name, so a
    folder with a suffix always differs; that is the known behaviour.
    """
    out, elf = Found(), _elf(data)
    info = module_info(elf.sections.get(".modinfo", b"")) if elf else {}
    if not info:
        return out
    first = lambda key: info.get(key, [""])[0]
    name = first("name") or path.rsplit("/", 1)[-1].split(".ko")[0]
    fields = {"module": name, "arch": elf.machine} | {k: first(k) for k in ("description", "license", "author", "depends", "vermagic", "firmware", "srcversion") if first(k)}
    fields |= {to: str(len(info[key])) for key, to in (("alias", "aliases"), ("parm", "parameters")) if key in info}
    severity, licence = "info", first("license")
    if licence and not any(x in licence for x in ("GPL", "BSD", "MIT", "Dual")):
        out.diagnostics.append(("info", "artifact-proprietary-module", f"'{path}' is licensed '{licence}'"))
    built, folder = re.match(r"[0-9.]*", first("vermagic"))[0], re.search(r"lib/modules/([^/]*)/", path)
    if built and folder and folder[1] and built != folder[1]:
        severity = "warning"
        out.diagnostics.append(("warning", "artifact-stale-module", f"'{path}' was built for kernel {built} but stands under {folder[1]}"))
    out.records.append(("kernel-module", path, severity, name, fields))
    return out


def banner(data: bytes) -> tuple[str, str] | None:
    """(banner, version) of the first "Linux version " line; null where no release follows, as in prose."""
    found = re.search(rb"Linux version [^\0\n]{0,1010}", data)
    text = sanitize_bytes(found[0]) if found else ""
    version = re.match(r"Linux version ((?=[0-9])[^ .]*(?<=[0-9])\.[0-9][^ ]*)", text)
    return (text, version[1]) if version else None


def _compiler(text: str) -> str:
    """The bracket that names the compiler, with the brackets within it."""
    start = text.find("(gcc version ")
    depth = 0
    for at in range(start, len(text)) if start >= 0 else ():
        depth += (text[at] == "(") - (text[at] == ")")
        if not depth:
            return text[start + 1 : at]
    return ""


def read_kernel(path: str, data: bytes) -> Found:
    """A kernel's banner, version, compiler and machine, and what its symbol table says."""
    out, found = Found(), banner(data)
    if found:
        text, version = found
        fields, elf, compiler = {"banner": text[:300], "version": version}, _elf(data), _compiler(text)
        fields |= ({"compiler": compiler[:200]} if compiler else {}) | ({"arch": elf.machine} if elf else {})
        table = kallsyms.decode(data)
        if table is None:
            out.diagnostics.append(("info", "kernel-no-symbol-table", f"'{path}' holds no symbol table that can be read"))
        else:
            fields |= symbol_fields(table, path)
        out.records.append(("linux-kernel", path, "info", text[:300], fields))
    return out


def symbol_fields(table: kallsyms.Table, path: str) -> dict[str, str]:
    """The count of symbols, their types, where the kernel is loaded, whether it can load modules, and the file that lists them."""
    types: dict[str, int] = {}
    for _, t, _ in table.symbols:
        types[t] = types.get(t, 0) + 1
    names = {n for _, _, n in table.symbols}
    shown = ",".join(f"{t}={n}" for t, n in sorted(types.items(), key=lambda x: (-x[1], x[0])))
    out = {"symbols": str(len(table.symbols)), "symbol_types": shown[:120], "loadable_modules": "yes" if names & {"module_layout", "load_module"} else "no", "symbols_file": f"symbols/{path.replace('/', '_')}.txt"}
    if table.mode:
        text = [a for a, t, _ in table.symbols if t in "tT"] or [a for a, _, _ in table.symbols]
        out |= {"address_mode": table.mode, "load_address": hex(min(text))}
    return out


def kernel_symbols(entries: DataFrame) -> DataFrame:
    """(node, path, ord, address, type, name) of the symbol tables of kernels among entries (node, path, content); addresses in hexadecimal digits, or null."""
    names = ["node", "path", "ord", "address", "type", "name"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = kallsyms.decode(data or b"")
                rows = [(node, path, k, None if a is None else f"{a:0{2 * table.word}x}", t, n) for k, (a, t, n) in enumerate(table.symbols)] if table else []
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000], strict=True), kinds, strict=True)], names)

    return entries.select("node", "path", F.col("content").cast("binary")).mapInArrow(run, "node string, path string, ord long, address string, type string, name string")


#: By name: (whether it applies to a path and a file's first bytes, what reads the file).
EXTRACTORS: dict[str, tuple[Callable[[str, bytes], bool], Callable[[str, bytes], Found]]] = {
    "certificates": (lambda path, head: b"-----BEGIN " in head or (len(path) > 4 and path.endswith((".pem", ".crt", ".cer", ".key"))), read_certificates),
    "kmodule": (lambda path, head: path.endswith(".ko") or (head.startswith(b"\x7fELF") and "lib/modules/" in path), read_module),
    "linux-kernel": (lambda path, head: path.rsplit("/", 1)[-1].startswith(("vmlinux", "vmlinuz", "zImage", "bzImage", "uImage", "Image", "kernel", "payload")), read_kernel),
}

_SCHEMA = "node string, entry_ord long, n int, extractor string, kind string, path string, severity string, identity string, fields map<string,string>, code string, message string"
_KINDS = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]


def examine(entries: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of what all extractors find in live, regular, written entries (node, entry_ord, path, kind, deleted, superseded, written, content).

    Records have a kind and fields, diagnostics a code and message. Null paths and contents are passed over. No shuffle.
    """
    live = entries.where("kind = 'regular' AND written AND NOT coalesce(deleted, false) AND NOT coalesce(superseded, false) AND path IS NOT NULL AND content IS NOT NULL")
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, order, path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                for name, (applies, read) in sorted(EXTRACTORS.items()):
                    if applies(path, data[:HEAD]):
                        found = read(path, data[:most_bytes])
                        for kind, at, severity, identity, fields in found.records:
                            rows.append((node, order, n := n + 1, name, kind, at, severity, identity, list(fields.items()), None, None))
                        for severity, code, message in found.diagnostics:
                            rows.append((node, order, n := n + 1, name, None, path, severity, None, None, code, message))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names)

    return live.select("node", "entry_ord", "path", F.col("content").cast("binary")).mapInArrow(run, _SCHEMA)


def collect(examined: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """(kind, node, path, severity, identity, fields), by kind, node and path: the first ``most`` records, those of one thing merged.

    Fields of digits add up, other ones keep the first value; the worst severity holds. The cap is the feature's own.
    """
    first = examined.where("kind IS NOT NULL").orderBy("node", "entry_ord", "n").limit(most)
    first = first.withColumn("ord", F.struct("entry_ord", "n")).withColumn("fields", F.map_filter("fields", lambda _, v: v.isNotNull()))
    rank = F.array_position(F.array(*map(F.lit, summaries.SEVERITIES)), F.col("severity"))
    by = ["kind", "node", "path"]
    whole = first.groupBy(*by).agg(F.max_by("severity", rank).alias("severity"), F.min_by("identity", "ord").alias("identity"))
    return whole.join(summaries.merge_records(first, by, "ord"), by).orderBy(*by)


def symbol_types(symbols: DataFrame, by: list[str], most: int = 120) -> DataFrame:
    """(by, symbol_types): how many symbols of each type, as T=3,t=9, by type; cut after ``most`` characters."""
    counts = symbols.groupBy(*by, "type").agg(F.count("*").alias("n"))
    items = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("type", F.concat_ws("=", "type", "n").alias("text")))).alias("all"))
    add = lambda acc, x: F.when(acc.endswith(",..."), acc).when(F.length(acc) > most, F.concat(acc, F.lit(",..."))).when(acc == "", x["text"]).otherwise(F.concat_ws(",", acc, x["text"]))
    return items.select(*by, F.aggregate("all", F.lit(""), add).alias("symbol_types"))
