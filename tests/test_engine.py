"""The engine's operators on small rows, and its queries against DuckDB."""

import bz2
import glob
import gzip
import io
import lzma
import os
import struct
import tarfile
import zipfile
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.formats import codecs, readers, structures, validators
from gneiss.functions import entropy, hashing, text
from gneiss.operators import diff, discovery, extraction, intervals, rules, summaries, survey, versions
from gneiss.plans import registry
from gneiss.sources import chunked

DATA = "/root/testdata/sf0.001"


def kept(spark, rows):
    """rows (offset, size, tier, format, category); returns (kept, {absorbed: owner}) by offset and format."""
    scores = (25, 60, 85, 99)
    df = spark.createDataFrame(
        [("i", o, s, scores[t], f, c, f"{f}-{k}") for k, (o, s, t, f, c) in enumerate(rows)], "image_id string, offset long, size long, confidence int, format string, category string, signature string"
    )
    got = {r.place: r for r in intervals.resolve(df).collect()}
    assert len(got) == len(rows)
    return [(r.format, r.offset) for r in sorted(got.values(), key=lambda r: r.place) if r.owner is None], {(r.format, r.offset): got[r.owner].offset for r in got.values() if r.owner is not None}


def test_resolve(spark):
    c = "container"
    assert kept(spark, [(100, 1000, 2, "out", c), (200, 50, 1, "inn", c), (300, 0, 0, "plain", c), (1090, 50, 1, "inn", c), (2000, 10, 3, "inn", c)]) == ([("out", 100), ("inn", 1090), ("inn", 2000)], {("inn", 200): 100, ("plain", 300): 100})
    assert kept(spark, [(100, 1000, 2, "out", c), (200, 50, 2, "inn", c)])[0] == [("out", 100), ("inn", 200)]
    z = "compressed"
    assert kept(spark, [(100, 1000, 1, "out", c), (200, 50, 1, "s", z), (300, 50, 2, "s", z), (2000, 50, 1, "s", z)])[0] == [("out", 100), ("s", 2000)]
    assert kept(spark, [(100, 1000, 3, "ubi", c), (200, 50, 3, "inn", c), (2000, 50, 3, "inn", c)])[0] == [("ubi", 100), ("inn", 2000)]
    assert kept(spark, [(100, 1000, 1, "out", c), (200, 50, 2, "inn", c)])[0] == [("out", 100), ("inn", 200)]
    assert kept(spark, [(100, 1000, 1, "s", z), (200, 50, 1, "s", z)])[0] == [("s", 100), ("s", 200)]
    assert kept(spark, [(100, 500, 1, "outer", c), (100, 20, 3, "shifted", c), (116, 20, 3, "inner", c)]) == ([("shifted", 100), ("inner", 116)], {("outer", 100): 100})


def test_partition_tables_absorb_only_tables(spark):
    t = "partition-table"
    assert kept(spark, [(0, 1000, 3, "fs", "filesystem"), (100, 512, 1, "mbr", t)])[0] == [("fs", 0), ("mbr", 100)]
    assert kept(spark, [(0, 1000, 3, "gpt", t), (0, 512, 2, "mbr", t)])[0] == [("gpt", 0)]


def test_covered_starts(spark):
    df = spark.createDataFrame([("i", 0, 4000, 85), ("i", 1000, 100, 99), ("i", 4000, 100, 99), ("i", 5000, 4000, 60), ("i", 6000, 10, 99)], "image_id string, offset long, size long, confidence int")
    assert sorted(r.offset for r in intervals.covered_starts(df, ["image_id"]).collect()) == [0, 4000, 5000, 6000]


def test_gaps(spark):
    claims = spark.createDataFrame([("i", a, b) for a, b in ((0, 10), (5, 20), (30, 40), (35, 36), (90, 100), (50, 50))], "image_id string, off long, stop long")
    got = intervals.gaps(claims, ["image_id"], F.lit(120).cast("long"), 1)
    assert sorted((r.gap_off, r.gap_end) for r in got.collect()) == [(20, 30), (40, 90), (100, 120)]


def hits(kind, pattern, validate, data):
    rule = rules.Rule("p", "r", "c", kind, pattern, validate, "low")
    return [m for _, m in rules.scan_bytes(rule, rules.compiled(rule), data)]


def test_rules():
    by = {r.id: r for r in rules.builtin()}
    n = lambda rule, data: len(hits(by[rule].kind, by[rule].pattern, by[rule].validate, data))
    assert [n("vin", x) for x in (b"vin 1HGCM82633A004352 end", b"vin 1HGCM82633A004353 end", b" X1X2X3X4X6X7X8X9X ")] == [1, 0, 0]
    assert [n("phone-e164", x) for x in (b"  %e+631065600\t", b" call +14155552671 now")] == [0, 1]
    assert [n("mac-colon", x) for x in (b" 00:1a:2b:3c:4d:5e ", b" ff:ff:ff:ff:ff:ff ", b" 00:00:00:00:00:00 ")] == [1, 0, 0]
    assert n("ipv4", b"version 1.2.3.4.5 build 999.999.999.999") == 0
    assert hits("hex", "41 ?? 43", None, b"xABCAxC") == [b"ABC", b"AxC"]
    assert len(by) == 39 + 11


def test_bad_packs():
    good = "pack: p\nversion: 1\nrules:\n- {id: a, kind: literal, pattern: x, severity: low}\n"
    assert [r.id for r in rules.parse_pack(good)] == ["a"]
    for text_, code in ((good.replace("literal", "odd"), "rules-bad-kind"), (good.replace("version: 1", "version: 2"), "rules-bad-version"), (good + "- {id: a, pattern: y}\n", "rules-duplicate-id"), (good.replace("literal, pattern: x", "regex, pattern: (a+)+$"), "rules-bad-pattern"), ("[", "rules-bad-yaml")):
        with pytest.raises(rules.RuleError) as e:
            rules.parse_pack(text_)
        assert e.value.code == code


def test_globs(spark):
    df = spark.createDataFrame([("etc/shadow",), ("usr/local/etc/shadow",), ("etc/shadow.bak",), ("etc/a.conf",), ("etc/sub/a.conf",)], "p string")
    match = lambda g: sorted(r.p for r in df.where(F.col("p").rlike(text.glob_regex(g))).collect())
    assert match("**/etc/shadow") == ["etc/shadow", "usr/local/etc/shadow"]
    assert match("etc/*.conf") == ["etc/a.conf"]


def test_sweep_caps_and_order(spark):
    items = spark.createDataFrame([(k, "n", f"etc/f{k}.conf", b"a@b.org " * 3, False) for k in range(5)], "item long, node string, path string, content binary, region boolean")
    chosen = [r for r in rules.builtin("pii") if r.id == "email"] + [rules.Rule("net", "conf", "c", "glob-path", "etc/*.conf", None, "low")]
    got = rules.sweep(items, chosen, max_hits=6).collect()
    assert [(r.item, r.rule) for r in got] == [(0, "conf"), (0, "email"), (0, "email"), (0, "email"), (1, "conf"), (1, "email")]


def test_registered_sweeps_count_all_hits(spark, tmp_path):
    many = " ".join(f"user{k}@example.org 10.0.{k}.1" for k in range(100))
    spark.createDataFrame([(1, many), (2, many)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = registry.queries()
    assert {(r.doc_id, r.rule): r.hits for r in run["sweep_top_hits"](spark, str(tmp_path)).collect()} == {(d, r): 100 for d in (1, 2) for r in ("email", "ipv4")}
    assert {r.value: r.hits for r in run["sweep_summary"](spark, str(tmp_path)).where("by = 'rule'").collect()} == {"email": 200, "ipv4": 200}
    for name in ("rule_hits_email", "rule_hits_ipv4"):
        assert sum(r.n for r in run[name](spark, str(tmp_path)).collect()) == 200
    items = registry._items(spark, str(tmp_path))
    assert rules.sweep(items, rules.builtin("pii"), max_hits=None, per_rule=7).where("rule = 'email'").count() == 14
    assert rules.limit_diagnostic(rules.sweep(items, rules.builtin("pii"), max_hits=9), 9).startswith("the sweep reached max_hits_total (9)")
    assert rules.limit_diagnostic(rules.sweep(items, rules.builtin("pii"), max_hits=None), None) is None


def test_entropy():
    assert entropy.profile_of(b"")["mean"] == 0 and entropy.profile_of(b"\xff" * 4096)["fill"] == 255
    assert abs(entropy.profile_of(bytes(range(256)))["mean"] - 8) < 1e-9 and abs(entropy.profile_of(b"ab" * 100)["mean"] - 1) < 1e-9


def test_sanitize():
    assert [text.sanitize_bytes(x) for x in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", "é\t\n\r€😀".encode(), b"\x00a\x7f")] == ["\\xc0\\x80", "\\xed\\xa0\\x80", "\\xf4\\x90\\x80\\x80", "é\t\n\r€😀", "\\x00a\x7f"]
    assert text.quote_bytes(b"a\\\n\x01zz", 9) == "a\\\\\\n\\x01z..." and text.swap_words(b"abcde", 2) == b"badce"


def test_text_columns(spark):
    df = spark.createDataFrame([("a/b/./c", 1536), ("../x", 1023), ("/abs", 1 << 40), ("CON.txt", 0), ("..hidden. ", 5)], "s string, n long")
    got = df.select(text.normalize_path(F.col("s")).alias("p"), text.safe_filename(F.col("s")).alias("f"), text.human_bytes(F.col("n")).alias("h"), text.hex_offset(F.col("n")).alias("x")).collect()
    assert [(r.p.path, r.p.why) for r in got] == [("a/b/c", None), (None, "dotdot"), (None, "absolute"), ("CON.txt", None), ("..hidden. ", None)]
    assert [r.f for r in got] == ["a_b_._c", "_x", "_abs", "CON.txt_", "hidden"]
    assert [r.h for r in got] == ["1.5 KiB", "1023 B", "1.0 TiB", "0 B", "5 B"] and got[0].x == "0x600"


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 3, "q")], "k string, v long, s string")
    asked = spark.createDataFrame([("a", 0), ("a", 5), ("a", 8), ("b", 99), ("c", 1)], "k string, t long")
    got = {(r.k, r.t): r.s for r in versions.as_of(asked, rows, ["k"], "t", ["v"], "s").collect()}
    assert got == {("a", 0): None, ("a", 5): "y", ("a", 8): "y", ("b", 99): "q", ("c", 1): None}
    early = {(r.k, r.t): r.s for r in versions.as_of(asked, rows, ["k"], "t", ["v"], "s", earliest=True).collect()}
    assert early["a", 0] == "x"
    raw = spark.createDataFrame([("a", k, v) for k, v in enumerate((3, 3, 1, 9, 2))], "k string, i long, raw long")
    assert [r.version for r in versions.running_versions(raw, ["k"], [F.col("i")], "raw").orderBy("i").collect()] == [3, 4, 5, 9, 10]


def test_file_diff(spark):
    side = lambda rows: diff.flatten(spark.createDataFrame([(p, s, "n", k, 1) for k, (p, s) in enumerate(rows)], "path string, sha256 string, node string, ord long, size long"))
    a, b = side([("passwd", "a"), ("busybox", "b"), ("only-in-a", "c")]), side([("passwd", "a"), ("busybox", "d"), ("only-in-b", "e")])
    assert {r.state: r.total for r in diff.totals(diff.files(a, b)).collect()} == {"same": 1, "changed": 1, "removed": 1, "added": 1}
    moved = diff.contents(side([("usr/bin/tool", "a")]), side([("bin/tool", "a")])).first()
    assert (moved.common, moved.moved) == (1, 1)


def test_survey(spark):
    e = spark.createDataFrame(
        [("n", k, p, kind, None, False, False) for k, (p, kind) in enumerate([("etc/passwd", "regular"), ("/bin/sh", "symlink"), ("etc/init.d/rcS", "regular"), ("data/x", "regular")])]
        + [("m", 0, "photos/a", "regular", None, False, False)], "node string, ord long, path string, kind string, link_target string, deleted boolean, superseded boolean",
    )
    got = survey.best(survey.scores(survey.path_index(e)), ["node"], list(survey.PLATFORMS)).collect()
    assert [(r.node, r.platform, r.score) for r in got] == [("n", "linux", 6)]


def test_links(spark):
    e = spark.createDataFrame([("n", "bin/sh", "symlink", "busybox"), ("n", "bin/busybox", "regular", None), ("n", "l/a", "symlink", "b"), ("n", "l/b", "symlink", "a"), ("n", "x/y", "symlink", "../../bin/sh")], "node string, path string, kind string, link_target string")
    got = {r.path: r.target for r in survey.resolve_links(e).collect()}
    assert got == {"bin/sh": "bin/busybox", "l/a": None, "l/b": None, "x/y": "bin/busybox"}


def test_coverage_and_tally(spark):
    c = spark.createDataFrame([(1, "a", "supported", "x"), (2, "a", "partial", ""), (3, "a", "supported", "y"), (4, "b", "partial", ""), (5, "b", "missing", "z")], "ord long, format string, status string, detail string")
    assert {r.format: (r.status, r.detail) for r in summaries.fold_coverage(c).collect()} == {"a": ("partial", "y"), "b": ("missing", "z")}


def archive():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in (("bin/busybox", b"x" * 3000), ("empty.txt", b""), ("data/ünïcödé.txt", b"hello")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_readers_round_trip():
    tar = archive()
    assert [(e.path, len(e.content)) for e in readers.read("tar", tar)] == [("bin/busybox", 3000), ("empty.txt", 0), ("data/ünïcödé.txt", 5)]
    for kind, data in (("gzip", gzip.compress(tar)), ("bzip2", bz2.compress(tar)), ("xz", lzma.compress(tar)), ("lzma", lzma.compress(tar, lzma.FORMAT_ALONE))):
        assert codecs.stream(kind, data + b"tail") == (tar, len(data))
        assert next(readers.read(kind, data)).content == tar
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.txt", "body")
    assert [(e.path, e.content) for e in readers.read("zip", z.getvalue())] == [("a/b.txt", b"body")]
    ar = b"!<arch>\n" + b"a.o/            0           0     0     100644  3         `\nabc\n" + b"b.o/            0           0     0     100644  2         `\nxy"
    assert [(e.path, e.content) for e in readers.read("ar", ar)] == [("a.o", b"abc"), ("b.o", b"xy")]
    newc = lambda name, body, mode: (f"070701{1:08x}{mode:08x}" + "0" * 8 * 4 + f"{len(body):08x}" + "0" * 8 * 4 + f"{len(name) + 1:08x}" + "0" * 8).encode() + name.encode() + b"\0" + b"\0" * (-(110 + len(name) + 1) % 4) + body + b"\0" * (-len(body) % 4)
    assert [(e.path, e.content) for e in readers.read("cpio", newc("f", b"data!", 0o100644) + newc("TRAILER!!!", b"", 0))] == [("f", b"data!")]


def test_damage_ends_with_a_diagnostic():
    tar = gzip.compress(archive())
    for cut in range(0, len(tar), 7):
        assert all(e.diagnostics or e.content for e in readers.read("gzip", tar[:cut]))
    for kind in readers.REGISTRY:
        for junk in (b"", b"\0" * 64, bytes(range(256)) * 20):
            list(readers.read(kind, junk))
    for s in discovery.builtin():
        for junk in (b"\0" * 32, s.magic, b"\xff" * 10000):
            validators.validate(s, junk, 0)


def test_lz4_and_rtime():
    assert codecs.lz4_block(bytes([0x40]) + b"abcd", 100) == b"abcd"
    assert codecs.lz4_block(bytes([0x1F]) + b"a" + b"\x01\x00" + bytes([10]) + bytes([0x10]) + b"z", 100) == b"a" * 30 + b"z"
    assert codecs.rtime(b"a\x03b\x00", 5) == b"aaaab"


def test_fdt_and_uimage():
    names = b"data\0"
    body = struct.pack(">I", 1) + b"\0\0\0\0" + struct.pack(">I", 1) + b"images\0\0" + struct.pack(">I", 1) + b"kern\0\0\0\0" + struct.pack(">III", 3, 3, 0) + b"abc\0" + struct.pack(">IIII", 2, 2, 2, 9)
    head = struct.pack(">10I", 0xD00DFEED, 40 + len(body) + len(names), 40, 40 + len(body), 40, 17, 16, 0, len(names), len(body))
    assert [n.path for n in structures.fdt(head + body + names)] == ["/", "/images", "/images/kern"]
    assert [(e.path, e.content) for e in readers.read("fit", head + body + names)] == [("kern", b"abc")]
    head = bytearray(struct.pack(">7I", 0x27051956, 0, 0, 5, 0, 0, zlib.crc32(b"hello")) + bytes([5, 2, 2, 0]) + b"k".ljust(32, b"\0"))
    head[4:8] = struct.pack(">I", zlib.crc32(bytes(head)))
    sig = next(s for s in discovery.builtin() if s.name == "uimage")
    f = validators.validate(sig, b"pad" + bytes(head) + b"hello", 3)
    assert (f.confidence, f.size) == (99, 69)


def test_scan_and_descend(spark):
    image = b"\0" * 4096 + archive() + b"\0" * 512 + gzip.compress(b"payload" * 100)
    blobs = spark.createDataFrame([("img", bytearray(image))], "source_id string, content binary")
    found = {(r.format, r.offset): (r.confidence, r.owner) for r in discovery.scan(blobs).collect()}
    assert found["tar", 4096] == (99, None)
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w") as t:
        info, inner = tarfile.TarInfo("inner.tar.gz"), gzip.compress(archive())
        info.size = len(inner)
        t.addfile(info, io.BytesIO(inner))
    nested = spark.createDataFrame([("n", "tar", bytearray(outer.getvalue()))], "node_id string, format string, content binary")
    got = extraction.descend(nested, extraction.format_of).orderBy("level", "entry_ord").collect()
    assert [(r.level, r.path) for r in got] == [(0, "inner.tar.gz"), (1, "payload"), (2, "bin/busybox"), (2, "empty.txt"), (2, "data/ünïcödé.txt")]


def test_chunks_lose_no_hit(spark, tmp_path):
    data = bytearray(100)
    for at in (0, 14, 30, 47, 95):
        data[at : at + 4] = b"hsqs"
    (tmp_path / "img").write_bytes(bytes(data))
    sig = [s for s in discovery.builtin() if s.name == "squashfs-le"]
    got = discovery.magic_hits(chunked.chunks(spark, str(tmp_path / "img"), 16, discovery.overlap(sig)), sig)
    assert sorted(r.offset for r in got.collect()) == [0, 14, 30, 47, 95]
    whole = hashing.chunk_digests(chunked.chunks(spark, str(tmp_path / "img"), 16, 3)).first()
    import hashlib

    assert whole.sha256 == hashlib.sha256(bytes(data)).hexdigest() and whole.bytes == 100


def rows_of(table):
    def value(v):
        return "null" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    frame = pd.DataFrame(table.to_pydict(), dtype=object)
    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(sql).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert rows_of(got) == rows_of(want)
    assert got.num_rows or name in ("rule_hits_card", "luhn_cards")


def test_human_bytes_are_exact(spark):
    """Just under half a tenth stays below, whatever the unit; the largest unit may be named."""
    n = [1127428915, 2144047674162, 1 << 50, (1 << 63) - 1]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(text.human_bytes(F.col("n")).alias("h"), text.human_bytes(F.col("n"), "TiB").alias("t")).collect()
    assert [r.h for r in got] == ["1.0 GiB", "1.9 TiB", "1.0 PiB", "8.0 EiB"] and [r.t for r in got] == ["1.0 GiB", "1.9 TiB", "1024.0 TiB", "8388608.0 TiB"]


def test_scans_deal_rows_over_all_cores(spark, tmp_path):
    """However few row groups a table has, building and scanning are dealt over all cores, and finds are resolved without a shuffle."""
    spark.createDataFrame([(k, "text") for k in range(40)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["scan_filesystems"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and plan.count("Exchange hashpartitioning") == 1 and found.count() == 40


def test_stamps_beyond_year_9999(spark):
    got = spark.createDataFrame([(0,), (253402300799,), (253402300800,), (518478000000,)], "s long").select(text.iso8601(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "18399-11-30T18:40:00Z"]


def test_merged_records_take_the_first_of_equal_lines(spark, tmp_path):
    """Lines with the same keys come in the order of the table, as DuckDB's arg_min has them; missing values are passed over."""
    rows = pd.DataFrame({"l_partkey": [1, 1, 1, 2, 2, 3], "l_orderkey": [7, 7, 9, 4, 4, 5], "l_linenumber": pd.array([1, 1, 1, 2, 2, 1], "int32"), "l_quantity": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "l_returnflag": ["R", "A", "N", None, "A", None]})
    rows.to_parquet(tmp_path / "lineitem.parquet")
    got = {(r.l_partkey, r.field): r.value for r in registry.queries()["record_merge"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert got == {x[:2]: x[2] for x in con.execute(registry.oracle_sql()["record_merge"]).fetchall()} and got[1, "flag"] == "R" and got[2, "flag"] == "A"
