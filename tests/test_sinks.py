"""Sinks, cases, reports, word swaps and whole runs."""

import hashlib
import io
import json
import os
import random
import tarfile

import pytest
import yaml
from pyspark.sql import functions as F

from gneiss.formats import builders
from gneiss.formats.builders import File
from gneiss.functions import swap
from gneiss.functions.text import swap_words
from gneiss.operators import analyze, diff, extraction, reports, rules, sinks

FILES = [File("etc/passwd", b"root:x:0:0:r:/root:/bin/sh\n", 0o644, 0, 0, 1_500_000_000), File("bin/su", b"\x7fELF", 0o4755), File("etc/os-release", b"NAME=Made\n"), File("a?b", b"mail jo@example.org now"), File("empty", b"")]


@pytest.fixture(scope="module")
def entries(spark):
    images = [("n", "tar", builders.tar([*FILES, File("../up", b"x"), File("/abs", b"x")]))]
    return extraction.walk(spark.createDataFrame(images, "node_id string, format string, content binary")).cache()


def test_disk(entries, tmp_path):
    got = {r.entry_ord: r for r in sinks.write_files(entries, str(tmp_path)).collect()}
    assert [got[k].refused for k in range(7)] == [None] * 5 + ["dotdot", "absolute"]
    for k, f in enumerate(FILES):
        host = got[k].host_path
        with open(host, "rb") as h:
            assert h.read() == f.body and got[k].sha256 == hashlib.sha256(f.body).hexdigest()
        assert os.stat(host).st_mode & 0o7000 == 0
    assert os.stat(tmp_path / "n/etc/passwd").st_mtime == 1_500_000_000 and (tmp_path / "n/a_b").exists()


def test_tar(entries):
    parts = sorted(sinks.tar_parts(entries).collect(), key=lambda r: r.entry_ord)
    with tarfile.open(fileobj=io.BytesIO(b"".join(r.part for r in parts))) as t:
        assert {m.name: t.extractfile(m).read() for m in t if m.isreg()} == {f.name.replace("?", "_"): f.body for f in FILES}
        assert t.getmember("bin/su").mode == 0o755


def test_listing(entries):
    plain = sinks.listing(entries)
    assert "content" not in plain.columns and plain.where("path = 'etc/passwd'").first().md5 == hashlib.md5(FILES[0].body).hexdigest()
    text = "".join(r.item for r in sinks.listing_yaml(plain).orderBy("entry_ord").collect())
    items = sinks.parse_listing(text)
    assert [x["path"] for x in items][:5] == [f.name for f in FILES] and items[0]["size"] == len(FILES[0].body) and yaml.safe_load(text)
    for bad in ("- path: [", "path: x", "- {kind: a}"):
        with pytest.raises(ValueError):
            sinks.parse_listing(bad)


def test_case(spark, entries, tmp_path):
    tables = {"entries": entries, "hits": spark.createDataFrame([(1, "x")], "item long, match string")}
    at = str(tmp_path / "case")
    sinks.write_case(tables, at)
    moved = str(tmp_path / "moved")
    os.rename(at, moved)
    read, said = sinks.read_case(spark, moved)
    assert not said and sinks.round_trips(tables, read)
    assert not sinks.round_trips(tables, read | {"hits": read["hits"].withColumn("match", F.lit("y"))}) and not sinks.round_trips(tables, {"hits": read["hits"]})
    for name in os.listdir(f"{moved}/hits"):
        if name.endswith(".parquet") or name.endswith(".crc"):
            os.remove(f"{moved}/hits/{name}")
    read, said = sinks.read_case(spark, moved)
    assert set(read) == {"entries"} and [c for c, _ in said] in (["case-rows-missing"], ["case-unreadable"])


def test_swap(spark):
    rnd = random.Random(4)
    prose = ("Some Words In English, and More of Them. " * 900).encode()
    firmware = b"U-Boot 2020 " + prose + b"Linux version 5.4 " + rnd.randbytes(4000)
    firmware += bytes(-len(firmware) % 4)
    for width in (0, 2, 4):
        raw = swap_words(firmware, width) if width else firmware
        assert swap.detect(raw)[0] == width
        text = prose[: len(prose) // 4 * 4]
        assert swap.detect(swap_words(text, width) if width else text)[0] == width
    assert swap.detect(rnd.randbytes(1 << 17))[0] == swap.detect(b"\xff" * 100_000)[0] == swap.detect(b"")[0] == 0
    assert swap.detect(swap_words(firmware, 4))[1] >= 60 and b"hsqs" in swap.AMBIGUOUS and b"UBI#" not in swap.AMBIGUOUS
    df = spark.createDataFrame([("i", bytearray(swap_words(firmware, 2) + b"t")), ("j", None)], "image_id string, content binary")
    got = {r.image_id: r for r in sinks.corrected_copy(df).collect()}
    assert bytes(got["i"].content) == firmware + b"t" and got["i"].word_swap == 2 and got["j"].content is None


def test_reports(spark):
    nasty = "<script>alert(1)</script> | *x*\nline"
    d = reports.Document(nasty, [reports.Section("s", [reports.Table(["a", "b"], [[nasty], [1, 2, 3]]), reports.KeyValues([("k", nasty)]), reports.Callout("warning", nasty), reports.CodeBlock("a ``` b"), reports.BulletList([nasty]), reports.Paragraph(nasty)])])
    page, text = reports.page(d), reports.markdown(d)
    assert "<script>" not in page and "<script>" not in text and "````" in text
    tables = [x for x in text.split("\n") if x.startswith("| ")]
    assert all(x.replace("\\|", "").count("|") == 3 for x in tables)
    schema = reports.json_schema(spark.createDataFrame([], "a long, b array<string>, c map<string,double>, d struct<e:boolean>").schema, "t")
    assert schema["properties"]["b"] == {"type": "array", "items": {"type": "string"}} and json.loads(json.dumps(schema)) == schema
    assert diff.empty_cases(spark.range(0), spark.range(1)).collect()[0].side == "a"


def test_required_bytes():
    rule = lambda pattern, kind="regex": rules.required(rules.Rule("p", "r", "c", kind, pattern, None, "low"))
    assert rule("abc[0-9]+defg") == b"defg" and rule("a(?:bc)+d") == b"abc" and rule("x?yz|abc") == b"" and rule("(?i)abc") == b"" and rule("6162 ?? 63", "hex") == b"ab"
    assert rule("a.b", "literal") == b"a.b" and rule(r"\bfoo(bar)baz") == b"foobarbaz" and rule("a{0,3}bc") == b"bc"


@pytest.mark.parametrize("swapped", [0, 4])
def test_analyze(spark, swapped):
    inner = builders.STREAMS["gzip"](builders.cpio([File("deep/secret.txt", b"write to jo@example.org")]))
    system = builders.squashfs([*FILES, File("boot/vmlinux", b"\x7fker" + b"Linux version 5.4.55 (me) #1\0" + builders.kallsyms([(0xC0000000 + 64 * k, "T", f"sym{k}") for k in range(300)]))])
    data = builders.ext2([File("in.cpio.gz", inner)])
    pad = lambda x: x + bytes(-len(x) % 512)
    at = 4096
    parts, body = [], b""
    for name, part in (("system", pad(system)), ("data", pad(data))):
        parts.append((name, (at + len(body)) // 512, (at + len(body) + len(part)) // 512 - 1))
        body += part
    image = builders.gpt(parts)[:4096].ljust(4096, b"\0")
    at = 64 * 512
    parts = [(n, a - 8 + 64, b - 8 + 64) for n, a, b in parts]
    image = builders.gpt(parts).ljust(at, b"\0") + body + b"\xff" * 20000
    image += bytes(-len(image) % 4)
    raw = swap_words(image, swapped) if swapped else image
    case = analyze.analyze(spark.createDataFrame([("img", bytearray(raw))], "image_id string, content binary"), analyze.Run(carve_all=True))
    assert case["images"].first().word_swap == swapped
    files = {(r.node_id.split("/")[1], r.path): bytes(r.content or b"") for r in case["entries"].where("kind = 'regular'").collect()}
    assert files["gpt", "etc/os-release"] == b"NAME=Made\n" and ("gpt", "deep/secret.txt") in files
    assert {(r.rule, r.path) for r in case["hits"].where("rule = 'email'").collect()} >= {("email", "deep/secret.txt"), ("email", "a?b")}
    assert ("os.name", "Made") in {(r.key, r.value) for r in case["facts"].collect()}
    assert case["symbols"].count() >= 300 and case["records"].where("kind = 'linux-kernel'").first().fields["symbols"] == "300"
    assert any(r["class"] == "erased" for r in case["gaps"].collect()) and case["carves"].count() > 0
    assert {r.format for r in case["coverage"].collect()} >= {"gpt"}
    page = reports.page(reports.build_report("Case", case))
    assert "Search hits" in page and "Platforms" in page and "Structure" in page
    fewer = analyze.analyze(spark.createDataFrame([("img", bytearray(raw))], "image_id string, content binary"), analyze.Run(packs=None, survey=False, artifacts=False, depth=1, history=False, files=2))
    assert "hits" not in fewer and "facts" not in fewer and fewer["entries"].agg(F.max("level")).first()[0] == 0


def test_a_long_write_is_swept_once(spark):
    """A file longer than a page is several nodes of a JFFS2 log, but one version: its hits count once."""
    body = b"write to jo@example.org " + bytes(9000) + b" or to al@example.org"
    log = builders.jffs2_log([[File("a/long", body)], [File("a/long", body, mtime=5), File("a/b", b"b")]])
    blobs = spark.createDataFrame([("i/jffs2", "jffs2", bytearray(log))], "node_id string, format string, content binary")
    found = extraction.descend(blobs, extraction.format_of).where("kind = 'regular'").collect()
    assert sorted((r.path, r.superseded, len(r.content)) for r in found) == [("a/b", False, 1), ("a/long", False, len(body))]
    assert sum(r.superseded for r in extraction.walk(blobs).collect()) == 2


def test_prose_that_swaps_to_a_magic_is_put_right():
    """Letters that read "ustar" in reversed words are no archive; an archive's own header is one."""
    prose = b"U-Boot 2020.01 Linux version 5.4 " + b"...su xxrat"
    text = prose + b" " * (-len(prose) % 4)
    raw = swap_words(text, 4)
    at = raw.find(b"ustar")
    assert at >= 0 and swap.detect(raw)[0] == 4
    for archive in (builders.tar(FILES), builders.cpio(FILES), builders.REGISTRY["cpio-odc"](FILES)):
        assert swap.detect(archive)[0] == 0 and swap.scores(archive)[2] >= 1
        assert swap.detect(swap_words(archive + bytes(-len(archive) % 4), 4))[0] == 4
