"""Builders against readers: every format there and back, histories, damage."""

import random

import pytest

from gneiss.formats import builders, lzo, qnx, readers, validators, yaffs
from gneiss.formats.builders import File
from gneiss.operators import discovery


@pytest.fixture(scope="module")
def files():
    rnd = random.Random(1)
    out = [File((f"sub{k % 3}/" if k % 2 else "") + f"file number {k}.text", bytes(rnd.choice(b"abc \n") for _ in range(rnd.choice([0, 5, 4096, 9000, 40000]))), 0o640, k, k + 1, 1_600_000_000 + k) for k in range(14)]
    return [*out, File("big.bin", rnd.randbytes(400_000))]


def live(kind, image):
    found = list(readers.read(kind, image))
    assert not [e.diagnostics for e in found if e.diagnostics]
    return {e.path: e.content for e in found if e.kind == "regular" and not e.superseded and not e.deleted}


@pytest.mark.parametrize("name", sorted(set(builders.REGISTRY) - {"uimage"}))
def test_round_trip(files, name):
    kind = {"cpio-odc": "cpio", "fat12": "fat", "fat16": "fat", "fat32": "fat"}.get(name, name)
    got = live(kind, builders.REGISTRY[name](files))
    if name == "android-super":  # whole sectors
        assert {k: v.rstrip(b"\0") for k, v in got.items()} == {f.name.replace("/", "_"): f.body.rstrip(b"\0") for f in files}
    else:
        shown = {"fit": lambda n: n.replace("/", "_"), "qnx-ifs": lambda n: f"proc/boot/{n}"}.get(name, lambda n: n)
        assert got == {shown(f.name): f.body for f in files}


@pytest.mark.parametrize("codec", ["gzip", "xz", "lzma", "lz4", "lzo", "zstd"])
def test_squashfs_codecs(files, codec):
    image = builders.squashfs(files, codec)
    assert live("squashfs", image) == {f.name: f.body for f in files}
    by_path = {e.path: e for e in readers.read("squashfs", image)}
    assert all((by_path[f.name].mode, by_path[f.name].uid, by_path[f.name].gid, by_path[f.name].mtime) == (f.mode, f.uid, f.gid, f.mtime) for f in files)
    assert by_path["sub1"].kind == "directory"


@pytest.mark.parametrize("packed", ["none", "zlib", "lzo", "ucl", "lz4"])
def test_boot_images(files, packed):
    image = builders.qnx_ifs(files, packed)
    assert live("qnx-ifs", image) == {f"proc/boot/{f.name}": f.body for f in files}
    broken = bytearray(builders.qnx_ifs(files, "none"))
    broken[-20] ^= 1
    assert [e.diagnostics for e in readers.read("qnx-ifs", bytes(broken)) if e.diagnostics] == [["qnx-ifs-image-checksum"]]


@pytest.mark.parametrize("filters", ["lzma", "lzma2", "x86", "copy"])
def test_sevenzip(files, filters):
    assert live("7z", builders.sevenzip(files, filters)) == live("7z", builders.sevenzip(files, filters, False)) == {f.name: f.body for f in files}
    damaged = bytearray(builders.sevenzip(files, filters))
    damaged[40] ^= 0xFF
    assert any(e.diagnostics for e in readers.read("7z", bytes(damaged)))


def test_lzo_and_ucl(files):
    rnd = random.Random(2)
    bodies = [f.body for f in files] + [rnd.randbytes(5000), bytes(100_000), b"abcabcabcabcabc" * 999, b"a", b"ab", b"abc", b"abcd", *(rnd.randbytes(n) for n in (17, 18, 19, 238, 239, 600))]
    for body in bodies:
        if body:
            assert lzo.lzo1x(builders.lzo1x(body), len(body)) == body
        assert lzo.nrv2b(builders.nrv2b(body), len(body)) == body
    with pytest.raises(ValueError):
        lzo.lzo1x(builders.lzo1x(b"abcabc" * 50), 10)


def test_lzop(files):
    found = list(readers.read("lzop", builders.lzop(files)))
    assert [(e.content, e.extra.get("name")) for e in found] == [(f.body, f.name) for f in files]
    broken = bytearray(builders.lzop(files[1:2]))
    broken[-30] ^= 0xFF
    assert list(readers.read("lzop", bytes(broken)))[0].diagnostics


@pytest.mark.parametrize("name", ["ubifs", "ubifs without journal", "yaffs2", "yaffs2 at 2", "qnx6", "jffs2"])
def test_history(files, name):
    half = [File(f.name, f.body[: len(f.body) // 2], f.mode, f.uid, f.gid, f.mtime) for f in files]
    less = [f for k, f in enumerate(files) if k % 5]
    states = [half, files, less]
    image = {
        "ubifs": lambda: builders.ubifs(states), "ubifs without journal": lambda: builders.ubifs(states, False), "yaffs2": lambda: builders.yaffs2(states),
        "yaffs2 at 2": lambda: builders.yaffs2(states, at=2), "qnx6": lambda: builders.qnx6(half, less), "jffs2": lambda: builders.jffs2_log(states),
    }[name]()
    found = [e for e in readers.read(name.split()[0], image) if e.kind == "regular"]
    want = {f.name: f.body for f in less}
    assert {e.path: e.content for e in found if not e.deleted and not e.superseded} == want
    before = half if name == "qnx6" else files
    assert {e.path: e.content for e in found if e.deleted and not e.superseded} == {f.name: f.body for f in before if f.name not in want}
    older = [(e.path, e.content) for e in found if not e.deleted and e.superseded]
    assert {(f.name, f.body) for f in half if f.name in want and f.body != want[f.name]} <= set(older)
    versions = [(e.path, e.version) for e in found if e.version]
    assert len(set(versions)) == len(versions)


def test_deleted_long_names(files):
    gone = frozenset(f.name for f in files[::3])
    found = {e.path: e for e in readers.read("fat", builders.fat(files, 32, gone)) if e.kind == "regular"}
    assert {p for p, e in found.items() if e.deleted} == gone and all(found[f.name].content == f.body for f in files)


def test_validators_size_images(files):
    signatures = discovery.builtin()
    for kind, image in (("qnx6", builders.qnx6(files, files)), ("yaffs2", builders.yaffs2([files])), ("qnx-ifs", builders.qnx_ifs(files)), ("lzop", builders.lzop(files)), ("7z", builders.sevenzip(files)), ("squashfs", builders.squashfs(files))):
        found = [f for _, f, _ in discovery.findings_of(bytes(4096) + image + bytes(4096), signatures) if f.format == kind and f.offset == 4096]
        assert found and found[0].size == len(image) and found[0].confidence >= 85, (kind, found, len(image))
    assert validators.validate(next(s for s in signatures if s.format == "qnx-ifs"), b"\xeb\x7e\xff\0" + bytes(range(255)) * 2, 0) is None


def test_damage_never_raises(files):
    rnd = random.Random(3)
    few = [f for f in files if len(f.body) < 5000]
    for name, build in builders.REGISTRY.items():
        kind = {"cpio-odc": "cpio", "fat12": "fat", "fat16": "fat", "fat32": "fat"}.get(name, name)
        image = build(few)
        for _ in range(12):
            broken = bytearray(image)
            for _ in range(rnd.choice([1, 5, 50])):
                broken[rnd.randrange(len(broken))] = rnd.randrange(256)
            list(readers.read(kind, bytes(broken[: rnd.choice([len(broken), len(broken) // 2, 600])])))


def test_parity_and_crc():
    assert yaffs.parity(bytes(16)) == (0, 0, 0) and yaffs.parity(b"\1" + bytes(15)) != yaffs.parity(b"\2" + bytes(15))
    assert qnx.crc_be(b"123456789") == 0x89A1897F


def test_long_luks_header_keeps_its_size():
    found = discovery.findings_of(bytes(8192) + builders.luks2(90_000) + bytes(32768), discovery.builtin())
    assert [(f.offset, f.size, f.diagnostics) for _, f, _ in found if f.format == "luks"] == [(8192, 90_000, [])]


def test_quiet_pages_hide_no_magic():
    """The spans that are searched hold every place of every magic, also at the ends of runs of one byte."""
    rnd, magics = random.Random(5), {s.magic for s in discovery.builtin()} | {b"\0\0\xff", b"\xff\0"}
    reach = max(map(len, magics))
    for _ in range(300):
        data = bytearray(b"".join(rnd.choice([bytes(4096), b"\xff" * 8192, bytes(5000), rnd.randbytes(4096)]) for _ in range(rnd.randrange(9))))
        for _ in range(4 if len(data) > 64 else 0):
            m = rnd.choice(sorted(magics))
            at = max(0, min(len(data) - len(m), 4096 * rnd.randrange(len(data) // 4096 + 1) - rnd.randrange(-5, 30)))
            data[at : at + len(m)] = m
        raw = bytes(data)
        spans = discovery.busy(raw, reach)
        assert all([p for a, b in spans for p in discovery.places(raw, m, b - len(m) + 1, a)] == list(discovery.places(raw, m)) for m in magics if len(set(m)) > 1)
    assert sum(b - a for a, b in discovery.busy(bytes(1 << 20) + b"hsqs" + bytes(1 << 20), 16)) < 4 * 4096
