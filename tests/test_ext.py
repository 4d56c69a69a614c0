"""The ext reader on images that the system's own tools make."""

import os
import shutil
import subprocess

import pytest

from gneiss.formats import readers

MKFS = shutil.which("mkfs.ext4", path="/usr/sbin:/sbin:/usr/bin:/bin")
DEBUGFS = shutil.which("debugfs", path="/usr/sbin:/sbin:/usr/bin:/bin")


@pytest.mark.skipif(not (MKFS and DEBUGFS), reason="needs e2fsprogs")
@pytest.mark.parametrize("kind", ["ext2", "ext4"])
def test_ext(tmp_path, kind):
    tree, image = tmp_path / "tree", tmp_path / "image"
    (tree / "a/b c").mkdir(parents=True)
    files = {"a/small": b"x" * 10, "a/b c/large": os.urandom(700_000), "empty": b"", "zz gone": b"deleted" * 400, "a/ünï": b"name"}
    for name, body in files.items():
        (tree / name).write_bytes(body)
    (tree / "a/sparse").write_bytes(b"a" * 4096 + b"\0" * 300_000 + b"b" * 4096)
    (tree / "link").symlink_to("a/small")
    (tree / "far").symlink_to("y" * 100)
    os.link(tree / "a/small", tree / "hard")
    subprocess.run([MKFS, "-q", "-t", kind, "-b", "1024", "-d", tree, image, "8m"], check=True)
    subprocess.run([DEBUGFS, "-w", "-R", 'rm "/zz gone"', image], check=True, capture_output=True)
    found = list(readers.read(kind, image.read_bytes()))
    assert not [e for e in found if e.diagnostics]
    got = {e.path: e for e in found if not e.deleted}
    for name, body in files.items():
        if name != "zz gone":
            e = got.get(name)
            assert (e if e.kind != "hardlink" else got[e.link_target]).content == body, name
    assert got["a/sparse"].content == (tree / "a/sparse").read_bytes()
    assert (got["link"].link_target, got["far"].link_target) == ("a/small", "y" * 100)
    assert sorted([got["hard"].kind, got["a/small"].kind]) == ["hardlink", "regular"]
    assert "zz gone" not in got
    gone = [e for e in found if e.deleted and e.kind == "regular"]
    assert gone
    if kind == "ext2":
        assert files["zz gone"] in [e.content for e in gone]


def test_damage():
    assert [e.kind for e in readers.read("ext4", b"\0" * 4096)] == ["diagnostic"]
