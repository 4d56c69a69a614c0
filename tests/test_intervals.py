"""The streamed interval operators against brute force; checksums."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from gneiss.functions import hashing
from gneiss.operators import intervals


@pytest.fixture(scope="module")
def claims():
    rnd = random.Random(9)
    return [(k, rnd.choice("abc"), o := rnd.randrange(300), o + rnd.choice([0, 1, 5, 40, 200])) for k in range(400)]


def test_innermost_parent(spark, claims):
    rnd = random.Random(10)
    points = [(k, rnd.choice("abcd"), rnd.randrange(-20, 600)) for k in range(500)]
    got = {r.point: r.parent for r in intervals.innermost_parent(spark.createDataFrame(points, "point long, key string, at long"), spark.createDataFrame(claims, "ord long, key string, off long, stop long"), ["key"], 64).collect()}
    assert len(got) == len(points)
    for p, key, at in points:
        hold = [(-(stop - off), k) for k, own, off, stop in claims if own == key and off <= at < stop]
        assert got[p] == (max(hold)[1] if hold else None)
    none = spark.createDataFrame([], "ord long, key string, off long, stop long")
    assert {r.parent for r in intervals.innermost_parent(spark.createDataFrame(points, "point long, key string, at long"), none, ["key"], 64).collect()} == {None}


def test_overlay(spark, claims):
    got = intervals.overlay(spark.createDataFrame([(k, key, a, b) for k, key, a, b in claims], "version long, key string, off long, stop long"), ["key"]).collect()
    held = {}
    for r in got:
        for x in range(r.off, r.stop):
            assert (r.key, x) not in held
            held[r.key, x] = r.version
    want = {}
    for k, key, a, b in claims:
        for x in range(a, b):
            want[key, x] = max(k, want.get((key, x), -1))
    assert held == want
    runs = sorted((r.key, r.off, r.stop, r.version) for r in got)
    assert not any(a[0] == b[0] and a[2] == b[1] and a[3] == b[3] for a, b in zip(runs, runs[1:], strict=False))
    assert intervals.overlay(spark.createDataFrame([], "version long, key string, off long, stop long"), ["key"]).count() == 0


def test_crcs(spark):
    r = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "c binary").select(hashing.crcs(F.col("c")).alias("x")).collect()
    x = r[0].x
    assert (x.crc32, x.crc32c, x.qnx6, x.ubi) == (0xCBF43926, 0xE3069283, 0x89A1897F, 0xCBF43926 ^ 0xFFFFFFFF) and r[1].x is None
    assert x.jffs2 == zlib.crc32(b"123456789", 0xFFFFFFFF) ^ 0xFFFFFFFF
