"""The evidence graph on small rows."""

from pyspark.sql import functions as F

from gneiss.operators import graph

T = "partition-table"


def test_choose_tables(spark):
    rows = [(0, "mbr", T, "mbr-primary", ""), (1, "gpt", T, "gpt-primary", "a"), (2, "gpt", T, "gpt-primary", "a"), (3, "gpt", T, "gpt-backup", "a"), (4, "gpt", T, "gpt-backup", "b"), (5, "gpt", T, "gpt-backup", ""), (6, "gpt", T, "gpt-primary", ""), (7, "ext4", "filesystem", None, None)]
    df = spark.createDataFrame([("i", *r) for r in rows], "image_id string, place long, format string, category string, role string, disk_guid string")
    assert sorted((r.place, r.backup) for r in graph.choose_tables(df).collect()) == [(0, None), (1, 3), (2, None), (4, None), (5, None), (6, None)]
    assert graph.choose_tables(df.limit(0)).count() == 0


def test_table_bytes(spark):
    df = spark.createDataFrame([("mbr", 0, None, None, None), ("gpt", 0, 512, 128, 128), ("gpt", 0, 512, 5, 128), ("gpt", 0, 0, 4, 128), ("gpt", 1000, 512, 128, 128), ("gpt", 0, None, None, None)], "f string, s long, sector long, n long, e long")
    got = df.select(graph.table_bytes(*(F.col(c) for c in ("f", "s", "sector", "n", "e"))).alias("x"))
    assert [r.x for r in got.collect()] == [512, 17408, 2048, 1536, 1000, 1024]


def test_table_entries(spark):
    rows = [("i", 0, 0, "mbr", "p1:512:9000:0xee", 10000), ("i", 1, 512, "gpt", "p1:2000:3000:x;p2:9000:5000:y;bad", 10000), ("i", 2, 2500, "mbr", "p1:5500:100:0x83", 10000), ("i", 3, 5550, "mbr", "p1:12000:5:0x83", 10000)]
    rows = [(a, b, c, d, e.replace("p", ""), f) for a, b, c, d, e, f in rows]
    df = spark.createDataFrame(rows, "image_id string, place long, offset long, format string, partitions string, image_size long")
    got = sorted((r.place, r.start, r.protective, r.nested, r.length, r.outside) for r in graph.table_entries(df).collect())
    assert got == [(0, 512, True, False, 9000, False), (1, 2000, False, False, 3000, False), (1, 9000, False, False, 1000, False), (2, 5500, False, True, 100, False), (3, 12000, False, False, 0, True)]


def test_subtract_claims(spark):
    gaps = spark.createDataFrame([("i", 100, 200), ("i", 300, 400), ("j", 0, 10)], "image_id string, gap_off long, gap_end long")
    claims = spark.createDataFrame([("i", 120, 130), ("i", 150, 350), ("i", 390, 500), ("i", 600, 700), ("k", 5, 6), ("k", 8, 9)], "image_id string, off long, stop long")
    assert sorted(map(tuple, graph.subtract_claims(gaps, claims, ["image_id"]).collect())) == [("i", 100, 120), ("i", 130, 150), ("i", 350, 390), ("j", 0, 10)]


def test_to_rescan(spark):
    parts = spark.createDataFrame([("i", 0, 10, b"\0\0"), ("i", 10, 10, b"ab"), ("i", 20, 10, b"ab"), ("i", 30, 0, b"ab")], "image_id string, start long, length long, head binary")
    found = spark.createDataFrame([("i", 10), ("i", 10)], "image_id string, offset long")
    assert [r.start for r in graph.to_rescan(parts, found).collect()] == [20]


def test_describe_gap(spark):
    noise = bytes((k * k * 7919 + k // 256 * 31) % 251 for k in range(8192))
    df = spark.createDataFrame([(0, b"\xff" * 5000), (1, b"\x05" * 300), (2, b"plain text, many words " * 40), (3, b"abc"), (4, b""), (5, noise)], "k int, c binary")
    got = {r.k: r.g for r in df.select("k", graph.describe_gap(F.col("c")).alias("g")).collect()}
    assert (got[0].fill, got[0].entropy, got[0]["class"], got[0].high) == ("0xff", "0.000", "erased", False)
    assert got[1].fill == "0x5" and got[2].fill is None and got[2]["class"] == "text" and not got[2].high
    assert got[3]["class"] is None and got[4].fill is None and got[4]["class"] is None


def test_nodes(spark):
    df = spark.createDataFrame(
        [("i", 0, 10, 99, "ext4", "filesystem", "s", "e", {"label": "", "name": "data", "category": "old"}, ["d"], [("x", "y", 16, 25)]), ("i", 9, 0, 60, "uimage", "other", "s", "e", {}, [], [])],
        "image_id string, offset long, size long, confidence int, format string, category string, signature string, evidence string, attrs map<string,string>, diagnostics array<string>, also array<struct<format:string,signature:string,offset:long,confidence:int>>",
    )
    a, b = graph.nodes_from_findings(df).orderBy("offset").collect()
    assert (a.kind, a.name, a.attrs["category"], b.kind, b.name) == ("filesystem", "data", "filesystem", "container", "uimage")
    assert a.diagnostics == ["d", "also-matched: x (y) at 0x10 with confidence 25"]


def test_order_ids_and_budgets(spark):
    items = spark.createDataFrame([("c", 5, True, 0), ("c", 5, False, 1), ("c", 0, True, 2)], "c string, offset long, is_gap boolean, ord long")
    assert [r.ord for r in graph.in_byte_order(items, ["c"]).orderBy("item").collect()] == [2, 1, 0]
    nodes = spark.createDataFrame([("c", "a", None, 1, 10), ("c", "b", "a", 2, 20), ("c", "d", "zz", 4, 40)], "c string, key string, parent string, n_files long, n_bytes long")
    got = graph.number_nodes(nodes, ["c"], "key").orderBy("key").collect()
    assert [(r.id, r.parent_id, r.parent_missing) for r in got] == [("n000001", None, False), ("n000002", "n000001", False), ("n000003", None, True)]
    assert [(r.files_before, r.bytes_before) for r in graph.used_before(nodes, ["c"], "key").orderBy("key").collect()] == [(0, 0), (1, 10), (3, 30)]


def test_carve_plan(spark):
    rows = [
        ("img", None, "image", "", 0, 999, None, False, False, False), ("t", "img", "partition", "gpt", 0, 512, None, True, False, False), ("p", "img", "partition", "", 100, 50, None, False, False, False),
        ("o", "img", "partition", "", 900, 0, None, False, False, True), ("v", "img", "partition", "", 0, 99, None, False, True, False), ("big", "img", "partition", "", 200, 500, None, False, False, False),
        ("fs", "p", "filesystem", "ext4", 100, 40, None, False, False, False), ("in", "p", "container", "zip", 120, 10, None, False, False, False), ("un", "img", "region", "", 300, 10, None, False, False, False),
        ("z", "img", "region", "elf", 310, 0, None, False, False, False), ("f", "fs", "file", "", 0, 40, 20, False, False, False), ("w", "f", "container", "gzip", 0, 20, None, False, False, False), ("s", "f", "region", "elf", 4, 10, None, False, False, False), ("deep", "fs", "region", "elf", 4, 10, None, False, False, False),
    ]
    df = spark.createDataFrame([("i", *r) for r in rows], "image_id string, id string, parent_id string, kind string, format string, offset long, length long, file_size long, is_table boolean, protective boolean, outside boolean")
    got = {r.id: (r.action, r.carved_in) for r in graph.carve_plan(df, True, 400).collect()}
    assert got == {"p": ("carve", None), "big": ("too-large", None), "fs": ("in-parent", "p"), "in": ("carve", None), "z": ("unknown-size", None), "s": ("carve", None)}
    assert {r.id for r in graph.carve_plan(df, False, 400).collect()} == {"p", "big"}


def test_mounts(spark):
    rows = graph.mounts(spark.createDataFrame([("a.img", "fat16"), ("it's", "ext2"), ("c", "ubifs"), ("d", "zip")], "file string, format string")).orderBy("file").collect()
    assert [(r.file, r.how, r.mount_type) for r in rows] == [("a.img", "mount", "vfat"), ("c", "flash", None), ("it's", "mount", "ext4")]
    assert "mount -o ro,loop -t ext4 \"$here\"/'it'\\''s'" in graph.mount_script([r for r in rows if r.how == "mount"])
