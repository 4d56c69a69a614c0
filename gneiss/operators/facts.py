"""What a system says about itself: facts (node, ord, key, value, source) of Linux, Android and QNX trees.

Trees are DataFrames of entries (node, ord, path, kind, link_target, deleted, superseded, content). Most facts are named
values of small files, so they come from tables that say which file, which name in it, and which key it becomes;
one join makes them all. A source is the path that a fact was read from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions.text import sanitize
from gneiss.operators import survey
from gneiss.operators.lineage import cut

#: How much of a text is read, and where lists and names are cut.
TEXT_BYTES, LIST_CHARS, NAME_CHARS = 4 << 20, 400, 600

#: Fixed values: (platform, group, files, names and their keys). Of a group's files the first that is there is read; where ``each`` is set, all are.
ENV_FILES = [
    ("linux", "release", ("etc/os-release", "usr/lib/os-release", "etc/lsb-release"), False, {
        "PRETTY_NAME": "os.pretty_name", "NAME": "os.name", "ID": "os.id", "VERSION": "os.version", "VERSION_ID": "os.version_id", "BUILD_ID": "os.build_id",
        "DISTRIB_DESCRIPTION": "os.pretty_name", "DISTRIB_ID": "os.name", "DISTRIB_RELEASE": "os.version",
    }),
    ("linux", "openwrt", ("etc/openwrt_release",), False, {
        "DISTRIB_DESCRIPTION": "os.pretty_name", "DISTRIB_ID": "os.name", "DISTRIB_RELEASE": "os.version", "DISTRIB_REVISION": "os.build_id", "DISTRIB_TARGET": "os.target", "DISTRIB_ARCH": "os.arch",
    }),
    ("android", "properties", ("build.prop", "system/build.prop", "default.prop"), True, {
        "ro.build.fingerprint": "os.fingerprint", "ro.build.version.release": "os.version", "ro.build.version.sdk": "os.sdk", "ro.build.version.security_patch": "os.security_patch",
        "ro.build.id": "build.id", "ro.build.date": "build.date", "ro.build.type": "build.type", "ro.build.tags": "build.tags", "ro.build.flavor": "build.flavor",
        "ro.product.model": "device.model", "ro.product.manufacturer": "device.manufacturer", "ro.product.brand": "device.brand", "ro.product.device": "device.codename",
        "ro.product.name": "device.product", "ro.product.cpu.abi": "device.abi", "ro.board.platform": "device.soc", "ro.debuggable": "security.debuggable", "ro.secure": "security.secure",
        "ro.boot.verifiedbootstate": "security.verified_boot", "ro.build.selinux": "security.selinux", "ro.boot.flash.locked": "security.bootloader_locked", "ro.oem_unlock_supported": "security.oem_unlock",
    }),
    ("qnx", "buildinfo", ("Buildinfo.txt", "etc/Buildinfo.txt", "build.txt"), False, {
        "BUILD_ID": "build.id", "BUILD_TIMESTAMP": "build.timestamp", "TARGET_PRODUCT": "build.product", "TARGET_BUILD_VARIANT": "build.variant", "SECURE_BOOT": "build.secure_boot",
        "QC_PRODUCT": "build.soc", "QC_DISTRIBUTION": "build.soc_distribution", "MANIFESTS_REVISION": "build.manifest_revision",
    }),
]

#: The JSON manifest of QNX units, its names and their keys; arrays count.
MANIFESTS = ("artifact.json", "fs/os/artifact.json", "etc/artifact.json")
MANIFEST_KEYS = {
    "FPN": "build.part_number", "artifact_version": "build.id", "FD02": "build.product", "build_guid": "build.guid", "build_method": "build.method", "git_commit": "build.git_commit", "groupid": "build.group",
    "jenkins_build": "build.jenkins", "nexus_version": "build.nexus_version", "file": "build.image", "schema_version": "build.manifest_schema", "component": "build.components", "engineering_use_only": "build.engineering_only",
}

#: Fixed values: (platform, path, key): a file whose being there is the fact; ``value`` says present, or the path where it is None.
PRESENT = [
    ("linux", "etc/config/network", "network.uci", "present"), ("linux", "etc/config/wireless", "network.wireless_uci", "present"), ("linux", "etc/network/interfaces", "network.interfaces", "present"),
    ("linux", "bin/busybox", "userland.busybox", "present"), ("linux", "usr/sbin/dropbear", "service.ssh", None), ("linux", "sbin/dropbear", "service.ssh", None), ("linux", "usr/sbin/sshd", "service.ssh", None),
    ("linux", "usr/sbin/telnetd", "service.telnet", None), ("linux", "sbin/telnetd", "service.telnet", None),
    ("android", "system/users/userlist.xml", "users.list", "present"), ("android", "system/packages.xml", "apps.packages_xml", "present"),
    ("qnx", "etc/ftpusers", "service.ftpusers", "present"), ("qnx", "usr/sbin/sshd", "service.sshd", None), ("qnx", "bin/sshd", "service.sshd", None),
    ("qnx", "bin/secpol", "security.secpol", "present"), ("qnx", "etc/secpolgenerate.cfg", "security.secpol", "present"), ("qnx", "lib64/libsecpol.so", "security.secpol", "present"),
]

#: Services whose credentials cross the network in clear text.
CLEAR_TEXT = ("telnet", "shell", "login", "ftp", "exec")

#: Password states that an account gets a row of its own for, and the hashes that crack quickly.
REAL_HASHES, WEAK_HASHES = ("md5", "bcrypt", "sha256", "sha512", "yescrypt", "crypt-other", "descrypt", "qnx-strong"), ("md5", "descrypt")


#: The paths whose contents analyzers read, apart from lib/modules.
READ = {p for _, _, paths, _, _ in ENV_FILES for p in paths} | set(MANIFESTS) | {
    "etc/hostname", "etc/banner", "etc/resolv.conf", "etc/passwd", "etc/shadow", "proc/boot/passwd", "proc/boot/shadow", "etc/inetd.conf", "proc/boot/inetd.conf",
}


def files(entries: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(node, path, source, content): every readable file under its own path and under those of links to it.

    ``wanted`` tells by ``path`` which ones; contents of others never move.
    """
    wanted = F.lit(True) if wanted is None else wanted
    index = survey.path_index(entries.drop("content"))
    held = entries.where("NOT deleted AND NOT superseded AND kind = 'regular'").select("node", "ord", F.btrim("path", F.lit("/")).alias("path"), "content")
    links = survey.resolve_links(index.select("node", "path", "kind", "link_target")).where(wanted & F.col("target").isNotNull())
    own = index.where(wanted & (F.col("kind") == "regular")).select("node", "path", F.col("path").alias("target"))
    places = own.unionByName(links.select("node", "path", "target"))
    first = index.select("node", F.col("path").alias("target"), "ord")
    return places.join(first, ["node", "target"]).join(held.withColumnRenamed("path", "target"), ["node", "target", "ord"]).select("node", "path", F.col("target").alias("source"), "content")


def _read(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of a tree and the few texts that analyzers read, each cut from its lineage: many facts come from both."""
    index = cut(survey.path_index(entries.drop("content")))
    return index, cut(files(entries, F.col("path").isin(*sorted(READ)) | F.col("path").rlike("^lib/modules/[^/]+/modules[.]builtin$")))


def read_text(tree: DataFrame, paths: tuple[str, ...], most: int = TEXT_BYTES, each: bool = False) -> DataFrame:
    """(node, path, source, text): of the paths the first that can be read, or all; sanitised, up to ``most`` bytes."""
    place = F.array_position(F.array(*map(F.lit, paths)), F.col("path"))
    held = tree.where(F.col("path").isin(*paths) & F.col("content").isNotNull()).withColumn("__n", place)
    if not each:
        held = held.withColumn("__k", F.row_number().over(W.partitionBy("node").orderBy("__n"))).where("__k = 1")
    return held.select("node", "path", "source", sanitize(F.substring("content", 1, most)).alias("text"))


def list_dir(index: DataFrame, folder: str) -> DataFrame:
    """(node, name, folder): direct children of a folder, folders that only a child's path implies included."""
    below = index.select("node", "path", F.lit(False).alias("isdir")).union(survey.directories(index).withColumn("isdir", F.lit(True)))
    names = below.where(F.col("path").startswith(f"{folder}/")).select("node", F.substring("path", len(folder) + 2, 1 << 20).alias("name"), "isdir")
    return names.where(~F.col("name").contains("/") & (F.col("name") != "")).groupBy("node", "name").agg(F.max("isdir").alias("isdir"))


def files_under(index: DataFrame, folder: str, most: int = 8192) -> DataFrame:
    """(node, path): what lies below a folder and is none itself, in order, the first ``most`` of a node."""
    own = index.where(F.col("path").startswith(f"{folder}/") & (F.col("kind") != "directory")).select("node", "path")
    return own.withColumn("__n", F.row_number().over(W.partitionBy("node").orderBy("path"))).where(F.col("__n") <= most).drop("__n")


def joined(names: Column, most: int) -> Column:
    """Names in order, joined by commas; once more than ``most`` characters are used, the rest is three dots."""
    step = lambda acc, x: (
        F.when(acc.endswith(",..."), acc).when(F.length(acc) > most, F.concat(acc, F.lit(",..."))).when(acc == "", x).otherwise(F.concat_ws(",", acc, x))
    )
    return F.aggregate(names, F.lit(""), step)


def _facts(rows: DataFrame, order: int, key, value, source) -> DataFrame:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("node", F.lit(order).alias("ord"), column(key).alias("key"), column(value).cast("string").alias("value"), column(source).alias("source"))


def env_facts(tree: DataFrame, platform: str) -> DataFrame:
    """The facts of KEY=VALUE files; of one name the first value counts."""
    out = []
    for k, (own, _, paths, each, names) in enumerate(ENV_FILES):
        if own == platform:
            pairs = survey.env_pairs(read_text(tree, paths, 1 << 20, each), ["node", "source"], "text").withColumnRenamed("key", "name")
            table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
            out.append(_facts(pairs.withColumn("__key", F.try_element_at(table, F.col("name"))).where("__key IS NOT NULL"), k, F.col("__key"), F.col("value"), F.col("source")))
    return reduce(DataFrame.unionByName, out)


def present_facts(index: DataFrame, platform: str) -> DataFrame:
    own = [(path, key, value or path) for p, path, key, value in PRESENT if p == platform]
    table = F.broadcast(index.sparkSession.createDataFrame(own, "path string, __key string, __value string"))
    return _facts(index.where("kind <> 'directory'").select("node", "path").join(table, "path"), 50, F.col("__key"), F.col("__value"), F.col("path"))


def account_facts(tree: DataFrame, passwd: tuple[str, ...], shadow: tuple[str, ...], least: int) -> tuple[DataFrame, DataFrame]:
    """Facts and diagnostics of accounts: how many, which are root, which have a hash or none at all, and how many are in each other state.

    Hashes are never told. Counts come from the shadow file where there is one, else from passwd.
    """
    lines = lambda t: t.select("node", "source", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> '' AND NOT startswith(line, '#')").select("node", "source", F.split("line", ":").alias("f"))
    pw, sh = lines(read_text(tree, passwd)), lines(read_text(tree, shadow))
    users = pw.where(F.size("f") >= least)
    counts = users.groupBy("node", "source").agg(F.count("*").alias("n"), F.count_if(F.col("f")[2] == "0").alias("root"))
    facts = [
        _facts(users.where(F.col("f")[2] == "0").withColumn("name", F.col("f")[0]), 20, "user.uid0", F.col("name"), F.col("source")),
        _facts(counts, 21, "users.count", F.col("n"), F.col("source")),
        _facts(counts.where("root > 1"), 22, "users.uid0_count", F.col("root"), F.col("source")),
    ]
    states = lambda rows, shadow: rows.where((F.size("f") >= 2) & (F.col("f")[0] != "")).select("node", "source", F.col("f")[0].alias("name"), survey.hash_kind(F.col("f")[1], shadow).alias("state"))
    both = states(pw, False).withColumn("shadow", F.lit(False)).unionByName(states(sh, True).withColumn("shadow", F.lit(True)))
    own = both.where(F.col("state").isin(*REAL_HASHES, "empty"))
    facts.append(_facts(own, 23, F.concat(F.lit("user."), "name", F.lit(".password")), F.col("state"), F.col("source")))
    counted = both.join(sh.select("node").distinct().withColumn("has_shadow", F.lit(True)), "node", "left").where(F.col("shadow") == F.coalesce("has_shadow", F.lit(False)))
    kind = F.when(F.col("state").isin(*REAL_HASHES), F.lit("users.with_password")).otherwise(F.concat(F.lit("users.password_"), "state"))
    facts.append(_facts(counted.groupBy("node", "source", kind.alias("__key")).agg(F.count("*").alias("n")), 24, F.col("__key"), F.col("n"), F.col("source")))
    empty = own.where("state = 'empty'").select("node", F.lit("platform-account-no-password").alias("code"), F.format_string("'%s' in %s logs in without a password", "name", "source").alias("message"))
    exposed = F.col("state").isin(*WEAK_HASHES) | (~F.col("shadow") & F.col("state").isin(*REAL_HASHES))
    weak = own.where(exposed).select("node", F.lit("platform-account-weak-hash").alias("code"), F.format_string("'%s' in %s: the %s hash is weak or stands where all can read it", "name", "source", "state").alias("message"))
    return reduce(DataFrame.unionByName, facts), empty.unionByName(weak)


def kernel_facts(tree: DataFrame, index: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The release that lib/modules names, its modules by subsystem and name, those built in, and one module's version magic."""
    root = "lib/modules/"
    rest = F.substring("path", len(root) + 1, 1 << 20)
    part = F.substring_index(rest, "/", 1)
    below = index.where(F.col("path").startswith(root))
    is_module = F.col("path").rlike(r"\.ko(\.(gz|xz|zst|bz2))?$")
    named = below.where((rest.contains("/")) | (F.col("kind") == "directory")).select("node", part.alias("release")).where("release <> ''").distinct()
    releases = named.groupBy("node").agg(F.array_sort(F.collect_set("release")).alias("all"))
    last = releases.select("node", F.element_at("all", -1).alias("release"), "all")
    several = last.where(F.size("all") > 1)
    of = last.select("node", "release", F.concat(F.lit(root), "release").alias("folder"))
    inside = F.substring(rest, F.length("release") + 2, F.lit(1 << 20))
    modules = below.where(is_module & (F.col("kind") != "directory")).join(of, "node").where((part == F.col("release")) & rest.contains("/"))
    modules = modules.select("node", "folder", "path", inside.alias("inside"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.ko.*$", "").alias("name"))
    counts = of.join(modules.groupBy("node").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("path", "name"))), lambda x: x["name"]).alias("names")), "node", "left")
    folder = F.when(F.col("inside").startswith("kernel/") & F.substring(F.col("inside"), 8, 1 << 20).contains("/"), F.regexp_replace(F.substring("inside", 8, 1 << 20), "/[^/]*$", ""))

    def by_folder(rows: DataFrame, name: str) -> DataFrame:
        n = rows.where(F.col(name).isNotNull()).groupBy("node", "folder", name).agg(F.count("*").alias("n"))
        lists = n.groupBy("node", "folder").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(name).alias("k")))).alias("all"))
        return lists.select("node", "folder", joined(F.transform("all", lambda x: F.concat_ws("=", x["k"], (-x["m"]).cast("string"))), LIST_CHARS).alias("value"))

    built_path = F.concat("folder", F.lit("/modules.builtin"))
    built = tree.join(of, "node").where(F.col("path") == built_path).select("node", F.col("path").alias("folder"), F.posexplode(F.split(sanitize(F.substring("content", 1, 1 << 20)), "\n")).alias("pos", "line"))
    built = built.withColumn("line", F.rtrim("line")).where("line <> '' AND NOT startswith(line, '#')")
    built = built.select("node", "folder", "pos", F.regexp_replace(F.substring_index("line", "/", -1), r"\.ko.*$", "").alias("name"), F.when(F.col("line").rlike("^kernel/.+/"), F.regexp_replace(F.substring("line", 8, 1 << 20), "/[^/]*$", "")).alias("where"))
    built_counts = built.groupBy("node", "folder").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    said = F.regexp_extract(F.decode(F.substring("content", 1, 512 << 10), "iso-8859-1"), r"(?s)(?:^|\x00)vermagic=([^\x00]*)", 1)
    magic = entries.where("kind = 'regular' AND NOT deleted AND NOT superseded").select("node", F.btrim("path", F.lit("/")).alias("path"), "content").where(F.col("path").startswith(root) & is_module)
    magic = modules.select("node", "path").join(magic.select("node", "path", said.alias("magic")), ["node", "path"]).where("magic <> ''")
    first = magic.groupBy("node").agg(F.min_by(F.struct("path", "magic"), "path").alias("m")).select("node", "m.path", "m.magic")
    facts = [
        _facts(several, 10, "kernel.versions", F.substring(F.array_join("all", ","), 1, 200), "lib/modules"),
        _facts(of, 11, "kernel.version", F.col("release"), F.col("folder")),
        _facts(counts, 12, "kernel.modules.count", F.coalesce("n", F.lit(0)), F.col("folder")),
        _facts(built_counts, 13, "kernel.builtin.count", F.col("n"), F.col("folder")),
        _facts(built_counts, 13, "kernel.builtin.names", joined(F.col("names"), NAME_CHARS), F.col("folder")),
        _facts(by_folder(built, "where"), 13, "kernel.builtin.subsystems", F.col("value"), F.col("folder")),
        _facts(by_folder(modules.withColumn("where", folder), "where"), 14, "kernel.modules.subsystems", F.col("value"), F.col("folder")),
        _facts(counts.where("n > 0"), 15, "kernel.modules.names", joined(F.col("names"), NAME_CHARS), F.col("folder")),
        _facts(first, 16, "kernel.vermagic", F.col("magic"), F.col("path")),
    ]
    claimed = F.regexp_extract("magic", r"^[0-9.]*", 0)
    wrong = first.join(of, "node").where((claimed != "") & (claimed != F.col("release")))
    said = wrong.select("node", F.lit("platform-linux-kernel-mismatch").alias("code"), F.format_string("'%s' was built for kernel %s but stands under %s", "path", claimed, "release").alias("message"))
    many = several.select("node", F.lit("platform-linux-kernel-multiple").alias("code"), F.format_string("lib/modules holds %d releases", F.size("all")).alias("message"))
    return reduce(DataFrame.unionByName, facts), said.unionByName(many)


def linux_facts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and diagnostics of Linux trees: release files, host, banner, kernel, accounts, network and services."""
    index, tree = _read(entries)
    one = lambda path, most: read_text(tree, (path,), most)
    host = one("etc/hostname", 256).select("node", "source", F.substring(F.btrim("text", F.lit(" \t\r\n")), 1, 128).alias("value"))
    line = F.element_at(F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]")), 1)
    banner = one("etc/banner", 8 << 10).where(F.exists(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]"))).select("node", "source", F.substring(F.btrim(line, F.lit(" -")), 1, 200).alias("value"))
    servers = F.filter(F.transform(F.filter(F.split("text", "\n"), lambda x: x.startswith("nameserver")), lambda x: F.regexp_replace(F.substring(x, 11, 1 << 20), "^[ \t]+", "")), lambda x: x != "")
    resolv = one("etc/resolv.conf", 8 << 10).select("node", "source", F.array_join(servers, ",").alias("value"))
    kernel, kernel_said = kernel_facts(tree, index, entries)
    users, users_said = account_facts(tree, ("etc/passwd",), ("etc/shadow",), 7)
    services = None
    for k, folder in enumerate(("etc/init.d", "etc/rc.d", "etc/systemd/system")):
        own = list_dir(index, folder).groupBy("node").agg(F.array_sort(F.collect_list("name")).alias("names")).withColumns({"folder": F.lit(folder), "k": F.lit(k)})
        services = own if services is None else services.unionByName(own)
    first = services.groupBy("node").agg(F.min_by(F.struct("folder", "names"), "k").alias("s")).select("node", "s.*")
    init = [_facts(first, 40, "init.dir", F.col("folder"), F.col("folder")), _facts(first, 41, "init.count", F.size("names"), F.col("folder")), _facts(first, 42, "init.services", joined(F.col("names"), LIST_CHARS), F.col("folder"))]
    parts = [env_facts(tree, "linux"), _facts(host, 5, "os.hostname", F.col("value"), F.col("source")), _facts(banner, 6, "os.banner", F.col("value"), F.col("source")), kernel, users, _facts(resolv, 30, "network.nameservers", F.col("value"), F.col("source")), *init, present_facts(index, "linux")]
    facts = reduce(DataFrame.unionByName, parts)
    known = tree.where(F.col("path").isin("etc/os-release", "usr/lib/os-release", "etc/lsb-release", "etc/openwrt_release")).select("node").distinct()
    silent = index.select("node").distinct().join(known, "node", "left_anti").select("node", F.lit("platform-linux-no-release").alias("code"), F.lit("no release file says which distribution this is").alias("message"))
    return _told(facts), kernel_said.unionByName(users_said).unionByName(silent)


def android_facts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and diagnostics of Android partitions: which one, properties, users and apps."""
    index, tree = _read(entries)
    facts = [env_facts(tree, "android"), present_facts(index, "android")]
    pairs = survey.env_pairs(read_text(tree, ENV_FILES[2][2], 1 << 20, True), ["node", "source"], "text")
    wide = pairs.groupBy("node", "source").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(a) for k, a in (("ro.product.brand", "brand"), ("ro.product.model", "model"), ("ro.build.version.release", "release"))))
    pretty = F.concat(F.concat_ws(" ", "brand", "model"), F.coalesce(F.format_string(" (Android %s)", F.col("release")), F.lit("")))
    facts.append(_facts(wide.where("model IS NOT NULL").withColumn("value", F.when(F.col("release").isNull(), F.concat_ws(" ", "brand", "model")).otherwise(pretty)), 3, "os.pretty_name", F.col("value"), F.col("source")))
    users = list_dir(index, "system/users").where(F.col("name").rlike("^[0-9]+$")).groupBy("node").agg(F.count("*").alias("n"))
    apps = list_dir(index, "data").groupBy("node").agg(F.count("*").alias("n"))
    facts += [_facts(users, 20, "users.count", F.col("n"), "system/users"), _facts(apps, 21, "apps.data_dirs", F.col("n"), "data")]
    bad = (("ro.debuggable", F.col("value") == "1", "platform-android-debuggable"), ("ro.secure", F.col("value") == "0", "platform-android-insecure"), ("ro.boot.verifiedbootstate", F.col("value") != "green", "platform-android-unverified"))
    said = [pairs.where((F.col("key") == k) & test).select("node", F.lit(code).alias("code"), F.concat_ws("=", "key", "value").alias("message")) for k, test, code in bad]
    return _told(reduce(DataFrame.unionByName, facts)), reduce(DataFrame.unionByName, said)


def qnx_facts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and diagnostics of QNX trees: build files and manifests, accounts, inetd services, security policies."""
    index, tree = _read(entries)
    facts = [env_facts(tree, "qnx"), present_facts(index, "qnx")]
    pairs = survey.env_pairs(read_text(tree, ENV_FILES[3][2], 64 << 10), ["node", "source"], "text")
    facts.append(_facts(pairs.where("contains(key, '.')"), 4, F.concat(F.lit("build.vendor."), F.replace("key", F.lit("."), F.lit("_"))), F.col("value"), F.col("source")))
    manifest = read_text(tree, MANIFESTS)
    table = F.create_map(*(F.lit(x) for kv in MANIFEST_KEYS.items() for x in kv))
    own = survey.json_facts(manifest, ["node", "source"], "text").withColumn("__key", F.try_element_at(table, F.col("key"))).where("__key IS NOT NULL")
    facts.append(_facts(own, 5, F.col("__key"), F.col("value"), F.col("source")))
    users, users_said = account_facts(tree, ("etc/passwd", "proc/boot/passwd"), ("etc/shadow", "proc/boot/shadow"), 3)
    inetd = read_text(tree, ("etc/inetd.conf", "proc/boot/inetd.conf"), 256 << 10).select("node", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("NOT startswith(line, '#')")
    words = inetd.select("node", "source", "pos", F.filter(F.split("line", "[ \t]+"), lambda x: x != "").alias("w")).where(F.size("w") >= 6).select("node", "source", "pos", F.col("w")[0].alias("service"), F.col("w")[4].alias("user"))
    names = words.groupBy("node", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "service"))), lambda x: x["service"]), ",").alias("value"))
    facts += [users, _facts(words, 31, F.concat(F.lit("service."), "service"), F.col("user"), F.col("source")), _facts(names, 32, "services.inetd", F.col("value"), F.col("source"))]
    policies = list_dir(index, "proc/boot").where(F.col("name").startswith("secpol")).groupBy("node").agg(F.count("*").alias("n"))
    chroot = survey.directories(index).where(F.col("path").isin("var/chroot", "chroot")).select("node").distinct()
    facts += [_facts(policies, 45, "security.secpol_files", F.col("n"), "proc/boot"), _facts(chroot, 46, "security.chroot", "present", "var/chroot")]
    clear = words.where(F.col("service").isin(*CLEAR_TEXT)).select("node", F.lit("platform-qnx-insecure-service").alias("code"), F.format_string("%s enables '%s' as %s", "source", "service", "user").alias("message"))
    agent = index.where(F.col("path").isin("usr/sbin/qconn", "bin/qconn")).select("node", F.lit("platform-qnx-insecure-service").alias("code"), F.lit("qconn is present: remote control without a password").alias("message")).distinct()
    engineering = own.where((F.col("key") == "engineering_use_only") & ~F.col("value").isin("NO", "false", "0")).select("node", F.lit("platform-qnx-engineering-build").alias("code"), F.concat("source", F.lit(": not a production image")).alias("message"))
    unreadable = manifest.where(F.expr("try_parse_json(text)").isNull()).select("node", F.lit("platform-manifest-unreadable").alias("code"), F.col("source").alias("message"))
    return _told(reduce(DataFrame.unionByName, facts)), reduce(DataFrame.unionByName, [users_said, clear, agent, engineering, unreadable])


def _told(facts: DataFrame) -> DataFrame:
    """Without empty values; of equal (key, value) of a node the first stays, with its source."""
    good = facts.where("coalesce(value, '') <> ''")
    first = good.groupBy("node", "key", "value").agg(F.min_by(F.struct("ord", "source"), F.struct("ord", "source")).alias("f"))
    return first.select("node", "f.ord", "key", "value", "f.source")


ANALYZERS = {"linux": linux_facts, "android": android_facts, "qnx": qnx_facts}


def register(platform: str, analyzer) -> None:
    """Adds an analyzer (entries) -> (facts, diagnostics); survey.MARKERS says when it applies."""
    ANALYZERS[platform] = analyzer


def describe(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, platform, score), facts and diagnostics of each node by the analyzer of its platform; nodes of none say platform-unrecognised."""
    index = survey.path_index(entries.drop("content"))
    scored = cut(survey.best(survey.scores(index), ["node"], list(survey.PLATFORMS)).select("node", "platform", "score"))
    facts, said = [], []
    for platform, analyzer in ANALYZERS.items():
        own = entries.join(scored.where(F.col("platform") == platform).select("node"), "node", "left_semi")
        a, b = analyzer(own)
        facts.append(cut(a))
        said.append(cut(b))
    unknown = entries.select("node").distinct().join(scored, "node", "left_anti").select("node", F.lit("platform-unrecognised").alias("code"), F.lit("no analyzer knows this tree").alias("message"))
    return scored, reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, [*said, unknown])
