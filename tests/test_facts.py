"""Facts of small Linux, Android and QNX trees."""

from gneiss.operators import facts

SCHEMA = "node string, ord long, path string, kind string, link_target string, deleted boolean, superseded boolean, content binary"


def tree(spark, node, rows, links=()):
    out = [(node, k, p, "directory" if b is None else "regular", None, False, False, None if b is None else b) for k, (p, b) in enumerate(rows)]
    out += [(node, 1000 + k, p, "symlink", to, False, False, None) for k, (p, to) in enumerate(links)]
    return spark.createDataFrame(out, SCHEMA)


def told(df):
    return {(r.key, r.value) for r in df.collect()}


def test_linux(spark):
    rows = [
        ("usr/lib/os-release", b'NAME="OpenWrt"\nVERSION_ID=18.06\n#ID=no\nEMPTY=\n'), ("etc/openwrt_release", b"DISTRIB_ARCH='mips'\nDISTRIB_ID='OpenWrt'\n"), ("etc/hostname", b"router\n"),
        ("etc/banner", b" W I R E L E S S\n -- Release 18 r1 --\n"), ("etc/passwd", b"root:x:0:0:r:/root:/bin/sh\nme:$1$a$b:0:0:m:/:/bin/sh\nshort:x\n"), ("etc/shadow", b"root::1:2:3:4:5:6:\nme:*:1\n"),
        ("lib/modules/5.4.55/kernel/drivers/net/wifi.ko", b"\x7fELF\0vermagic=5.4.54 SMP\0"), ("lib/modules/5.4.55/kernel/drivers/net/eth.ko.xz", b""), ("lib/modules/5.4.55/kernel/fs/x.ko", b""),
        ("lib/modules/5.4.55/modules.builtin", b"kernel/drivers/usb/a.ko\nkernel/drivers/usb/b.ko\n"), ("etc/resolv.conf", b"nameserver 1.1.1.1\n# x\nnameserver\t8.8.8.8\n"), ("etc/init.d/boot", b""), ("etc/init.d/net", b""),
        ("bin/busybox", b""), ("usr/sbin/dropbear", b""), ("etc/config/network", b""),
    ]
    entries = tree(spark, "n", rows, [("etc/os-release", "../usr/lib/os-release")])
    found, said = facts.linux_facts(entries)
    got = told(found)
    assert got == {
        ("os.name", "OpenWrt"), ("os.version_id", "18.06"), ("os.arch", "mips"), ("os.hostname", "router"), ("os.banner", "Release 18 r1"), ("user.uid0", "root"), ("user.uid0", "me"), ("users.count", "2"), ("users.uid0_count", "2"),
        ("user.root.password", "empty"), ("user.me.password", "md5"), ("users.password_empty", "1"), ("users.password_locked", "1"), ("kernel.version", "5.4.55"), ("kernel.modules.count", "3"), ("kernel.modules.subsystems", "drivers/net=2,fs=1"),
        ("kernel.modules.names", "eth,wifi,x"), ("kernel.builtin.count", "2"), ("kernel.builtin.names", "a,b"), ("kernel.builtin.subsystems", "drivers/usb=2"), ("kernel.vermagic", "5.4.54 SMP"),
        ("network.nameservers", "1.1.1.1,8.8.8.8"), ("init.dir", "etc/init.d"), ("init.count", "2"), ("init.services", "boot,net"), ("userland.busybox", "present"), ("service.ssh", "usr/sbin/dropbear"), ("network.uci", "present"),
    }
    assert {r.source for r in found.where("key = 'os.version_id'").collect()} == {"usr/lib/os-release"}
    assert {r.code for r in said.collect()} == {"platform-linux-kernel-mismatch", "platform-account-no-password", "platform-account-weak-hash"}
    scored, all_facts, all_said = facts.describe(entries.unionByName(tree(spark, "photos", [("a.jpg", b"")])))
    assert [(r.node, r.platform) for r in scored.collect()] == [("n", "linux")] and told(all_facts) == got
    assert ("photos", "platform-unrecognised") in {(r.node, r.code) for r in all_said.collect()}


def test_android(spark):
    prop = b"ro.product.brand=Acme\nro.product.model=One\nro.build.version.release=9\nro.debuggable=1\nro.boot.verifiedbootstate=orange\nro.secure=1\n"
    found, said = facts.android_facts(tree(spark, "n", [("system/build.prop", prop), ("system/users/0", None), ("system/users/10/x", b""), ("system/users/userlist.xml", b""), ("data/com.a", None), ("data/com.b/f", b"")]))
    assert told(found) == {("device.brand", "Acme"), ("device.model", "One"), ("os.version", "9"), ("os.pretty_name", "Acme One (Android 9)"), ("security.debuggable", "1"), ("security.verified_boot", "orange"), ("security.secure", "1"), ("users.list", "present"), ("users.count", "2"), ("apps.data_dirs", "2")}
    assert {r.code for r in said.collect()} == {"platform-android-debuggable", "platform-android-unverified"}


def test_qnx(spark):
    rows = [
        ("Buildinfo.txt", b"BUILD_ID=7\nACME.VERSION=1.2\n"), ("fs/os/artifact.json", b'{"FPN": "P1", "component": [1, 2, 3], "engineering_use_only": "YES", "deep": {"a": 1}}'), ("proc/boot/passwd", b"root:@S@x@y:0:0::/:/bin/sh\n"),
        ("etc/inetd.conf", b"# x\ntelnet stream tcp nowait root /usr/sbin/telnetd telnetd\nbad line\n"), ("proc/boot/secpol.bin", b""), ("bin/qconn", b""), ("var/chroot/x", b""), ("bin/secpol", b""),
    ]
    found, said = facts.qnx_facts(tree(spark, "n", rows, [("artifact.json", "/fs/os/artifact.json")]))
    assert told(found) == {
        ("build.id", "7"), ("build.vendor.ACME_VERSION", "1.2"), ("build.part_number", "P1"), ("build.components", "3"), ("build.engineering_only", "YES"), ("user.uid0", "root"), ("users.count", "1"), ("user.root.password", "qnx-strong"), ("users.with_password", "1"),
        ("service.telnet", "root"), ("services.inetd", "telnet"), ("security.secpol_files", "1"), ("security.secpol", "present"), ("security.chroot", "present"),
    }
    assert {r.code for r in said.collect()} == {"platform-qnx-insecure-service", "platform-qnx-engineering-build", "platform-account-weak-hash"}
    assert facts.qnx_facts(tree(spark, "n", rows).limit(0))[0].count() == 0


def test_listing(spark):
    entries = tree(spark, "n", [("a/b/c", b""), ("a/d", b""), ("a/e", None), ("ab", b"")])
    index = facts.survey.path_index(entries)
    assert sorted((r.name, r.isdir) for r in facts.list_dir(index, "a").collect()) == [("b", True), ("d", False), ("e", True)]
    assert sorted(r.path for r in facts.files_under(index, "a").collect()) == ["a/b/c", "a/d"]
