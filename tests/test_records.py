"""Record extractors on files made here."""

import struct
from base64 import encodebytes

from gneiss.operators import records


def tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + struct.pack(">H", len(body))
    return bytes([tag]) + size + body


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = bytes([first * 40 + second])
    for n in rest:
        part = [n & 127]
        while n := n >> 7:
            part.append(n & 127 | 128)
        out += bytes(reversed(part))
    return tlv(6, out)


def name(**parts):
    return tlv(0x30, *(tlv(0x31, tlv(0x30, oid({"C": "2.5.4.6", "O": "2.5.4.10", "CN": "2.5.4.3"}[k]), tlv(12, v.encode()))) for k, v in parts.items()))


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = tlv(0x30, oid("1.2.840.113549.1.1.1"), b"\x05\0")


def cert(begin=b"200101000000Z", end=b"300305000000Z"):
    signed = tlv(0x30, oid("1.2.840.113549.1.1.11"), b"\x05\0")
    key = tlv(0x30, RSA, tlv(3, b"\0", tlv(0x30, number(1 << 2047), number(65537))))
    extensions = tlv(0xA3, tlv(0x30, tlv(0x30, oid("2.5.29.19"), tlv(1, b"\xff"), tlv(4, tlv(0x30, tlv(1, b"\xff")))), tlv(0x30, oid("2.5.29.17"), tlv(4, tlv(0x30, tlv(0x82, b"a.test"), tlv(0x82, b"b.test"))))))
    who = name(C="CH", O="A, B", CN="root")
    body = tlv(0x30, tlv(0xA0, number(2)), number(5), signed, who, tlv(0x30, tlv(0x17, begin), tlv(0x17, end)), who, key, extensions)
    return tlv(0x30, body, signed, tlv(3, b"\0sig"))


def pem(label, der):
    return b"-----BEGIN " + label + b"-----\n" + encodebytes(der) + b"-----END " + label + b"-----\n"


def test_certificates():
    found = records.read_certificates("etc/my.pem", b"note\n" + pem(b"CERTIFICATE", cert()) + pem(b"CERTIFICATE", cert(end=b"190101000000Z")) + pem(b"CERTIFICATE", b"junk"))
    (kind, _, severity, identity, fields), second = found.records
    assert (kind, severity, len(identity), second[2]) == ("certificate", "info", 64, "warning")
    assert fields == {
        "fingerprint": identity, "subject": "CN=root,O=A\\, B,C=CH", "issuer": "CN=root,O=A\\, B,C=CH", "not_before": "Jan  1 00:00:00 2020 GMT", "not_after": "Mar  5 00:00:00 2030 GMT",
        "self_signed": "true", "key_type": "rsa", "key_bits": "2048", "signature": "RSA-SHA256", "ca": "true", "dns_names": "a.test,b.test",
    }
    assert [d[1] for d in found.diagnostics] == ["artifact-certificate-expired"]
    assert [d[1] for d in records.read_certificates("x.pem", b"").diagnostics] == ["artifact-certificate-unparsable"]


def test_private_keys():
    rsa = tlv(0x30, number(0), number(1 << 1023), number(65537))
    wrapped = tlv(0x30, number(0), RSA, tlv(4, rsa))
    ec = tlv(0x30, number(1), tlv(4, b"k" * 32), tlv(0xA0, oid("1.2.840.10045.3.1.7")))
    locked = b"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nAAAA\n-----END RSA PRIVATE KEY-----\n"
    found = records.read_certificates("k.key", pem(b"RSA PRIVATE KEY", rsa) + pem(b"PRIVATE KEY", wrapped) + pem(b"EC PRIVATE KEY", ec) + locked)
    assert [(r[4]["key_type"], r[4]["key_bits"]) for r in found.records] == [("rsa", "1024"), ("rsa", "1024"), ("ec", "256")]
    assert [d[1] for d in found.diagnostics].count("artifact-weak-key") == 2


def elf(section):
    names = b"\0.modinfo\0.names\0"
    head = b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 1, 40, 1, 0, 0, 52 + len(section) + len(names), 0, 52, 0, 0, 40, 3, 2)
    table = bytes(40) + struct.pack("<IIIIIIIIII", 1, 1, 0, 0, 52, len(section), 0, 0, 0, 0) + struct.pack("<IIIIIIIIII", 10, 3, 0, 0, 52 + len(section), len(names), 0, 0, 0, 0)
    return head + section + names + table


def test_modules():
    data = elf(b"license=Proprietary\0alias=a\0alias=b\0\0junk\0vermagic=4.14.63 SMP mod_unload\0")
    found = records.read_module("lib/modules/4.14.64/foo.ko", data)
    assert found.records == [("kernel-module", "lib/modules/4.14.64/foo.ko", "warning", "foo", {"module": "foo", "arch": "arm", "license": "Proprietary", "vermagic": "4.14.63 SMP mod_unload", "aliases": "2"})]
    assert [d[1] for d in found.diagnostics] == ["artifact-proprietary-module", "artifact-stale-module"]
    assert not records.read_module("a.ko", b"\x7fELF").records and not records.read_module("a.ko", elf(b"")).records


def test_kernels():
    found = records.read_kernel("boot/zImage", b"\0Linux version 5.4.55 (me@here) (gcc version 8.4.0 (Build 1)) #1 SMP\nmore")
    assert found.records[0][4] == {"banner": "Linux version 5.4.55 (me@here) (gcc version 8.4.0 (Build 1)) #1 SMP", "version": "5.4.55", "compiler": "gcc version 8.4.0 (Build 1)"}
    assert not records.read_kernel("kernel", b"Linux version of the software 1.2").records
    assert not records.read_kernel("kernel", b"Linux version 5").records and not records.read_kernel("kernel", b"").records


def test_collect(spark):
    store = "etc/ssl/certs/"
    rows = [
        (0, store + "a.crt", "regular", False, True, pem(b"CERTIFICATE", cert())), (1, store + "b.crt", "regular", False, True, pem(b"CERTIFICATE", cert())),
        (2, "boot/vmlinux", "regular", False, True, b"Linux version 5.4.55 x"), (3, "boot/vmlinux-old", "regular", True, True, b"Linux version 5.4.54 x"),
        (4, "payload", "regular", False, False, b"Linux version 5.4.53 x"), (5, "c.pem", "regular", False, True, None), (6, "d.pem", "regular", None, True, b""), (7, None, "regular", False, True, b"x"),
    ]
    df = spark.createDataFrame([("n", a, b, c, d, False, e, f) for a, b, c, d, e, f in rows], "node string, entry_ord long, path string, kind string, deleted boolean, superseded boolean, written boolean, content binary")
    examined = records.examine(df)
    got = records.collect(examined).collect()
    assert [(r.kind, r.path) for r in got] == [("certificate-bundle", "etc/ssl/certs"), ("linux-kernel", "boot/vmlinux")]
    assert got[0].fields["certificates"] == "2" and got[0].fields["first_subject"].startswith("CN=root") and got[1].identity == "Linux version 5.4.55 x"
    assert [r.code for r in examined.where("code IS NOT NULL").collect()] == ["kernel-no-symbol-table", "artifact-certificate-unparsable"]
    assert records.collect(records.examine(df.limit(0))).count() == 0
    assert records.collect(examined, 1).count() == 1


def test_symbol_types(spark):
    df = spark.createDataFrame([("i", t) for t in "TTtbTd"], "image string, type string")
    assert records.symbol_types(df, ["image"]).first().symbol_types == "T=3,b=1,d=1,t=1"
    assert records.symbol_types(df, ["image"], 4).first().symbol_types == "T=3,b=1,..."
