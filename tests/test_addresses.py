"""Addresses against the standard library, ranges against brute force."""

import ipaddress

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import addresses as A

GOOD = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "127.0.0.1", "10.9.8.7", "172.32.0.1", "172.31.255.255", "100.64.0.1", "8.8.8.8", "::", "::1", "2001:db8::1", "2606:4700::1111", "fe80::1", "fc00::", "1:2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "64:ff9b::8.8.8.8", "FF02::1", "[2a00:1450::5]", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4"]
BAD = ["", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::1", "12345::", "::1.2.3.999", "fe80::1%eth0", "example.org", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:7:8::", None]


def number(text):
    a = ipaddress.ip_address(text.strip("[]"))
    n = int(a) << (96 if a.version == 4 else 0)
    return a.version, n >> 64, n & ((1 << 64) - 1)


def test_parsed(spark):
    rng = np.random.default_rng(0)
    texts = GOOD + BAD + [str(ipaddress.IPv6Address(rng.bytes(16))) for _ in range(40)] + [str(ipaddress.IPv4Address(rng.bytes(4))) for _ in range(40)]
    texts += [str(ipaddress.IPv6Address(bytes(b if rng.random() < 0.3 else 0 for b in rng.bytes(16)))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", A.parsed(F.col("t")).alias("p"), A.is_blocked(F.col("t")).alias("b")).collect():
        if r.t in BAD:
            assert r.p is None and r.b is None, r.t
        else:
            assert (r.p.family, r.p.hi % (1 << 64), r.p.lo % (1 << 64)) == number(r.t), r.t
            a = ipaddress.ip_address(r.t.strip("[]"))
            assert r.b == any(a in ipaddress.ip_network(n) for n in A.SPECIAL if ipaddress.ip_network(n).version == a.version), r.t


def test_known_ranges(spark):
    verdict = {"127.8.9.10": True, "10.77.0.1": True, "172.20.1.2": True, "192.168.40.3": True, "169.254.7.7": True, "93.184.216.34": False, "172.32.0.1": False, "::1": True, "fd00::1": True, "::ffff:8.8.8.8": True, "2606:2800:220:1::1": False, "224.0.0.5": True}
    df = spark.createDataFrame([(t,) for t in verdict], "t string")
    assert {r.t: r.b for r in df.select("t", A.is_blocked(F.col("t")).alias("b")).collect()} == verdict


def test_narrowest_range(spark):
    rng = np.random.default_rng(1)
    blocks = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "::/0", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1::/64", "2001:db8:1::7/128", "2001:db8:1:0:8000::/65"]
    nets = [ipaddress.ip_network(b) for b in blocks if b != "::/0"]
    texts = ["10.1.2.3", "10.1.2.4", "10.1.3.4", "10.2.0.0", "11.0.0.0", "2001:db8:1::7", "2001:db8:1::8", "2001:db8:1:1::8", "2001:db8:2::", "2001:db9::", "2001:db8:1:0:8000::1", "2001:db8:1:0:7fff::1", "none", None] + ["10.1.2.3"] * 20
    texts += [str(ipaddress.IPv4Address((10 << 24) + int(rng.integers(0, 1 << 18)))) for _ in range(50)]
    ranges = A.ranges_of(spark, [(str(n), str(n)) for n in nets])
    found = A.with_range(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", ranges).collect()
    assert len(found) == len(texts)
    for r in found:
        fit = [] if r.t in (None, "none") else [n for n in nets if n.version == ipaddress.ip_address(r.t).version and ipaddress.ip_address(r.t) in n]
        assert r.range == (str(max(fit, key=lambda n: n.prefixlen)) if fit else None), r.t
