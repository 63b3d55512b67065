"""IP addresses as numbers in columns, and ranges of them."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binding import let

#: Ranges that aren't public unicast, from the registries of special-purpose addresses.
SPECIAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "::ffff:0:0/96", "::ffff:0:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "2620:4f:8000::/48", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


_FOUR = r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"
_GROUP = "[0-9a-f]{1,4}"
_SIDE = rf"((?:{_GROUP}(?::{_GROUP})*)?)"


def _octets(text: Column) -> Column:
    """The 32 bits of an IPv4 address as a long; null for anything else."""
    parts = F.transform(F.split(F.when(text.rlike(_FOUR), text), r"\."), lambda p: p.cast("long"))
    return let(parts, lambda v: F.when(~F.exists(v, lambda p: p > 255), F.aggregate(v, F.lit(0).cast("long"), lambda n, p: n * 256 + p)))


def _groups(six: Column) -> Column:
    """The eight groups of an IPv6 address without an IPv4 tail, as hexadecimal texts; null for anything else."""
    side = lambda i: F.filter(F.split(F.regexp_extract(six, f"^{_SIDE}::{_SIDE}$", i), ":"), lambda g: g != "")
    short = F.when(six.rlike(f"^{_SIDE}::{_SIDE}$"), F.array(side(1), side(2)))
    filled = let(short, lambda s: F.when(F.size(s[0]) + F.size(s[1]) < 8, F.concat(s[0], F.array_repeat(F.lit("0"), 8 - F.size(s[0]) - F.size(s[1])), s[1])))
    return F.coalesce(F.when(six.rlike(f"^{_GROUP}(?::{_GROUP}){{7}}$"), F.split(six, ":")), filled)


def parsed(address: Column) -> Column:
    """struct(family, hi, lo) of a textual address; null for anything else.

    ``family`` is 4 or 6; an IPv4 address is its 32 bits at the top of ``hi``, an IPv6 one two
    halves.  IPv4 has four decimal parts without leading zeros.  IPv6 may be shortened once by
    ``::``, end in an IPv4 address, and stand in brackets; zones aren't addresses.
    """
    half = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda n, g: F.shiftleft(n, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))

    def without_tail(text: Column) -> Column:
        """The text with an IPv4 tail as two groups."""
        tail = F.regexp_extract(text, r":([0-9.]+\.[0-9.]+)$", 1)
        return let(tail, lambda t: F.when(t == "", text).otherwise(let(_octets(t), lambda n: F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(t)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))))))

    def whole(text: Column) -> Column:
        return let(
            F.struct(_octets(text).alias("four"), F.when(F.contains(text, F.lit(":")), _groups_of(without_tail(text))).alias("six")),
            lambda x: F.when(x["four"].isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(x["four"], 32).alias("hi"), F.lit(0).cast("long").alias("lo"))).when(
                x["six"].isNotNull(), F.struct(F.lit(6).alias("family"), half(F.slice(x["six"], 1, 4)).alias("hi"), half(F.slice(x["six"], 5, 4)).alias("lo"))
            ),
        )

    return let(F.lower(F.regexp_replace(F.trim(address), r"^\[(.*)\]$", "$1")), whole)


def _groups_of(text: Column) -> Column:
    return let(text, _groups)


def ranges_of(spark: SparkSession, blocks: list[tuple[str, str]]) -> DataFrame:
    """(family, bits, hi, lo, name) of named ranges in prefix notation."""
    rows = []
    for text, name in blocks:
        net = ipaddress.ip_network(text)
        n = int(net.network_address) << (96 if net.version == 4 else 0)
        rows.append((net.version, net.prefixlen, _signed(n >> 64), _signed(n & ((1 << 64) - 1)), name))
    return spark.createDataFrame(rows, "family int, bits int, hi long, lo long, name string")


def _mask(bits: Column) -> Column:
    """A long with its first ``bits`` set: none for 0 or less, all for 64 or more."""
    rest = (64 - F.least(bits, F.lit(64))).cast("int")
    return F.when(bits > 0, F.call_function("shiftleft", F.lit(-1).cast("long"), rest)).otherwise(F.lit(0).cast("long"))


def with_range(df: DataFrame, address: str, ranges: DataFrame) -> DataFrame:
    """``df`` with ``range``: the name of the narrowest range that has the address; null for none and for texts that are no address.

    Addresses meet ranges by equal prefixes: each is cut to the lengths that the ranges of its
    family have, of which there are at most 33 and 129, and joined by the prefix.  So ranges may be
    as many as they like.  Equal addresses are looked up once.
    """
    seen = df.select(F.col(address).alias("__address")).distinct().withColumn("__p", parsed(F.col("__address"))).filter("__p IS NOT NULL")
    lengths = ranges.groupBy("family").agg(F.collect_set("bits").alias("lengths"))
    each = seen.join(F.broadcast(lengths), F.col("__p.family") == F.col("family")).select("__address", "__p", "family", F.explode("lengths").alias("bits"))  # one row a family
    cut = each.select("__address", "family", "bits", F.col("__p.hi").bitwiseAND(_mask(F.col("bits"))).alias("hi"), F.col("__p.lo").bitwiseAND(_mask(F.col("bits") - 64)).alias("lo"))
    hit = cut.join(ranges, ["family", "bits", "hi", "lo"]).groupBy("__address").agg(F.max_by("name", F.struct("bits", "name")).alias("range"))
    return df.join(hit, df[address] == hit["__address"], "left").drop("__address")


def is_blocked(address: Column) -> Column:
    """True for an address that isn't public unicast; null for texts that are no address."""

    def within(p: Column) -> Column:
        test = F.lit(False)
        for text in SPECIAL:
            net = ipaddress.ip_network(text)
            n, m = (int(x) << (96 if net.version == 4 else 0) for x in (net.network_address, net.netmask))
            own = p["family"] == net.version
            for half, mask, want in (("hi", m >> 64, n >> 64), ("lo", m & ((1 << 64) - 1), n & ((1 << 64) - 1))):
                if mask:
                    own = own & (p[half].bitwiseAND(F.lit(_signed(mask)).cast("long")) == F.lit(_signed(want)).cast("long"))
            test = test | own
        return F.when(p.isNotNull(), test)

    return let(parsed(address), within)
