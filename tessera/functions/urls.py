"""URL functions: normalisation, admission, document ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .addresses import parsed
from .binding import let

_URL = r"^(?i:(https?))://([^/?#@:]+)(?::([0-9]+))?((?:/[^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"


#: Characters of a path that are written as percent codes.
_CODED = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]"
_DOT, _DOTS = ("", ".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
_ABSOLUTE = r"^(?i:(https?)):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?"


def _parts(text: Column) -> Column:
    """struct(scheme, authority, path, query) of an absolute HTTP address; null for anything else."""
    part = lambda i: F.regexp_extract(text, _ABSOLUTE, i)
    return F.when(text.rlike(_ABSOLUTE), F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query")))


def _joined(text: Column, base: Column) -> Column:
    """The parts of a reference against those of its base."""
    path, query = F.regexp_extract(text, r"^([^?#]*)(\?[^#]*)?", 1), F.regexp_extract(text, r"^([^?#]*)(\?[^#]*)?", 2)
    within = lambda b, p, q: F.struct(b["scheme"].alias("scheme"), b["authority"].alias("authority"), p.alias("path"), q.alias("query"))
    folder = lambda b: F.regexp_extract(F.concat(F.lit("/"), b["path"]), r"^/(.*[/\\])?", 1)
    return let(
        base,
        lambda b: F.when(b.isNull(), None)
        .when(text.rlike(r"^[/\\]{2}"), _parts(F.concat(b["scheme"], F.lit(":"), text)))
        .when(text.rlike(r"^[/\\]"), within(b, path, query))
        .when(text.rlike(r"^\?"), within(b, b["path"], query))
        .when(path == "", within(b, b["path"], b["query"]))
        .otherwise(within(b, F.concat(F.when(folder(b) == "", "/").otherwise(folder(b)), path), query)),
    )


def _path(path: Column) -> Column:
    """Dot segments resolved, slashes single, other characters as percent codes."""
    parts = F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]")

    def step(done: Column, x: Column) -> Column:
        last = F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        name = F.lower(x["name"])
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(name.isin(*_DOTS), F.concat(shorter, last)).when(name.isin(*_DOT[1:]), F.concat(done, last)).otherwise(F.concat(done, F.array(x["name"])))

    named = let(parts, lambda p: F.transform(p, lambda n, i: F.struct(n.alias("name"), (i == F.size(p) - 1).alias("last"))))
    clean = F.regexp_replace(F.concat(F.lit("/"), F.array_join(F.aggregate(named, F.array().cast("array<string>"), step), "/")), "/{2,}", "/")
    code = lambda c: F.when(c.rlike(_CODED), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return let(clean, lambda c: F.when(F.replace(c, F.lit("%"), F.lit("")).rlike(_CODED), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1), lambda x: F.when(x == "%", x).otherwise(code(x))), "")).otherwise(c))


def _query(query: Column) -> Column:
    """A question mark and the pairs, decoded, in order of name and value, and encoded again; empty without any."""
    # A percent sign that begins no code stands for itself.
    decoded = lambda t: F.url_decode(F.regexp_replace(t, r"%(?![0-9A-Fa-f]{2})", "%25"))
    pairs = F.filter(F.split(F.substring(query, 2, 2**31 - 1), "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")))
    ordered = F.array_sort(F.transform(split, lambda x: F.struct(F.collate(x["k"], "UNICODE").alias("a"), F.collate(x["v"], "UNICODE").alias("b"), x["k"].alias("k"), x["v"].alias("v"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return let(text, lambda t: F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(F.concat(F.lit("?"), t)))


def _host(host: Column) -> Column:
    """A host in lower case; null for one that can't be: empty, with forbidden characters, or a number that is no plain IPv4 address."""
    return let(
        F.lower(host),
        lambda h: F.when(h.rlike(r"^\[.*\]$"), F.when(parsed(h)["family"] == 6, h))
        .when(h.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]") | (h == ""), None)
        .when(h.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"), F.when(parsed(h).isNotNull(), h))
        .otherwise(h),
    )


def normalized_url(url: Column, base: Column | None = None) -> Column:
    """An HTTP address in one form; null if it isn't admissible.

    A reference is resolved against ``base`` first.  Scheme and host are in lower case, default ports and
    fragments go, dot segments are resolved, slashes are single, a path's other characters are percent
    codes, and a query's pairs are decoded, sorted by name and value and encoded again.  Credentials,
    other schemes, and hosts that can't be aren't admissible; IPv6 hosts stay as they are written, in
    lower case.  Hosts with other than ASCII letters aren't admissible before ``with_ascii_hosts``.
    """
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def located(t: Column) -> Column:
        own = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), _parts(t))
        return own if base is None else F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), _parts(t)).otherwise(_joined(t, _parts(F.trim(base))))

    port = lambda p: F.regexp_extract(p["authority"], r":([0-9]*)$", 1)
    def written(p: Column) -> Column:
        host = F.regexp_replace(p["authority"], r":[0-9]*$", "")
        own = F.when(~host.rlike(r"[^\x00-\x7F]"), _host(host))
        number = F.when(port(p) != "", F.try_to_number(F.right(F.concat(F.lit("000000"), port(p)), F.lit(6)), F.lit("999999")).cast("int"))
        shown = F.when(number.isNull() | (number == F.when(p["scheme"] == "http", 80).otherwise(443)), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        good = ~F.contains(p["authority"], F.lit("@")) & (F.coalesce(number, F.lit(0)) <= 65535) & (F.length(F.regexp_replace(port(p), "^0+", "")) <= 5)
        return F.when(good, F.concat(p["scheme"], F.lit("://"), own, shown, _path(p["path"]), _query(p["query"])))

    return let(let(text, located), written)


def with_ascii_hosts(df: DataFrame, column: str) -> DataFrame:
    """``df`` with hosts of other than ASCII letters in Punycode; only texts that have one pass through Python workers."""
    foreign = r"^[^/\\?#]*[/\\]{2}[^/\\?#]*[^\x00-\x7F]"

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ascii_of(match: re.Match) -> str:
            host, colon, port = match[2].partition(":")
            return match[1] + host.lower().encode("idna").decode() + colon + port

        for batch in batches:
            out = []
            for url in batch["__url"]:
                try:
                    out.append(re.sub(r"^([^/\\?#]*[/\\]{2})([^/\\?#]*)", ascii_of, url))
                except UnicodeError:
                    out.append(None)
            yield pd.DataFrame({"__url": batch["__url"], "__ascii": out})

    some = df.filter(F.col(column).rlike(foreign)).select(F.col(column).alias("__url")).distinct().mapInPandas(rewritten, "__url string, __ascii string")
    both = df.join(some, df[column] == some["__url"], "left")
    return both.select(*(F.when(F.col("__url").isNotNull(), F.col("__ascii")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def allowed_domain(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    host = host_of(url)
    return reduce(or_, ((host == d) | host.endswith("." + d) for d in (x.lower().removeprefix(".") for x in domains)), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A path glob: ``*`` within a segment, ``**`` across segments."""
    return "^" + "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]+", pattern)) + "$"


def admitted(url: Column, domains: list[str], include: list[str] = (), exclude: list[str] = ()) -> Column:
    ok = normalized_url(url).isNotNull() & allowed_domain(url, domains)
    path = F.coalesce(F.nullif(F.regexp_extract(url, _URL, 4), F.lit("")), F.lit("/"))
    if include:
        ok = ok & reduce(or_, (path.rlike(glob_regex(g)) for g in include))
    return ok & ~reduce(or_, (path.rlike(glob_regex(g)) for g in exclude), F.lit(False))


def document_id(canonical: Column, normalized: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(canonical, normalized), 256), 1, 32)


__all__ = ["admitted", "allowed_domain", "document_id", "glob_regex", "host_of", "normalized_url", "with_ascii_hosts"]
