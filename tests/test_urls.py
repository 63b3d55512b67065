"""Addresses in one form: golden values for absolute ones, references and what isn't admissible."""

from pyspark.sql import functions as F

from tessera.functions.urls import normalized_url, with_ascii_hosts

BASE = "http://site.example:8080/one/two/page.html?old=1"
ABSOLUTE = {
    "HTTPS://Site.Example:443/A/./b/../c": "https://site.example/A/c",
    "http://site.example": "http://site.example/",
    "http:\\\\site.example\\a\\b": "http://site.example/a/b",
    "  http://site.example/a b\t/ü?q=ü&a=%7e \n": "http://site.example/a%20b/%C3%BC?a=%7E&q=%C3%BC",
    "http://site.example/%7euser/%zz?b=%zz&b=1+2&c": "http://site.example/%7euser/%zz?b=%25zz&b=1+2&c=",
    "http://site.example/a/../../b/..": "http://site.example/",
    "http://site.example/a/%2e%2E/b/%2e": "http://site.example/b/",
    "http://site.example//x//../y": "http://site.example/x/y",
    "http://site.example/?z=1&a=2&a=1&&": "http://site.example/?a=1&a=2&z=1",
    "http://site.example:00080/x#frag?no": "http://site.example/x",
    "http://site.example:81/?": "http://site.example:81/",
    "http://10.1.2.3/": "http://10.1.2.3/",
    "http://[2001:DB8::1]:8080/x": "http://[2001:db8::1]:8080/x",
    'http://site.example/"<>`{}|^': "http://site.example/%22%3C%3E%60%7B%7D|^",
    "http://site.example/😀?k=😀": "http://site.example/%F0%9F%98%80?k=%F0%9F%98%80",
    "http://site.example/p?a=b=c&%26=%3D": "http://site.example/p?%26=%3D&a=b%3Dc",
}
REFUSED = ["ftp://site.example/", "mailto:a@site.example", "http://u:p@site.example/", "http://u@site.example/", "http://", "http://a b/", "http://site.example:65536/", "http://1.2.3/", "http://0x7f.1/", "http://1.2.3.256/", "http://[::1/", "http://[1::2::3]/", "site.example/x", "", None, "http://é.example/"]
REFERENCES = {
    "next.html": "http://site.example:8080/one/two/next.html", "./a/../b": "http://site.example:8080/one/two/b", "../up": "http://site.example:8080/one/up", "../../../../top": "http://site.example:8080/top", "/root": "http://site.example:8080/root",
    "//other.example/x": "http://other.example/x", "?new=2": "http://site.example:8080/one/two/page.html?new=2", "#part": "http://site.example:8080/one/two/page.html?old=1", "": "http://site.example:8080/one/two/page.html?old=1",
    "https://else.example": "https://else.example/", "javascript:void(0)": None, "a:b": None, "..": "http://site.example:8080/one/", ".": "http://site.example:8080/one/two/", "x?y=1#z": "http://site.example:8080/one/two/x?y=1", "\\back": "http://site.example:8080/back",
}


def test_absolute(spark):
    df = spark.createDataFrame([(u,) for u in [*ABSOLUTE, *REFUSED]], "u string")
    found = {r.u: r.n for r in df.select("u", normalized_url(F.col("u")).alias("n")).collect()}
    assert found == ABSOLUTE | dict.fromkeys(REFUSED)
    # The form is its own form.
    again = spark.createDataFrame([(u,) for u in ABSOLUTE.values()], "u string").select("u", normalized_url(F.col("u")).alias("n")).collect()
    assert all(r.u == r.n for r in again)


def test_references(spark):
    df = spark.createDataFrame([(u, BASE) for u in REFERENCES], "u string, b string")
    assert {r.u: r.n for r in df.select("u", normalized_url(F.col("u"), F.col("b")).alias("n")).collect()} == REFERENCES
    bare = df.select(normalized_url(F.lit("x"), F.lit("http://site.example")).alias("a"), normalized_url(F.lit("x"), F.lit("no base")).alias("b"), normalized_url(F.lit("x"), F.lit(None).cast("string")).alias("c")).first()
    assert (bare.a, bare.b, bare.c) == ("http://site.example/x", None, None)


def test_international_hosts(spark):
    hosts = {"http://BÜCHER.example:8080/ü": "http://xn--bcher-kva.example:8080/%C3%BC", "http://例え.example": "http://xn--r8jz45g.example/", "http://plain.example/ü": "http://plain.example/%C3%BC", f"http://{'ü' * 80}.example/": None, None: None}
    df = with_ascii_hosts(spark.createDataFrame([(u, u) for u in hosts] * 2, "u string, v string"), "v")
    assert {r.u: r.n for r in df.select("u", normalized_url(F.col("v")).alias("n")).collect()} == hosts
    assert df.count() == 10
