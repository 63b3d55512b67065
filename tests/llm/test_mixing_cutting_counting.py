"""Mixing, fill-in-the-middle and dominance counting against brute force, and on awkward tables."""

import datetime
import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dominance, fill_in_middle, mixing
from tessera.llm.queries import ORACLES, QUERIES

from ..oracle import database, difference

AWKWARD = [None, "", " \t\n", "word", "\n\n\n", "one\ntwo\nthree", "no end", "a<P>b\nc", "<S>", "x <M", "é ü 🙂\n中文\r\n " * 20, "same\n" * 30, "same\n" * 30, "z" * 3_000_000, "line of words\n" * 200_000]


@pytest.mark.parametrize("name", ["op11_mixing", "op12_fill_in_middle", "op13_dominance"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), database(sf_dir), ORACLES[name]) == ""


# Mixing


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    """By resharing the excess again and again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, shared = total - cap * sum(sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: Fraction(cap * sizes[s]) if s in full else Fraction(left * weight[s], shared) for s in order}
        above = {s for s in order if target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def check_mix(rows, cap=3):
    """rows: (source, size, source_size, target, copies)."""
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    sizes = {s: sum(r[1] for r in found) for s, found in own.items()}
    want = expected_targets(sizes)
    for s, found in own.items():
        assert {r[2] for r in found} == {sizes[s]}
        assert all(abs(r[3] - float(want[s])) <= 1e-9 * max(1.0, float(want[s])) for r in found)
        assert all(0 <= r[4] <= cap for r in found)
        each = float(want[s]) / sizes[s] if sizes[s] else 0
        assert all(int(each) <= r[4] <= int(each) + 1 for r in found) or abs(each - round(each)) < 1e-6
        assert abs(sum(r[1] * r[4] for r in found) - float(want[s])) <= 2 * max(r[1] for r in found) + 1


def rows_of_mix(df):
    return [(r.row.source, r.size, r.source_size, r.target, r.copies) for r in df.collect()]


def test_mixing_hits_targets_without_one_large_task(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate([400, 30, 3, 1, 120, 60, 900]):
        rows += [(len(rows) + i, "w " * int(s), f"s{k}" if k else None) for i, s in enumerate(rng.geometric(0.02, n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixed(docs, keep=["doc_id", "source"])
    found = mix.collect()
    check_mix([(r.row.source, r.size, r.source_size, r.target, r.copies) for r in found])
    assert {r.row.doc_id: r.size for r in found} == {i: len(t.split()) for i, t, _ in rows}
    again = mixing.mixed(docs.repartition(7), keep=["doc_id", "source"])
    assert sorted((r.row.doc_id, r.copies) for r in again.collect()) == sorted((r.row.doc_id, r.copies) for r in found)
    emitted = mixing.mixture(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in found)


def test_ranks_are_whole(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), (F.col("id") % 7).alias("x"))
    found = defaultdict(list)
    for r in mixing.ranked(df, ["g"], ["x"]).collect():
        found[r.g].append((r.rank, r.x))
    for own in found.values():
        assert [k for k, _ in sorted(own)] == list(range(len(own)))
        assert [x for _, x in sorted(own)] == sorted(x for _, x in own)


def test_mixing_awkward(spark):
    rows = [(i, t, None if i % 4 == 0 else "" if i % 4 == 1 else "s", "row", 5, 1.0, 7) for i, t in enumerate(AWKWARD)]
    rows += [(3, "word", "s", "row", 5, 1.0, 7)] * 5 + [(None, "lone words", "t", "row", 5, 1.0, 7)]
    kinds = "doc_id long, text string, source string, row string, size long, target double, rank long"
    docs = spark.createDataFrame(rows, kinds)
    found = mixing.mixed(docs, keep=docs.columns)
    check_mix(rows_of_mix(found))
    assert found.count() == len(rows)
    assert mixing.mixture(docs).schema == docs.schema
    assert mixing.mixed(docs.limit(0)).count() == 0
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    assert all(r.size == 0 and r.target == 0 and r.copies == 0 for r in mixing.mixed(empty).collect())


# Fill-in-the-middle


def expected_cut(doc_id, text, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return (len(units), "plain", None, None, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit,rate,spm", [(fill_in_middle.LINES, 100, 50), (fill_in_middle.LINES, 40, 0), (r"\S*\s|\S+", 100, 100)])
def test_fill_in_middle(spark, unit, rate, spm):
    texts = [*AWKWARD, "ends in <S\nnext", "< \n<\n", *("\n".join(f"line {i} of {k}" for i in range(k)) for k in range(40))]
    rows = [(i, t, "f", 3, "o") for i, t in enumerate(texts)] + [(None, "x\ny\nz\n", "f", 3, "o"), (5, texts[5], "f", 3, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long, output string")
    cut = fill_in_middle.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    found = cut.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    assert {r.form for r in found} >= {"plain"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected_cut(r.doc_id, by_id[r.doc_id], unit, rate, spm)
        assert r.back == (by_id[r.doc_id] or "")
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_matcher_keeps_no_units():
    import tracemalloc

    text, unit = "ab\n" * 1_000_000, re.compile(fill_in_middle.LINES)
    tracemalloc.start()
    assert fill_in_middle.count(unit, text) == 1_000_000
    assert fill_in_middle.ends(unit, text, 250_000, 900_000) == (750_000, 2_700_000)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


# Dominance counting


def brute(points):
    """(n, w) for each (slot, level, weight)."""
    out = []
    for s, v, _ in points:
        above = [] if s is None or v is None else [w for t, u, w in points if t is not None and u is not None and t < s and u > v]
        out.append((None, None) if s is None or v is None else (len(above), sum(above)))
    return out


@pytest.mark.parametrize("slots,levels,n", [(1, 50, 300), (50, 1, 300), (30, 30, 900), (1000, 1000, 900), (3, 1000, 900), (1000, 3, 900)])
def test_stream_of_runs(slots, levels, n):
    rng = np.random.default_rng(n + slots)
    group, level, weight = np.sort(rng.integers(0, slots, n)), rng.integers(0, levels, n), rng.integers(1, 9, n)
    found = dominance.stream(group, level, np.stack([np.ones(n, np.int64), weight], axis=1))
    assert [tuple(x) for x in found.tolist()] == brute(list(zip(group.tolist(), level.tolist(), weight.tolist(), strict=True)))


def test_runs_grow_geometrically():
    runs = dominance.Runs()
    for i in range(1000):
        runs.add(np.array([i % 17]), np.ones((1, 2), np.int64))
    sizes = [k.size for k, _ in runs.runs]
    assert sum(sizes) == 1000 and len(sizes) <= 10 and sizes == sorted(sizes, reverse=True)
    assert runs.above(np.array([15]))[0].tolist() == [sum(i % 17 > 15 for i in range(1000))] * 2


@pytest.mark.parametrize("leaf", [1 << 17, 20])
def test_dominance(spark, monkeypatch, leaf):
    # With a small leaf the histogram of shards and bands is counted by shards itself.
    monkeypatch.setattr(dominance, "LEAF", leaf)
    monkeypatch.setattr(dominance, "shard_count", lambda cells: 9 if cells > 200 else 3)
    rng = np.random.default_rng(3)
    points = [(int(s), int(v), int(w)) for s, v, w in zip(rng.integers(-5, 40, 1200), rng.integers(-20, 60, 1200), rng.integers(1, 4, 1200), strict=True)]
    points += [(7, 7, 2)] * 600 + [(None, 3, 1), (3, None, 1), (None, None, 1)] + [(8, v, 1) for v in range(100)] + [(s, 61, 1) for s in range(60)]
    table = spark.createDataFrame(points, "slot long, level long, w long").withColumn("row", F.lit("x")).withColumn("large", F.lit(True))
    found = dominance.dominated(table, F.col("slot"), F.col("level"), F.col("w")).select("row.w", "row.row", "slot", "level", "n_above", "w_above").collect()
    want = sorted(((s, v, w, *c) for (s, v, w), c in zip(points, brute(points), strict=True)), key=repr)
    assert sorted(((r.slot, r.level, r.w, r.n_above, r.w_above) for r in found), key=repr) == want
    assert dominance.dominated(table.limit(0), F.col("slot"), F.col("level"), F.col("w")).count() == 0


def test_slots_and_levels_of_sales(spark):
    day = datetime.datetime(2024, 2, 29, 23, 59, 59, 900_000)
    rows = [(0, day, 9.99), (1, datetime.datetime(1969, 12, 31, 23, 0), 10.0), (12345, None, 0.0), (None, day, None), (7, day, float("nan")), (8, day, -0.01), (9, day, 0.005)]
    sales = spark.createDataFrame(rows, "sale_id long, at timestamp_ntz, total double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Pacific/Auckland", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            found = sales.select(dominance.day_of(sales, "at").alias("d"), dominance.level_of("total").alias("v"), dominance.copies_of("sale_id").alias("c")).collect()
            assert [r.d for r in found] == [19782, -1, None, 19782, 19782, 19782, 19782]
            assert [r.v for r in found] == [0, 1, 0, None, None, -1, 0]
            assert [r.c for r in found] == [1 + zlib.crc32(b"" if i is None else str(i).encode()) % 3 for i, _, _ in rows]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
