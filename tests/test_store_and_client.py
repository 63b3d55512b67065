"""Versions on disk, cursors, and the client."""

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.client import SearchClient, highlighted, next_page
from tessera.functions.cursor import decode_cursor
from tessera.operators import search as S
from tessera.operators.control import pending_steps
from tessera.operators.index import build, persisted
from tessera.settings import IndexSettings, SearchRequest
from tessera.sources import claims, segments

SETTINGS = IndexSettings(boosts={"title": 4.0, "content": 1.0})


@pytest.fixture(scope="module")
def index(spark):
    rows = [("a", "Greenhouse watering guide", "Fast watering.", ["guide", "water"]), ("b", "Watering roses", "Roses need deep watering.", ["roses"]), ("c", "Fences", None, None)]
    return persisted(build(spark.createDataFrame(rows, "doc_id string, title string, content string, tags array<string>"), SETTINGS))


def test_round_trip_and_refused_overwrite(spark, index, tmp_path):
    root = str(tmp_path)
    segments.write_version(index, root, "main", "v17")
    again = segments.read_version(spark, root, "main", "v17")
    assert again.n_docs == 3 and again.settings == SETTINGS
    with pytest.raises(Exception):
        segments.write_version(index, root, "main", "v17")
    with pytest.raises(ValueError):
        segments.write_version(index, root, "../escape", "v1")
    again.lengths.limit(1).write.mode("overwrite").parquet(f"{root}/x")
    spark.read.parquet(f"{root}/x").write.mode("overwrite").parquet(f"{root}/main/v17/lengths")
    with pytest.raises(ValueError):
        segments.read_version(spark, root, "main", "v17")


def test_activation_and_rollback(spark, index, tmp_path):
    root = str(tmp_path)
    assert segments.active_version(spark, root, "main") is None
    for v in ("v1", "v2"):
        segments.write_version(index, root, "main", v)
        segments.activate(spark, root, "main", v)
    assert segments.active_version(spark, root, "main") == "v2"
    segments.activate(spark, root, "main", "v1")
    assert segments.active_version(spark, root, "main") == "v1"
    assert segments.raise_fence(spark, root, "main") == 3
    with pytest.raises(ValueError, match="predates"):
        segments.activate(spark, root, "main", "v2")
    segments.write_version(index, root, "main", "v3")
    segments.activate(spark, root, "main", "v3")
    assert segments.active_version(spark, root, "main") == "v3"


def test_backup(spark, index, tmp_path):
    segments.write_version(index, f"{tmp_path}/a", "main", "v1")
    segments.copied(spark, f"{tmp_path}/a", "main", "v1", f"{tmp_path}/b")
    assert segments.read_version(spark, f"{tmp_path}/b", "main", "v1").n_docs == 3
    with pytest.raises(Exception):
        segments.copied(spark, f"{tmp_path}/a", "main", "v1", f"{tmp_path}/b")


def test_search_in_a_stored_version(spark, index, tmp_path):
    segments.write_version(index, str(tmp_path), "main", "v1")
    stored = segments.read_version(spark, str(tmp_path), "main", "v1")
    terms = S.parsed_queries(spark, {"q": "watering roses"}, SETTINGS)[0]
    ranked = lambda i: [(r.doc_id, round(r.score, 9)) for r in S.top(S.score(i, terms), 5).orderBy("rank").collect()]
    assert ranked(stored) == ranked(index) != []


def test_migration_ledger():
    files = {"0002_b.sql": "b", "0001_a.sql": "a", "notes.txt": "x"}
    assert pending_steps(files, {}) == ["0001_a.sql", "0002_b.sql"]
    done = {"0001_a.sql": hashlib.sha256(b"a").hexdigest()}
    assert pending_steps(files, done) == ["0002_b.sql"]
    with pytest.raises(ValueError, match="0001"):
        pending_steps(files | {"0001_a.sql": "changed"}, done)


def test_client(spark, index):
    client = SearchClient(spark, index, "v1")
    request = SearchRequest("watering", limit=1, facets=("tags",))
    first = client.search(request)
    assert first.total == 2 and first.facets["tags"] == {"guide": 1, "water": 1, "roses": 1}
    second = client.search(next_page(request, first))
    assert second.next_cursor is None and {first.hits[0]["id"], second.hits[0]["id"]} == {"a", "b"}
    with pytest.raises(ValueError, match="different search request"):
        client.search(SearchRequest("fences", cursor=first.next_cursor))
    with pytest.raises(ValueError):
        SearchClient(spark, index, "v2").search(SearchRequest("watering", cursor=first.next_cursor))
    assert client.search(SearchRequest("")).total == 3
    hit = next(h for h in client.search(SearchRequest("greenhuose")).hits if h["id"] == "a")
    f, s, e = hit["highlights"][0]
    assert hit["document"][f][s:e] == "Greenhouse"


def test_cursor_members():
    with pytest.raises(ValueError, match="Invalid cursor"):
        decode_cursor("bm90IGpzb24")


def test_highlight_runs():
    assert highlighted("abcdef", [(1, 3), (2, 4), (5, 6)]) == [("a", False), ("bc", True), ("de", False), ("f", True)]


def wide_index(spark, words):
    rows = [(i, " ".join(f"w{(i * 7 + k) % words:05}" for k in range(20)) + " common") for i in range(words)]
    return build(spark.createDataFrame(rows, "doc_id long, content string"), IndexSettings(boosts={"content": 1.0}))


def test_lookups_read_only_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_ROWS", 500)
    files = []
    for words in (200, 800):
        root = f"{tmp_path}/{words}"
        segments.write_version(wide_index(spark, words), root, "main", "v1")
        stored = segments.read_version(spark, root, "main", "v1")
        assert stored.buckets["postings"] > words / 50
        one = stored.rows("postings", ["w00007"])
        plan = one._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "EqualTo(term,w00007)" in plan
        buckets = {r.bucket for r in one.select("bucket").distinct().collect()}
        assert len(buckets) == 1 and one.count() == 20
        files.append(len(list((tmp_path / str(words) / "main" / "v1" / "postings" / f"bucket={buckets.pop()}").glob("*.parquet"))))
        terms = S.parsed_queries(spark, {"q": "w00007"}, stored.settings)[0]
        assert "EqualTo(term,w00007)" in S.score(stored, terms)._jdf.queryExecution().toString()
        completions = S.autocomplete(stored, "w0000", 3)
        assert "EqualTo(prefix,w0000)" in completions._jdf.queryExecution().toString()
        assert [r.value for r in completions.collect()] == ["w00000", "w00001", "w00002"]
        grown = S.expand_in(stored, spark.createDataFrame([("q", "w00l07")], "query_id string, term string"))
        assert {r.term for r in grown.collect()} >= {"w00l07", "w00007"}
    assert max(files) <= 4  # as many as there are tasks, whatever the vocabulary


def test_expansion_is_the_same_from_stored_tables(spark, tmp_path):
    index = wide_index(spark, 60)
    segments.write_version(index, str(tmp_path), "main", "v1")
    stored = segments.read_version(spark, str(tmp_path), "main", "v1")
    terms = spark.createDataFrame([("q", "w0001"), ("r", "comon")], "query_id string, term string")
    synonyms = spark.createDataFrame([("comon", "w00003")], "term string, expansion string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.expand_in(stored, terms, synonyms)) == rows(S.expand(terms, index.vocabulary, index.settings, synonyms))
    with pytest.raises(ValueError):
        S.autocomplete(stored, "w", 21)


def test_two_writers(spark, index, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda v: segments.write_version(index, root, "main", v), ["a", "b", "c"]))
        sequences = sorted(r.sequence for r in segments.manifests(spark, root, "main").collect())
        assert sequences == [1, 2, 3]
        # One name, two writers: one of them is refused before it writes a table.
        same = list(pool.map(lambda _: outcome(lambda: segments.write_version(index, root, "main", "d")), range(2)))
        assert sorted(same) == ["", "ValueError"]
        segments.activate(spark, root, "main", "a")
        swaps = list(pool.map(lambda v: outcome(lambda: segments.activate(spark, root, "main", v, expected="a")), ["b", "c"]))
        assert sorted(swaps) == ["", "Conflict"]
        assert segments.active_version(spark, root, "main") == "bc"[swaps.index("")]
        taken = list(pool.map(lambda _: claims.next_number(spark, f"{root}/numbers", "x"), range(20)))
        assert sorted(taken) == list(range(1, 21))


def outcome(run):
    try:
        run()
        return ""
    except Exception as error:
        return type(error).__name__


def test_version_cache(spark, index, tmp_path):
    root = str(tmp_path)
    for v in ("a", "b", "c"):
        segments.write_version(index, root, "main", v)
    cache = segments.VersionCache(2)
    first = cache.get(spark, root, "main", "a")
    cache.get(spark, root, "main", "b")
    assert cache.get(spark, root, "main", "a") is first
    cache.get(spark, root, "main", "c")
    assert len(cache.held) == 2 and cache.get(spark, root, "main", "a") is first
