"""Browsing documents, their state against the active version, and changed entries."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import explorer as X

T0 = datetime.datetime(2024, 1, 1)
DOCS = [(f"d{i:02}", f"Title {i}", "100% of it" if i % 3 == 0 else "some_text", f"s{i % 2}", T0 if i % 4 == 0 else None) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, content string, source_id string, deleted_at timestamp")


def ids(df):
    return [r.doc_id for r in df.orderBy("doc_id").collect()]


def test_pages_follow_each_other(docs):
    live, seen, after = [d[0] for d in DOCS if d[4] is None], [], None
    while True:
        page = X.browse(docs, after=after, limit=4)
        seen += ids(page)
        after = page.first().next_after
        assert {r.next_after for r in page.collect()} == {after}
        if after is None:
            break
    assert seen == live


@pytest.mark.parametrize(
    "asked,expected",
    [
        ({"q": "0% O"}, lambda d: "100%" in d[2] and d[4] is None), ({"q": "_"}, lambda d: "_" in d[2] and d[4] is None), ({"q": "TITLE 1"}, lambda d: "Title 1" in d[1] and d[4] is None), ({"q": "d07"}, lambda d: d[0] == "d07"),
        ({"status": "deleted"}, lambda d: d[4] is not None), ({"status": "all", "source": "s1"}, lambda d: d[3] == "s1"), ({"status": "all", "after": "d15"}, lambda d: d[0] > "d15"), ({"q": "nowhere"}, lambda d: False),
    ],
)
def test_filters_of_the_browser(docs, asked, expected):
    assert ids(X.browse(docs, limit=100, **asked)) == [d[0] for d in DOCS if expected(d)]


def test_browser_bounds(docs):
    with pytest.raises(ValueError):
        X.browse(docs, limit=101)
    with pytest.raises(ValueError):
        X.browse(docs, status="gone")


def test_states(spark, docs):
    active = docs.filter("doc_id <= 'd10'").withColumn("title", F.when(F.col("doc_id") == "d05", "Older").otherwise(F.col("title")))
    found = {r.doc_id: (r.in_active, r.state) for r in X.document_states(docs, active, ["title", "content"]).collect()}
    assert found["d01"] == (True, "indexed") and found["d04"] == (True, "deleted") and found["d05"] == (True, "pending") and found["d11"] == (False, "pending") and found["d12"] == (False, "deleted")


def test_changed_entries(spark):
    old = spark.createDataFrame([(1, '{"a": 1, "b": {"x": 1}, "c": null}'), (2, '{"a": 1}'), (3, None), (4, "no json")], "doc_id long, body string")
    new = spark.createDataFrame([(1, '{"b": {"x": 2}, "a": 1, "d": "é"}'), (2, '{"a": 1}'), (3, '{"z": 1}'), (4, '{"y": null}')], "doc_id long, body string")
    assert {r.doc_id: r.changed for r in X.changed_fields(old, new).collect()} == {1: ["b", "c", "d"], 2: [], 3: ["z"], 4: ["y"]}
    assert {r.doc_id: r.changed for r in X.changed_fields(old, new, most=2).collect()}[1] == ["b", "c"]
