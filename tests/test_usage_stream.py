from datetime import datetime, timedelta

from tessera.plans import stream_queries
from tessera.streaming.usage import admission_sink

DAY = datetime(2024, 1, 1)


def test_batches_of_a_stream_are_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(DAY + timedelta(minutes=i % 500), i) for i in range(2000)], "at timestamp, seq long")
    seen = []

    def run(stream):
        folder = spark.read.parquet(f"{tmp_path}/in")
        seen.append((len(folder.inputFiles()), folder.count(), folder.agg({"at": "max"}).first()[0]))

    stream_queries._in_order(rows, str(tmp_path), 2, ["at", "seq"], run)
    assert [n for _, n, _ in seen][1] == 2000 and 600 < seen[0][1] < 1400 and seen[0][2] < seen[1][2]
    # Each batch was one file of one task.
    assert seen[0][0] > 1 and seen[1][0] > seen[0][0] + 1


def test_a_batch_of_one_row_leaves_the_other_empty(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, 1)], "at timestamp, seq long")
    counts = []
    stream_queries._in_order(rows, str(tmp_path), 2, ["at", "seq"], lambda stream: counts.append(spark.read.schema(rows.schema).parquet(f"{tmp_path}/in").count()))
    assert counts[-1] == 1


def test_admission_by_batches(spark, tmp_path):
    """State is carried on, a repeated batch changes nothing, and requests without a project or a time count."""
    counters = spark.createDataFrame([(1, "2024-01", 1, 3), (2, "2024-01", 9, 4)], "project_id long, period string, used long, most long")
    apply = admission_sink(str(tmp_path), counters)
    schema = "project_id long, request_id long, at timestamp"
    first = [(1, 10, DAY), (2, 11, DAY), (3, 12, DAY), (None, 13, DAY), (1, 14, None)]
    second = [(1, 21, DAY + timedelta(2)), (1, 20, DAY + timedelta(1)), (1, 22, DAY + timedelta(40)), (3, 23, DAY), (None, 24, DAY), (1, 25, None)]
    for number, rows in ((0, first), (1, second), (1, second)):
        apply(spark.createDataFrame(rows, schema), number)
    got = {r.request_id: (r.period, r.admitted, r.used) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {10: ("2024-01", True, 2), 11: ("2024-01", False, 9), 12: ("2024-01", True, 1), 13: ("2024-01", True, 1), 14: (None, True, 1)}
    want |= {20: ("2024-01", True, 3), 21: ("2024-01", False, 3), 22: ("2024-02", True, 1), 23: ("2024-01", True, 2), 24: ("2024-01", True, 2), 25: (None, True, 2)}
    assert got == want
