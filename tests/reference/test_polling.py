"""A database table as a stream: pages, restarts, equal times, late rows and rates."""

import sqlite3
import time
from collections import Counter

import pytest

from proofmill.streaming import polling


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "source.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE leads (id INTEGER PRIMARY KEY, created_at TEXT, amount TEXT)")
    return path


def add(path, rows):
    con = sqlite3.connect(path)
    con.executemany("INSERT INTO leads VALUES (?, ?, ?)", rows)
    con.commit()
    con.close()


def at(minute, second=0):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"


class Run:
    """A query over the table: every batch is kept with its rows."""

    def __init__(self, spark, path, checkpoint, **options):
        self.batches = []
        options = {"module": "sqlite3", "connect": path, "table": "leads", "columns": "id, created_at, amount", "from": at(0), **options}
        stream = polling.poll(spark, checkpoint, **options)
        keep = lambda df, n: self.batches.append([tuple(r) for r in df.collect()])
        self.query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(processingTime="100 milliseconds").start()

    def until(self, done, seconds=60):
        began = time.time()
        while not done(self) and time.time() - began < seconds:
            if self.query.exception():
                raise self.query.exception()
            time.sleep(0.1)
        assert done(self), self.batches
        return self

    def stop(self):
        self.query.stop()
        return self

    @property
    def ids(self):
        return [int(r[0]) for b in self.batches for r in b]


def test_stream_equals_batch_and_restarts(spark, base, tmp_path):
    add(base, [(i, at(i // 3, i % 60), str(i)) for i in range(250)] + [(900, "2023-12-31 23:59:59", "before")])
    run = Run(spark, base, str(tmp_path / "ck"), page=60, overlap=0).until(lambda r: len(set(r.ids)) == 250).stop()
    assert sorted(run.ids) == list(range(250)) and max(map(len, run.batches)) <= 60 and len(run.batches) >= 5
    batch = spark.read.format("polled_table").options(module="sqlite3", connect=base, table="leads", columns="id, created_at, amount", **{"from": at(0)}).load()
    assert sorted(map(tuple, batch.collect())) == sorted(r for b in run.batches for r in b)
    # A restart goes on behind the last batch, page by page.
    add(base, [(i, at(100 + i), "new") for i in range(300, 500)])
    again = Run(spark, base, str(tmp_path / "ck"), page=60, overlap=0).until(lambda r: len(set(r.ids)) == 200).stop()
    assert sorted(again.ids) == list(range(300, 500)) and max(map(len, again.batches)) <= 60
    assert polling.reached(spark, str(tmp_path / "none")) is None


def test_many_rows_of_one_time(spark, base, tmp_path):
    add(base, [(i, at(5), "x") for i in range(1000)])
    run = Run(spark, base, str(tmp_path / "ck"), page=128, overlap=0).until(lambda r: len(set(r.ids)) == 1000).stop()
    assert sorted(run.ids) == list(range(1000))


def test_late_rows_inside_the_overlap(spark, base, tmp_path):
    add(base, [(i, at(i), "x") for i in range(30)])
    run = Run(spark, base, str(tmp_path / "ck"), overlap=10).until(lambda r: len(set(r.ids)) == 30)
    n = len(run.batches)
    add(base, [(700, at(25, 30), "late"), (701, at(3, 30), "too late")])
    run.until(lambda r: 700 in r.ids).stop()
    assert 701 not in run.ids and len(run.batches) > n
    # The overlap is read again, nothing before it.
    seen = Counter(run.ids)
    assert {i for i, k in seen.items() if k > 1} <= set(range(19, 30)) and seen[700] == 1


def test_rate(spark, base, tmp_path):
    add(base, [(i, at(i), "x") for i in range(200)])
    run = Run(spark, base, str(tmp_path / "ck"), overlap=0, rows_per_minute=600)
    time.sleep(6)
    run.stop()
    assert 0 < len(run.ids) <= 150 and sorted(run.ids) == list(range(len(run.ids)))


def test_names_are_checked():
    for bad in ({"table": "x; drop"}, {"table": "t", "columns": "a, b c"}, {"table": "t", "columns": "a", "id": "1"}):
        with pytest.raises(ValueError):
            polling.Rows({"columns": "a", **bad})
