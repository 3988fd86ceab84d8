import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from proofmill.operators import lookup
from proofmill.operators.dedup import dedup_verdicts, ledger_rows
from proofmill.operators.mapping import Mapping
from proofmill.sources import readers, sinks
from proofmill.streaming import ingest, polling


def test_csv_and_submit(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,amount\n1,"5,000"\n2,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "5,000"), ("2", "")]
    assert [tuple(r) for r in readers.submitted(spark, {"rows": [{"a": 1}, {"a": None, "b": "x"}]}).collect()] == [("1", ""), ("", "x")]
    for bad in ({}, {"rows": [{"a": 1}] * 2001}):
        with pytest.raises(ValueError):
            readers.submitted(spark, bad)


def test_database_options():
    assert readers.jdbc_options("postgresql+psycopg://u:p@h:5/db") == {"url": "jdbc:postgresql://h:5/db", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    for bad in ("x; drop table y", "1a", "", "a b"):
        with pytest.raises(ValueError):
            readers.checked_name(bad)
    with pytest.raises(ValueError):
        readers.open_source(None, "ftp")


def test_increment(spark):
    df = spark.createDataFrame([(3, 10), (1, 20), (2, 20), (4, 5)], "id int, created_at int")
    assert [r["id"] for r in readers.increment(df, 10, limit=2).collect()] == [3, 1]


def test_card_logs_in_again(spark):
    calls = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            calls.append(self.path)
            refuse = "query" in self.path and sum("query" in c for c in calls) == 1
            self.send_response(401 if refuse else 200)
            self.end_headers()
            if not refuse:
                self.wfile.write(json.dumps({"id": "s"} if "session" in self.path else [{"id": i, "amount": None} for i in range(5)]).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = readers.open_source(spark, "card", url=f"http://127.0.0.1:{server.server_port}", card="7", columns="id, amount", limit="3")
    assert [tuple(r) for r in df.collect()] == [("0", None), ("1", None), ("2", None)]
    assert calls == ["/api/session", "/api/card/7/query/json"] * 2
    server.shutdown()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "verified"), ("b", "unverified"), ("c", "odd"), ("d", "unverified")], "lead_id string, verification_status string")
    sinks.write_results(df, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("lead_id")]
    assert lines == ["c,odd", "b,unverified", "d,unverified", "a,verified"]
    store, blobs = str(tmp_path / "blobs"), spark.createDataFrame([(b"x",), (b"x",), (b"yy",), (None,)], "content binary")
    assert sinks.put_blobs(blobs, store).count() == 2 and sinks.put_blobs(blobs, store).count() == 0
    keys = spark.createDataFrame([(b"x",), (b"z",)], "c binary").select(F.sha2("c", 256).alias("sha256"))
    assert sorted(bytes(r["content"] or b"-") for r in sinks.get_blobs(keys, store).collect()) == [b"-", b"x"]


def test_ingest_is_idempotent(spark, tmp_path):
    src, queue, bad, ck, runs = (str(tmp_path / n) for n in ("src", "queue", "bad", "ck", "runs"))
    m = Mapping({"institute_name": "lender", "payment_amount": "amount"}, "created_at", "id", "LEAD-", ["institute_name"])
    schema = "id string, lender string, amount string, created_at string"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").json(src)
    leads = lambda: sorted(r["lead_id"] for r in ingest.queue_table(spark, queue).read().collect())
    held = lambda: sorted((r["source_key"], r["reason"], r["resolved"]) for r in ingest.quarantine_table(spark, bad).read().collect())
    write([("1", "A", "5", "t"), ("2", "", "5", "t"), ("3", "B", "x", "t"), ("1", "A", "5", "t")])
    run = lambda: ingest.start_ingest(spark.readStream.schema(schema).json(src), m, queue, bad, ck, backfill=True, runs=runs, compact_every=2).awaitTermination()
    run()
    faults = [("LEAD-2", "missing required field 'institute_name'", False), ("LEAD-3", "payment_amount not numeric: 'x'", False)]
    assert leads() == ["LEAD-1"] and held() == faults
    # Somebody resolves a row; it comes again with another fault and is open again.
    table = ingest.quarantine_table(spark, bad)
    table.write(table.read().where("source_key = 'LEAD-3'").withColumn("resolved", F.lit(True)), "by-hand")
    assert held()[1][2] is True
    write([("1", "A", "5", "t"), ("4", "A", "7", "s"), ("3", "B", "y", "t")])
    run()
    assert leads() == ["LEAD-1", "LEAD-4"] and held() == [faults[0], ("LEAD-3", "payment_amount not numeric: 'y'", False)]
    write([("5", "A", "5", "t")])
    run()  # the third batch compacts first
    assert leads() == ["LEAD-1", "LEAD-4", "LEAD-5"] and held() == [faults[0], ("LEAD-3", "payment_amount not numeric: 'y'", False)]
    counts = spark.read.parquet(runs).select("rows_seen", "enqueued", "duplicates", "quarantined").collect()
    assert sorted(map(tuple, counts)) == [(1, 1, 0, 0), (3, 1, 1, 1), (4, 1, 1, 2)]
    # A batch that is run again replaces itself.
    for _ in range(2):
        ingest.ingest(spark.createDataFrame([("9", "A", "5", "t"), ("1", "A", "5", "t")], schema), m, queue, bad, batch="again")
        assert leads() == ["LEAD-1", "LEAD-4", "LEAD-5", "LEAD-9"]


def test_ingest_polls_a_table(spark, tmp_path):
    base, queue, bad, ck = (str(tmp_path / n) for n in ("source.db", "queue", "bad", "ck"))
    con = sqlite3.connect(base)
    con.execute("CREATE TABLE leads (id INTEGER PRIMARY KEY, created_at TEXT, lender TEXT, amount TEXT)")
    con.executemany("INSERT INTO leads VALUES (?, ?, ?, ?)", [(i, f"2024-01-01 00:{i:02d}:00", "A" if i % 7 else "", str(i)) for i in range(50)])
    con.commit()
    con.close()
    m = Mapping({"institute_name": "lender", "payment_amount": "amount"}, "created_at", "id", "LEAD-", ["institute_name"])
    for _ in range(2):
        stream = polling.poll(spark, ck, module="sqlite3", connect=base, table="leads", columns="id, created_at, lender, amount", **{"from": "2024-01-01 00:00:00"})
        ingest.start_ingest(stream, m, queue, bad, ck, backfill=True).awaitTermination()
    assert sorted(r["lead_id"] for r in ingest.queue_table(spark, queue).read().collect()) == sorted(f"LEAD-{i}" for i in range(50) if i % 7)
    assert ingest.quarantine_table(spark, bad).read().count() == 8


def test_dedup_stream_agrees_with_batch(spark, tmp_path):
    rows = [(f"L{i}", i, i % 7 == 0, f"C{i % 5}", f"ln{i % 3}", str(100 + i % 2), f"2024-0{1 + i % 2}-05") for i in range(60)] + [("L99", 99, False, "", "ln", "1", "2024-01-01")]
    schema = "lead_id string, seq long, is_test boolean, lead_code string, loan_account_number string, payment_amount string, payment_date string"
    for lo in (0, 20, 40):
        spark.createDataFrame(rows[lo : lo + 20 + (lo == 40)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "s"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "s"))
        out = ingest.dedup_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).format("parquet")
        out.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).select("lead_id", "dedup", "owner").collect()))
    batch = dedup_verdicts(spark.createDataFrame(rows, schema)).where("dedup <> 'skip'").select("lead_id", "dedup", "owner").collect()
    assert got == sorted(map(tuple, batch))


def test_dedup_stream_goes_on_from_a_ledger(spark, tmp_path):
    schema = "lead_id string, seq long, is_test boolean, lead_code string, loan_account_number string, payment_amount string, payment_date string"
    rows = [(f"L{i:03d}", i, False, f"C{i % 4}", f"ln{i * 7 % 5}", str(100 + i % 3), f"2024-0{1 + i % 2}-05") for i in range(90)]
    old, new = spark.createDataFrame(rows[:40], schema), rows[40:]
    ledger = ledger_rows(old, spark.createDataFrame([(r[0], False) for r in rows[:40]], "lead_id string, is_test boolean"))
    for lo in (0, 25):
        spark.createDataFrame(new[lo : lo + 25], schema).coalesce(1).write.mode("append").json(str(tmp_path / "s"))
        out = ingest.dedup_stream(spark.readStream.schema(schema).json(str(tmp_path / "s")), ledger=ledger)
        out.writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).format("parquet").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).select("lead_id", "dedup", "owner").collect()))
    every = dedup_verdicts(spark.createDataFrame(rows, schema)).select("lead_id", "dedup", "owner").collect()
    assert got == sorted(tuple(r) for r in every if r["lead_id"] >= "L040") and "duplicate" in {r[1] for r in got}
    # The state holds what the ledger of all leads has, and no more.
    whole = ledger_rows(spark.createDataFrame(rows, schema), spark.createDataFrame([(r[0], False) for r in rows], "lead_id string, is_test boolean"))
    assert ingest.ledger_difference(spark, str(tmp_path / "c"), whole).count() == 0
    assert ingest.ledger_difference(spark, str(tmp_path / "c"), ledger).count() == whole.count() - ledger.count() > 0


def test_database_by_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/derby;create=true"
    rows = spark.range(1000).select((F.col("id") * 3).cast("int").alias("id"), F.concat(F.lit("lead "), "id").alias("name"))
    rows.write.format("jdbc").options(**readers.jdbc_options(url), dbtable="leads").save()
    df = readers.open_source(spark, "db", url=url, table="leads", key="id", parts="5")
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))
    some = readers.increment(df, 2990, "id", "id").select("id")
    assert [r["id"] for r in some.collect()] == [2991, 2994, 2997]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ID,2990)" in plan.replace("id", "ID") and "ReadSchema: struct<ID:int>" in plan.replace("id", "ID")
    # Each range holds its part of the rows.
    assert max(len(p) for p in df.rdd.glom().collect()) < 400
    empty = spark.createDataFrame([], "id int, name string")
    empty.write.format("jdbc").options(**readers.jdbc_options(url), dbtable="nothing").save()
    assert readers.read_database(spark, url, "nothing", "id").count() == 0


def test_journey_reads_one_file(spark, tmp_path):
    events = spark.range(20_000).select("id", F.concat(F.lit("LEAD-"), F.pmod(F.col("id") * 7919, F.lit(3000))).alias("lead_id"), F.lit("stage").alias("stage"))
    path = str(tmp_path / "events")
    lookup.write_clustered(events, path, "lead_id", "id", buckets=32)
    rows = lookup.lookup(spark, path, "lead_id", "LEAD-77", buckets=32)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, events.where("lead_id = 'LEAD-77'").collect()))
    leaf = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().get("numFiles").get().value() <= 2 and leaf.metrics().get("numOutputRows").get().value() < 3000
    assert [r["id"] for r in lookup.journey(spark, path, "LEAD-77", buckets=32).collect()] == sorted(r["id"] for r in rows.collect())
    assert lookup.journey(spark, path, "nobody", buckets=32).count() == 0


def test_windows(spark):
    rows = [("lead_closed", "2024-01-01 00:00:10"), ("lead_closed", "2024-01-01 00:00:50"), ("lead_closed", "2024-01-01 00:01:10"), ("x", "2024-01-01 00:01:10")]
    df = spark.createDataFrame(rows, "stage string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n"] for r in ingest.throughput(df).collect()) == [1, 2]
    assert ingest.within(df, F.lit("2024-01-01 00:01:10").cast("timestamp"), 1).count() == 3
