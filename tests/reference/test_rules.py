"""Rules that DuckDB cannot restate: free-text dates, payment handles, pixels; and plans that change with a decision."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.functions import dates, images, names, text
from proofmill.operators import mapping, receivers, tables, verify
from proofmill.plans import dashboard, leads, metrics
from proofmill.queries import RECEIVERS, RULES
from proofmill.sources import readers, sinks
from proofmill.views import register, view

SF = "/root/testdata/sf0.001"


def test_dates_are_those_of_the_parser(spark):
    """Native forms and free text against the parser itself, for both readings of ISO dates."""
    from dateutil import parser

    rng = random.Random(1)
    short = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    long = "January February March April May June July August September October November December".split()
    texts = ["", "abc", None, "paid on 5 Jan 2024 at 10:30", "12/25/2024", "31/02/2024", "2024-02-30", "Jan 5, 2024 10:30 AM", " 2025-10-05 ", "32/10/03", "nope"]
    for _ in range(1500):
        y, m, d, sep = rng.randrange(1990, 2040), rng.randrange(1, 14), rng.randrange(1, 33), rng.choice("-/.")
        forms = (
            f"{y}{sep}{m:02}{sep}{d:02}", f"{d:02}{sep}{m:02}{sep}{y}", f"{d}{sep}{m}{sep}{y}", f"{d:02}{sep}{m:02}{sep}{y % 100:02}", f"{y}{m:02}{d:02}", f"{d} {rng.choice(short)} {y}",
            f"{rng.choice(long)} {d}, {y}", f"{d:02}-{rng.choice(short)}-{y % 100:02}", f"{d}th {rng.choice(long)} {y}", f"{y}-{m}-{d}", f"{m}{sep}{d}{sep}{y}", f"on {d} {rng.choice(short)} {y}",
        )
        texts.append(rng.choice(forms) + rng.choice(["", "", " 10:30", "T10:20:30", " 10:30 AM", " 23:59:59", " 12:05 pm", "T10:20:30Z"]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def want(t, iso):
        try:
            return parser.parse(t, dayfirst=iso or not re.match(r"\s*\d{4}-\d{1,2}-\d{1,2}", t), fuzzy=True).date() if t else None
        except Exception:
            return None

    for iso in (True, False):
        rows = df.select("t", dates.native_date(F.col("t"), iso).alias("native"), dates.parse_date(F.col("t"), True, iso).alias("any")).collect()
        assert [(r["t"], r["any"]) for r in rows] == [(r["t"], want(r["t"], iso)) for r in rows]
        assert all(r["native"] in (None, r["any"]) for r in rows) and sum(r["native"] is not None for r in rows) > 0.75 * len(rows)


@pytest.mark.parametrize("handle,name,hit", [
    ("smfgindia@icici", "SMFG India Credit", True), ("smf1@icici", "SMFG India Credit", False), ("pay.zztestcorp9@upi", "ZZTest Corp", True), ("zztes@upi", "ZZTest Corp", False),
    ("mail zztest@corp.example.com", "ZZTest Corp", False), ("bank@upi", "Bank of Finance", False), ("aba" * 21 + "@upi", "abab abaa aabb baba", False), ("hdbfin@ybl", "HDB Financial Services", True),
])
def test_handles(spark, handle, name, hit):
    began = time.time()
    accepted = spark.createDataFrame([("L", 0, False, name, name.lower())], "lender string, rank int, own boolean, name string, norm string")
    found = spark.range(1).select(F.lit("L").alias("lender"), names.handles(F.lit(f"utr {handle} ok")).alias("handles"))
    assert (receivers.handle_hits(found, accepted).count() == 1) == hit and time.time() - began < 30


def test_image_quality(spark):
    rng = np.random.default_rng(1)
    shapes = {"black": np.zeros((9, 9, 1), np.uint8), "white": np.full((9, 9, 3), 255, np.uint8), "noise": rng.integers(0, 256, (32, 32, 3), np.uint8), "tiny": np.full((2, 2, 1), 200, np.uint8), "line": np.full((1, 50, 1), 90, np.uint8)}
    ramp = np.tile(np.arange(0, 250, 5, dtype=np.uint8), (50, 1))[..., None]
    rows = [(k, *v.shape[:2], v.shape[2], v.tobytes()) for k, v in {**shapes, "ramp": ramp}.items()]
    df = spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary").select(F.struct("origin", "height", "width", "nChannels", "data").alias("image"))
    out = {r["origin"]: (r["reason"].split(" (")[0], r["passed"], r["m"]) for r in images.quality(df).collect()}
    assert out["black"][0] == "image effectively black" and out["noise"][:2] == ("image quality acceptable", True)
    assert {k: out[k][0] for k in ("white", "tiny", "line", "ramp")} == dict.fromkeys(("white", "tiny", "line", "ramp"), "image too blurry")
    # The variance of the Laplacian, one pixel at a time.
    g = np.floor(shapes["noise"].astype(float) @ [0.114, 0.587, 0.299] + 0.5)
    lap = [g[y - 1, x] + g[y + 1, x] + g[y, x - 1] + g[y, x + 1] - 4 * g[y, x] for y in range(1, 31) for x in range(1, 31)]
    assert out["noise"][2]["blur_laplacian_var"] == round(float(np.var(lap)), 1) and out["noise"][2]["brightness"] == round(float(g.mean()), 1)


def test_lead_ids(spark):
    df = spark.createDataFrame([(" a ", "x\ty"), ("", "é")], "id string, v string")
    import hashlib
    import json

    want = "LEAD-" + hashlib.sha1(json.dumps({"id": "", "v": "é"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
    assert [r["lead_id"] for r in mapping.with_lead_id(df, "id").collect()] == ["a", want]
    assert [tuple(r) for r in mapping.multi_select(df, {"id": ["—"], "v": None}).collect()] == [("", "é")]


def decision_tables(spark):
    """Lead 1 fails on its receiver alone, lead 2 on amount too, lead 3 is of another lender."""
    ids = ["1", "2", "3"]
    results = spark.createDataFrame(
        [(i, "HDBFS_PL" if i != "3" else "JANA_SF", "unverified", False, '{"failed_fields":["receiver"]}' if i != "2" else '{"failed_fields":["amount","receiver"]}', '{"receiver_name":"Speedo Fin"}') for i in ids],
        "lead_id string, lender string, verification_status string, is_test boolean, outcome string, extracted string",
    )
    rows = spark.createDataFrame([(i, i != "x", "HDBFS_PL" if i != "3" else "JANA_SF", "5000", "2024-01-15", "1") for i in ids], "lead_id string, is_test boolean, institute_name string, payment_amount string, payment_date string, loan_account_number string")
    docs = spark.createDataFrame([(i, "5000" if i != "2" else "9", "15/01/2024", "Speedo Fin", None, "paid") for i in ids], "lead_id string, amount string, doc_date string, receiver_name string, loan_account_number string, full_text string")
    return results, rows, docs, spark.createDataFrame([], "lender string, receiver_norm string")


def test_decisions(spark):
    results, rows, docs, none = decision_tables(spark)
    table = verify.lender_table(spark, RULES, RECEIVERS)
    queue = leads.approval_queue(results, none).collect()
    assert [(r["lender"], r["receiver_norm"], r["count"], r["ready"]) for r in queue] == [("HDBFS_PL", "speedo fin", 2, 1), ("JANA_SF", "speedo fin", 1, 1)]
    taught, again = leads.decide(results, none, rows, docs, table, "HDBFS_PL", "Speedo Fin", "approved")
    assert taught.where("lender = 'HDBFS_PL'").first()["receivers"][-1] == "Speedo Fin"
    assert sorted((r["lead_id"], r["new"], r["changed"]) for r in again.collect()) == [("1", "verified", True), ("2", "unverified", False)]
    same, again = leads.decide(results, none, rows, docs, table, "HDBFS_PL", "Speedo Fin", "rejected")
    assert same is table and not again.where("changed").count()
    decided = spark.createDataFrame([("HDBFS_PL", "speedo fin")], none.schema)
    for lender, receiver, what in (("HDBFS_PL", "Speedo Fin", "approved"), ("", "x", "approved"), ("A", " ", "approved"), ("A", "x", "maybe")):
        with pytest.raises(ValueError):
            leads.decide(results, decided, rows, docs, table, lender, receiver, what)
    assert [r["lender"] for r in leads.approval_queue(results, decided).collect()] == ["JANA_SF"]


def near(rows):
    return sorted((tuple(f"{x:.6g}" if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("scope", ["real", "test"])
def test_snapshot_equals_the_queries(spark, scope):
    sql = metrics.analytics(metrics.SPARK, scope)
    register(spark, SF, " ".join(metrics.analytics(metrics.SPARK).values()))
    found = dashboard.snapshot(spark, scope)
    assert set(found) == set(metrics.SNAPSHOT)
    for name, df in found.items():
        want = spark.sql(sql[name])
        assert df.columns == want.columns, name
        assert near(df.collect()) == near(want.collect()), name
        scans = df._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
        assert name == "a11_queue" or not any(t in scans for t in ("o_orderkey", "event_id", "doc_id")), name


def test_each_cube_scans_once(spark):
    register(spark, SF, " ".join(metrics.analytics(metrics.SPARK).values()))
    for cube, table, wide in ((dashboard.event_cube, "lead_events", "event_type"), (dashboard.result_cube, "lead_results", "o_orderstatus"), (dashboard.review_cube, "lead_reviews", "toxic")):
        plan = cube(spark.table(table))._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("ReadSchema: ")[1:] if wide in x.split("\n")[0]]
        assert len(scans) == (2 if table == "lead_reviews" else 1), table  # the view itself is a union of two scans


def test_scopes(spark):
    n = {s: tables.scoped(view(spark, SF, "leads"), s).count() for s in ("real", "test", "all")}
    assert n["real"] + n["test"] == n["all"] and n["test"]


def test_retention(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")
    assert [tables.purge(df, "t", d, now).count() for d in (0, -1, 1, 1.5, 3)] == [2, 2, 1, 1, 2]


def test_excel_needs_its_package(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"PK")
    with pytest.raises(Exception, match="openpyxl|zip|Excel"):
        readers.read_excel(spark, str(tmp_path / "a.xlsx")).collect()


def test_rules_of_configuration(spark):
    with pytest.raises(ValueError):
        verify.lender_table(spark, RULES | {"X": RULES["SMFG_PL"] | {"needs_lan": False}}, {})
    assert [r["x"] for r in spark.createDataFrame([("[1",), ("",), ('{"a": 2}',)], "v string").select(F.try_variant_get(text.as_object(F.col("v")), "$.a", "int").alias("x")).collect()] == [None, None, 2]
    assert spark.range(1).select(text.utc(F.lit("2024-01-01T05:30:00+05:30")).alias("x")).first()["x"] == "2024-01-01 00:00:00"


def test_reverify_counts_and_events(spark):
    results, rows, docs, _ = decision_tables(spark)
    held = spark.createDataFrame([("4", "HDBFS_PL", "unverified", False, '{"flag":"different_loan_account_same_lead_code"}', "{}"), ("5", "X", "duplicate", False, "{}", "{}")], results.schema)
    every = results.unionByName(held)
    more = spark.createDataFrame([("4", True, "HDBFS_PL", "1", "2024-01-15", "1")], rows.schema)
    table = verify.lender_table(spark, RULES, RECEIVERS | {"HDBFS_PL": ["Speedo Fin"]})
    moves = leads.reverify(every, rows.unionByName(more), docs, table)
    assert sorted((r["lead_id"], r["new"]) for r in moves.collect()) == [("1", "verified"), ("2", "unverified"), ("3", "unverified")]
    counts = leads.reverify_counts(every, rows.unionByName(more), moves).first()
    assert tuple(counts)[:4] == (4, 1, 1, 1) and counts["moves"] == {"unverified->verified": 1}
    assert [tuple(r) for r in leads.reverify_events(moves, "approved").collect()] == [("1", "reverify", "PASS", "unverified -> verified (deterministic re-verify, no model call; approved)")]
    none = leads.reverify_counts(every, rows, moves.limit(0)).first()
    assert (none["changed"], none["flipped"], none["moves"]) == (0, 0, {})


def test_one_record(spark):
    table = verify.lender_table(spark, RULES, RECEIVERS)
    record = {"institute_name": "HDBFS_PL", "payment_amount": "5000", "payment_date": "2024-01-15", "loan_account_number": 77, "lead_code": None}
    paid = {"amount": "5000.00", "doc_date": "15/01/2024", "receiver_name": "HDB Fin Services", "full_text": "amount paid"}
    assert leads.verify_one(table, record, paid)["status"] == "verified"
    bad = leads.verify_one(table, record, paid | {"amount": "9"}, "L1")
    assert (bad["lead_id"], bad["status"], bad["failed_fields"]) == ("L1", "unverified", ["amount"])
    assert leads.verify_one(table, record)["status"] == "unprocessed"
    assert leads.verify_one(table, record, {"full_text": "lunch"})["status"] == "non_document"


def test_review_history_and_event_log(spark, tmp_path):
    reviews = spark.createDataFrame([(3, "a", "confirmed"), (1, "a", "overturned"), (2, "b", "confirmed")], "id long, lead_id string, decision string")
    assert [r["id"] for r in leads.review_history(reviews, "a").collect()] == [1, 3]
    for batch, ids in (("0", [1, 2]), ("1", [3]), ("1", [3])):
        sinks.append_events(spark.createDataFrame([(i, "x") for i in ids], "id long, stage string"), str(tmp_path / "events"), batch)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "events")).collect()) == [1, 2, 3]
