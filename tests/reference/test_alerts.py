"""Timed alerts: the stream and the table against an evaluation minute by minute."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.streaming import alerts
from proofmill.streaming.alerts import Rule

RULES = (Rule("model_errors", 3, 1), Rule("latency_p95", 4, 80, 3, 0.95), Rule("truncation", 2, 0, 2))
SCHEMA = "ts timestamp, stage string, ms double, model_error string, finish_reason string"
BASE = datetime(2024, 1, 1)


def made(rng, minutes=120, n=250):
    out = []
    for _ in range(n):
        ts = BASE + timedelta(seconds=rng.choice((rng.randrange(minutes * 60), 60 * rng.randrange(minutes))), microseconds=rng.choice((0, 0, 1)))
        slow = (ts - BASE).seconds // 1200 % 2
        out.append((ts, rng.choice(("stage2_ocr_classify",) * 3 + ("lead_closed",)), rng.choice((None, float(rng.randrange(100 if slow else 70)))), rng.choice(("", None, "", "", "Timeout")), rng.choice(("stop", "stop", "stop", "stop", "length"))))
    return out


def minute_by_minute(rows, rules, minutes=140):
    out = []
    for r in rules:
        state, since = "normal", 0
        for m in range(-1, minutes):
            now = BASE + timedelta(minutes=m)
            window = [x for x in rows if x[1] == "stage2_ocr_classify" and now - timedelta(minutes=r.minutes) < x[0] <= now]
            if r.quantile:
                values = [x[2] for x in window if x[2] is not None]
                value = float(np.quantile(values, r.quantile)) if values else None
            else:
                value = sum(1 for x in window if (x[3] or "" if r.name == "model_errors" else x[4] == "length"))
            before = state
            if value is not None and value > r.limit:
                since = m if state == "normal" else since
                state = "firing" if m - since >= r.hold else "pending"
            else:
                state = "normal"
            if state != before:
                out.append((r.name, now, "resolved" if before == "firing" else state))
    return sorted(out)


def test_quantile():
    rng = random.Random(2)
    for _ in range(50):
        counts = [(float(rng.randrange(20)), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 8))]
        flat = [v for v, n in counts for _ in range(n)]
        assert alerts.quantile(counts, 0.95) == pytest.approx(np.quantile(flat, 0.95))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table(spark, seed):
    rows = made(random.Random(seed))
    want = minute_by_minute(rows, RULES)
    assert sorted(map(tuple, alerts.states(spark.createDataFrame(rows, SCHEMA), RULES).collect())) == want
    assert {s for _, _, s in want} == {"pending", "firing", "resolved", "normal"}


def test_stream(spark, tmp_path):
    rows = sorted(made(random.Random(4)), key=lambda r: r[0])
    want, src = minute_by_minute(rows, RULES), str(tmp_path / "src")
    end = [(BASE + timedelta(days=2, minutes=i), "lead_closed", None, None, None) for i in (0, 30)]
    for part in (rows[:80], rows[80:150], rows[150:], end[:1], end[1:]):
        random.Random(1).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        out = alerts.watch(spark.readStream.schema(SCHEMA).parquet(src), RULES, "1 minute")
        run = out.writeStream.option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("rule", "minute", "state").where(F.col("minute").isNotNull())
    assert sorted(map(tuple, got.collect())) == want
