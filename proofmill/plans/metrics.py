"""The analytic queries over leads, events, results, reviews and jobs.

Each is SQL over the lead views. ``dialect`` supplies the few functions that Spark and DuckDB spell
differently, so the same question can be asked of both. Windows of time end at the newest event, never at the
clock; limits have a key as tiebreak. All aggregate before they shuffle and no query sorts more than its limit.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles

SPARK = SimpleNamespace(
    js=lambda c, p: f"get_json_object({c}, '$.{p}')", list=lambda c, p: f"from_json(get_json_object({c}, '$.{p}'), 'array<string>')",
    pctl=lambda x, p: f"percentile({x}, {p})", each=lambda x: f"explode({x})", epoch=lambda t: f"unix_timestamp({t})",
    time=lambda t, f: f"date_format({t}, '{f}')", has=lambda a, x: f"array_contains({a}, {x})", first=lambda a, b: f"min_by({a}, {b})", last=lambda a, b: f"max_by({a}, {b})",
    left=lambda x, n: f"left({x}, {n})", join=lambda a: f"array_join({a}, ', ')",
)
_FORMATS = {"HH:mm": "%H:%M", "MM-dd": "%m-%d", "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M"}
DUCKDB = SimpleNamespace(
    js=lambda c, p: f"json_extract_string({c}, '$.{p}')", list=lambda c, p: f"from_json(json_extract({c}, '$.{p}'), '[\"VARCHAR\"]')",
    pctl=lambda x, p: f"quantile_cont({x}, {p})", each=lambda x: f"unnest({x})", epoch=lambda t: f"cast(floor(epoch({t})) as bigint)",
    time=lambda t, f: f"strftime({t}, '{_FORMATS[f]}')", has=lambda a, x: f"list_contains({a}, {x})", first=lambda a, b: f"arg_min({a}, {b})", last=lambda a, b: f"arg_max({a}, {b})",
    left=lambda x, n: f"left({x}, {n})", join=lambda a: f"array_to_string({a}, ', ')",
)

#: Lenders with a rule, and with receivers, in the queries' configuration.
RULES = ("SMFG_PL", "BAJAJ_AUTO", "MONEYVIEW")
RECEIVERS = ("SMFG_PL", "HDBFS_PL", "JANA_SF", "KHATABOOK", "BAJAJ_AUTO", "MONEYVIEW")


def scoped(view: str, scope: str) -> str:
    return {"real": f"(SELECT * FROM {view} WHERE NOT is_test)", "test": f"(SELECT * FROM {view} WHERE is_test)", "all": view}[scope]


def analytics(d: SimpleNamespace, scope: str = "real") -> dict[str, str]:
    """Query name to SQL in the dialect ``d`` over the rows of ``scope``."""
    ev, res, rev, jobs = (scoped(v, scope) for v in ("lead_events", "lead_results", "lead_reviews", "jobs"))
    now = "(SELECT max(ts) FROM lead_events)"
    day = "(SELECT max(updated_at) FROM lead_results)"
    model = "stage = 'stage2_ocr_classify' AND model_ms IS NOT NULL AND model_ms > 0"
    errors = "stage = 'stage2_ocr_classify' AND coalesce(model_error, '') <> ''"
    pct = lambda n, of, places=1: f"round(cast(100 as double) * {n} / nullif({of}, 0), {places})"
    n_if = lambda x: f"count(*) FILTER (WHERE {x})"
    filled = lambda f: f"coalesce({d.js('extracted', f)}, '') <> ''"
    failed = f"coalesce({d.list('outcome', 'failed_fields')}, {d.list('outcome', 'verification.failed_fields')})"
    latest = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY id DESC) AS rn FROM {rev} r) x WHERE rn = 1)"
    minute = f"cast(floor({d.epoch('ts')} / 60) * 60 as bigint)"
    five = f"cast(floor({d.epoch('ts')} / 300) * 300 as bigint)"
    qs = lambda x: f"{d.pctl(x, 0.5)} AS p50, {d.pctl(x, 0.95)} AS p95"
    fields = (("amount", "amount"), ("date", "date"), ("receiver", "receiver_name"), ("lan", "loan_account_number"))
    names = lambda xs: "(SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in xs) + ") AS t(lender))"
    issue = f"lower(coalesce({d.js('outcome', 'describes')}, ''))"
    bucket = f"""CASE WHEN {d.js('outcome', 'stage_failed')} = 'image_qc' THEN 'Quality discarded' WHEN {issue} LIKE '%no image source provided%' THEN 'No image URL'
 WHEN {issue} LIKE '%file not found%' THEN 'File not found' WHEN {issue} LIKE '%access denied%' THEN 'Private / access denied'
 WHEN {issue} LIKE '%returned a web page%' OR {issue} LIKE '%returned an error response%' OR {issue} LIKE '%expired%' THEN 'Private / expired link'
 WHEN {issue} LIKE '%could not download%' THEN CASE WHEN {issue} LIKE '%timeout%' THEN 'Download timeout' ELSE 'Download failed' END
 WHEN {issue} LIKE '%empty image payload%' THEN 'Empty file' WHEN {issue} LIKE '%unreadable/corrupt%' OR {issue} LIKE '%could not read image source%' THEN 'Corrupt / unreadable' ELSE 'Other loading issue' END"""
    candidates = f"""(SELECT lead_id, lender, {d.js('extracted', 'receiver_name')} AS receiver, {failed} AS f FROM {res} r WHERE verification_status = 'unverified'
 AND {d.has(d.list('outcome', 'failed_fields'), "'receiver'")} AND coalesce({d.js('outcome', 'flag')}, '') <> 'different_loan_account_same_lead_code' AND {filled('receiver_name')})"""
    queue = f"""(SELECT lender, trim(regexp_replace(lower(receiver), '[^a-z0-9 ]+', ' '{", 'g'" if d is DUCKDB else ""})) AS receiver_norm, {d.first('receiver', 'lead_id')} AS receiver, count(*) AS n,
 {n_if(f"{d.join('f')} = 'receiver'")} AS ready FROM {candidates} c GROUP BY 1, 2)"""
    detail = lambda cols, src, where, order, limit=300: f"SELECT {cols} FROM {src} t WHERE {where} ORDER BY {order} LIMIT {limit}"
    total = "sum(n) OVER ()"
    out = {
        "a1_status_counts": f"SELECT verification_status AS s, count(*) AS n FROM {res} r GROUP BY 1 UNION ALL SELECT 'total' AS s, count(*) AS n FROM {res} r",
        "a2_method_counts": f"SELECT coalesce(nullif(payment_method, ''), 'Non-document') AS method, count(*) AS n FROM {res} r WHERE verification_status <> 'unprocessed' GROUP BY 1",
        "a3_test_count": "SELECT count(*) AS n FROM lead_results WHERE is_test",
        "a4_issue_counts": f"SELECT {bucket} AS issue, count(*) AS n FROM {res} r WHERE verification_status = 'unprocessed' GROUP BY 1",
        "a5_batch_progress": f"""SELECT batch_id, count(*) AS total, {n_if("status = 'pending'")} AS pending, {n_if("status = 'in_progress'")} AS in_progress, {n_if("status = 'done'")} AS done, {n_if("status = 'failed'")} AS failed,
 {n_if("status = 'done' AND verification_status = 'verified'")} AS verified, {n_if("status = 'done' AND verification_status = 'unverified'")} AS unverified FROM jobs GROUP BY batch_id""",
        "a6_open_work": "SELECT count(*) AS n FROM jobs WHERE status IN ('pending', 'in_progress')",
        "a7_model_latency": f"SELECT count(*) AS n, {qs('model_ms')}, {d.pctl('model_ms', 0.99)} AS p99, round(avg(model_ms), 6) AS avg, max(model_ms) AS max FROM {ev} e WHERE {model}",
        "a8_latency_series": f"SELECT {minute} AS minute, min({d.time('ts', 'HH:mm')}) AS t, count(*) AS n, {qs('model_ms')} FROM {ev} e WHERE {model} AND ts > {now} - INTERVAL 2880 MINUTES GROUP BY 1",
        "a9_throughput": f"SELECT {minute} AS minute, min({d.time('ts', 'HH:mm')}) AS t, count(*) AS n FROM {ev} e WHERE stage = 'lead_closed' AND ts > {now} - INTERVAL 2880 MINUTES GROUP BY 1",
        "a10_stage_timings": f"SELECT stage, count(*) AS n, round(avg(ms), 6) AS avg_ms, {d.pctl('ms', 0.95)} AS p95_ms FROM {ev} e WHERE ms IS NOT NULL GROUP BY stage",
        "a11_queue": f"SELECT {n_if('attempts > 1')} AS retried, {n_if(chr(39).join(['status = ', 'failed', '']))} AS failed, {n_if(chr(39).join(['status = ', 'done', '']))} AS done, round(coalesce(avg(cast(attempts as double)), 0), 9) AS avg_attempts, count(*) AS total FROM {jobs} j",
        "a12_cache": f"SELECT {n_if(chr(39).join(['cache = ', 'hit', '']))} AS served_from_cache, count(*) AS stage2_total, {pct(n_if(chr(39).join(['cache = ', 'hit', ''])), 'count(*)')} AS hit_rate_pct FROM {ev} e WHERE stage = 'stage2_ocr_classify'",
        "a12_cache_entries": "SELECT count(*) AS entries, cast(coalesce(sum(hits), 0) as bigint) AS hits FROM ocr_cache",
        "a13_model_errors": f"SELECT count(*) AS n FROM {ev} e WHERE {errors}",
        "a13_failed_jobs": f"SELECT coalesce(nullif(last_error, ''), '(no message)') AS err, count(*) AS n FROM {jobs} j WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, err LIMIT 8",
        "a14_unverified_reasons": f"SELECT f AS field, count(*) AS n FROM (SELECT {d.each(failed)} AS f FROM {res} r WHERE verification_status = 'unverified') x GROUP BY 1",
        "a15_lender_funnel": "SELECT lender, count(*) AS total, " + ", ".join(f"""{n_if(f"verification_status = '{s}'")} AS {s}""" for s in ("verified", "unverified", "duplicate", "non_document", "unprocessed"))
        + f" FROM {res} r WHERE coalesce(lender, '') <> '' GROUP BY lender ORDER BY total DESC, lender LIMIT 40",
        "a16_fillrates": "SELECT count(*) AS n, " + ", ".join(f"{n_if(filled(c))} AS {n}" for n, c in fields) + f" FROM {res} r WHERE verification_status IN ('verified', 'unverified')",
        "a17_fillrate_series": f"SELECT cast(cast(updated_at as date) as string) AS day, min({d.time('updated_at', 'MM-dd')}) AS t, count(*) AS n, " + ", ".join(f"cast({pct(n_if(filled(c)), 'count(*)', 0)} as int) AS {n}" for n, c in fields)
        + f" FROM {res} r WHERE verification_status IN ('verified', 'unverified') AND updated_at > {day} - INTERVAL 14 DAYS GROUP BY 1",
        "a18_config_coverage": f"""SELECT x.lender, x.n, v.lender IS NOT NULL AS receiver_list, u.lender IS NOT NULL AS explicit_rule FROM (SELECT lender, count(*) AS n FROM {res} r WHERE coalesce(lender, '') <> '' GROUP BY lender) x
 LEFT JOIN {names(RULES)} u ON u.lender = x.lender LEFT JOIN {names(RECEIVERS)} v ON v.lender = x.lender WHERE u.lender IS NULL OR v.lender IS NULL""",
        "a19_latest_reviews": f"SELECT lead_id, id, system_status, decision, corrected_status FROM {latest} l",
        "a20_review_accuracy": f"""SELECT reviewed, confirmed, overturned, verified_reviewed, verified_overturned, unverified_reviewed, unverified_overturned, total_results, {pct('reviewed', 'total_results')} AS coverage_pct, {pct('confirmed', 'reviewed')} AS agreement_pct,
 {pct('(verified_reviewed - verified_overturned)', 'verified_reviewed')} AS verified_precision_pct, {pct('unverified_overturned', 'unverified_reviewed')} AS unverified_overturn_pct FROM (SELECT count(*) AS reviewed, {n_if("decision = 'confirmed'")} AS confirmed, {n_if("decision = 'overturned'")} AS overturned,
 {n_if("system_status = 'verified'")} AS verified_reviewed, {n_if("system_status = 'verified' AND decision = 'overturned'")} AS verified_overturned, {n_if("system_status = 'unverified'")} AS unverified_reviewed, {n_if("system_status = 'unverified' AND decision = 'overturned'")} AS unverified_overturned FROM {latest} l) x
 CROSS JOIN (SELECT count(*) AS total_results FROM {res} r) y""",
        "a21_confusion": f"SELECT system_status, corrected_status, count(*) AS n FROM {latest} l WHERE decision = 'overturned' AND corrected_status IS NOT NULL GROUP BY 1, 2",
        "a22_accuracy_series": f"SELECT {d.time('ts', 'MM-dd')} AS t, count(*) AS reviewed, {n_if(chr(39).join(['decision = ', 'confirmed', '']))} AS confirmed, {pct(n_if(chr(39).join(['decision = ', 'confirmed', ''])), 'count(*)')} AS agreement_pct FROM {latest} l WHERE ts > (SELECT max(ts) FROM lead_reviews) - INTERVAL 14 DAYS GROUP BY 1",
        "a23_model_errors": detail(f"lead_id, {d.left('model_error', 180)} AS error, {d.time('ts', 'yyyy-MM-dd HH:mm')} AS at", ev, errors, "ts DESC, id", 200),
        "a23_failed_jobs": detail(f"job_id AS lead_id, {d.left(chr(39).join(['coalesce(last_error, ', '', ')']), 180)} AS error, attempts", jobs, "status = 'failed'", "created_at DESC, job_id", 200),
        "a23_missing_field": detail("lead_id, lender, verification_status AS status", res, f"verification_status IN ('verified', 'unverified') AND NOT ({filled('receiver_name')})", "updated_at DESC, lead_id"),
        "a23_unverified_field": detail("lead_id, lender", res, f"verification_status = 'unverified' AND {d.has(failed, chr(39) + 'amount' + chr(39))}", "updated_at DESC, lead_id"),
        "a23_lender": detail("lead_id, verification_status AS status, coalesce(payment_method, '') AS method", res, "lender = 'SMFG_PL'", "updated_at DESC, lead_id"),
        "a23_overturned_verified": detail(f"lead_id, corrected_status, reviewer, {d.left('note', 120)} AS note", latest, "system_status = 'verified' AND decision = 'overturned'", "ts DESC, id"),
        "a23_overturned": detail("lead_id, system_status, corrected_status, reviewer", latest, "decision = 'overturned'", "ts DESC, id"),
        "a23_unreviewed": detail("lead_id, lender, verification_status AS status", res, f"verification_status IN ('verified', 'unverified') AND NOT EXISTS (SELECT 1 FROM {rev} v WHERE v.lead_id = t.lead_id)", "updated_at DESC, lead_id"),
        "a25_approval_queue": f"SELECT lender, receiver_norm, receiver, n, ready FROM {queue} q",
        "a26_recent_decisions": f"SELECT id, lead_id, decision, reviewer FROM {rev} r ORDER BY id DESC LIMIT 30",
        "a28_facets": f"SELECT coalesce(nullif(payment_method, ''), '—') AS value, count(*) AS n FROM {res} r GROUP BY 1",
        "a29_kpi": f"SELECT s, n, {pct('n', total)} AS share FROM (SELECT verification_status AS s, count(*) AS n FROM {res} r GROUP BY 1) x",
        "a29_top_methods": f"SELECT coalesce(nullif(payment_method, ''), 'Non-document') AS method, count(*) AS n FROM {res} r WHERE verification_status <> 'unprocessed' GROUP BY 1 ORDER BY n DESC, method LIMIT 8",
        "a30_leads_per_minute": f"SELECT round(avg(cast(n as double)), 9) AS per_minute FROM (SELECT {minute} AS m, count(*) AS n FROM {ev} e WHERE stage = 'lead_closed' GROUP BY 1 ORDER BY m DESC LIMIT 5) x",
        "a31_verified_rate": f"""SELECT lender, {pct(n_if("verification_status = 'verified'"), 'count(*)', 0)} AS verified_pct FROM {res} r WHERE coalesce(lender, '') <> '' GROUP BY lender""",
        "a32_trend": f"""SELECT CASE WHEN delta > 2 THEN 'up' WHEN delta < -2 THEN 'down' ELSE 'flat' END AS trend, delta FROM (SELECT {d.last('v', 'day')} - {d.first('v', 'day')} AS delta FROM
 (SELECT cast(updated_at as date) AS day, {pct(n_if(filled('date')), 'count(*)', 0)} AS v FROM {res} r GROUP BY 1) x) y""",
        "a33_approval_totals": f"SELECT lender, cast(sum(n) as bigint) AS leads, cast(sum(ready) as bigint) AS ready FROM {queue} q GROUP BY lender UNION ALL SELECT '' AS lender, cast(sum(n) as bigint) AS leads, cast(sum(ready) as bigint) AS ready FROM {queue} q",
        "a34_batch_finished": f"""SELECT batch_id, {pct(n_if("status IN ('done', 'failed')"), 'count(*)')} AS finished_pct FROM jobs GROUP BY batch_id""",
        "a35_fail_reasons": "SELECT stage, reason, count(*) AS n FROM lead_events WHERE status = 'FAIL' AND stage IN ('stage1_image_qc', 'stage2_ocr_classify') GROUP BY 1, 2",
        "a35_verdict_rollup": "SELECT verdict, count(*) AS n FROM lead_events WHERE stage = 'stage4_verify' GROUP BY 1",
        "a35_lender_reasons": f"SELECT lender, {d.js('outcome', 'reason')} AS why, count(*) AS n FROM lead_results WHERE verification_status = 'unverified' GROUP BY 1, 2",
        "a36_stuck_leases": f"SELECT job_id FROM jobs WHERE status = 'in_progress' AND lease_until < {day} - INTERVAL 30 DAYS",
        "a36_quarantine_reasons": "SELECT reason, count(*) AS n FROM ingest_quarantine WHERE NOT resolved GROUP BY reason",
        "a36_run_health": "SELECT id, source, ok, error, rows_seen, images_prefetched, prefetch_failed FROM ingest_runs ORDER BY id DESC LIMIT 20",
        "a36_last_run": "SELECT source, max(started_at) AS started_at, cast(sum(images_prefetched) as bigint) AS images_prefetched, cast(sum(prefetch_failed) as bigint) AS prefetch_failed FROM ingest_runs GROUP BY source",
        "a36_blob_totals": "SELECT count(*) AS blobs, cast(sum(bytes) as bigint) AS bytes FROM image_blobs",
        "a37_counts": f"""SELECT {n_if("status = 'pending'")} AS pending, {n_if("status = 'in_progress'")} AS in_progress, {n_if("status = 'failed'")} AS failed FROM jobs""",
        "a37_latency": f"SELECT {minute} AS minute, {qs('ms')}, {d.pctl('ms', 0.99)} AS p99 FROM lead_events WHERE stage = 'stage2_ocr_classify' AND ms IS NOT NULL GROUP BY 1",
        "a37_closed": f"SELECT {minute} AS minute, count(*) AS leads_closed FROM lead_events WHERE stage = 'lead_closed' GROUP BY 1",
        "a37_errors": f"SELECT {five} AS bucket, count(*) AS model_errors FROM lead_events WHERE {errors} GROUP BY 1",
        "a37_outcomes": f"SELECT {five} AS bucket, " + ", ".join(f"""{n_if(f"verdict = '{s}'")} AS {s}""" for s in ("verified", "unverified", "non_document", "duplicate")) + " FROM lead_events WHERE stage = 'lead_closed' GROUP BY 1",
        "a37_time_per_stage": f"SELECT stage, count(*) AS n, round(avg(ms)) AS avg_ms, round({d.pctl('ms', 0.95)}) AS p95_ms FROM lead_events WHERE ms IS NOT NULL GROUP BY stage",
        "a37_truncated": f"SELECT {five} AS bucket, count(*) AS truncated FROM lead_events WHERE stage = 'stage2_ocr_classify' AND finish_reason = 'length' GROUP BY 1",
        "a37_http_status": "SELECT coalesce(http_status, '(none)') AS http_status, count(*) AS n FROM lead_events WHERE stage = 'stage2_ocr_classify' GROUP BY 1",
        "a38_alerts": f"""SELECT errors > 0 AS errors_firing, coalesce(p95, 0) > 60000 AS latency_firing, truncated > 0 AS truncation_firing, errors, truncated FROM (SELECT
 {n_if(f"{errors} AND ts > {now} - INTERVAL 10 MINUTES")} AS errors, {d.pctl(f"CASE WHEN stage = 'stage2_ocr_classify' AND ts > {now} - INTERVAL 10 MINUTES THEN ms END", 0.95)} AS p95,
 {n_if(f"stage = 'stage2_ocr_classify' AND finish_reason = 'length' AND ts > {now} - INTERVAL 15 MINUTES")} AS truncated FROM lead_events) x""",
        "j1_batch_leads": "SELECT j.lead_id, j.status AS job_status, coalesce(r.verification_status, j.verification_status) AS verification_status, r.payment_method FROM jobs j LEFT JOIN lead_results r ON r.lead_id = j.lead_id WHERE j.batch_id = 'batch-1'",
        "j3_ledger_backfill": "SELECT j.lead_id FROM jobs j JOIN lead_results r ON r.lead_id = j.lead_id WHERE NOT j.is_test AND NOT r.is_test",
        "j4_unreviewed": "SELECT lead_id FROM lead_results r WHERE NOT EXISTS (SELECT 1 FROM lead_reviews v WHERE v.lead_id = r.lead_id) AND verification_status IN ('verified', 'unverified')",
        "j5_orphan_reviews": "SELECT id FROM lead_reviews v WHERE NOT EXISTS (SELECT 1 FROM lead_results r WHERE r.lead_id = v.lead_id)",
        "j7_failed_fields": f"SELECT lead_id, {d.each(failed)} AS field FROM lead_results WHERE verification_status = 'unverified'",
        "j10_delete_cascade": "SELECT e.id FROM lead_events e WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.lead_id = e.lead_id AND j.is_test AND j.batch_id = 'batch-1')",
        "k9_results_view": f"""SELECT lead_id, lender, verification_status, {d.js('outcome', 'reason')} AS reason, CASE WHEN verification_status = 'unprocessed' THEN {d.js('outcome', 'describes')} END AS unprocessed_issue,
 payment_method, {d.js('extracted', 'amount')} AS doc_amount, {d.js('extracted', 'date')} AS doc_date, {d.js('extracted', 'receiver_name')} AS doc_receiver FROM (SELECT * FROM lead_results WHERE NOT is_test) r""",
        "p13_outcome_text": f"""SELECT lead_id, CASE WHEN verification_status = 'verified' THEN 'Verified fields: ' || coalesce({d.join(d.list('outcome', 'verified_fields'))}, '') WHEN verification_status IN ('unverified', 'duplicate') THEN coalesce({d.js('outcome', 'reason')}, verification_status)
 WHEN verification_status = 'unprocessed' THEN coalesce({d.js('outcome', 'describes')}, 'image never reached OCR') ELSE coalesce({d.js('outcome', 'describes')}, 'not a valid payment document') END AS outcome FROM lead_results""",
        "p14_result_filter": f"SELECT lead_id, lender, payment_method FROM {res} r WHERE verification_status = 'verified' AND (lead_id ILIKE '%LEAD-1%' OR lender ILIKE '%LEAD-1%' OR payment_method ILIKE '%LEAD-1%') ORDER BY updated_at DESC, lead_id LIMIT 300 OFFSET 10",
        "p15_multi_select": f"SELECT lead_id FROM {res} r WHERE coalesce(nullif(payment_method, ''), '—') IN ('—', 'PhonePe') AND coalesce(nullif(lender, ''), '—') IN ('SMFG_PL', 'JANA_SF')",
        "k6_export_order": f"SELECT lead_id, verification_status, CASE verification_status WHEN 'unverified' THEN 0 WHEN 'unprocessed' THEN 1 WHEN 'non_document' THEN 2 WHEN 'duplicate' THEN 3 WHEN 'verified' THEN 4 ELSE -1 END AS place FROM {res} r",
        "s4_fetch_since": "SELECT lead_id, seq FROM leads WHERE seq >= 1000 ORDER BY seq, lead_id LIMIT 500",
        "s12_journey": "SELECT id, stage, status FROM lead_events WHERE lead_id = 'LEAD-7' ORDER BY id",
        "w3_runs": "SELECT id, lead_id, greatest(sum(CASE WHEN stage = 'lead_received' THEN 1 ELSE 0 END) OVER (PARTITION BY lead_id ORDER BY id), 1) AS run FROM lead_events",
        "q7_events_kept": f"SELECT id FROM lead_events WHERE ts >= {now} - INTERVAL 7 DAYS",
    }
    out["w3_runs"] = out["w3_runs"].replace("greatest(sum", "greatest(cast(sum").replace("ORDER BY id), 1)", "ORDER BY id) as bigint), 1)")
    return out


#: What the dashboard asks for at once.
SNAPSHOT = (
    "a7_model_latency", "a8_latency_series", "a9_throughput", "a10_stage_timings", "a11_queue", "a13_model_errors", "a12_cache", "a14_unverified_reasons",
    "a15_lender_funnel", "a16_fillrates", "a17_fillrate_series", "a18_config_coverage", "a20_review_accuracy", "a22_accuracy_series", "a21_confusion",
)


def model_latency(events: DataFrame) -> DataFrame:
    """One row: count, percentiles, mean and maximum of the model's time; the percentiles by selection, as the events may be any number."""
    rows = events.where("stage = 'stage2_ocr_classify' AND model_ms > 0")
    whole = rows.agg(F.count("*").alias("n"), F.round(F.avg("model_ms"), 6).alias("avg"), F.max("model_ms").alias("max"))
    return whole.join(quantiles(rows, [], "model_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), F.lit(True), "left").select("n", "p50", "p95", "p99", "avg", "max")


def stage_timings(events: DataFrame) -> DataFrame:
    """``stage, n, avg_ms, p95_ms``: a stage may hold a third of all events, so its percentile is selected, not gathered."""
    rows = events.where("ms IS NOT NULL")
    by = rows.groupBy(F.col("stage").alias("s")).agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"))
    found = quantiles(rows, ["stage"], "ms", {"p95_ms": 0.95})
    return by.join(found, F.col("s").eqNullSafe(F.col("stage"))).select("stage", "n", "avg_ms", "p95_ms")
