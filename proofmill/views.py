"""Lead tables derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LENDER = """CASE cast({k} % 8 as int) WHEN 0 THEN 'SMFG_PL' WHEN 1 THEN 'HDBFS_PL' WHEN 2 THEN 'JANA_SF' WHEN 3 THEN 'KHATABOOK'
 WHEN 4 THEN 'BAJAJ_AUTO' WHEN 5 THEN 'MONEYVIEW' WHEN 6 THEN 'ZZTEST_CORP' ELSE '' END"""

#: Texts of documents: every payment marker, method, phrase of money coming in or going out, handles and look-alikes.
TEXTS = (
    "qwerty keyboard", "", "lunch menu for today", "Paid to zztest corp successfully", "Rs credited to your account", "payment successful PhonePe UTR",
    "bill paid", "order successful", "payment receipt", "amount paid", "txn 4411", "UTR 88", "rrn 77", "reference kept", "receipt no 5", "receipt number 6", "debited today",
    "credited today", "transaction id 9", "paid to a shop", "payment of bills", "amount shown", "Rs. 40", "INR 40", "₹ 40", "no dues left", "no due left", "no objection letter", "NOC issued",
    "fully paid", "loan closed", "loan closure", "account closed", "closure note", "foreclosure note", "settled in full", "no outstanding sum", "outstanding is nil", "cleared at last", "fully repaid",
    "phonepe screen", "phon epe screen", "sent from me@ybl", "ppe slip", "Google Pay screen", "gpay screen", "g pay screen", "x1@okaxis done", "x1@oksbi done", "x1@okhdfcbank done", "x1@okicici done",
    "paytm screen", "x1@paytm done", "ptm slip", "Amazon Pay screen", "amazonpay screen", "BHIM screen", "x1@upi done", "cred club", "Bharat Connect bill", "bbps bill", "bharatbillpay bill",
    "NEFT advice", "imps advice", "rtgs advice", "fund transfer advice", "cash receipt kept", "mode of payment : cash", "mode of payment cash", "paid by cash", "cheque leaf", "chq no 12",
    "e-nach form", "enach form", "e nach form", "auto debit form", "mandate form",
    "credited to your a/c", "credited to your acc", "credited in your account", "credited to your savings", "credited to your bank", "amount credited to your card", "received in your account", "has been credited to your card",
    "credited to your account and debited from mine", "credited to your account by debit", "credited to your account, you paid", "credited to your account, you have paid", "credited to your account as payment to x",
    "credited to your account, sent to y", "credited to your account, transferred to y", "credited to your account, paid successfully", "credited to your account, paid rs 5", "credited to your account, paid inr 5",
    "utr 1 smfgindia@icici ok", "utr 1 hdbfin@ybl ok", "utr 1 hdbx@ybl ok", "utr 1 janabank1@sbi ok", "utr 1 zztestcorp@upi ok", "utr 1 zztes@upi ok", "utr 1 bajaj.auto@axl ok", "utr 1 care@bajaj.co.in ok",
    "utr 1 khatabook9@ok ok", "utr 1 xkhatabook@ok ok", "utr 1 moneyview-pay@hdfc ok", "HDB Financial Services Limited received it", "zztest corporation", "Jana Small Finance Bank, thank you", "xkhatabook app",
)
KINDS = ("", "PhonePe screenshot", "gpay slip", "Google page", "paytm page", "cash slip", "neft slip", "imps slip", "rtgs slip", "cheque slip", "other")
RECEIVERS = ("", "SMFG India Credit", "HDB Fin Services", "Ram Financial Services", "ZZTst Corp", "Khatabook", "Kathabook Ltd", "Bajaj Auto", "Smfg", "a", "Paytm Payments", "Whizdm")


def pick(n: str, values: tuple[str, ...]) -> str:
    """SQL for the value at place ``n`` (counted round) of ``values``."""
    return f"CASE cast(({n}) % {len(values)} as int) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def written(d: str, n: str) -> str:
    """SQL for the date ``d`` in the form at place ``n`` (counted round) of those that people write."""
    t = f"cast({d} as string)"
    y, m, dd = f"substr({t}, 1, 4)", f"substr({t}, 6, 2)", f"substr({t}, 9, 2)"
    name = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast({m} as int) - 2, 3)"
    forms = (
        t, f"{dd} || '/' || {m} || '/' || {y}", f"{y} || '/' || {m} || '/' || {dd}", f"{dd} || '/' || {m} || '/' || substr({y}, 3, 2)", f"{dd} || ' ' || {name} || ' ' || {y}",
        f"{name} || ' ' || {dd} || ', ' || {y} || ' 10:30 AM'", f"{dd} || '/' || {m} || '/' || {y} || ' 10:20'", f"{y} || {m} || {dd}", f"{t} || 'T10:20:30'", f"{dd} || '-' || {name} || '-' || substr({y}, 3, 2)",
        f"{dd} || '.' || {m} || '.' || {y}",
    )
    return f"CASE cast(({n}) % {len(forms)} as int) " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


VIEWS = {
    "leads": f"""
WITH b AS (SELECT o_orderkey AS k, o_custkey AS ck, cast(o_orderdate as date) AS pd, cast(o_totalprice as decimal(14,2)) AS amt FROM orders),
u AS (SELECT k, ck, pd, amt, 0 AS r FROM b UNION ALL SELECT k, ck, pd, amt, 1 AS r FROM b WHERE k % 13 = 0)
SELECT CASE WHEN r = 0 THEN 'LEAD-' ELSE 'LEAD-R' END || cast(k as string) AS lead_id,
 cast(k + r * 1000000000 as bigint) AS seq, (k % 10 = 9) AS is_test, {_LENDER.format(k="k")} AS institute_name,
 CASE WHEN k % 29 = 0 THEN '' ELSE ' LC' || cast(ck as string) || ' ' END AS lead_code,
 CASE WHEN k % 11 = 0 THEN 'lx-' ELSE 'ln-' END || lpad(cast(ck as string), 9, '0') AS loan_account_number,
 CASE WHEN k % 31 = 0 THEN 'abc' WHEN k % 3 = 0 THEN 'Rs. ' || cast(amt as string) ELSE cast(amt as string) END AS payment_amount,
 CASE WHEN k % 37 = 0 THEN 'nope' WHEN k % 41 = 0 THEN '' ELSE {written('pd', 'k')} END AS payment_date
FROM u""",
    "extractions": f"""
WITH b AS (SELECT o_orderkey AS k, o_custkey AS ck, cast(o_orderdate as date) AS pd, cast(o_totalprice as decimal(14,2)) AS amt FROM orders),
x AS (SELECT k, ck, amt, pd + cast(CASE cast(k % 6 as int) WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 8 ELSE 0 END as int) AS dd, cast(floor(k / 8) as bigint) AS j FROM b)
SELECT 'LEAD-' || cast(k as string) AS lead_id,
 CASE cast(k % 7 as int) WHEN 0 THEN NULL WHEN 1 THEN cast(cast(amt + 1.00 as decimal(14,2)) as string) WHEN 2 THEN cast(cast(amt + 100.00 as decimal(14,2)) as string) ELSE cast(amt as string) END AS amount,
 CASE WHEN k % 43 = 0 THEN NULL WHEN k % 47 = 0 THEN 'soon' ELSE {written('dd', 'j')} END AS doc_date,
 {pick('j + k % 5', RECEIVERS)} AS receiver_name,
 CASE WHEN k % 9 = 0 THEN NULL ELSE 'LN ' || lpad(cast(ck as string), 9, '0') END AS loan_account_number,
 {pick('j', TEXTS)} AS full_text, {pick('k', KINDS)} AS document_type
FROM x""",
    "lead_events": """
SELECT event_id AS id, 'LEAD-' || cast(user_id as string) AS lead_id, cast(ts as timestamp) AS ts, (event_id % 10 = 9) AS is_test,
 CASE event_type WHEN 'signup' THEN 'lead_received' WHEN 'view' THEN 'stage1_image_qc' WHEN 'error' THEN 'stage2_ocr_classify' WHEN 'click' THEN 'stage4_verify' ELSE 'lead_closed' END AS stage,
 CASE WHEN event_id % 6 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, value AS ms,
 CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN value END AS model_ms,
 CASE WHEN event_type = 'error' AND event_id % 20 = 5 THEN 'Timeout' ELSE '' END AS model_error,
 CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'hit' WHEN event_type = 'error' THEN 'miss' END AS cache,
 CASE WHEN event_type = 'error' AND event_id % 9 = 4 THEN 'length' ELSE 'stop' END AS finish_reason,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 3 THEN '500' WHEN event_id % 7 = 5 THEN NULL ELSE '200' END END AS http_status,
 CASE cast(event_id % 4 as int) WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'non_document' ELSE 'duplicate' END AS verdict,
 'reason ' || cast(event_id % 5 as string) AS reason
FROM events""",
    "lead_reviews": """
WITH r AS (SELECT doc_id AS id, doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id + 1000000 AS id, doc_id, quality, 1 - toxic AS toxic FROM labels WHERE doc_id % 4 = 0)
SELECT id, 'LEAD-' || cast(doc_id as string) AS lead_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'unverified' END AS system_status,
 CASE WHEN toxic = 1 THEN 'overturned' ELSE 'confirmed' END AS decision,
 CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'unverified' ELSE 'verified' END ELSE CASE WHEN quality = 1 THEN 'verified' ELSE 'unverified' END END AS corrected_status,
 cast(date '2024-01-01' + cast(doc_id % 30 as int) as timestamp) AS ts, (doc_id % 10 = 9) AS is_test, 'r' || cast(doc_id % 3 as string) AS reviewer, 'note ' || cast(id as string) AS note FROM r""",
    "lead_results": f"""
SELECT 'LEAD-' || cast(o_orderkey as string) AS lead_id, (o_orderkey % 10 = 9) AS is_test, {_LENDER.format(k="o_orderkey")} AS lender,
 CASE WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'O' THEN 'unverified' WHEN o_orderkey % 3 = 0 THEN 'duplicate' WHEN o_orderkey % 3 = 1 THEN 'non_document' ELSE 'unprocessed' END AS verification_status,
 CASE cast(o_orderkey % 4 as int) WHEN 0 THEN 'PhonePe' WHEN 1 THEN 'Google Pay' WHEN 2 THEN 'Other' ELSE '' END AS payment_method,
 CASE WHEN o_orderstatus = 'P' THEN CASE cast(o_orderkey % 5 as int) WHEN 0 THEN '{{"describes":"could not download image (ReadTimeout)"}}' WHEN 1 THEN '{{"describes":"no image source provided"}}'
   WHEN 2 THEN '{{"stage_failed":"image_qc","describes":"blurry"}}' ELSE '{{"describes":"image URL returned a web page"}}' END
  WHEN o_orderstatus <> 'O' THEN '{{"verified_fields":["date","amount","receiver"]}}' WHEN o_orderkey % 3 = 0 THEN '{{"failed_fields":["receiver"],"reason":"receiver: no"}}'
  WHEN o_orderkey % 3 = 1 THEN '{{"failed_fields":["amount","receiver"],"reason":"amount: no"}}'
  ELSE '{{"flag":"different_loan_account_same_lead_code","verification":{{"failed_fields":["date"]}}}}' END AS outcome,
 CASE WHEN o_orderkey % 7 = 0 THEN '{{"amount":""}}' ELSE '{{"amount":"5000","date":"2024-01-05","receiver_name":"Speedo Finance"}}' END AS extracted,
 cast(o_orderdate as timestamp) AS updated_at FROM orders""",
    "jobs": f"""
SELECT 'LEAD-' || cast(o_orderkey as string) AS job_id, 'LEAD-' || cast(o_orderkey as string) AS lead_id, 'batch-' || cast(o_custkey % 4 as string) AS batch_id, {_LENDER.format(k="o_orderkey")} AS lender,
 CASE WHEN o_orderkey % 10 < 6 THEN 'done' WHEN o_orderkey % 10 = 6 THEN 'in_progress' WHEN o_orderkey % 10 = 7 THEN 'failed' ELSE 'pending' END AS status,
 CASE WHEN o_orderkey % 10 < 4 THEN 'verified' WHEN o_orderkey % 10 < 6 THEN 'unverified' END AS verification_status,
 cast(o_orderkey % 4 as int) AS attempts, 3 AS max_attempts, CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 5 END AS priority, (o_custkey % 10 = 9) AS is_test,
 CASE WHEN o_orderkey % 10 = 7 THEN 'error ' || cast(o_custkey % 5 as string) END AS last_error,
 CASE WHEN o_orderkey % 5 = 0 THEN 'blob:' || cast(o_custkey as string) ELSE 'https://x.example/' || cast(o_orderkey as string) || '.png' END AS image_url,
 cast(o_orderdate as timestamp) AS created_at, cast(o_orderdate as timestamp) AS lease_until FROM orders""",
    "ocr_cache": """
SELECT sha2(cast(c_custkey as string), 256) || ':m' || cast(c_custkey % 3 as string) || ':v2' AS cache_key, '{"amount":"' || cast(c_custkey as string) || '"}' AS extraction, 'm' || cast(c_custkey % 3 as string) AS model,
 cast(c_custkey % 5 as bigint) AS hits FROM customer WHERE c_custkey % 2 = 0""",
    "image_blobs": """
SELECT sha2(cast(c_custkey as string), 256) AS sha256, cast(1000 + c_custkey % 700 as bigint) AS bytes FROM customer""",
    "ingest_runs": """
SELECT event_id AS id, 'src-' || cast(user_id % 3 as string) AS source, CASE WHEN event_id % 8 = 0 THEN 'backfill' ELSE 'live' END AS mode, cast(ts as timestamp) AS started_at, cast(user_id % 50 as int) AS rows_seen,
 cast(user_id % 9 as int) AS images_prefetched, cast(event_id % 3 as int) AS prefetch_failed, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'Timeout: ' || cast(user_id % 4 as string) END AS error FROM events""",
    "ingest_quarantine": """
SELECT 'src-' || cast(o_custkey % 3 as string) AS source, 'LEAD-' || cast(o_orderkey as string) AS source_key, '{"k":"' || cast(o_orderkey as string) || '"}' AS source_row, 'reason ' || cast(o_custkey % 6 as string) AS reason,
 cast(o_orderdate as timestamp) AS first_seen, o_orderkey % 4 = 0 AS resolved FROM orders WHERE o_orderkey % 5 = 0""",
    "raw_cells": r"""
SELECT doc_id AS id, CASE cast(doc_id % 12 as int) WHEN 0 THEN 'https://x.example/' || cast(doc_id as string) || '.PNG?sig=1' WHEN 1 THEN 'see https://x.example/a.' WHEN 2 THEN '["https://x.example/b.jpg","c"]' WHEN 3 THEN '["","rel/d.png"]'
 WHEN 4 THEN 'rel/e.png' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'data:image/png;base64,AA' WHEN 8 THEN 'HTTP://x.example/page' WHEN 9 THEN '[]' WHEN 10 THEN 'blob:ab' ELSE '  padded.gif ' END AS payment_document,
 CASE WHEN doc_id % 3 = 0 THEN 'https://y.example/scan.webp#1' ELSE 'no link' END AS note, CASE WHEN doc_id % 5 = 0 THEN 'https://z.example/page' ELSE '' END AS homepage,
 CASE cast(doc_id % 7 as int) WHEN 0 THEN '<Error><Code>AccessDenied</Code>' WHEN 1 THEN '<!DOCTYPE html><p>hi' WHEN 2 THEN '<?xml version="1.0"?>' WHEN 3 THEN 'RIFF' WHEN 4 THEN '' WHEN 5 THEN 'x <HTML> y' ELSE 'request has expired <html>' END AS body,
 CASE WHEN doc_id % 11 = 0 THEN 'text/HTML' WHEN doc_id % 13 = 0 THEN 'application/xml' ELSE 'image/png' END AS content_type,
 CASE cast(doc_id % 6 as int) WHEN 0 THEN 'Sure: {"is_payment_document": true, "amount": "5,000", "date": "null", "full_text": "Paid"} bye' WHEN 1 THEN 'no json here' WHEN 2 THEN '{broken' WHEN 3 THEN '{"is_payment_document": "yes", "document_type": "upi", "receiver_name": "None"}'
  WHEN 4 THEN '{"amount": }' ELSE NULL END AS answer,
 CASE cast(doc_id % 4 as int) WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'no' END AS ex_is_receipt, CASE cast(doc_id % 3 as int) WHEN 0 THEN 'nan' WHEN 1 THEN 'upi' ELSE '' END AS ex_doc_type, CASE cast(doc_id % 5 as int) WHEN 0 THEN 'None' WHEN 1 THEN '100' END AS ex_amount
FROM documents""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(sql: str, among) -> list[str]:
    """Those of the names ``among`` that ``sql`` mentions."""
    return [n for n in among if re.search(rf"\b{n}\b", sql)]


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views over a folder of tables: the tables and lead views that ``sql`` mentions."""
    views = named(sql, VIEWS)
    for n in named(" ".join([sql, *(VIEWS[v] for v in views)]), TABLES):
        read(spark, sf_dir, n).createOrReplaceTempView(n)
    for n in views:
        spark.sql(VIEWS[n]).createOrReplaceTempView(n)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, name)
    return spark.table(name)


def with_views(sql: str) -> str:
    """DuckDB SQL that sees the lead views it names."""
    used = named(sql, VIEWS)
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if not used:
        return body
    head = re.sub(r"sha2\((.+?), 256\)", r"sha256(\1)", head)  # the one function of the views that DuckDB spells differently
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
