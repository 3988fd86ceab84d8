"""Named queries over a folder of tables, and the DuckDB SQL that answers them alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import dates, images, text
from .operators import cache, classify, cursors, dedup, mapping, tables, verify
from .plans import leads, metrics
from .sources.scratch import materialise
from .streaming import alerts
from .views import register, view, with_views

#: Configuration of the queries: rules and receivers of the lenders in the lead views.
RULE = {"mandatory_fields": ["date", "amount", "receiver"], "needs_lan": False, "date_tolerance_days": 3, "amount_tolerance_rupees": 1.0}
RULES = {
    "__default__": RULE, "SMFG_PL": RULE | {"needs_lan": True, "mandatory_fields": ["date", "amount", "receiver", "loan_account_number"]},
    "BAJAJ_AUTO": RULE | {"date_tolerance_days": 7}, "MONEYVIEW": RULE | {"date_tolerance_days": 1},
}
RECEIVERS = {
    "SMFG_PL": ["SMFG India Credit", "SMFG India Credit Company Limited"], "HDBFS_PL": ["HDB Financial Services Limited"],
    "JANA_SF": ["Paytm", "Jana Small Finance Bank"], "KHATABOOK": ["SMFG India Credit Company Limited"], "BAJAJ_AUTO": ["Bajaj Auto Credit Limited", "Bharat Connect"],
    "MONEYVIEW": ["Easebuzz", "Moneyview", "Whizdm Innovations"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = with_views(oracle)
        return f

    return add


def _config(spark: SparkSession) -> DataFrame:
    return verify.lender_table(spark, RULES, RECEIVERS)


_NUM, _NAME, _date, _IDENT, _DEDUP = oracle.NUM, oracle.NAME, oracle.date, oracle.IDENT, oracle.DEDUP
_VERIFIED, _FLAGSHIP = oracle.verified(RULES, RECEIVERS), oracle.flagship(RULES, RECEIVERS)


@query(f"""SELECT lead_id, {_NAME.format(x='institute_name')} AS name, regexp_replace(loan_account_number, '\\D', '', 'g') AS digits, cast({_NUM.format(x='payment_amount')} AS double) AS num,
 cast(cast({_NUM.format(x='payment_amount')} AS decimal(14,2)) AS double) AS amount, upper(regexp_replace(loan_account_number, '[^A-Za-z0-9]', '', 'g')) AS loan, sha1(lead_id) AS sha1, sha256(lead_id) AS sha2,
 regexp_matches(institute_name, '^[A-Za-z_][A-Za-z0-9_.]*$') AS safe, repeat('•', greatest(0, length(loan_account_number) - 4)) || right(loan_account_number, 4) AS redacted FROM leads""")
def f_text(spark, sf):
    """Normalised text, numbers and keys of every lead."""
    c = F.col
    return view(spark, sf, "leads").select(
        "lead_id", text.norm_name(c("institute_name")).alias("name"), text.digits(c("loan_account_number")).alias("digits"), text.num(c("payment_amount")).alias("num"),
        text.amount(c("payment_amount")).cast("double").alias("amount"), text.loan_key(c("loan_account_number")).alias("loan"), F.sha1("lead_id").alias("sha1"), F.sha2("lead_id", 256).alias("sha2"),
        text.safe_identifier(c("institute_name")).alias("safe"), text.redact(c("loan_account_number")).alias("redacted"),
    )


@query(f"SELECT lead_id, cast({_date('payment_date', True)} AS varchar) AS verify_date, strftime({_date('payment_date', False)}, '%Y-%m') AS pay_ym FROM leads")
def f_dates(spark, sf):
    """Dates as the verification rules and as the identity rules read them."""
    c = F.col("payment_date")
    return view(spark, sf, "leads").select("lead_id", dates.parse_date(c).cast("string").alias("verify_date"), dates.pay_month(c).alias("pay_ym"))


@query(f"SELECT doc_id, coalesce({oracle.has('lower(text)', oracle.MARKERS)}, false) AS candidate FROM documents")
def p17_evidence_documents(spark, sf):
    """P17, P18 over long texts: does any marker occur?"""
    return view(spark, sf, "documents").select("doc_id", classify.is_candidate(F.col("text"), {}).alias("candidate"))


@query(f"""SELECT lead_id, {oracle.method('document_type', 'full_text')} AS method, {oracle.incoming('full_text')} AS incoming, {oracle.candidate('full_text', ['amount', 'loan_account_number'])} AS candidate,
 array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(full_text), '{m}') THEN '{m}' END" for m in oracle.MARKERS)}], lambda x: x IS NOT NULL), ',') AS markers,
 CASE WHEN amount IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN loan_account_number IS NOT NULL THEN 1 ELSE 0 END AS n_fields FROM extractions""")
def p16_classify(spark, sf):
    """Payment evidence, method and direction of every extraction."""
    c = F.col
    fields = {"amount": c("amount"), "loan_account_number": c("loan_account_number")}
    return view(spark, sf, "extractions").select(
        "lead_id", classify.payment_method(c("document_type"), c("full_text")).alias("method"), classify.incoming_credit(c("full_text")).alias("incoming"),
        classify.is_candidate(c("full_text"), fields).alias("candidate"), F.array_join(classify.markers(c("full_text")), ",").alias("markers"), F.size(classify.evidence_fields(fields)).alias("n_fields"),
    )


MAPPING = mapping.Mapping({"institute_name": "institute_name", "payment_amount": "payment_amount", "payment_date": "payment_date", "lead_code": "lead_code"}, "seq", "lead_id", "X-", ["institute_name", "payment_amount", "payment_date"])


_REQUIRED = " ".join(f"WHEN NOT {oracle.present(c)} THEN 'missing required field ''{c}'''" for c in ("institute_name", "payment_amount", "payment_date"))


@query(f"""SELECT 'X-' || nullif(trim(id), '') AS lead_id, institute_name, seq, loan_account_number, CASE WHEN trim(id) = '' THEN 'missing lead id (column ''lead_id'')' WHEN seq IS NULL THEN 'missing cursor timestamp (column ''seq'')' {_REQUIRED}
 WHEN {_NUM.format(x='payment_amount')} IS NULL THEN 'payment_amount not numeric: ''' || payment_amount || '''' WHEN {_date('payment_date', False)} IS NULL THEN 'payment_date not parseable: ''' || payment_date || '''' END AS reason
 FROM (SELECT * REPLACE (CASE WHEN seq % 59 <> 0 THEN seq END AS seq), CASE WHEN seq % 53 = 0 THEN ' ' ELSE lead_id END AS id FROM leads) r""")
def p4_mapping(spark, sf):
    """Mapped rows, columns that pass through, and the first reason for quarantine; some rows lack their id or cursor."""
    raw = view(spark, sf, "leads").withColumns({"lead_id": F.when(F.col("seq") % 53 == 0, " ").otherwise(F.col("lead_id")), "seq": F.when(F.col("seq") % 59 != 0, F.col("seq"))})
    return mapping.map_rows(raw, MAPPING).select("lead_id", "institute_name", "seq", "loan_account_number", "reason")


@query("""SELECT job_id, CASE WHEN image_url LIKE 'http%' THEN image_url END AS url, CASE WHEN image_url LIKE 'blob:%' THEN substr(image_url, 6) END AS sha FROM jobs""")
def p8_sources(spark, sf):
    """The link in every image cell."""
    c = F.concat(F.lit('["'), F.col("image_url"), F.lit('"]'))
    return view(spark, sf, "jobs").select("job_id", F.when(text.is_url(mapping.clean_source(c)), mapping.clean_source(c)).alias("url"), text.blob_sha(F.col("image_url")).alias("sha"))


@query(f"SELECT lead_id, dedup, owner FROM {_DEDUP} d")
def w2_dedup(spark, sf):
    """The identity's verdict and owner."""
    return dedup.dedup_verdicts(view(spark, sf, "leads")).select("lead_id", "dedup", "owner")


@query(f"SELECT lead_id, status, failed FROM ({_FLAGSHIP}) f")
def flagship(spark, sf):
    """Identity, evidence and verification of every lead, to its final status."""
    out = leads.process(view(spark, sf, "leads"), view(spark, sf, "extractions"), _config(spark))
    return out.select("lead_id", "status", F.array_join("failed_fields", ",").alias("failed"))


@query(_FLAGSHIP)
def v7_outcomes(spark, sf):
    """Status, reason, flag and the fields that failed and matched."""
    out = leads.process(view(spark, sf, "leads"), view(spark, sf, "extractions"), _config(spark))
    return out.select("lead_id", "status", F.array_join("failed_fields", ",").alias("failed"), F.array_join("matched_fields", ",").alias("matched"), "reason", "flag")


@query(f"SELECT lead_id, gap, delta FROM {_VERIFIED} v WHERE has")
def v8_margins(spark, sf):
    """V8: days and rupees between the system's row and the document."""
    rows = materialise(leads.with_documents(view(spark, sf, "leads"), view(spark, sf, "extractions"), "inner"))
    return verify.verify(rows, _config(spark)).select("lead_id", F.col("date_gap_days").alias("gap"), F.col("amount_delta").alias("delta"))


@query(f"SELECT status, count(*) AS n FROM ({_FLAGSHIP}) f GROUP BY status")
def v14_batch_counts(spark, sf):
    """How many leads end in each status."""
    return flagship(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT stage, s AS status, count(*) AS n FROM (SELECT unnest(stages) AS stage, unnest(sts) AS s FROM (SELECT CASE status WHEN 'duplicate' THEN ['lead_received','stage_dedup','lead_closed'] WHEN 'unprocessed' THEN ['lead_received','stage_dedup','stage0_load_image','lead_closed']
 WHEN 'non_document' THEN ['lead_received','stage_dedup','stage0_load_image','stage2_ocr_classify','lead_closed'] ELSE ['lead_received','stage_dedup','stage0_load_image','stage2_ocr_classify','stage4_verify','lead_closed'] END AS stages,
 CASE status WHEN 'duplicate' THEN ['PASS','FAIL','PASS'] WHEN 'unprocessed' THEN ['PASS','PASS','FAIL','PASS'] WHEN 'non_document' THEN ['PASS','PASS','PASS','FAIL','PASS'] WHEN 'verified' THEN ['PASS','PASS','PASS','PASS','PASS','PASS'] ELSE ['PASS','PASS','PASS','PASS','FAIL','PASS'] END AS sts
 FROM ({_FLAGSHIP}) f) g) h GROUP BY 1, 2""")
def v11_events(spark, sf):
    """Events by stage and status."""
    out = leads.process(view(spark, sf, "leads"), view(spark, sf, "extractions"), _config(spark))
    return leads.events(out).groupBy("stage", "status").agg(F.count("*").alias("n"))


@query(f"""SELECT verification_status AS old, CASE WHEN v.incoming OR v.failed <> '' THEN 'unverified' ELSE 'verified' END AS new, count(*) AS n FROM lead_results r JOIN {_VERIFIED} v ON v.lead_id = r.lead_id
 WHERE v.has AND verification_status IN ('verified', 'unverified') AND coalesce(json_extract_string(outcome, '$.flag'), '') <> 'different_loan_account_same_lead_code' GROUP BY 1, 2""")
def v12_reverify(spark, sf):
    """Moves between the stored verdicts and those of a second run."""
    moves = leads.reverify(view(spark, sf, "lead_results"), view(spark, sf, "leads"), view(spark, sf, "extractions"), _config(spark))
    return moves.groupBy("old", "new").agg(F.count("*").alias("n"))


@query("SELECT job_id, status AS prev_status, attempts + 1 AS attempts FROM jobs WHERE status = 'pending' OR (status = 'in_progress' AND lease_until < (SELECT max(created_at) FROM jobs)) ORDER BY priority, created_at, job_id LIMIT 100")
def q2_claim(spark, sf):
    """Q2, Q4: the next hundred jobs."""
    jobs = view(spark, sf, "jobs")
    now = jobs.agg(F.max("created_at").alias("now"))
    return tables.claim(jobs.crossJoin(F.broadcast(now)), F.col("now"), 100).select("job_id", "prev_status", "attempts")


@query("SELECT job_id, CASE WHEN attempts % 2 = 1 THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN attempts % 2 = 1 THEN 'boom' ELSE last_error END AS last_error FROM jobs")
def q3_fail(spark, sf):
    """Q3: retries and failures."""
    jobs = view(spark, sf, "jobs")
    return tables.fail(jobs, jobs.where("attempts % 2 = 1").select("job_id", F.lit("boom").alias("error"))).select("job_id", "status", "last_error")


@query("SELECT lead_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY seq) AS rn FROM leads) l WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = l.lead_id)")
def q1_enqueue(spark, sf):
    """Q1, K4: leads that enqueueing would add."""
    jobs = view(spark, sf, "jobs").select(F.col("job_id").alias("lead_id"))
    return tables.insert_if_absent(jobs, view(spark, sf, "leads"), ["lead_id"], F.asc("seq")).select("lead_id", "seq")


@query("SELECT lead_id, CASE WHEN lead_id IN (SELECT lead_id FROM jobs WHERE status = 'failed') THEN 'failed' ELSE verification_status END AS verification_status FROM lead_results")
def k2_upsert(spark, sf):
    """K2: results after an upsert of the failed jobs."""
    old = view(spark, sf, "lead_results").select("lead_id", "verification_status")
    return tables.upsert(old, view(spark, sf, "jobs").where("status = 'failed'").select("lead_id", F.lit("failed").alias("verification_status")), ["lead_id"])


@query("""SELECT v.id, CASE WHEN r.verification_status IS NULL THEN 'no such lead' END AS error, CASE WHEN v.decision = 'overturned' AND coalesce(v.corrected_status <> r.verification_status, false) THEN 'overturned' ELSE 'confirmed' END AS decision
 FROM lead_reviews v LEFT JOIN lead_results r ON r.lead_id = v.lead_id""")
def k12_review_rules(spark, sf):
    """Review requests as ledger rows."""
    requests = view(spark, sf, "lead_reviews").select("id", "lead_id", "decision", "corrected_status", "reviewer")
    return tables.review_rows(requests, view(spark, sf, "lead_results")).select("id", "error", "decision")


@query("""SELECT cast(o_custkey as string) AS sha256, min(o_orderkey) AS n FROM orders GROUP BY o_custkey
 HAVING max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS OR cast(o_custkey as string) IN (SELECT substr(image_url, 6) FROM jobs WHERE status IN ('pending', 'in_progress') AND image_url LIKE 'blob:%')""")
def j6_blob_purge(spark, sf):
    """Blobs that a purge keeps."""
    jobs = view(spark, sf, "jobs")
    register(spark, sf, "orders")
    orders = spark.table("orders")
    now = orders.agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("now"))
    blobs = orders.groupBy(F.col("o_custkey").cast("string").alias("sha256")).agg(F.min("o_orderkey").alias("n"), F.max(F.col("o_orderdate").cast("timestamp")).alias("last_used"))
    return tables.purge_blobs(blobs.crossJoin(F.broadcast(now)), jobs, 30, F.col("now")).select("sha256", "n")


_labels = "CASE WHEN {t} THEN {v} END"


@query(f"""SELECT e.lead_id, CASE WHEN regexp_replace(coalesce(e.loan_account_number, ''), '\\D', '', 'g') <> '' THEN contains(regexp_replace(e.loan_account_number, '\\D', '', 'g'), regexp_replace(l.loan_account_number, '\\D', '', 'g')) END AS lan,
 CASE WHEN e.amount IS NOT NULL THEN coalesce(abs(cast(e.amount AS double) - cast({_NUM.format(x='l.payment_amount')} AS double)) <= 1.0, false) END AS amount FROM extractions e JOIN leads l ON l.lead_id = e.lead_id""")
def p23_labels(spark, sf):
    """Extracted fields that agree with the system row."""
    e = view(spark, sf, "extractions").alias("e").join(view(spark, sf, "leads").alias("l"), "lead_id")
    doc = {"loan_account_number": F.col("e.loan_account_number"), "amount": F.col("e.amount"), "date": F.col("doc_date"), "receiver_name": F.col("receiver_name")}
    m = classify.field_labels(doc, F.col("l.loan_account_number"), F.col("payment_amount"))
    return e.select("lead_id", m.alias("m")).select("lead_id", F.col("m.loan_account_number.matches_system").alias("lan"), F.col("m.amount.matches_system").alias("amount"))


@query("""SELECT o.o_orderkey AS id, c.extraction AS cached, CASE WHEN c.extraction IS NOT NULL THEN 'hit' ELSE 'miss' END AS cache FROM orders o
 LEFT JOIN ocr_cache c ON c.cache_key = sha256(cast(o.o_custkey as varchar)) || ':m' || cast(o.o_custkey % 3 as varchar) || ':v2'""")
def j12_cache_probe(spark, sf):
    """Images probed in the cache of model answers."""
    register(spark, sf, "orders")
    rows = spark.table("orders").select(F.col("o_orderkey").alias("id"), cache.cache_key(F.col("o_custkey").cast("string"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")), 2).alias("cache_key"))
    return cache.probe(rows, view(spark, sf, "ocr_cache")).select("id", "cached", "cache")


@query("""SELECT c.cache_key, c.hits + (SELECT count(*) FROM orders o WHERE sha256(cast(o.o_custkey as varchar)) || ':m' || cast(o.o_custkey % 3 as varchar) || ':v2' = c.cache_key) AS hits FROM ocr_cache c
 UNION ALL SELECT sha256(cast(c_custkey as varchar)) || ':m' || cast(c_custkey % 3 as varchar) || ':v2' AS cache_key, 0 AS hits FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 7 <> 0""")
def j12_cache_after(spark, sf):
    """The cache after a run, with its hits counted and good answers added."""
    register(spark, sf, "orders customer")
    key = lambda c: cache.cache_key(F.col(c).cast("string"), F.concat(F.lit("m"), (F.col(c) % 3).cast("string")), 2).alias("cache_key")
    held = view(spark, sf, "ocr_cache")
    answers = spark.table("customer").select(key("c_custkey"), F.lit("{}").alias("extraction"), F.lit("m").alias("model"), F.when(F.col("c_custkey") % 7 == 0, "Timeout").alias("error"))
    return cache.filled(cache.counted(held, cache.probe(spark.table("orders").select(key("o_custkey")), held)), answers).select("cache_key", "hits")


_REFERENCE = "CASE WHEN amount IS NOT NULL THEN 'amount' END, CASE WHEN loan_account_number IS NOT NULL THEN 'loan_account_number' END"


@query(f"""SELECT lead_id, m <> [] OR f <> [] AS is_document, CASE WHEN m <> [] OR f <> [] THEN 'payment document (' || array_to_string(list_filter([CASE WHEN f <> [] THEN 'fields:' || array_to_string(f, ',') END, CASE WHEN m <> [] THEN len(m) || ' text marker(s)' END], lambda x: x IS NOT NULL), '; ') || ')'
 ELSE 'non-document — no payment evidence (' || coalesce(nullif(document_type, ''), 'no payment content') || ')' END AS reason, {oracle.method('document_type', 'full_text')} AS payment_method, length(full_text) AS text_len
 FROM (SELECT *, list_filter([{', '.join(f"'{m}'" for m in oracle.MARKERS)}], lambda x: contains(lower(full_text), x)) AS m, list_filter([{_REFERENCE}], lambda x: x IS NOT NULL) AS f FROM extractions) e""")
def p28_stage_two(spark, sf):
    """What the classification stage says of every extraction."""
    c = F.col
    said = classify.stage_two(c("document_type"), c("full_text"), F.lit(""), {"amount": c("amount"), "loan_account_number": c("loan_account_number")})
    return view(spark, sf, "extractions").select("lead_id", said.alias("s")).select("lead_id", "s.is_document", "s.reason", "s.payment_method", "s.text_len")


@query(f"SELECT lead_id, CASE WHEN lc IS NULL OR loan IS NULL OR amt IS NULL OR ym IS NULL THEN '' ELSE lc || ' | ' || loan || ' | ' || amt || ' | ' || ym END AS identity FROM {_IDENT} i")
def p29_identity_text(spark, sf):
    """The identity as people read it."""
    return dedup.with_identity(view(spark, sf, "leads")).select("lead_id", dedup.identity_text().alias("identity"))


@query(f"""SELECT c.lead_id, c.field, c.expected, c.document, CASE WHEN list_contains(string_split(c.matched, ','), c.key) THEN 'ok' WHEN list_contains(string_split(c.failed, ','), c.key) THEN 'bad' ELSE 'na' END AS mark FROM (
SELECT l.lead_id, v.matched, v.failed, unnest(['Amount', 'Date', 'Receiver', 'Loan a/c', 'Reference']) AS field, unnest(['amount', 'date', 'receiver', 'loan_account_number', '-']) AS key,
 unnest(list_transform([l.payment_amount, l.payment_date, l.institute_name, l.loan_account_number, NULL], lambda x: coalesce(nullif(x, ''), '—'))) AS expected,
 unnest(list_transform([e.amount, e.doc_date, e.receiver_name, e.loan_account_number, NULL], lambda x: coalesce(nullif(x, ''), '—'))) AS document FROM leads l JOIN extractions e ON e.lead_id = l.lead_id JOIN {_VERIFIED} v ON v.lead_id = l.lead_id) c""")
def p24_comparison(spark, sf):
    """The system's fields beside the document's, with the verdict's mark."""
    rows = materialise(leads.with_documents(view(spark, sf, "leads"), view(spark, sf, "extractions"), "inner"))
    return leads.comparison(verify.verify(rows, _config(spark))).select("lead_id", "field", "expected", "document", "mark")


@query("SELECT lead_id, is_test, lc AS lead_code, loan AS loan_acct, cast(amt AS double) AS amount, ym AS pay_ym FROM (SELECT *, row_number() OVER (PARTITION BY lc, loan, amt, ym ORDER BY seq, lead_id) AS rn FROM " + _IDENT + """ i
 WHERE NOT is_test AND lc IS NOT NULL AND loan IS NOT NULL AND amt IS NOT NULL AND ym IS NOT NULL AND lead_id IN (SELECT lead_id FROM lead_results WHERE NOT is_test)) x WHERE rn = 1""")
def k13_ledger(spark, sf):
    """The ledger of claims that the processed real leads make."""
    return dedup.ledger_rows(view(spark, sf, "leads"), view(spark, sf, "lead_results")).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT job_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts, CASE WHEN status <> 'failed' THEN last_error END AS last_error FROM jobs")
def q5_requeue(spark, sf):
    """Q5: failed jobs wait again."""
    return tables.requeue(view(spark, sf, "jobs")).select("job_id", "status", "attempts", "last_error")


@query("SELECT job_id, CASE WHEN attempts = 2 THEN 'done' ELSE status END AS status, CASE WHEN attempts = 2 THEN 'unverified' ELSE verification_status END AS verification_status, CASE WHEN attempts <> 2 THEN last_error END AS last_error FROM jobs")
def q3_complete(spark, sf):
    """Q3: jobs that end with a verdict."""
    jobs = view(spark, sf, "jobs")
    return tables.complete(jobs, jobs.where("attempts = 2").select("job_id", F.lit("unverified").alias("verdict"))).select("job_id", "status", "verification_status", "last_error")


@query("SELECT e.lead_id, e.seq FROM leads e WHERE NOT (e.is_test AND e.lead_id IN (SELECT lead_id FROM jobs WHERE is_test AND batch_id = 'batch-1'))")
def q7_clear_test(spark, sf):
    """Leads without the test rows of one batch."""
    return tables.clear_test(view(spark, sf, "leads"), view(spark, sf, "jobs"), "batch-1").select("lead_id", "seq")


@query("""SELECT source, source_key, CASE WHEN k % 10 = 0 THEN 'again' ELSE reason END AS reason, first_seen, CASE WHEN k % 10 = 0 THEN false ELSE resolved END AS resolved FROM (SELECT *, cast(substr(source_key, 6) AS bigint) AS k FROM ingest_quarantine) q
 UNION ALL SELECT 'src-9', 'LEAD-N' || o_orderkey, 'again', cast(timestamp '2030-01-01' AS timestamp), false FROM orders WHERE o_orderkey % 101 = 0""")
def k5_quarantine(spark, sf):
    """K5: quarantine after rows come again: new reason, unresolved, first seen when they first came."""
    held = view(spark, sf, "ingest_quarantine")
    register(spark, sf, "orders")
    late = F.lit("2030-01-01").cast("timestamp").alias("first_seen")
    again = held.where("cast(substr(source_key, 6) AS bigint) % 10 = 0").select("source", "source_key", F.lit("{}").alias("source_row"), F.lit("again").alias("reason"), late)
    new = spark.table("orders").where("o_orderkey % 101 = 0").select(F.lit("src-9").alias("source"), F.concat(F.lit("LEAD-N"), "o_orderkey").alias("source_key"), F.lit("{}").alias("source_row"), F.lit("again").alias("reason"), late)
    return cursors.quarantined(held, again.unionByName(new)).select("source", "source_key", "reason", "first_seen", "resolved")


@query(f"""SELECT 'src' AS source, count(*) AS rows_seen, count(*) FILTER (WHERE reason IS NULL AND j.job_id IS NULL) AS enqueued, count(*) FILTER (WHERE reason IS NULL AND j.job_id IS NOT NULL) AS duplicates, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined, true AS ok
 FROM (SELECT lead_id, CASE {_REQUIRED} WHEN {_NUM.format(x='payment_amount')} IS NULL OR {_date('payment_date', False)} IS NULL THEN 'bad' END AS reason FROM leads) m LEFT JOIN jobs j ON j.job_id = m.lead_id""")
def k8_run(spark, sf):
    """K8: the bookkeeping row of one ingestion cycle."""
    plain = mapping.Mapping(MAPPING.fields, "seq", "lead_id", "", MAPPING.required)
    known = view(spark, sf, "jobs").select(F.col("job_id").alias("lead_id"), F.lit(False).alias("is_new"))
    rows = mapping.map_rows(view(spark, sf, "leads"), plain).join(known, "lead_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    at = F.lit("2030-01-01").cast("timestamp")
    return cursors.run_row(rows, "src", "live", at, at).select("source", "rows_seen", "enqueued", "duplicates", "quarantined", "ok")


@query("""SELECT source, max(wm_ts) AS wm_ts, max_by(wm_id, wm_ts) AS wm_id FROM (SELECT source, max(started_at) AS wm_ts, CAST(max_by(id, started_at) AS varchar) AS wm_id FROM ingest_runs WHERE source <> 'src-2' GROUP BY source
 UNION ALL SELECT 'src-0', timestamp '1990-01-01', 'x' UNION ALL SELECT 'src-1', timestamp '2090-01-01', '7' UNION ALL SELECT 'src-2', timestamp '2024-01-01', '') c GROUP BY source""")
def t1_cursors(spark, sf):
    """Cursors seeded and advanced; what lies behind does not move them."""
    runs = view(spark, sf, "ingest_runs")
    at = runs.where("source <> 'src-2'").groupBy("source").agg(F.max("started_at").alias("wm_ts"), F.max_by("id", "started_at").cast("string").alias("wm_id"))
    moved = spark.createDataFrame([("src-0", "1990-01-01", "x"), ("src-1", "2090-01-01", "7")], "source string, wm_ts string, wm_id string").withColumn("wm_ts", F.col("wm_ts").cast("timestamp"))
    return cursors.advance(cursors.seed(at, runs.select("source"), F.lit("2024-01-01")), moved)


@query("SELECT id FROM ingest_runs WHERE started_at >= (SELECT max(started_at) FROM ingest_runs) - INTERVAL 600 MINUTES")
def t2_overlap(spark, sf):
    """The rows that a poll reads again."""
    runs = view(spark, sf, "ingest_runs")
    last = runs.agg(F.max("started_at").alias("__at"))
    return cursors.overlapping(runs.crossJoin(F.broadcast(last)), F.col("__at"), 600, "started_at").select("id")


@query("SELECT lead_id, id, decision, note FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY id DESC) AS rn FROM lead_reviews) r WHERE rn = 1")
def s12_latest_review(spark, sf):
    """The state of review of every lead."""
    return leads.latest_review(view(spark, sf, "lead_reviews")).select("lead_id", "id", "decision", "note")


@query("SELECT j.job_id, j.status AS job_status, coalesce(r.verification_status, j.verification_status) AS verification_status, j.status IN ('done', 'failed') AS terminal FROM jobs j LEFT JOIN lead_results r ON r.lead_id = j.lead_id")
def s12_lead_status(spark, sf):
    """What a caller polls."""
    return leads.lead_status(view(spark, sf, "jobs"), view(spark, sf, "lead_results")).select("job_id", "job_status", "verification_status", "terminal")


def _link(x: str) -> str:
    """The first link in a cell, else the first filled entry of a JSON list, else the cell."""
    url, cell = r"regexp_extract(" + x + r", 'https?://[^\s\x22''\\\]}<>]+')", r"regexp_replace(coalesce(" + x + r", ''), '^\s+|\s+$', '', 'g')"
    return f"(CASE WHEN {url} <> '' THEN regexp_replace({url}, '[.,;]+$', '') WHEN {cell} LIKE '[%' THEN coalesce(list_filter(from_json({cell}, '[\"VARCHAR\"]'), lambda y: trim(y) <> '')[1], '') ELSE {cell} END)"


def _image(x: str) -> str:
    return r"(starts_with(lower(" + x + r"), 'data:image/') OR regexp_matches(" + x + r", '(?i)\.(jpe?g|png|webp|gif|bmp|tiff?|heic|heif)(\?|#|$)'))"


@query(f"""SELECT id, CASE WHEN doc <> '' THEN doc WHEN lower(n) LIKE 'http%' AND {_image('n')} THEN n WHEN lower(h) LIKE 'http%' AND {_image('h')} THEN h WHEN (lower(n) LIKE 'http%') <> (lower(h) LIKE 'http%') THEN CASE WHEN lower(n) LIKE 'http%' THEN n ELSE h END ELSE '' END AS link,
 {_image('doc')} AS image FROM (SELECT id, {_link('payment_document')} AS doc, {_link('note')} AS n, {_link('homepage')} AS h FROM raw_cells) c""")
def p10_resolve(spark, sf):
    """Where a row's image is, and whether the chosen link looks like one."""
    rows = view(spark, sf, "raw_cells").select("id", "payment_document", "note", "homepage")
    links = rows.drop("id")
    return rows.select("id", mapping.resolve_image(links).alias("link"), F.coalesce(mapping.looks_like_image(mapping.clean_source(F.col("payment_document"))), F.lit(False)).alias("image"))


@query("""SELECT id, CASE WHEN contains(lower(body), 'accessdenied') OR contains(lower(body), 'request has expired') THEN 'private' WHEN contains(lower(content_type), 'html') OR contains(lower(body), '<html') OR starts_with(lower(body), '<!doctype html') THEN 'page'
 WHEN contains(lower(content_type), 'xml') OR contains(lower(body), '<?xml') OR contains(lower(body), '<error') THEN 'error' ELSE '' END AS kind FROM raw_cells""")
def p11_diagnose(spark, sf):
    """Why a fetched body is no image."""
    said = images.diagnose_body(F.col("body"), F.col("content_type"))
    kind = F.when(F.contains(said, F.lit("access denied")), "private").when(F.contains(said, F.lit("web page")), "page").when(F.contains(said, F.lit("error response")), "error").otherwise(said)
    return view(spark, sf, "raw_cells").select("id", kind.alias("kind"))


@query("""SELECT id, CASE cast(id % 6 as int) WHEN 0 THEN 'true' WHEN 3 THEN 'yes' ELSE 'false' END AS is_doc, CASE WHEN id % 6 = 0 THEN '5,000' END AS amount, CASE WHEN id % 6 IN (0, 3) THEN NULL WHEN id % 6 = 4 THEN 'unparseable model output' ELSE 'unreadable model output' END AS why,
 CASE WHEN id % 6 = 0 THEN 'Paid' WHEN id % 6 = 3 THEN '' ELSE coalesce(answer, '') END AS full_text FROM raw_cells""")
def p20_model_output(spark, sf):
    """P20: fields of model answers: in order, broken, without JSON, empty."""
    out = classify.coerce_model_output(F.col("answer"))
    return view(spark, sf, "raw_cells").select("id", out.alias("o")).select("id", F.col("o.is_payment_document").alias("is_doc"), "o.amount", F.col("o.describes").alias("why"), "o.full_text")


@query("""SELECT id, coalesce(lower(ex_is_receipt) IN ('true', '1'), false) AS is_doc, CASE WHEN coalesce(lower(ex_is_receipt) IN ('true', '1'), false) THEN '' WHEN ex_doc_type = 'upi' THEN 'upi' ELSE 'non-payment image' END AS describes,
 CASE WHEN ex_doc_type = 'upi' THEN 'upi' ELSE 'other' END AS document_type, CASE WHEN ex_amount = '100' THEN '100' END AS amount FROM raw_cells""")
def p21_precomputed(spark, sf):
    """Extractions that came with the row."""
    none = lambda c: F.col(c) if c in ("ex_is_receipt", "ex_doc_type", "ex_amount") else F.lit(None).cast("string")
    out = view(spark, sf, "raw_cells").select("id", *classify.precomputed(none))
    return out.select("id", F.col("is_payment_document").alias("is_doc"), "describes", "document_type", "amount")


@query("""SELECT lead_id AS source_id, 'LEAD-' || substr(sha1('{"amount": "' || payment_amount || '", "lender": "' || institute_name || '"}'), 1, 12) AS lead_id FROM leads""")
def p6_content_id(spark, sf):
    """Ids from the rows' content."""
    rows = view(spark, sf, "leads").select(F.col("lead_id").alias("source_id"), F.col("institute_name").alias("lender"), F.col("payment_amount").alias("amount"))
    return rows.select("source_id", text.content_id(["lender", "amount"]).alias("lead_id"))


@query("SELECT id, CASE WHEN id % 6 = 3 THEN 'yes' END AS doc FROM raw_cells")
def p31_objects(spark, sf):
    """JSON objects read with tolerance."""
    whole = F.when(F.col("id") % 6 != 0, F.col("answer"))
    return view(spark, sf, "raw_cells").select("id", F.try_variant_get(text.as_object(whole), "$.is_payment_document", "string").alias("doc"))


@query(f"""SELECT lender, receiver_norm, first_lead, n, ready FROM (SELECT lender, {_NAME.format(x="json_extract_string(extracted, '$.receiver_name')")} AS receiver_norm, min(lead_id) AS first_lead, count(*) AS n,
 count(*) FILTER (WHERE json_extract_string(outcome, '$.failed_fields') = '["receiver"]') AS ready FROM lead_results WHERE NOT is_test AND verification_status = 'unverified' AND coalesce(json_extract_string(outcome, '$.flag'), '') <> 'different_loan_account_same_lead_code'
 AND contains(coalesce(json_extract_string(outcome, '$.failed_fields'), ''), '"receiver"') AND coalesce(json_extract_string(extracted, '$.receiver_name'), '') <> '' GROUP BY 1, 2) q WHERE lender NOT IN ('SMFG_PL', 'MONEYVIEW')""")
def a25_undecided(spark, sf):
    """The approval queue without the pairs that were decided."""
    decided = spark.createDataFrame([("SMFG_PL", "speedo finance"), ("MONEYVIEW", "speedo finance"), ("JANA_SF", "other")], "lender string, receiver_norm string")
    out = leads.approval_queue(view(spark, sf, "lead_results"), decided)
    return out.select("lender", "receiver_norm", "first_lead", F.col("count").alias("n"), "ready")


_SPAN = "(CASE rule WHEN 'truncation' THEN 15 ELSE 10 END)"


@query(f"""WITH e AS (SELECT cast(floor((epoch_us(ts) - 1) / 60000000) AS bigint) + 1 AS minute, ms, coalesce(model_error, '') AS err, finish_reason FROM lead_events WHERE stage = 'stage2_ocr_classify'),
h AS (SELECT minute, 'model_errors' AS rule, 0.0::DOUBLE AS v FROM e WHERE err <> '' UNION ALL SELECT minute, 'latency_p95', ms FROM e WHERE ms IS NOT NULL UNION ALL SELECT minute, 'truncation', 0.0 FROM e WHERE finish_reason = 'length'),
s AS (SELECT rule, unnest(range(minute, minute + {_SPAN})) AS minute, v FROM h),
f AS (SELECT rule, minute, minute - row_number() OVER (PARTITION BY rule ORDER BY minute) AS run FROM s GROUP BY rule, minute HAVING CASE WHEN rule = 'latency_p95' THEN quantile_cont(v, 0.95) > 100 ELSE count(*) > 0 END),
r AS (SELECT rule, min(minute) AS a, max(minute) AS b, CASE WHEN rule = 'latency_p95' THEN 5 ELSE 0 END AS hold FROM f GROUP BY rule, run)
SELECT rule, a AS minute, 'pending' AS state FROM r WHERE hold > 0 UNION ALL SELECT rule, a + hold, 'firing' FROM r WHERE b - a >= hold UNION ALL SELECT rule, b + 1, CASE WHEN b - a >= hold THEN 'resolved' ELSE 'normal' END FROM r""")
def a38_alert_states(spark, sf):
    """When each alert became pending, fired and ended; slow means 100 ms here, as the events' times are small."""
    watched = tuple(replace(r, limit=100.0) if r.quantile else r for r in alerts.RULES)
    return alerts.states(view(spark, sf, "lead_events"), watched).select("rule", F.floor(F.unix_timestamp("minute") / 60).alias("minute"), "state")


def _sql_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = metrics.analytics(metrics.SPARK)[name]
        register(spark, sf_dir, sql)
        return spark.sql(sql)

    run.__name__ = name
    return run


for _name, _sql in metrics.analytics(metrics.DUCKDB).items():
    QUERIES[_name] = _sql_query(_name)
    ORACLE[_name] = with_views(_sql)


def a7_model_latency(spark, sf):
    """Percentiles of the model's time, selected over all events."""
    return metrics.model_latency(tables.scoped(view(spark, sf, "lead_events")))


def a10_stage_timings(spark, sf):
    """A10: mean and 95th percentile of every stage."""
    return metrics.stage_timings(tables.scoped(view(spark, sf, "lead_events"))).withColumn("avg_ms", F.round("avg_ms", 6))


def a37_time_per_stage(spark, sf):
    """The panel of whole milliseconds."""
    return metrics.stage_timings(view(spark, sf, "lead_events")).select("stage", "n", F.round("avg_ms").alias("avg_ms"), F.round("p95_ms").alias("p95_ms"))


for _f in (a7_model_latency, a10_stage_timings, a37_time_per_stage):
    QUERIES[_f.__name__] = _f
