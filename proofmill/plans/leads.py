"""From leads and extractions to final verdicts, events and re-verification, as lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, dedup, tables, verify
from ..sources.scratch import materialise

DOC = ("doc_amount", "doc_date", "doc_receiver", "doc_lan", "doc_text")


def with_documents(leads: DataFrame, extractions: DataFrame, how: str = "left") -> DataFrame:
    """``leads`` with their document's fields, ``doc_amount`` and so on, and ``has_doc``."""
    docs = extractions.select(
        "lead_id", F.col("amount").alias("doc_amount"), "doc_date", F.col("receiver_name").alias("doc_receiver"),
        F.col("loan_account_number").alias("doc_lan"), F.col("full_text").alias("doc_text"), F.lit(True).alias("has_doc"),
    )
    return leads.join(docs, "lead_id", how)


def process(leads: DataFrame, extractions: DataFrame, lenders: DataFrame, ledger: DataFrame | None = None, fuzzy_dates: bool = True) -> DataFrame:
    """The final row of every lead: ``status`` of duplicate, unprocessed, non_document, verified or unverified, with its reasons.

    Duplicates stop before any document is read; leads without an extraction are unprocessed; documents
    without payment evidence are no documents; the rest is verified. A lead whose loan account is new
    under a known lead code is never verified. The extraction joins only leads that still need it; these rows are written once, as
    verification reads them twice.
    """
    judged = dedup.dedup_verdicts(leads, ledger, fuzzy_dates=fuzzy_dates)
    ids = [c for c in leads.columns]
    stopped = judged.where("dedup = 'duplicate'")
    alive = with_documents(judged.where("dedup <> 'duplicate'"), extractions)
    evidence = classify.is_candidate(F.col("doc_text"), {"amount": F.col("doc_amount"), "loan_account_number": F.col("doc_lan")})
    alive = materialise(alive.withColumn("__evidence", evidence))
    seen = verify.verify(alive, lenders, fuzzy_dates, F.col("has_doc") & F.col("__evidence"))
    none = F.array().cast("array<string>")
    held, unread, blank = F.col("dedup") == "manual_review", F.col("has_doc").isNull(), ~F.col("__evidence")
    status = F.when(unread, "unprocessed").when(blank, "non_document").when(held, "unverified").otherwise(F.col("status"))
    reason = F.when(unread, "image never reached OCR").when(blank, "not a valid payment document").when(
        held, "different loan account under an already-seen lead_code - needs review").otherwise(F.col("reason"))
    flag = F.when(~unread & ~blank, F.when(held, "different_loan_account_same_lead_code").otherwise(F.col("flag")))
    out = seen.withColumns({"failed_fields": F.when(unread | blank, none).otherwise(F.col("failed_fields")), "matched_fields": F.when(unread | blank, none).otherwise(F.col("matched_fields")), "reason": reason, "flag": flag, "status": status})
    columns = [*ids, "dedup", "owner", "status", "reason", "failed_fields", "matched_fields", "flag"]
    dup = stopped.withColumns({
        "status": F.lit("duplicate"), "failed_fields": none, "matched_fields": none, "flag": F.lit(None).cast("string"),
        "reason": F.concat(F.lit("already processed (lead "), "owner", F.lit(")")),
    })
    return out.select(columns).unionByName(dup.select(columns))


def events(final: DataFrame) -> DataFrame:
    """Rows ``lead_id, seq, stage, status``: the stages that each lead went through."""
    stage = lambda n, s, when=F.lit(True): F.when(when, F.struct(F.lit(n).alias("stage"), s.alias("status")))
    s, ok = F.col("status"), lambda c: F.when(c, "PASS").otherwise("FAIL")
    live, read = s != "duplicate", ~s.isin("duplicate", "unprocessed")
    steps = F.array_compact(F.array(
        stage("lead_received", F.lit("PASS")), stage("stage_dedup", ok(live)), stage("stage0_load_image", ok(read), live), stage("stage2_ocr_classify", ok(s != "non_document"), read),
        stage("stage4_verify", ok(s == "verified"), s.isin("verified", "unverified")), stage("lead_closed", F.lit("PASS")),
    ))
    return final.select("lead_id", F.posexplode(steps).alias("seq", "e")).select("lead_id", "seq", "e.stage", "e.status")


def _held() -> Column:
    return F.coalesce(F.get_json_object("outcome", "$.flag"), F.lit("")) == "different_loan_account_same_lead_code"


def _scanned(results: DataFrame, ids: DataFrame | None) -> DataFrame:
    scan = results.where(F.col("verification_status").isin("verified", "unverified"))
    return scan.join(ids, "lead_id", "left_semi") if ids is not None else scan


def reverify(results: DataFrame, leads: DataFrame, extractions: DataFrame, lenders: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows ``lead_id, old, new, changed`` of verified and unverified results judged again, without those held by dedup.

    The joined rows are written once, as verification reads them twice.
    """
    scan = _scanned(results, ids).where(~_held())
    rows = with_documents(scan.select("lead_id", F.col("verification_status").alias("old")).join(leads.drop("is_test"), "lead_id"), extractions, "inner")
    again = verify.verify(materialise(rows), lenders)
    return again.select("lead_id", "old", F.col("status").alias("new"), (F.col("old") != F.col("status")).alias("changed"))


def reverify_counts(results: DataFrame, leads: DataFrame, moves: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row on what :func:`reverify` did: ``scanned, changed, flipped`` (to verified), ``skipped_dedup`` and ``moves`` (old to new, how often).

    ``moves`` are its rows; write them first, so that nothing is judged twice.
    """
    scan = _scanned(results, ids).join(leads.select("lead_id"), "lead_id", "left_semi")
    seen = scan.agg(F.count("*").alias("scanned"), F.count_if(_held()).alias("skipped_dedup"))
    by = moves.where("changed").groupBy(F.concat("old", F.lit("->"), "new").alias("move"), "new").agg(F.count("*").alias("n"))
    # At most one row for each pair of statuses.
    every = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("changed"), F.coalesce(F.sum(F.when(F.col("new") == "verified", F.col("n"))), F.lit(0)).alias("flipped"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("move", "n")))).alias("moves"))
    return seen.join(F.broadcast(every)).select("scanned", "changed", "flipped", "skipped_dedup", "moves")


def reverify_events(moves: DataFrame, note: str = "") -> DataFrame:
    """``lead_id, stage, status, reason`` of the events that changed rows leave behind."""
    reason = F.concat("old", F.lit(" -> "), "new", F.lit(f" (deterministic re-verify, no model call{note and '; ' + note})"))
    return moves.where("changed").select("lead_id", F.lit("reverify").alias("stage"), F.when(F.col("new") == "verified", "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"))


def verify_one(lenders: DataFrame, record: dict, extraction: dict | None = None, lead_id: str = "API-LEAD") -> dict:
    """The decision on one record, as a request submits it: no ledger is asked and none is changed.

    ``extraction`` has the document's fields (``amount, doc_date, receiver_name, loan_account_number, full_text``); without one the
    document could not be read.
    """
    spark = lenders.sparkSession
    names = ("institute_name", "payment_amount", "payment_date", "loan_account_number", "lead_code")
    row = (lead_id, 0, True, *(str(record.get(n) or "").strip() for n in names))
    rows = spark.createDataFrame([row], "lead_id string, seq long, is_test boolean, " + ", ".join(f"{n} string" for n in names))
    fields = ("amount", "doc_date", "receiver_name", "loan_account_number", "full_text")
    docs = [] if extraction is None else [(lead_id, *(extraction.get(n) for n in fields))]
    out = process(rows, spark.createDataFrame(docs, "lead_id string, " + ", ".join(f"{n} string" for n in fields)), lenders)
    return out.select("lead_id", "status", "reason", "failed_fields", "matched_fields", "flag").first().asDict()


def approval_candidates(results: DataFrame) -> DataFrame:
    """Unverified real leads that failed on a readable receiver, with ``ready`` where it is all that failed."""
    failed = F.from_json(F.get_json_object("outcome", "$.failed_fields"), "array<string>")
    rows = results.where(~F.col("is_test") & (F.col("verification_status") == "unverified") & ~_held()).withColumns({
        "receiver": F.get_json_object("extracted", "$.receiver_name"), "failed": failed, "ready": failed == F.array(F.lit("receiver")),
    })
    rows = rows.where(F.array_contains("failed", "receiver") & (F.coalesce("receiver", F.lit("")) != ""))
    return rows.withColumn("receiver_norm", text.norm_name(F.col("receiver"))).where("receiver_norm <> ''")


def approval_queue(results: DataFrame, decided: DataFrame) -> DataFrame:
    """One row for each undecided (lender, receiver): ``count``, ``ready`` and the spelling of the first lead; heaviest first.

    The leads behind a pair are a query of :func:`approval_candidates`, not a list in one row.
    """
    rows = approval_candidates(results).join(decided.select("lender", "receiver_norm"), ["lender", "receiver_norm"], "left_anti")
    agg = rows.groupBy("lender", "receiver_norm").agg(
        F.min_by("receiver", "lead_id").alias("receiver"), F.count("*").alias("count"), F.count_if("ready").alias("ready"), F.min("lead_id").alias("first_lead"))
    return agg.orderBy(F.desc("ready"), F.desc("count"), "lender", "receiver_norm")


def decide(results: DataFrame, decided: DataFrame, leads: DataFrame, extractions: DataFrame, lenders: DataFrame, lender: str, receiver: str, decision: str) -> tuple[DataFrame, DataFrame]:
    """The lender table that a human decision leads to, and the re-verified rows of the leads it affects."""
    if decision not in ("approved", "rejected"):
        raise ValueError("decision must be 'approved' or 'rejected'")
    norm = text.norm_name(F.lit(receiver))
    if not lender.strip() or not receiver.strip():
        raise ValueError("lender and receiver are required")
    if decided.where((F.col("lender") == lender) & (F.col("receiver_norm") == norm)).limit(1).count():
        raise ValueError(f"'{receiver}' for {lender} was already decided")
    hit = approval_candidates(results).where((F.col("lender") == lender) & (F.col("receiver_norm") == norm)).select("lead_id")
    if decision == "approved":
        new = ~F.exists("receivers", lambda r: text.norm_name(r) == norm)
        added = F.when((F.col("lender") == lender) & new, F.array_append("receivers", F.lit(receiver))).otherwise(F.col("receivers"))
        known = lenders.where(F.col("lender") == lender).limit(1).count()
        base = lenders if known else lenders.unionByName(lenders.where("lender = '__default__'").withColumns({"lender": F.lit(lender), "receivers": F.array().cast("array<string>")}))
        lenders = base.withColumn("receivers", added)
    return lenders, reverify(results, leads, extractions, lenders, hit)


def comparison(rows: DataFrame) -> DataFrame:
    """``lead_id, place, field, expected, document, mark``: the system's fields beside the document's, five rows a lead.

    ``rows`` has both sides (as from :func:`with_documents`, with ``transaction_id`` and ``doc_reference`` if known) and the
    verdict's ``matched_fields`` and ``failed_fields``. The mark is ok, bad or na; blanks are shown as a dash.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    shown = lambda c: F.when(text.present(c.cast("string")), c.cast("string")).otherwise("—")
    mark = lambda f: F.when(F.array_contains("matched_fields", f), "ok").when(F.array_contains("failed_fields", f), "bad").otherwise("na")
    sides = (
        ("Amount", "payment_amount", "doc_amount", "amount"), ("Date", "payment_date", "doc_date", "date"), ("Receiver", "institute_name", "doc_receiver", "receiver"),
        ("Loan a/c", "loan_account_number", "doc_lan", "loan_account_number"), ("Reference", "transaction_id", "doc_reference", None),
    )
    each = F.array(*(F.struct(F.lit(n).alias("field"), shown(has(a)).alias("expected"), shown(has(b)).alias("document"), (mark(f) if f else F.lit("na")).alias("mark")) for n, a, b, f in sides))
    return rows.select("lead_id", F.posexplode(each).alias("place", "c")).select("lead_id", "place", "c.*")


def latest_review(reviews: DataFrame) -> DataFrame:
    """The state of review of every lead: its last row."""
    return tables.latest(reviews, ["lead_id"], F.desc("id"))


def review_history(reviews: DataFrame, lead_id: str) -> DataFrame:
    """All that reviewers did to one lead, in order."""
    return reviews.where(F.col("lead_id") == lead_id).orderBy("id")


def lead_status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """What a caller polls: the job's state, the verdict if there is one, and whether the job is over."""
    verdicts = results.select("lead_id", F.col("verification_status").alias("__v"))
    both = jobs.join(verdicts, "lead_id", "left").withColumn("verification_status", F.coalesce("__v", "verification_status"))
    return both.select("lead_id", "job_id", F.col("status").alias("job_status"), "attempts", "max_attempts", "last_error", "is_test", "verification_status", F.col("status").isin("done", "failed").alias("terminal"))
