"""Deterministic verification: every mandatory field of the lender's rule needs positive evidence."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from . import classify, receivers

#: Rows of the rule and receiver tables (one per lender) that are broadcast at most.
MAX_LENDERS = 100_000
CHECKS = ("date", "amount", "receiver", "loan_account_number")
RULE_SCHEMA = "lender string, needs_lan boolean, date_tol int, amt_tol double, mandatory array<string>, reconciliation boolean, receivers array<string>"


def lender_table(spark: SparkSession, rules: dict[str, dict], receivers: dict[str, list[str]]) -> DataFrame:
    """One row for each lender with a rule or receivers; lenders without a rule have the default's."""
    default = rules["__default__"]
    if len(rules) + len(receivers) > MAX_LENDERS:
        raise ValueError("the lender tables are configuration; they are too large to broadcast")
    rows = []
    for lender in sorted({*rules, *receivers}):
        r = rules.get(lender, default)
        mandatory, lan = list(r["mandatory_fields"]), bool(r["needs_lan"])
        if "loan_account_number" in mandatory and not lan:
            raise ValueError(f"{lender}: loan_account_number is mandatory but needs_lan is false")
        rows.append((lender, lan, int(r["date_tolerance_days"]), float(r["amount_tolerance_rupees"]), mandatory, bool(r.get("reconciliation_dependent")), list(receivers.get(lender, []))))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def load_lender_table(spark: SparkSession, rules_path: str, receivers_path: str) -> DataFrame:
    """The lender table from two JSON files, read through Spark so that any store works."""
    read = lambda p: json.loads(spark.read.text(p, wholetext=True).first()[0])
    return lender_table(spark, read(rules_path), read(receivers_path))


def with_rule(leads: DataFrame, lenders: DataFrame, lender: str = "institute_name") -> DataFrame:
    """Add ``rule``: the lender's own, else the default's without receivers.

    ``lenders`` is configuration with a row for each lender; more than ``MAX_LENDERS`` rows are joined by a shuffle.
    """
    hint = F.broadcast if lenders.limit(MAX_LENDERS + 1).count() <= MAX_LENDERS else lambda df: df
    full = lenders.withColumn("has_receivers", F.size("receivers") > 0).drop("receivers")
    named = full.where("lender <> '__default__'").select(F.col("lender").alias("__l"), F.struct(*full.columns).alias("own"))
    default = full.where("lender = '__default__'").select(F.struct(*full.columns).alias("base"))
    joined = leads.join(hint(named), F.col(lender) == F.col("__l"), "left").crossJoin(F.broadcast(default.limit(1)))
    bare = F.col("base").withField("has_receivers", F.lit(False))
    return joined.withColumn("rule", F.coalesce("own", bare)).drop("own", "base", "__l")


def check_amount(d: Column, s: Column, tol: Column) -> Column:
    two = lambda x: F.format_string("%.2f", x)
    return _result(
        (d.isNull(), False, F.lit("amount not readable on document")),
        (s.isNull(), False, F.lit("system amount missing")),
        (F.abs(d - s) <= tol, True, F.concat(F.lit("amount matches ("), two(d), F.lit(")"))),
        (F.lit(True), False, F.concat(F.lit("amount mismatch (doc "), two(d), F.lit(" vs system "), two(s), F.lit(")"))),
    )


def check_date(d: Column, s: Column, tol: Column) -> Column:
    gap = F.abs(F.datediff(d, s))
    return _result(
        (d.isNull(), False, F.lit("date not readable on document")),
        (s.isNull(), False, F.lit("system date missing")),
        (gap <= tol, True, F.concat(F.lit("date matches (gap "), gap, F.lit("d)"))),
        (F.lit(True), False, F.concat(F.lit("date mismatch (gap "), gap, F.lit("d > "), tol, F.lit("d - possible old/recycled receipt)"))),
    )


def check_receiver(receiver: Column, lender: Column, some: Column, hits: dict[str, Column]) -> Column:
    """Own name, then allowed names, then a payment handle; a payee that matches none fails; without a payee, whole words of the text.

    ``some``: the lender has allowed names. ``hits`` are the names found by :func:`receivers.with_hits`.
    """
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    ok = lambda hit, *message: F.when(hits[hit].isNotNull(), F.struct(F.lit(True).alias("ok"), say(*message).alias("msg")))
    who, named = text.strip(receiver), text.norm_name(receiver) != ""
    return F.coalesce(
        ok("own_name", "receiver matches lender name '", hits["own_name"], "'"),
        ok("allowed_name", "receiver matches approved receiver '", hits["allowed_name"], "'"),
        ok("handle_name", "receiver UPI id '", hits["handle"], "' carries '", hits["handle_name"], "'"),
        _result(
            (named & some, False, say("receiver '", who, "' is not among accepted names for ", lender)),
            (named, False, say("receiver '", who, "' does not match ", lender, " (no allowlist configured)")),
        ),
        ok("written_name", "payee not in a field; '", hits["written_name"], "' found on document"),
        _result(
            (some, False, say("receiver unreadable and no accepted name found on document for ", lender)),
            (F.lit(True), False, say("no accepted-receiver list configured for ", lender, ", and lender name not found on document")),
        ),
    )


def check_lan(d: Column, s: Column) -> Column:
    return _result(
        (d == "", False, F.lit("loan account number not readable on document")),
        (s == "", False, F.lit("system loan account number missing")),
        ((d == s) | ((F.length(s) >= 8) & (F.contains(d, s) | F.contains(s, d))), True, F.lit("loan account number matches")),
        (F.lit(True), False, F.lit("loan account number mismatch")),
    )


def _result(*rules: tuple[Column, bool, Column]) -> Column:
    """``struct(ok, msg)`` of the first rule whose condition holds."""
    out = None
    for test, ok, msg in rules:
        value = F.struct(F.lit(ok).alias("ok"), msg.alias("msg"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def verify(leads: DataFrame, lenders: DataFrame, fuzzy_dates: bool = True, only: Column | None = None) -> DataFrame:
    """Add the verdict to rows that hold the system's and the document's fields; rows where ``only`` is not true get nulls.

    Reads ``institute_name, payment_amount, payment_date, loan_account_number`` and the document's ``doc_amount,
    doc_date, doc_receiver, doc_lan, doc_text``. Adds ``status, reason, failed_fields, matched_fields, flag,
    date_gap_days, amount_delta, details``. The lender table is joined as a broadcast; names are matched once for every different
    payee, handle list and text (:mod:`receivers`), for which ``leads`` is read once more: write it first if it is costly.
    """
    c = F.col
    hits = ("own_name", "allowed_name", "handle_name", "handle", "written_name")
    df = with_rule(receivers.with_hits(leads, lenders, F.lit(True) if only is None else only), lenders)
    read = F.struct(
        dates.parse_date(c("doc_date"), fuzzy_dates).alias("dd"), dates.parse_date(c("payment_date"), fuzzy_dates).alias("sd"), text.num(c("doc_amount")).alias("da"),
        text.num(c("payment_amount")).alias("sa"), text.digits(c("doc_lan")).alias("dl"), text.digits(c("loan_account_number")).alias("sl"),
    )

    # A column of its own, so that a caller who needs only gaps does not pay for the checks and their messages.
    df = df.withColumn("__r", read if only is None else F.when(only, read))
    v = lambda n: c(f"__r.{n}")
    by_field = {
        "date": check_date(v("dd"), v("sd"), c("rule.date_tol")), "amount": check_amount(v("da"), v("sa"), c("rule.amt_tol")),
        "receiver": check_receiver(c("doc_receiver"), c("institute_name"), c("rule.has_receivers"), {n: c(n) for n in hits}), "loan_account_number": check_lan(v("dl"), v("sl")),
    }
    one = lambda f: F.coalesce(*(F.when(f == n, check) for n, check in by_field.items()))
    results = F.transform(c("rule.mandatory"), lambda f: text.let(one(f), lambda x: F.struct(f.alias("field"), x["ok"].alias("ok"), x["msg"].alias("msg"))))
    judged = lambda x: F.when(c("__r").isNotNull(), x)
    df = df.withColumn("__v", judged(results))
    bad = F.filter("__v", lambda r: ~r["ok"])
    recon, incoming = c("rule.reconciliation"), classify.incoming_credit(c("doc_text"))
    of = lambda kind: F.array(F.lit(kind))
    why = F.array_join(F.transform(bad, lambda r: F.concat(r["field"], F.lit(": "), r["msg"])), "; ")
    return df.withColumns({
        "status": judged(F.when(~recon & ~incoming & (F.size(bad) == 0), "verified").otherwise("unverified")),
        "reason": judged(F.when(recon, "requires cash-deposit reconciliation - not verifiable from document alone").when(
            incoming, "looks like an incoming credit to your own account, not an outgoing loan repayment - needs review").otherwise(why)),
        "failed_fields": judged(F.when(recon, of("reconciliation")).when(incoming, of("direction")).otherwise(F.transform(bad, lambda r: r["field"]))),
        "matched_fields": F.transform(F.filter("__v", lambda r: r["ok"] & ~recon), lambda r: r["field"]),
        "flag": judged(F.when(~recon & incoming, "incoming_credit")),
        "date_gap_days": F.abs(F.datediff(v("dd"), v("sd"))),
        "amount_delta": F.round(F.abs(v("da") - v("sa")), 2),
        "details": F.map_from_entries(F.transform("__v", lambda r: F.struct(r["field"], r["msg"]))),
    }).drop("__r", "__v", "rule", *hits)
