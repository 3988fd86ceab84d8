"""Is a document a payment proof, by which method, and which way did the money go?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

#: Texts that mark payment evidence, in order; substrings, not words.
MARKERS = (
    "paid", "successful", "payment receipt", "amount paid", "txn", "utr", "rrn", "reference", "receipt no", "receipt number",
    "debited", "credited", "transaction id", "paid to", "payment of", "amount", "rs.", "inr", "₹", "no dues", "no due",
    "no objection", "noc", "fully paid", "loan closed", "loan closure", "account closed", "closure", "foreclosure", "settled",
    "no outstanding", "outstanding is nil", "cleared", "fully repaid",
)

#: Fields that are evidence by themselves.
EVIDENCE = ("amount", "reference_id", "loan_account_number")

#: Words in the document type, then in the text, that name a payment method; the first hit counts.
TYPE_METHODS = (
    ("PhonePe", ("phonepe",)), ("Google Pay", ("gpay", "google")), ("Paytm", ("paytm",)), ("Cash Receipt", ("cash",)),
    ("Bank Transfer (NEFT/IMPS/RTGS)", ("neft", "imps", "rtgs")), ("Cheque", ("cheque",)),
)
TEXT_METHODS = (
    ("PhonePe", ("phonepe", "phon epe", "@ybl", "ppe")),
    ("Google Pay", ("google pay", "gpay", "g pay", "@okaxis", "@oksbi", "@okhdfcbank", "@okicici")),
    ("Paytm", ("paytm", "@paytm", "ptm")),
    ("Amazon Pay", ("amazon pay", "amazonpay")),
    ("BHIM UPI", ("bhim", "@upi")),
    ("Cred", ("cred ",)),
    ("Bharat Connect (BBPS)", ("bharat connect", "bbps", "bharatbillpay")),
    ("Bank Transfer (NEFT/IMPS/RTGS)", ("neft", "imps", "rtgs", "fund transfer")),
    ("Cash Receipt", ("cash receipt", "mode of payment : cash", "mode of payment cash", "paid by cash")),
    ("Cheque", ("cheque", "chq no")),
    ("e-NACH", ("e-nach", "enach", "e nach", "auto debit", "mandate")),
)

#: Phrases of money coming in, and those of a payment going out that outweigh them.
INCOMING = (
    "credited to your account", "credited to your a/c", "credited to your acc", "credited in your account", "credited to your saving",
    "credited to your bank", "amount credited to your", "received in your account", "has been credited to your",
)
OUTGOING = (
    "debited", "debit", "paid to", "amount paid", "you paid", "you have paid", "payment to", "payment of", "sent to", "transferred to",
    "paid successfully", "paid rs", "paid inr", "debited from",
)


def _has(low: Column, words: tuple[str, ...]) -> Column:
    """Does a text have one of the words? ``low`` is a name bound by ``text.let``, so that it is lower-cased once."""
    return F.exists(F.array(*map(F.lit, words)), lambda m: F.contains(low, m))


def _low(x: Column) -> Column:
    return F.lower(F.coalesce(x.cast("string"), F.lit("")))


def markers(full_text: Column) -> Column:
    return text.let(_low(full_text), lambda low: F.filter(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(low, m)))


def evidence_fields(columns: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(text.present(columns[c]), F.lit(c)) for c in EVIDENCE if c in columns)))


def is_candidate(full_text: Column, columns: dict[str, Column]) -> Column:
    """Payment content in the text or a hard field; what a model says about the image does not count."""
    fields = [text.present(columns[c]) for c in EVIDENCE if c in columns]
    out = text.let(_low(full_text), lambda low: _has(low, MARKERS))
    for f in fields:
        out = out | f
    return out


def stage_two(document_type: Column, full_text: Column, describes: Column, fields: dict[str, Column]) -> Column:
    """``struct(is_document, reason, payment_method, text_len, markers, fields)``: what the classification stage says of an extraction."""
    found = F.struct(markers(full_text).alias("markers"), evidence_fields(fields).alias("fields"))

    def say(e: Column) -> Column:
        some, hard = F.size(e["markers"]) > 0, F.size(e["fields"]) > 0
        parts = F.array_compact(F.array(F.when(hard, F.concat(F.lit("fields:"), F.array_join(e["fields"], ","))), F.when(some, F.concat(F.size(e["markers"]).cast("string"), F.lit(" text marker(s)")))))
        filled = lambda x: F.nullif(x.cast("string"), F.lit(""))
        other = F.coalesce(filled(describes), filled(document_type), F.lit("no payment content"))
        reason = F.when(some | hard, F.concat(F.lit("payment document ("), F.array_join(parts, "; "), F.lit(")"))).otherwise(
            F.concat(F.lit("non-document — no payment evidence ("), other, F.lit(")")))
        return F.struct((some | hard).alias("is_document"), reason.alias("reason"), e["markers"].alias("markers"), e["fields"].alias("fields"))

    v = text.let(found, say)
    return text.let(v, lambda x: F.struct(
        x["is_document"].alias("is_document"), x["reason"].alias("reason"), payment_method(document_type, full_text).alias("payment_method"),
        F.length(F.coalesce(full_text, F.lit(""))).alias("text_len"), x["markers"].alias("markers"), x["fields"].alias("fields"),
    ))


def payment_method(document_type: Column, full_text: Column) -> Column:
    def named(v: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for where, table in ((v["kind"], TYPE_METHODS), (v["low"], TEXT_METHODS)):
            for label, words in table:
                out = out.when(_has(where, words), label)
        return out.otherwise("Other")

    return text.let(F.struct(_low(document_type).alias("kind"), _low(full_text).alias("low")), named)


def incoming_credit(full_text: Column) -> Column:
    return text.let(_low(full_text), lambda low: _has(low, INCOMING) & ~_has(low, OUTGOING))


def precomputed(ex=lambda c: F.col(c)) -> list[Column]:
    """Extraction columns from ``ex_*`` columns that came with the row."""
    get = lambda c: F.when(~F.coalesce(ex(c), F.lit("")).isin("", "None", "nan"), ex(c))
    receipt = F.lower(F.coalesce(ex("ex_is_receipt"), F.lit(""))).isin("true", "1")
    return [
        receipt.alias("is_payment_document"),
        F.when(receipt, "").otherwise(F.coalesce(get("ex_doc_type"), F.lit("non-payment image"))).alias("describes"),
        F.coalesce(get("ex_doc_type"), F.lit("other")).alias("document_type"),
        get("ex_loan_id").alias("loan_account_number"), get("ex_amount").alias("amount"), get("ex_date").alias("date"),
        get("ex_ref_id").alias("reference_id"), get("ex_receiver_name").alias("receiver_name"), get("ex_payer_name").alias("payer_name"),
        F.coalesce(get("ex_full_text"), F.lit("")).alias("full_text"),
    ]


#: Fields of a model's answer whose blank words count as missing.
FIELDS = ("loan_account_number", "amount", "date", "time", "reference_id", "receiver_name", "payer_name")


def coerce_model_output(content: Column) -> Column:
    """The JSON object inside a model's answer as a struct of texts; answers without one keep 500 characters of text.

    ``is_payment_document`` is the model's word as it stands (``true``, ``yes``): no decision rests on it.
    """
    body = F.nullif(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    v = F.try_parse_json(body)
    read = lambda n, kind="string": F.try_variant_get(v, f"$.{n}", kind)
    clean = lambda n: F.when(~read(n).isin("null", "", "None"), read(n)).alias(n)
    why = F.when(body.isNull(), "unreadable model output").when(v.isNull(), "unparseable model output")
    raw = F.substring(F.coalesce(content, F.lit("")), 1, 500)
    return F.struct(
        F.coalesce(read("is_payment_document"), F.lit("false")).alias("is_payment_document"),
        F.coalesce(why, read("describes")).alias("describes"),
        F.when(why.isNotNull(), "other").otherwise(read("document_type")).alias("document_type"),
        *(clean(n) for n in FIELDS),
        F.when(why.isNotNull(), raw).otherwise(F.coalesce(read("full_text"), F.lit(""))).alias("full_text"),
    )


def field_labels(doc: dict[str, Column], sys_lan: Column, sys_amount: Column) -> Column:
    """Map of field to ``struct(value, label, matches_system)`` for what the document shows."""
    d, s = text.digits(doc["loan_account_number"]), text.digits(sys_lan)
    a, b = text.num(doc["amount"]), text.num(sys_amount)
    lan = (s != "") & (F.contains(d, s) | F.contains(s, d))
    near = F.coalesce(F.abs(a - b) <= 1.0, F.lit(False))
    none = F.lit(None).cast("boolean")
    shown = lambda n, ok, when: F.when(when, F.struct(F.lit(n).alias("key"), F.struct(doc[n].alias("value"), F.lit(n).alias("label"), ok.alias("matches_system")).alias("value")))
    filled = lambda n: F.coalesce(doc[n], F.lit("")) != ""
    entries = [shown("loan_account_number", lan, d != ""), shown("amount", near, a.isNotNull())]
    entries += [shown(n, none, filled(n)) for n in ("date", "reference_id", "receiver_name") if n in doc]
    return F.map_from_entries(F.array_compact(F.array(*entries)))
