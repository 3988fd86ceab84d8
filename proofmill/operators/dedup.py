"""Payment identity and its verdict under a total order: the same answers as a ledger claimed row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources.scratch import materialise

IDENTITY = ("lead_code", "loan_acct", "amount", "pay_ym")


def with_identity(leads: DataFrame, fuzzy_dates: bool = True) -> DataFrame:
    """Add ``identity``: a struct of the four parts, null if one is missing."""
    parts = {
        "lead_code": F.nullif(text.strip(F.col("lead_code")), F.lit("")), "loan_acct": F.nullif(text.loan_key(F.col("loan_account_number")), F.lit("")),
        "amount": text.amount(F.col("payment_amount")), "pay_ym": dates.pay_month(F.col("payment_date"), fuzzy_dates),
    }
    whole = lambda i: F.when(reduce(lambda a, b: a & b, [i[n].isNotNull() for n in IDENTITY]), i)
    return leads.withColumn("identity", text.let(F.struct(*(p.alias(n) for n, p in parts.items())), whole))


def identity_text(identity: str = "identity") -> Column:
    """The identity as people read it; blank if there is none."""
    return F.when(F.col(identity).isNull(), "").otherwise(F.concat_ws(" | ", *(F.col(f"{identity}.{n}").cast("string") for n in IDENTITY)))


def ledger_rows(jobs: DataFrame, results: DataFrame, order: str = "seq") -> DataFrame:
    """``lead_id, is_test`` and the identity's parts of the claims that processed real leads make: the first lead of each identity.

    ``jobs`` has the leads' columns; :func:`dedup_verdicts` takes the result as its ``ledger``.
    """
    done = results.where("NOT is_test").select("lead_id")
    known = with_identity(jobs.where("NOT is_test").join(done, "lead_id", "left_semi")).where("identity IS NOT NULL")
    first = F.min_by("lead_id", F.struct(F.col(order), F.col("lead_id"))).alias("lead_id")
    return known.select("lead_id", "is_test", F.col(order), "identity.*").groupBy("is_test", *IDENTITY).agg(first).select("lead_id", "is_test", *IDENTITY)


def dedup_verdicts(leads: DataFrame, ledger: DataFrame | None = None, order: str = "seq", fuzzy_dates: bool = True) -> DataFrame:
    """Add ``dedup`` (skip, new, duplicate, emi, manual_review) and ``owner``, the first lead of the identity.

    Leads count in the order of ``order``, then ``lead_id``, within real and test rows apart. ``ledger`` holds
    earlier claims (``lead_id, is_test`` and the identity's parts); a lead never meets its own earlier claim.
    The first claim of each identity, loan and lead code are minima, so they are aggregated before the
    shuffle; one join brings them back, and Spark splits it where an identity is very common. The leads with
    their identities are written once, as several steps read them.
    """
    df = materialise(with_identity(leads, fuzzy_dates))
    whole = df.where("identity IS NOT NULL")
    place = lambda turn: F.struct(F.lit(turn).alias("turn"), F.col(order).cast("long").alias("seq"), "lead_id")
    known = whole.select("is_test", "identity.*", place(1).alias("at"))
    if ledger is not None:
        old = ledger.join(whole.select("lead_id").distinct(), "lead_id", "left_anti").withColumn(order, F.lit(0))
        known = known.unionByName(old.select("is_test", *IDENTITY, place(0).alias("at")))
    keys = ["is_test", *IDENTITY]
    firsts = known.groupBy(keys).agg(F.min("at").alias("of_identity"))
    loans = firsts.groupBy(keys[:3]).agg(F.min("of_identity").alias("of_loan"))
    codes = loans.groupBy(keys[:2]).agg(F.min("of_loan").alias("of_code"))
    # Only the first lead of an identity can be the first of a loan or code, so its verdict is known before the join with the leads.
    kind = F.when(F.col("of_identity") == F.col("of_code"), "new").when(F.col("of_identity") != F.col("of_loan"), "emi").otherwise("manual_review")
    firsts = firsts.join(loans.join(codes, keys[:2]), keys[:3])
    firsts = firsts.select(F.col("is_test").alias("__t"), F.struct(*IDENTITY).alias("__i"), "of_identity", kind.alias("kind"))
    at, same = place(1), (F.col("is_test") == F.col("__t"))
    for n in IDENTITY:
        same = same & (F.col(f"identity.{n}") == F.col(f"__i.{n}"))
    verdict = F.when(at != F.col("of_identity"), "duplicate").otherwise(F.col("kind"))
    judged = whole.join(firsts, same).withColumns({"dedup": verdict, "owner": F.col("of_identity.lead_id")})
    rest = df.where("identity IS NULL").withColumns({"dedup": F.lit("skip"), "owner": F.lit(None).cast("string")})
    return judged.select(rest.columns).unionByName(rest)


def runs(events: DataFrame, marker: str = "lead_received", order: str = "id") -> DataFrame:
    """Add ``run``: the log of a lead split at each ``marker``; what stands before the first belongs to run 1."""
    seen = F.sum(F.when(F.col("stage") == marker, 1).otherwise(0)).over(W.partitionBy("lead_id").orderBy(order))
    return events.withColumn("run", F.greatest(seen, F.lit(1)))
