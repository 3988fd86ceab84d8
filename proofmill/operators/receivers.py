"""Which accepted name a payee, a payment handle or a text carries: equality lookups, never every name for every lead.

Each different payee of a lender is matched once. Misspelt tokens meet in a deletion-neighbourhood index: two words within
``k`` edits have a string in common that each reaches by deleting ``k`` letters at most, so the strings left by deletions are
joined and the few pairs that meet are verified. Names inside payees, and payees inside names, meet in their short beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..sources.scratch import materialise

#: Letters of the beginnings by which one name is looked for inside another.
GRAM = 4

#: Answers are broadcast below so many bytes, counting as many for each besides its question.
ANSWERS, ROW_BYTES = 16 << 20, 400


def deleted(word: Column, most: int) -> Column:
    """What is left of ``word`` after deleting up to ``most`` of its letters, itself included."""
    out = level = F.array(word)
    for _ in range(most):
        one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out = F.array_union(out, level)
    return out


def grams(value: Column, most: int = GRAM) -> Column:
    """All different substrings of one to ``most`` letters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - n + 1, F.lit(1))), lambda i: F.substr(value, i, F.lit(n)))
    return F.filter(F.array_distinct(F.flatten(F.array(*(of(n) for n in range(1, most + 1))))), lambda g: g != "")


def accepted_names(lenders: DataFrame, known: DataFrame) -> DataFrame:
    """``lender, rank, own, name, norm``: in order of preference the names of every lender in ``lenders(lender)``: its own, then those of ``known(lender, receivers)``."""
    pool = lenders.join(known.where("lender <> '__default__'").select("lender", "receivers"), "lender", "left")
    own, allow = names.self_names(F.col("lender")), F.coalesce("receivers", F.array().cast("array<string>"))
    each = lambda of, own: F.transform(of, lambda n: F.struct(F.lit(own).alias("own"), n.alias("name")))
    rows = pool.select("lender", F.posexplode(F.concat(each(own, True), each(allow, False))).alias("rank", "n")).select("lender", "rank", "n.own", "n.name")
    return rows.withColumn("norm", text.norm_name(F.col("name"))).where("norm <> ''")


def payee_hits(payees: DataFrame, accepted: DataFrame) -> DataFrame:
    """``lender, cand, own_name, allowed_name``: the first names of both kinds that a normalised payee fits, of ``payees(lender, cand)``.

    A payee fits by containment either way, or by one distinctive token of the name that one of its own is near to
    (:func:`names.token_match`). Payees that fit no name are left out.
    """
    payees = payees.where("cand <> ''").distinct()
    name = ["lender", "rank", "own", "name", "norm"]
    tokens = accepted.select("*", F.explode(names.distinctive(F.col("norm"))).alias("token"))
    size = F.length("token")
    edits = F.when(size >= 8, deleted(F.col("token"), 2)).when(size >= 4, deleted(F.col("token"), 1)).otherwise(F.array("token"))
    index = tokens.select(*name, "token", F.explode(edits).alias("left"))
    # A token of more letters than the lender's longest and two is near to none of them.
    longest = tokens.groupBy("lender").agg((F.max(size) + 2).alias("longest"))
    parts = payees.select("lender", "cand", F.explode(F.array_distinct(F.split("cand", " "))).alias("part")).join(longest, "lender").where(F.length("part") <= F.col("longest"))
    asked = parts.select("lender", "cand", "part", F.explode(F.when(F.length("part") >= 6, deleted(F.col("part"), 2)).otherwise(deleted(F.col("part"), 1))).alias("left"))
    near = asked.join(index, ["lender", "left"]).where(names.token_match(F.col("token"), F.col("part")))
    inside = payees.withColumn("gram", F.substring("cand", 1, GRAM)).join(accepted.select(*name, F.explode(grams(F.col("norm"))).alias("gram")), ["lender", "gram"]).where(F.contains("norm", "cand"))
    around = payees.select("lender", "cand", F.explode(grams(F.col("cand"))).alias("gram")).join(accepted.withColumn("gram", F.substring("norm", 1, GRAM)), ["lender", "gram"]).where(F.contains("cand", "norm"))
    hits = near.select("lender", "cand", "rank", "own", "name")
    for more in (inside, around):
        hits = hits.unionByName(more.select(hits.columns))
    first = lambda when: F.min_by("name", F.when(when, F.col("rank")))
    return hits.groupBy("lender", "cand").agg(first(F.col("own")).alias("own_name"), first(~F.col("own")).alias("allowed_name"))


def handle_hits(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """``lender, handles, handle_name, handle``: the first name that one of the payment handles in ``found(lender, handles)`` carries.

    The segments of handles meet the names in their whole distinctive tokens; the full pattern is verified
    (:func:`names.name_pattern`).
    """
    found = found.where(F.size("handles") > 0).distinct()
    each = found.select("lender", "handles", F.posexplode("handles").alias("place", "handle"))
    local = F.element_at(F.split("handle", "@"), 1)
    parts = each.select("*", F.explode(F.array_distinct(F.split(local, "[._-]"))).alias("part"))
    sizes = F.sequence(F.lit(3), F.greatest(F.length("part"), F.lit(3)))
    pieces = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("part") - n + 1, F.lit(1))), lambda i: F.substr("part", i, n))))
    asked = parts.select("lender", "part", F.explode(F.array_distinct(pieces)).alias("token")).distinct()
    index = accepted.select("lender", "rank", "name", "norm", F.explode(names.distinctive(F.col("norm"))).alias("token"))
    met = asked.join(index, ["lender", "token"]).select("lender", "part", "rank", "name", "norm").distinct()
    fits = met.where(F.rlike("part", names.name_pattern(F.col("norm")))).select("lender", "part", "rank", "name")
    best = F.min(F.struct("rank", "place", "name", "handle")).alias("best")
    return parts.join(fits, ["lender", "part"]).groupBy("lender", "handles").agg(best).select("lender", "handles", F.col("best.name").alias("handle_name"), "best.handle")


def written_hits(texts: DataFrame, accepted: DataFrame) -> DataFrame:
    """``lender, body, written_name``: the first name, allowed ones before own ones, that stands as whole words in ``texts(lender, body)``.

    A text's words meet the names' first words; the rest of the name is verified.
    """
    texts = texts.where("body <> ''").distinct()
    words = texts.select("lender", "body", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    met = words.join(accepted.withColumn("word", F.element_at(F.split("norm", " "), 1)), ["lender", "word"]).where(names.word_in_text(F.col("norm"), F.col("body")))
    return met.groupBy("lender", "body").agg(F.min(F.struct("own", "rank", "name")).alias("best")).select("lender", "body", F.col("best.name").alias("written_name"))


def with_hits(leads: DataFrame, lenders: DataFrame, only: Column) -> DataFrame:
    """``leads`` with ``own_name, allowed_name, handle_name, handle, written_name`` where ``only`` is true; else nulls.

    Reads ``institute_name, doc_receiver, doc_text``. What is asked about a lead is its lender, payee, handles and, without a payee,
    text. Different questions are collected in one pass and written, each kind of name is matched to them once, and one join
    brings the answers back: a broadcast of up to ``ANSWERS`` bytes, as counted, so that the leads are not shuffled; else by shuffle.
    """
    c = F.col
    cand, asks = text.norm_name(c("doc_receiver")), F.coalesce(only, F.lit(False))
    question = F.struct(
        F.coalesce("institute_name", F.lit("")).alias("lender"), cand.alias("cand"), names.handles(c("doc_text")).alias("handles"), F.when(cand == "", text.norm_name(c("doc_text"))).alias("body"),
    )
    keyed = leads.withColumn("__asked", F.when(asks, question))
    asked = materialise(keyed.where("__asked IS NOT NULL").select("__asked").distinct())
    # Written, so that Spark knows its size when it plans the lookups.
    accepted = materialise(accepted_names(asked.select("__asked.lender").distinct(), lenders))
    found = asked.select("__asked", "__asked.*")
    for name, hits in (("cand", payee_hits), ("handles", handle_hits), ("body", written_hits)):
        of = asked.select("__asked.lender", f"__asked.{name}").where(c(name).isNotNull())
        found = found.join(hits(of, accepted), ["lender", name], "left")
    answers = materialise(found.select(c("__asked").alias("__key"), "own_name", "allowed_name", "handle_name", "handle", "written_name"))
    held = F.sum(ROW_BYTES + F.coalesce(F.octet_length(F.to_json("__key")), F.lit(0)))
    few = (answers.agg(held).first()[0] or 0) <= ANSWERS
    return keyed.join(answers.hint("broadcast" if few else "merge"), c("__asked") == c("__key"), "left").drop("__asked", "__key")
