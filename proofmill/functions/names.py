"""What names, payees and payment handles are made of, as native expressions; :mod:`proofmill.operators.receivers` matches them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_name

#: Words that carry no identity.
GENERIC = (
    "bank banking finance financial finserv fintech services service limited ltd "
    "pvt private company co corporation corp enterprises enterprise group india "
    "indian small credit card cards loan loans capital payment payments pay app "
    "technologies technology solutions international care and the of for"
).split()

#: Fixed value: a payment handle is a local part, ``@``, and a provider that no letter follows.
HANDLE = r"\b([a-z0-9][a-z0-9._-]{1,63})@([a-z][a-z0-9]{1,15})(?!\.?[a-z])"


def self_names(lender: Column) -> Column:
    """Names that a lender's own code suggests: all of it and its first part, if four letters or longer."""
    code = F.trim(F.coalesce(lender, F.lit("")))
    both = F.array(F.replace(code, F.lit("_"), F.lit(" ")), F.element_at(F.split(code, "_"), 1))
    long = F.filter(both, lambda x: F.length(norm_name(x)) >= 4)
    return F.when(norm_name(F.get(long, 0)) == norm_name(F.get(long, 1)), F.slice(long, 1, 1)).otherwise(long)


def distinctive(name: Column) -> Column:
    """Tokens of a normalised name that can carry a match."""
    return F.filter(F.split(name, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*GENERIC))


def token_match(accepted: Column, token: Column) -> Column:
    """Equal, or within one typo from four letters on, two from eight."""
    return F.when(F.length(accepted) >= 8, F.levenshtein(accepted, token, 2) >= 0).when(
        F.length(accepted) >= 4, F.levenshtein(accepted, token, 1) >= 0
    ).otherwise(accepted == token)


def word_in_text(name: Column, text: Column) -> Column:
    """A normalised name as whole words of a normalised text."""
    return (name != "") & (text != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" ")))


def handles(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(HANDLE), F.lit(0)))


def name_pattern(n: Column) -> Column:
    """A pattern for handle segments that consist of the name's tokens, their beginnings and digits, with one distinctive token whole.

    ``n`` is a normalised name.
    """
    starts = lambda t: F.transform(F.sequence(F.least(F.lit(3), F.length(t)), F.length(t)), lambda i: F.substr(t, F.lit(1), i))
    pieces = F.array_join(F.array_distinct(F.flatten(F.transform(F.filter(F.split(n, " "), lambda t: t != ""), starts))), "|")
    own = F.array_join(distinctive(n), "|")
    piece = F.concat(F.lit("(?:"), pieces, F.lit("|[0-9])*"))
    return F.when(own != "", F.concat(F.lit("^"), piece, F.lit("(?:"), own, F.lit(")"), piece, F.lit("$")))
