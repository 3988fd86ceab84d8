"""Text, number and identifier normalisers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(\.[0-9]{1,2})?"
BLANKS = ("", "null", "none", "nan")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def present(x: Column) -> Column:
    """Neither null nor one of the blank words."""
    return x.isNotNull() & ~F.lower(strip(x)).isin(*BLANKS)


def norm_name(x: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(x.cast("string"), F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(low, " +", " "))


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)\D", "")


def number_text(x: Column) -> Column:
    """The first number, commas dropped, at most two decimals; null if there is none. A sign is dropped."""
    return F.nullif(F.regexp_extract(F.replace(x.cast("string"), F.lit(","), F.lit("")), NUMBER, 0), F.lit(""))


def num(x: Column) -> Column:
    return number_text(x).try_cast("double")


def amount(x: Column) -> Column:
    """The number as decimal(14,2)."""
    return number_text(x).try_cast("decimal(14,2)")


def loan_key(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[^A-Za-z0-9]", ""))


def is_number(x: Column) -> Column:
    return number_text(x).isNotNull()


def safe_identifier(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")


def is_url(x: Column) -> Column:
    return F.lower(strip(x)).rlike("^https?://")


def blob_sha(x: Column) -> Column:
    """The content hash of a ``blob:`` reference, else null."""
    return F.when(x.startswith("blob:"), F.substring(x, 6, 64))


def pct(n: Column, of: Column, places: int = 1) -> Column:
    """Percentage rounded to ``places``; null if there is nothing to divide by."""
    return F.round(F.lit(100.0) * n / F.nullif(of, F.lit(0)), places)


def redact(x: Column) -> Column:
    """All but the last four characters as bullets."""
    return F.concat(F.repeat(F.lit("•"), F.greatest(F.lit(0), F.length(x) - 4)), F.right(x, F.lit(4)))


def content_id(columns: list[str]) -> Column:
    """``LEAD-`` and twelve digits of the SHA-1 of the row as JSON with sorted keys."""
    def quoted(c: Column) -> Column:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.concat(F.lit('"'), c, F.lit('"'))

    parts = [F.concat(quoted(F.lit(c)), F.lit(": "), F.coalesce(quoted(F.col(c).cast("string")), F.lit("null"))) for c in sorted(columns)]
    return F.concat(F.lit("LEAD-"), F.substring(F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), 1, 12))


def as_object(x: Column) -> Column:
    """JSON text as a variant; blank and broken texts are an empty object."""
    return F.coalesce(F.try_parse_json(F.coalesce(F.nullif(x, F.lit("")), F.lit("{}"))), F.parse_json(F.lit("{}")))


def utc(x: Column) -> Column:
    """A time of day and date as text, to the second, in UTC (the session's time zone is UTC; texts without a zone count as UTC)."""
    return F.date_format(x.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
