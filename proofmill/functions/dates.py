"""Dates written in many ways: native for the usual forms, a vectorised parser for the rest."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?|(?:0?\d|1[0-2]):[0-5]\d(?::[0-5]\d)?\s*[AP]M"
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_GAP = r"(?:\s*[-/.,]\s*|\s+)"
_PART = r"0?[1-9]|[12]\d|3[01]"
_YEAR_FIRST = rf"(\d{{4}})([-/.])({_PART})\2({_PART})"
_DAY_FIRST = rf"({_PART})([-/.])({_PART})\2(\d{{4}})"
#: Forms that need more than their parts put in another order.
_OTHERS = (
    r"(?<y2>\d{4})(?<p2>0[1-9]|[12]\d|3[01])(?<q2>0[1-9]|[12]\d|3[01])",
    rf"(?<a>{_PART})(?<s>[-/.])(?<b>{_PART})\k<s>(?<y3>\d{{2}})",
    rf"(?<d4>{_PART})(?:st|nd|rd|th)?{_GAP}(?<m4>{_MONTHS}){_GAP}(?<y4>\d{{4}}|\d{{2}})",
    rf"(?<m5>{_MONTHS}){_GAP}(?<d5>{_PART})(?:st|nd|rd|th)?{_GAP}(?<y5>\d{{4}}|\d{{2}})",
)


def _whole(*forms: str) -> str:
    """A pattern for texts that hold a date in one of the forms, with a time of day after it or not."""
    return rf"(?i)^\s*(?:{'|'.join(forms)})(?:[T ]\s*(?:{_CLOCK}))?\s*$"


_NATIVE = _whole(_YEAR_FIRST, _DAY_FIRST.replace(r"\2", r"\6"), *_OTHERS)
#: One pass over a text gives what stands in any form: year, sign and parts of dates that begin with their year; parts and year of
#: those that end with it; then of the others the year and parts, parts, year, day and month name. All are blank for other texts.
_PARTS = "$1|$2|$3|$4|$5|$7|$8|${y2}|${p2}|${q2}|${a}|${b}|${y3}${y4}${y5}|${d4}${d5}|${m4}${m5}"
_SPLIT = rf"(?s){_NATIVE}|^.*$"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")).try_cast("date")


def native_date(x: Column, iso_day_first: bool) -> Column:
    """Dates in digits, with or without separators, or with the month's name; null for all other texts.

    The day comes first, and gives way where the month would pass 12. Behind a leading year too: ``2025/10/05`` is
    the tenth of May, and ``iso_day_first`` says whether ``2025-10-05`` is as well, as the verification rules
    have it; the identity rules read it as the fifth of October. A year of two digits lies within fifty years.
    """

    def read(parts: Column) -> Column:
        part = lambda i: F.get(parts, i)
        number = lambda i: part(i).try_cast("int")
        plain = lambda *at: F.concat_ws("-", *(part(i) for i in at)).try_cast("date")
        year = F.when(F.length(part(12)) == 4, number(12)).when(2000 + number(12) >= F.year(F.current_date()) + 50, 1900 + number(12)).otherwise(2000 + number(12))
        month = ((F.position(F.lower(F.substring(part(14), 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int")
        day_first = plain(0, 3, 2) if iso_day_first else F.when(part(1) != "-", plain(0, 3, 2))
        return (
            F.when(part(0) != "", F.coalesce(day_first, plain(0, 2, 3)))
            .when(part(6) != "", F.coalesce(plain(6, 5, 4), plain(6, 4, 5)))
            .when(part(14) != "", _date(year, month, number(13)))
            .when(part(8) != "", F.when(number(9) <= 12, _date(number(7), number(9), number(8))).otherwise(_date(number(7), number(8), number(9))))
            .when((number(10) > 12) | (number(11) <= 12), _date(year, number(11), number(10)))
            .when(part(10) != "", _date(year, number(10), number(11)))
        )

    return let(F.split(F.regexp_replace(x.cast("string"), _SPLIT, _PARTS), "[|]"), read)


@F.pandas_udf(T.DateType())
def _free_text(texts: pd.Series, iso_day_first: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(t: str | None, day_first: bool):
        if not t:
            return None
        try:
            return parser.parse(t, dayfirst=bool(day_first) or not re.match(r"\s*\d{4}-\d{1,2}-\d{1,2}", t), fuzzy=True).date()
        except Exception:
            return None

    return pd.Series([one(t, d) for t, d in zip(texts, iso_day_first)], dtype=object)


_free_text = _free_text.asNondeterministic()  # it reads the clock; so, too, no plan evaluates it twice


def parse_date(x: Column, fuzzy: bool = True, iso_day_first: bool = True) -> Column:
    """The date in ``x``. Unless ``fuzzy`` is off, what the native forms cannot read goes to a parser of free text.

    That parser fills missing parts from the current day. Rows in a native form reach it as nulls.
    """
    native = native_date(x, iso_day_first)
    return F.coalesce(native, _free_text(F.when(~x.cast("string").rlike(_NATIVE), x.cast("string")), F.lit(iso_day_first))) if fuzzy else native


def pay_month(x: Column, fuzzy: bool = True) -> Column:
    """``YYYY-MM`` of a payment date, ISO dates read as written."""
    return F.date_format(parse_date(x, fuzzy, iso_day_first=False), "yyyy-MM")
