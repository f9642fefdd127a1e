"""Dates in normalised text: numeric, then ISO, then spelled out; impossible ones are passed over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import EDGE_AFTER, EDGE_BEFORE, ascii_digits
from acervo.plans.rules import MONTHS

# The three forms.  The look ahead comes first, so that only digits are looked at closely.
NUMERIC = rf"(?=\d){EDGE_BEFORE}(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{2,4}}){EDGE_AFTER}"
ISO = rf"(?=\d){EDGE_BEFORE}(\d{{4}})-(\d{{2}})-(\d{{2}}){EDGE_AFTER}"
SPELLED = rf"(?=\d){EDGE_BEFORE}(\d{{1,2}}) de ({'|'.join(MONTHS)}) de (\d{{4}}){EDGE_AFTER}"


def _date(day: Column, month: Column, year: Column) -> Column:
    """ISO text of a date, or null; years under 100 are of this century."""
    y = year.cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(y > 0, F.date_format(iso.try_cast("date"), "yyyy-MM-dd"))


def _found(text: Column, pattern: str, make) -> Column:
    """Dates of a text whose digits are ASCII."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(hits, make), lambda d: d.isNotNull())


def _once(text: Column, make) -> Column:
    """What ``make`` gives for a text with ASCII digits, which are made once however often it uses them."""
    return F.get(F.transform(F.array(ascii_digits(text)), make), F.lit(0))


def _numeric(text: Column) -> Column:
    def make(hit: Column) -> Column:
        part = F.split(hit, "[/.-]")
        return _date(part[0], part[1], part[2])

    return _found(text, NUMERIC, make)


def _iso(text: Column) -> Column:
    def make(hit: Column) -> Column:
        part = F.split(hit, "-")
        return _date(part[2], part[1], part[0])

    return _found(text, ISO, make)


def month_number(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))]), name)


def _spelled(text: Column) -> Column:
    def make(hit: Column) -> Column:
        part = F.split(hit, " de ")
        return _date(part[0], month_number(part[1]), part[2])

    return _found(text, SPELLED, make)


def numeric_dates(text: Column) -> Column:
    return _once(text, _numeric)


def iso_dates(text: Column) -> Column:
    return _once(text, _iso)


def spelled_dates(text: Column) -> Column:
    return _once(text, _spelled)


def all_dates(text: Column) -> Column:
    return _once(text, lambda t: F.concat(_numeric(t), _iso(t), _spelled(t)))


def document_date(text: Column, default: Column | None = None) -> Column:
    """The first date of the text, or the default."""
    first = F.get(all_dates(text), F.lit(0))
    return first if default is None else F.coalesce(first, default)


def modified_date(moment: Column) -> Column:
    """ISO date of a moment in the session's time zone."""
    return F.date_format(moment, "yyyy-MM-dd")
