"""Dates as ISO text with a precision: day, month or year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def of_arxiv(ident: Column) -> Column:
    """The month that an arXiv id names, as yyyy-mm; null for none."""
    return F.when(ident.rlike(r"^\d{2}(0[1-9]|1[0-2])\.\d{4,5}"), F.concat(F.lit("20"), F.substring(ident, 1, 2), F.lit("-"), F.substring(ident, 3, 2)))


def precision(date: Column) -> Column:
    return F.when(F.length(date) >= 10, F.lit("day")).when(F.length(date) >= 7, F.lit("month")).when(F.length(date) >= 4, F.lit("year"))


def dated(day: Column, source: Column, arxiv_id: Column, year: Column) -> Column:
    """date, precision, source: the earlier month of a source's day and an arXiv id (the day within the same month), else the year's first day, else empty."""
    month = F.concat(of_arxiv(arxiv_id), F.lit("-01"))
    one = lambda date, coarse, kind, of: F.struct(F.substring(date, 1, 7).alias("m"), F.lit(coarse).alias("coarse"), date.alias("date"), F.lit(kind).alias("precision"), of.alias("source"))
    real = F.array_min(F.array_compact(F.array(F.when(day.isNotNull() & source.isNotNull(), one(F.left(day, F.lit(10)), 0, "day", source)), F.when(month.isNotNull(), one(month, 1, "month", F.lit("arxiv_id"))))))
    some = lambda date, kind, of: F.struct(date.alias("date"), F.lit(kind).alias("precision"), F.lit(of).alias("source"))
    return (
        F.when(real.isNotNull(), F.struct(real["date"].alias("date"), real["precision"].alias("precision"), real["source"].alias("source")))
        .when(year.isNotNull(), some(F.concat(year.cast("string"), F.lit("-01-01")), "year", "year_fallback"))
        .otherwise(some(F.lit(""), "", ""))
    )


def resolve(day: Column, month: Column, year: Column) -> Column:
    """The earlier of a day and a month (a day within the month wins), else the year's first day, else empty."""
    options = F.array_compact(F.array(
        F.when(day.isNotNull(), F.struct(F.substring(day, 1, 7).alias("m"), F.lit(0).alias("coarse"), day.alias("date"))),
        F.when(month.isNotNull(), F.struct(month.alias("m"), F.lit(1).alias("coarse"), month.alias("date"))),
    ))
    return F.coalesce(F.array_min(options)["date"], F.concat(year.cast("string"), F.lit("-01-01")), F.lit(""))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 at the coarsest precision that both have."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.left(a, n), F.left(b, n)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def fractional_year(date: Column) -> Column:
    return F.year(date) + (F.month(date) - 1) / F.lit(12.0)
