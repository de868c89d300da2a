"""Calendar dimensions, generated on the executors.

``dim_date`` replaces the reference's driver-side Python row generator
(``week_of_month`` / ``date_data`` + ``createDataFrame``) with
``spark.range`` + column expressions, so the rows are produced in parallel
and nothing passes through the driver.

Decisions against the reference's quirks (see README):
* inclusive ``start``/``end`` (the reference starts one day late and ends on
  2029-10-30 because it steps 364 days a year);
* ``LastDayOfQuarter`` is the real quarter end (the reference returns the
  last day of the quarter's second month);
* ``DOWInMonth`` is the n-th occurrence of that weekday in the month,
  ``ceil(day / 7)`` (the reference stores WeekOfMonth twice);
  ``reference_dow_in_month=True`` restores the stored-twice behaviour.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Quarter names and the default calendar range.
QUARTER_NAMES = ["First", "Second", "Third", "Fourth"]
DEFAULT_START = dt.date(1980, 1, 1)
DEFAULT_END = dt.date(2029, 12, 31)


def date_attributes(dates: DataFrame, run_date: str, reference_dow_in_month: bool = False) -> DataFrame:
    """All dim_date columns for a frame with one ``date`` column."""
    d = F.col("date")
    first_of_month = F.trunc(d, "month")
    quarter = F.quarter(d)
    first_of_quarter = F.trunc(d, "quarter")
    week_of_month = F.ceil((F.dayofmonth(d) + F.weekday(first_of_month)) / 7).cast("int")
    dow_in_month = week_of_month if reference_dow_in_month else F.ceil(F.dayofmonth(d) / 7).cast("int")
    qnames = F.array(*[F.lit(q) for q in QUARTER_NAMES])
    stamp = F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")
    return dates.select(
        F.date_format(d, "yyyyMMdd").alias("DateKey"),
        d,
        F.dayofmonth(d).alias("day"),
        F.dayofweek(d).alias("Weekday"),  # Sunday = 1 .. Saturday = 7
        F.date_format(d, "EEEE").alias("WeekDayName"),
        (F.weekday(d) >= 5).alias("IsWeekend"),
        dow_in_month.alias("DOWInMonth"),
        F.dayofyear(d).alias("DayOfYear"),
        week_of_month.alias("WeekOfMonth"),
        F.weekofyear(d).alias("WeekOfYear"),  # ISO week
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("MonthName"),
        quarter.alias("Quarter"),
        F.element_at(qnames, quarter).alias("QuarterName"),
        F.year(d).alias("year"),
        F.date_format(d, "MMyyyy").alias("MMYYYY"),
        F.concat(F.date_format(d, "MMMM"), F.year(d).cast("string")).alias("MonthYear"),
        first_of_month.alias("FirstDayOfMonth"),
        F.last_day(d).alias("LastDayOfMonth"),
        first_of_quarter.alias("FirstDayOfQuarter"),
        F.date_sub(F.add_months(first_of_quarter, 3), 1).alias("LastDayOfQuarter"),
        F.trunc(d, "year").alias("FirstDayOfYear"),
        F.make_date(F.year(d), F.lit(12), F.lit(31)).alias("LastDayOfYear"),
        F.lit(run_date).alias("rundate"),
        stamp.alias("insert_dt"),
        stamp.alias("update_dt"),
    )


def dim_date(spark: SparkSession, start: dt.date = DEFAULT_START, end: dt.date = DEFAULT_END,
             run_date: str | None = None, reference_dow_in_month: bool = False) -> DataFrame:
    """Calendar rows for ``start..end`` inclusive, generated by ``spark.range``."""
    n = (end - start).days + 1
    dates = spark.range(0, n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    return date_attributes(dates, run_date or start.strftime("%Y%m%d"), reference_dow_in_month)


def dim_date_covering(fact: DataFrame, date_col: str = "LastEditedDate", run_date: str = "19000101") -> DataFrame:
    """Calendar of whole years covering the fact's dates (first Jan of the
    first year .. 31 Dec of the last). The span - not the data volume -
    sizes it, so the single-row ``sequence`` is bounded."""
    bounds = fact.agg(F.min(date_col).alias("__lo"), F.max(date_col).alias("__hi"))
    dates = bounds.select(F.explode(F.sequence(F.trunc("__lo", "year"),
                                               F.make_date(F.year("__hi"), F.lit(12), F.lit(31)))).alias("date"))
    return date_attributes(dates, run_date)


def report_calendar(fact: DataFrame, date_col: str = "LastEditedDate", forecast_years: int = 5) -> DataFrame:
    """Power-BI style ``DateTBL``: first fact date .. 31 Dec of (last year + 5).

    Bounds come from a one-row aggregate; the date span (not the data
    volume) sizes the output.
    """
    bounds = fact.agg(F.min(date_col).alias("__lo"), F.max(date_col).alias("__hi"))
    d = F.col("Date")
    return (
        bounds.select(
            F.explode(F.sequence(F.col("__lo"), F.make_date(F.year("__hi") + forecast_years, F.lit(12), F.lit(31)))).alias("Date"),
            F.col("__hi"),
        )
        .select(
            d,
            F.year(d).alias("Year"),
            F.month(d).alias("MonthNo"),
            F.date_format(d, "MMMM").alias("Month"),
            F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("Quarter"),
            F.date_format(d, "yyyy-MM").alias("YearMonth"),
            (F.year(d) * 100 + F.month(d)).alias("YearMonthNum"),
            F.date_sub(d, F.weekday(d)).alias("WeekStartMon"),
            F.trunc(d, "month").alias("MonthStart"),
            F.last_day(d).alias("MonthEnd"),
            (d <= F.col("__hi")).alias("IsActual"),
            (d > F.col("__hi")).alias("IsForecast"),
        )
    )
