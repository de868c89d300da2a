"""Calendar arithmetic with the reference's (T-SQL flavoured) semantics.

* ``DATEDIFF(day, a, b)``  -> whole 24-hour periods (``timestampdiff(DAY)``)
* ``DATEDIFF(month, a, b)`` -> whole elapsed months (``timestampdiff(MONTH)``:
  01-31 -> 02-29 is 0)
* ``DATEADD(month, n, t)`` -> month arithmetic clamped to month end
* ``DATE_TRUNC``           -> kept as ``timestamp_ntz`` so it compares with
  the NTZ order timestamps without a session-zone shift.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(value: dt.datetime | dt.date | str) -> Column:
    """A ``timestamp_ntz`` literal (the order timestamps are NTZ)."""
    if isinstance(value, dt.datetime):
        s = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, dt.date):
        s = value.strftime("%Y-%m-%d 00:00:00")
    else:
        s = value
    return F.lit(s).cast("timestamp_ntz")


def day_diff(start: Column | str, end: Column | str) -> Column:
    """Whole days between two instants (3-arg DATEDIFF(day, ...))."""
    return F.timestamp_diff("DAY", _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz"))


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Whole elapsed months between two instants (DATEDIFF(month, ...))."""
    return F.timestamp_diff("MONTH", _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz"))


def add_months_ts(ts: Column | str, months: int) -> Column:
    """DATEADD(month, n, ts) on a timestamp, clamped to month end."""
    return F.timestamp_add("MONTH", F.lit(months), _c(ts))


def trunc_ts(unit: str, ts: Column | str) -> Column:
    """DATE_TRUNC(unit, ts) returning ``timestamp_ntz``."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")
