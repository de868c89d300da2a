"""Money and revenue column expressions.

Money is ``decimal(12,2)`` end to end (the reference's ``float`` prices give
``3.3000000715``-style sums); results are cast to ``double`` only at the
report boundary, from an exact decimal, so every engine lands on the same
double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
RATE = "decimal(10,2)"


def revenue_cents(qty: str = "Quantity", price: str = "UnitPrice") -> Column:
    """Line revenue ``Quantity * UnitPrice`` in integer cents (long arithmetic, exact).

    ``int x decimal(12,2)`` would be ``decimal(23,2)``, beyond the 18 digits that
    Spark keeps in a long, so arithmetic per row would run on BigDecimal."""
    return F.col(qty).cast("long") * units(price)


def money_from_cents(c: Column) -> Column:
    """Integer cents -> ``decimal(38,2)`` (applied to aggregated rows only)."""
    return (c.cast("decimal(38,0)") / F.lit(100)).cast("decimal(38,2)")


def sum_revenue(condition: Column | None = None) -> Column:
    """``SUM(Quantity * UnitPrice)`` [optionally ``WHEN condition``] as an exact
    ``decimal(38,2)``: summed as long cents, converted once per group."""
    c = revenue_cents()
    if condition is not None:
        c = F.when(condition, c)
    return money_from_cents(F.sum(c))


def unit_price_from_extended(extended: str, quantity: str) -> Column:
    """Exact-cent unit price from an extended line amount.

    ``round_half_up(cents(extended) / qty)`` in integer arithmetic, so the
    result never depends on binary floating point beyond the one cent
    conversion of the input.
    """
    # floor(x + 0.5): the nearest cent of a 2-decimal amount without the
    # BigDecimal path of round(double); decimal(12,0) x decimal(2,2) stays
    # within Spark's long-backed decimals.
    cents = f"cast(floor(`{extended}` * 100 + 0.5) as bigint)"
    q = f"nullif(cast(`{quantity}` as bigint), 0)"
    unit_cents = F.expr(f"(2 * {cents} + {q}) div (2 * {q})")
    return (unit_cents.cast("decimal(12,0)") * F.lit(0.01).cast("decimal(2,2)")).cast(MONEY)


def half_up_div(a: str, b: str) -> Column:
    """``round_half_up(a / b)`` for integral SQL expressions ``a``, ``b`` (b >= 0).

    Integer arithmetic only, so the value is identical on every engine and
    independent of summation order; NULL when ``b`` is 0 or NULL.
    """
    a = f"cast({a} as decimal(38,0))"
    b = f"nullif(cast({b} as decimal(38,0)), 0)"
    return F.expr(
        f"case when {a} < 0 then -((2 * abs({a}) + {b}) div (2 * {b})) "
        f"else (2 * {a} + {b}) div (2 * {b}) end"
    )


def exact_avg(sum_units: str, count: str, in_scale: int = 2, out_scale: int = 2) -> Column:
    """Average of a decimal column from its exact unit sum and row count.

    ``sum_units`` = SUM(x * 10^in_scale) (an integer), ``count`` = COUNT(x).
    Rounded half-up to ``out_scale`` decimals. With ``out_scale = in_scale +
    4`` this is Spark's own ``AVG(decimal)`` result type; with 2 it is
    ``ROUND(AVG(x), 2)`` on the exact mean.
    """
    shift = out_scale - in_scale
    q = half_up_div(f"({sum_units}) * {10 ** shift}", count)
    return scaled_decimal(q, out_scale)


def scaled_decimal(units: Column, scale: int) -> Column:
    """``units * 10^-scale`` as an exact ``decimal(38, scale)``.

    Dividing a ``decimal(38,0)`` (or multiplying it by ``decimal(s,s)``)
    overflows Spark's 38 digits, and the overflow rule then caps the result
    scale at 6. ``decimal(37-s, 0) x decimal(s, s)`` is exactly 38 digits, so
    the full scale survives.
    """
    if scale == 0:
        return units.cast("decimal(38,0)")
    unit = F.lit(f"1E-{scale}").cast(f"decimal({scale},{scale})")
    return (units.cast(f"decimal({37 - scale},0)") * unit).cast(f"decimal(38,{scale})")


def units(c: str | Column, scale: int = 2) -> Column:
    """Exact integer units of a decimal value (``x * 10^scale``) as long."""
    c = F.col(c) if isinstance(c, str) else c
    return (c * F.lit(10 ** scale)).cast("long")
