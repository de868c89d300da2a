"""Distributed data-quality checks (replaces Great Expectations on a pandas copy).

The reference converts every frame to pandas on the driver and runs one
expectation at a time. Here:

* every row-level check (not null, max length, regex, between, > value,
  row count) is one conditional count inside a **single** ``df.agg`` pass;
* each uniqueness check is one ``groupBy(col).count()`` with map-side
  partial aggregation (a hot value is pre-counted per task, never gathered);
* in the jobs the same row counts are observed while a stage is written
  (``row_metrics``, ``from_metrics``), so that its input is evaluated once;
* schema checks (dtype, column exists, ordered column list) read metadata only.

The result is a lazy DataFrame ``(expectation, column, params, evaluated,
unexpected, success)``; ``all_passed`` is the one action that gates a load.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .share import attach_scalars

RESULT_SCHEMA = "expectation string, column string, params string, evaluated bigint, unexpected bigint, success boolean"

# The reference's timestamp-text and e-mail patterns.
TIMESTAMP_TEXT_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"


@dataclass(frozen=True)
class Check:
    kind: str  # unique | not_null | dtype | max_length | regex | between | greater_than
    #            | column_exists | columns_ordered | row_count
    column: str | None = None
    params: Mapping = field(default_factory=dict)

    def params_text(self) -> str:
        return json.dumps(dict(self.params), sort_keys=True, default=str)


def contract_checks(contract: Mapping[str, Mapping], expected_row_count: int | None = None,
                    check_ordered_columns: bool = True, enable_length_check: bool = False) -> list[Check]:
    """Checks for a contract ``{col: {size, dtype, unique, nullable}}``."""
    checks: list[Check] = []
    for col, props in contract.items():
        if props.get("unique", False):
            checks.append(Check("unique", col))
        if props.get("nullable", True) is False:
            checks.append(Check("not_null", col))
        if props.get("dtype"):
            checks.append(Check("dtype", col, {"type": props["dtype"]}))
        if enable_length_check and props.get("size") is not None:
            checks.append(Check("max_length", col, {"size": int(props["size"])}))
    if check_ordered_columns:
        checks.append(Check("columns_ordered", None, {"columns": list(contract)}))
    if expected_row_count is not None:
        checks.append(Check("row_count", None, {"value": int(expected_row_count)}))
    return checks


def _violation(ch: Check) -> Column | None:
    """Row-level predicate that marks an unexpected row (NULLs are not
    judged by value checks, as in GX)."""
    c = F.col(ch.column) if ch.column else None
    if ch.kind == "not_null":
        return c.isNull()
    if ch.kind == "max_length":  # strict upper bound
        return c.isNotNull() & (F.length(c.cast("string")) >= ch.params["size"])
    if ch.kind == "regex":
        return c.isNotNull() & ~c.cast("string").rlike(ch.params["pattern"])
    if ch.kind == "between":
        return c.isNotNull() & ~c.between(F.lit(ch.params["min"]), F.lit(ch.params["max"]))
    if ch.kind == "greater_than":
        return c.isNotNull() & (c <= F.lit(ch.params["value"]))
    return None


def _result(ch: Check, evaluated: Column, unexpected: Column, success: Column) -> Column:
    return F.struct(F.lit(ch.kind).alias("expectation"), F.lit(ch.column).cast("string").alias("column"),
                    F.lit(ch.params_text()).alias("params"), evaluated.cast("bigint").alias("evaluated"),
                    unexpected.cast("bigint").alias("unexpected"), success.alias("success"))


def _of_schema(ch: Check, columns: Sequence[str], schema: T.StructType) -> Column | None:
    """The result of a check that the schema alone decides, None for others."""
    missing = ch.column is not None and ch.column not in columns
    if ch.kind == "column_exists" or (missing and ch.kind != "dtype"):
        ok = not missing
        return _result(ch, F.lit(0), F.lit(0 if ok else 1), F.lit(ok))
    if ch.kind == "dtype":
        ok = not missing and type(schema[ch.column].dataType).__name__ == ch.params["type"]
        return _result(ch, F.lit(1), F.lit(0 if ok else 1), F.lit(ok))
    if ch.kind == "columns_ordered":
        ok = list(columns) == list(ch.params["columns"])
        return _result(ch, F.lit(len(columns)), F.lit(0 if ok else 1), F.lit(ok))
    return None


def _repeats(df: DataFrame, ch: Check, name: str) -> DataFrame:
    """One row: how many rows share their value with another. ``where`` (SQL)
    restricts the rows, ``within`` names columns that a value may repeat across."""
    rows = df.where(F.col(ch.column).isNotNull())
    if ch.params.get("where"):
        rows = rows.where(ch.params["where"])
    by = [F.col(ch.column).alias("__v"), *[F.col(c).alias(f"__w{k}") for k, c in enumerate(ch.params.get("within", ()))]]
    return (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > 1).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias(name)))


def _by_rows(ch: Check, columns: Sequence[str]) -> bool:
    return not (ch.column is not None and ch.column not in columns) and ch.kind not in (
        "unique", "row_count", "column_exists", "dtype", "columns_ordered")


def row_metrics(checks: Sequence[Check], columns: Sequence[str], judged: Column | None = None) -> list[Column]:
    """Aggregates that count the judged rows (``rows``) and, per row check i, the
    unexpected ones (``u<i>``); for an aggregate pass or ``DataFrame.observe``."""
    on = F.lit(True) if judged is None else judged
    out = [F.count_if(on).alias("rows")]
    for i, ch in enumerate(checks):
        if _by_rows(ch, columns):
            pred = _violation(ch)
            if pred is None:
                raise ValueError(f"unknown check {ch.kind}")
            out.append(F.count_if(on & pred).alias(f"u{i}"))
    return out


def _assemble(summary: DataFrame, checks: Sequence[Check], columns: Sequence[str], schema: T.StructType) -> DataFrame:
    """Result rows from one row that holds ``rows`` and the counts ``u<i>``."""
    results = []
    for i, ch in enumerate(checks):
        known = _of_schema(ch, columns, schema)
        if known is None and ch.kind == "row_count":
            n = F.lit(int(ch.params["value"]))
            known = _result(ch, F.col("rows"), F.abs(F.col("rows") - n), F.col("rows") == n)
        results.append(_result(ch, F.col("rows"), F.col(f"u{i}"), F.col(f"u{i}") == 0) if known is None else known)
    return summary.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def _uniques(checks: Sequence[Check], columns: Sequence[str]) -> list[tuple[int, Check]]:
    return [(i, ch) for i, ch in enumerate(checks) if ch.kind == "unique" and ch.column in columns]


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    if not checks:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    summary = df.agg(*row_metrics(checks, df.columns))
    for i, ch in _uniques(checks, df.columns):  # one-row frames
        summary = attach_scalars(summary, _repeats(df, ch, f"u{i}"))
    return _assemble(summary, checks, df.columns, df.schema)


def from_metrics(df: DataFrame, checks: Sequence[Check], metrics: Mapping[str, int], written: Callable[[], DataFrame],
                 judged: Column | None = None) -> list[tuple]:
    """The same results, as tuples in the order of ``RESULT_SCHEMA``, for rows that
    have been written under observation: row counts come from the metrics, and
    uniqueness from the written columns, all in one query."""
    columns, rows = list(df.columns), metrics.get("rows", 0)
    repeats: dict[int, int] = {}
    uniques = _uniques(checks, columns)
    if uniques and rows:
        src = written() if judged is None else written().where(judged)
        one = df.sparkSession.range(1).select(*[_repeats(src, ch, "n").scalar().alias(f"u{i}") for i, ch in uniques]).first()
        repeats = {i: one[f"u{i}"] for i, _ in uniques}
    out = []
    for i, ch in enumerate(checks):
        missing = ch.column is not None and ch.column not in columns
        if ch.kind == "dtype":
            evaluated, bad = 1, int(missing or type(df.schema[ch.column].dataType).__name__ != ch.params["type"])
        elif missing or ch.kind == "column_exists":
            evaluated, bad = 0, int(missing)
        elif ch.kind == "columns_ordered":
            evaluated, bad = len(columns), int(columns != list(ch.params["columns"]))
        elif ch.kind == "row_count":
            evaluated, bad = rows, abs(rows - int(ch.params["value"]))
        else:
            evaluated, bad = rows, repeats.get(i, 0) if ch.kind == "unique" else metrics.get(f"u{i}", 0)
        out.append((ch.kind, ch.column, ch.params_text(), evaluated, bad, bad == 0))
    return out


def all_passed(result: DataFrame) -> bool:
    """Gate: True when every check succeeded (one small action)."""
    bad = result.where(~F.col("success")).limit(1).count()
    return bad == 0
