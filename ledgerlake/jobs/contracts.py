"""The checks that each hop runs on its write, unless a caller passes others."""

from __future__ import annotations

import datetime as dt

from ..operators.dq import EMAIL_PATTERN, TIMESTAMP_TEXT_PATTERN, Check, contract_checks
from ..schemas import BRONZE_CONTRACTS, DIMENSIONS, GOLD_FACT_CONTRACT, SILVER_NOT_NULL, dimension_contract
from ..sources.landing import SOURCE

# Fixed value: the earliest version start that silver accepts.
EARLIEST = dt.datetime(1980, 1, 1)


def _from_contract(contract: dict) -> list[Check]:
    return contract_checks(contract, check_ordered_columns=False)


def bronze_checks(table: str) -> list[Check]:
    """The landing contract; a key is unique within its file (files of one load are loads of their own at the source)."""
    checks = [Check("unique", c.column, {"within": [SOURCE]}) if c.kind == "unique" else c for c in _from_contract(BRONZE_CONTRACTS[table])]
    return [*checks, *(Check("column_exists", c) for c in BRONZE_CONTRACTS[table])]


def silver_checks(table: str, loaded: dt.datetime) -> list[Check]:
    if table == "orders":
        return [*(Check("not_null", c) for c in ("OrderID", "ProductID", "CustomerID")), Check("greater_than", "Quantity", {"value": 0})]
    key, stamps = DIMENSIONS[table]["key"], ("ValidFrom",)
    checks = [Check("unique", key), *(Check("not_null", c) for c in SILVER_NOT_NULL[table]), *(Check("column_exists", c) for c in SILVER_NOT_NULL[table]),
              *(Check("regex", c, {"pattern": TIMESTAMP_TEXT_PATTERN}) for c in stamps),
              *(Check("between", c, {"min": EARLIEST, "max": loaded}) for c in stamps)]
    return checks + ([Check("regex", "Email", {"pattern": EMAIL_PATTERN})] if table == "customers" else [])


def dimension_checks(table: str) -> list[Check]:
    """The gold contract of versions: one surrogate key each, and one active version per natural key."""
    return [*_from_contract(dimension_contract(table)), Check("unique", DIMENSIONS[table]["key"], {"where": "active_flg = 1"})]


def fact_checks() -> list[Check]:
    return _from_contract(GOLD_FACT_CONTRACT)
