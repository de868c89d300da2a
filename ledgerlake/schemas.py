"""Typed layouts of the landing files and layer tables, and DQ contracts.

Money is ``decimal(12,2)`` / ``decimal(10,2)`` where the reference used
``float`` (and the invalid ``float(10,2)``). Contract dictionaries follow the
reference's ``{column: {size, dtype, unique, nullable}}`` shape.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
RATE = T.DecimalType(10, 2)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# ---------------------------------------------------------------- landing CSV layouts
# ValidFrom / ValidTo arrive as text ("yyyy.MM.dd HH:mm:ss") and are parsed
# after the read, so an unparsable stamp is quarantined rather than nulled.
CUSTOMERS_CSV = _s(
    ("CustomerID", T.IntegerType(), False), ("CustomerFirstName", T.StringType(), False),
    ("CustomerLastName", T.StringType(), False), ("PhoneNumber", T.StringType(), False),
    ("FaxNumber", T.StringType(), False), ("Email", T.StringType(), False),
    ("Address", T.StringType(), False), ("City", T.StringType(), False),
    ("State", T.StringType(), False), ("Zip", T.StringType(), False),
    ("Country", T.StringType(), False), ("ValidFrom", T.StringType(), True),
    ("ValidTo", T.StringType(), True),
)
PRODUCTS_CSV = _s(
    ("ProductID", T.IntegerType(), False), ("ProductName", T.StringType(), True),
    ("Color", T.StringType(), True), ("Brand", T.StringType(), True), ("Size", T.StringType(), True),
    ("Barcode", T.StringType(), True), ("TaxRate", RATE, True), ("UnitPrice", MONEY, True),
    ("SupplierId", T.IntegerType(), True), ("ValidFrom", T.StringType(), True),
    ("ValidTo", T.StringType(), True),
)
SUPPLIERS_CSV = _s(
    ("SupplierId", T.IntegerType(), False), ("SupplierName", T.StringType(), True),
    ("PhoneNumber", T.StringType(), True), ("Email", T.StringType(), True),
    ("ValidFrom", T.StringType(), True), ("ValidTo", T.StringType(), True),
)
ORDERS_CSV = _s(
    ("OrderID", T.IntegerType(), False), ("ProductID", T.IntegerType(), False),
    ("SupplierId", T.IntegerType(), True), ("CustomerID", T.IntegerType(), False),
    ("Quantity", T.IntegerType(), True), ("UnitPrice", MONEY, True), ("TaxRate", RATE, True),
    ("LastEditedBy", T.IntegerType(), True), ("LastEditedWhen", T.StringType(), True),
)

LANDING_TIMESTAMP_FORMAT = "yyyy.MM.dd HH:mm:ss"

# landing layout and text timestamp columns per table
LANDING = {
    "customers": (CUSTOMERS_CSV, ("ValidFrom", "ValidTo")),
    "products": (PRODUCTS_CSV, ("ValidFrom", "ValidTo")),
    "suppliers": (SUPPLIERS_CSV, ("ValidFrom", "ValidTo")),
    "orders": (ORDERS_CSV, ("LastEditedWhen",)),
}

# ---------------------------------------------------------------- dimension specs
# natural key, type-1 (overwrite) and type-2 (versioned) attribute lists
DIMENSIONS = {
    "customers": {
        "key": "CustomerID",
        "t1": ["PhoneNumber", "FaxNumber", "Email"],
        "t2": ["CustomerFirstName", "CustomerLastName", "Address", "City", "State", "Zip", "Country"],
        "csv": CUSTOMERS_CSV,
    },
    "suppliers": {
        "key": "SupplierId",
        "t1": ["PhoneNumber", "Email"],
        "t2": ["SupplierName"],
        "csv": SUPPLIERS_CSV,
    },
    "products": {
        "key": "ProductID",
        "t1": ["Barcode", "TaxRate"],
        "t2": ["ProductName", "Color", "Brand", "Size", "UnitPrice", "SupplierId"],
        "csv": PRODUCTS_CSV,
    },
}

# columns without which a landing row can't be taken further
REQUIRED = {**{t: (spec["key"],) for t, spec in DIMENSIONS.items()}, "orders": ("OrderID", "ProductID", "CustomerID")}

# columns that silver requires
SILVER_NOT_NULL = {
    "customers": ("CustomerID", "PhoneNumber", "FaxNumber", "Email", "Address", "City", "State", "Zip", "Country", "ValidFrom"),
    "products": ("ProductID",),
    "suppliers": ("SupplierId",),
}

# ---------------------------------------------------------------- DQ contracts
# Longest text per column, where the layer limits it.
TEXT_LIMITS = {
    "CustomerFirstName": 255, "CustomerLastName": 255, "PhoneNumber": 15, "FaxNumber": 15, "Email": 100,
    "Address": 150, "City": 100, "State": 100, "Zip": 25, "Country": 150, "Region": 150, "Segment": 150,
    "date_skey": 255, "product_skey": 255, "supplier_skey": 255, "customer_skey": 255,
}


def contract(schema: T.StructType, unique: tuple[str, ...] = ()) -> dict[str, dict]:
    """``{column: {size, dtype, unique, nullable}}`` of a layout; only text has a size."""
    return {f.name: {"size": TEXT_LIMITS.get(f.name) if isinstance(f.dataType, T.StringType) else None,
                     "dtype": type(f.dataType).__name__, "unique": f.name in unique, "nullable": f.nullable} for f in schema}


def parsed(schema: T.StructType, stamps: tuple[str, ...]) -> T.StructType:
    """A landing layout after its text timestamps are parsed."""
    return T.StructType([T.StructField(f.name, T.TimestampNTZType(), f.nullable) if f.name in stamps else f for f in schema])


BRONZE_CONTRACTS = {name: contract(parsed(*LANDING[name]), (DIMENSIONS[name]["key"],) if name in DIMENSIONS else ()) for name in LANDING}
BRONZE_CUSTOMERS_CONTRACT = BRONZE_CONTRACTS["customers"]

# Gold fact at order-line grain, so OrderID is not unique.
ORDERS_FACT = _s(
    ("date_skey", T.StringType(), False), ("product_skey", T.StringType(), False), ("supplier_skey", T.StringType(), False),
    ("customer_skey", T.StringType(), True), ("OrderID", T.LongType(), False), ("LineNumber", T.IntegerType(), False),
    ("ProductID", T.LongType(), False), ("SupplierId", T.LongType(), False), ("CustomerID", T.LongType(), False),
    ("Quantity", T.IntegerType(), False), ("UnitPrice", MONEY, False), ("TaxRate", RATE, False),
    ("LastEditedWhen", T.TimestampNTZType(), False), ("LastEditedDate", T.DateType(), True),
)
ORDERS_FACT_CONTRACT = contract(ORDERS_FACT)

GOLD_CUSTOMERS = _s(
    ("skey", T.StringType(), False), ("CustomerID", T.LongType(), False), ("CustomerFirstName", T.StringType(), False),
    ("CustomerLastName", T.StringType(), False), ("Country", T.StringType(), False), ("Region", T.StringType(), False),
    ("Segment", T.StringType(), True),
)
GOLD_CUSTOMERS_CONTRACT = contract(GOLD_CUSTOMERS, ("skey", "CustomerID"))


def dimension_contract(table: str) -> dict[str, dict]:
    """Gold contract of a dimension: its attributes and the columns of its versions."""
    spec = DIMENSIONS[table]
    kept = [f for f in spec["csv"] if f.name in (spec["key"], *spec["t1"], *spec["t2"])]
    ts = T.TimestampNTZType()
    versions = _s(("skey", T.StringType(), False), ("active_flg", T.IntegerType(), False), ("insert_dt", ts, True), ("update_dt", ts, False),
                  ("effective_start_dt", ts, False), ("effective_end_dt", ts, True), ("hash1", T.StringType(), True), ("hash2", T.StringType(), True))
    return contract(T.StructType([*kept, *versions]), ("skey",))


# Order fact as the jobs write it: the landing columns, the surrogate keys and the audit columns.
GOLD_FACT_CONTRACT = contract(T.StructType([
    *_s(("date_skey", T.StringType(), False), ("product_skey", T.StringType(), False), ("supplier_skey", T.StringType(), False),
        ("customer_skey", T.StringType(), True)),
    *(T.StructField(f.name, f.dataType, f.name not in ("OrderID", "ProductID", "SupplierId", "CustomerID", "Quantity", "UnitPrice", "TaxRate", "LastEditedBy", "LastEditedWhen"))
      for f in parsed(*LANDING["orders"])),
    *_s(("LastEditedDate", T.DateType(), True), ("effective_start_dt", T.TimestampNTZType(), False), ("active_flg", T.IntegerType(), False),
        ("update_dt", T.TimestampNTZType(), False))]))
