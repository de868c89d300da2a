"""Hand-made driver-shaped tables with the edge rows of FIXTURES.md §4.

Same column names and types as the driver's parquet tables, tiny, and
aimed at the corners: NULL order dates, orders of unknown customers,
lines of unknown parts, revenue ties at the top-k boundary, equal
Frequency across NTILE boundaries, single-purchase and same-day
customers, month-end dates, migration period boundaries, a missing month.
"""

from __future__ import annotations

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq

D = dt.datetime


def _write(folder: str, name: str, schema: pa.Schema, rows: list[tuple]) -> None:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table({f.name: pa.array(list(c), type=f.type) for f, c in zip(schema, cols)}, schema=schema)
    pq.write_table(table, os.path.join(folder, f"{name}.parquet"))


def build(folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    i32, i64, f64, s = pa.int32(), pa.int64(), pa.float64(), pa.string()
    ts = pa.timestamp("us")
    _write(folder, "region", pa.schema([("r_regionkey", i32), ("r_name", s)]),
           [(i, n) for i, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])])
    _write(folder, "nation", pa.schema([("n_nationkey", i32), ("n_name", s), ("n_regionkey", i32)]),
           [(i, f"NATION{i:02d}", i % 5) for i in range(25)])
    # balances hit every band of the derived SCD batch (<0, 8000-9000, >9000)
    _write(folder, "customer", pa.schema([("c_custkey", i64), ("c_name", s), ("c_nationkey", i32),
                                          ("c_acctbal", f64), ("c_mktsegment", s)]),
           [(c, f"Customer#{c:09d}", c % 25, [-5.0, 100.0, 8500.0, 9500.0, 9000.0, 8000.0][c % 6],
             ["BUILDING", "AUTOMOBILE", "MACHINERY"][c % 3]) for c in range(1, 13)])
    _write(folder, "supplier", pa.schema([("s_suppkey", i64), ("s_name", s), ("s_nationkey", i32),
                                          ("s_acctbal", f64)]),
           [(1, "Supplier#1", 1, 10.0), (2, "Supplier#2", 2, 20.0)])
    # parts: 1-6 two names share brands, 7 has the same revenue as 6 (tie), 999 is unknown
    _write(folder, "part", pa.schema([("p_partkey", i64), ("p_name", s), ("p_brand", s), ("p_type", s),
                                      ("p_size", i32), ("p_retailprice", f64)]),
           [(p, ["red bolt", "blue gear", "red bolt", "green nut", "blue gear", "tiny cog", "tiny cog"][p - 1],
             f"Brand#{(p - 1) % 4 + 1}", "SMALL", p, 10.0 + p) for p in range(1, 8)])
    orders = [
        # (orderkey, custkey, date)
        (1, 1, D(2001, 8, 1)),        # MaxDate of the anchor year
        (2, 1, D(2001, 7, 31)),
        (3, 1, D(2001, 7, 31)),       # two orders the same day
        (4, 2, D(2001, 5, 1)),        # exactly MaxDate - 3 months (period 2 lower bound)
        (5, 2, D(2001, 2, 1)),        # exactly MaxDate - 6 months (period 1 lower bound)
        (6, 2, D(2001, 4, 30)),       # period 1
        (7, 3, D(2000, 1, 31)),       # month-end first purchase
        (8, 3, D(2000, 2, 29)),       # not a whole month later
        (9, 4, D(1999, 6, 15)),       # single purchase, long ago
        (10, 5, D(2001, 3, 3)),       # same-day first and last purchase (gap 0)
        (11, 5, D(2001, 3, 3)),
        (12, 99, D(2000, 6, 1)),      # unknown customer
        (13, 6, None),                # NULL order date
        (14, 7, D(2000, 4, 10)),      # 2000-05 has no orders (gap month)
        (15, 7, D(2000, 6, 10)),
        (16, 8, D(2001, 6, 1)),
        (17, 8, D(2001, 6, 2)),
        (18, 8, D(2001, 6, 3)),
        (19, 9, D(2001, 1, 15)),
        (20, 10, D(2001, 7, 1)),
        (21, 11, D(2001, 7, 20)),
        (22, 12, D(2000, 12, 31)),
        (23, 2, D(2001, 7, 2)),
        (24, 9, D(2001, 4, 20)),
        (25, 6, D(2025, 6, 1)),       # beyond the former fixed cut
        (26, 6, D(2035, 6, 1)),       # beyond the default calendar
    ]
    _write(folder, "orders", pa.schema([("o_orderkey", i64), ("o_custkey", i64), ("o_orderstatus", s),
                                        ("o_totalprice", f64), ("o_orderdate", ts), ("o_orderpriority", s)]),
           [(o, c, "O", 100.0, d, "1-URGENT") for o, c, d in orders])
    lines = []
    for o, c, d in orders:
        part = (o % 6) + 1
        qty = float((o % 5) + 1)
        lines.append((o, part, 1, 1, qty, qty * (10.0 + part)))
        if o % 3 == 0:
            lines.append((o, 999, 2, 1, 2.0, 123.45))          # unknown part -> NULL brand / name
        if o % 4 == 0:
            lines.append((o, 7, 1, 1, 1.0, 33.33))              # same line number again (not unique)
    # a tie: part 7 gets exactly part 6's revenue in total
    _write(folder, "lineitem", pa.schema([("l_orderkey", i64), ("l_partkey", i64), ("l_suppkey", i64),
                                          ("l_linenumber", i32), ("l_quantity", f64), ("l_extendedprice", f64),
                                          ("l_discount", f64), ("l_tax", f64), ("l_returnflag", s),
                                          ("l_linestatus", s), ("l_shipdate", ts)]),
           [(o, p, sk, ln, q, e, 0.05, 0.08, "N", "O", D(2001, 1, 1)) for o, p, sk, ln, q, e in lines])
    return folder


RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
