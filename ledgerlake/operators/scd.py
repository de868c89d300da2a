"""Slowly changing dimension merge (type 1 + type 2) without a table format.

The reference stages its updates twice ('Y' insert copies and 'N' match
rows) and runs a Delta MERGE. Without a transactional table format the same
result is one DataFrame: the *active* target rows FULL OUTER JOIN the
(deduplicated) updates on the natural key, each joined row classified and
turned into one or two output rows, plus the untouched history rows.

Per joined row, first match wins:

| case                                  | output                                     |
|---------------------------------------|--------------------------------------------|
| key only in target                    | target row unchanged                        |
| key only in updates                   | new version (also when the key exists only as an inactive history row, see ``reactivate_inactive``) |
| type-2 hash differs                   | target closed (active_flg 0, end = now) + new version carrying the new type-1 values too |
| type-1 hash differs                   | target with type-1 columns, hash1, update_dt from the update (the reference copied PhoneNumber into FaxNumber and left Hash1 stale - both fixed) |
| nothing differs                       | target row unchanged (replaying a batch is a no-op) |

Hashes are null-safe (``functions.hashing.change_hash``) and surrogate keys
deterministic (``sha2(key ~ effective_start)``), so re-running a batch can
never mint a second key for the same version.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import change_hash, surrogate_key

HIGH_DATE = dt.datetime(2100, 12, 31)
AUDIT = ["active_flg", "insert_dt", "update_dt", "effective_start_dt", "effective_end_dt", "hash1", "hash2"]


def dimension_columns(key: str, t1: Sequence[str], t2: Sequence[str]) -> list[str]:
    return ["skey", key, *t2, *t1, *AUDIT]


def _ts(v: dt.datetime) -> Column:
    return F.lit(v.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def initial_load(updates: DataFrame, key: str, t1: Sequence[str], t2: Sequence[str],
                 now: dt.datetime, high_date: dt.datetime = HIGH_DATE) -> DataFrame:
    """First snapshot: every update row becomes an active version."""
    u = updates.withColumns({"hash1": change_hash(t1), "hash2": change_hash(t2)})
    return u.select(*_new_version_cols(key, t1, t2, now, high_date, prefix=""))


def _new_version_cols(key, t1, t2, now, high_date, prefix="u.") -> list[Column]:
    n = _ts(now)
    return [
        surrogate_key(F.col(f"{prefix}{key}"), n).alias("skey"),
        F.col(f"{prefix}{key}").alias(key),
        *[F.col(f"{prefix}{c}").alias(c) for c in t2],
        *[F.col(f"{prefix}{c}").alias(c) for c in t1],
        F.lit(1).alias("active_flg"), n.alias("insert_dt"), n.alias("update_dt"),
        n.alias("effective_start_dt"), _ts(high_date).alias("effective_end_dt"),
        F.col(f"{prefix}hash1").alias("hash1"), F.col(f"{prefix}hash2").alias("hash2"),
    ]


def merge(target: DataFrame, updates: DataFrame, key: str, t1: Sequence[str], t2: Sequence[str],
          now: dt.datetime, high_date: dt.datetime = HIGH_DATE, reactivate_inactive: bool = True) -> DataFrame:
    """New full snapshot of the dimension after applying ``updates``.

    ``updates`` must hold at most one row per key (see ``dedupe.latest_per_key``).
    ``reactivate_inactive=False`` reproduces the reference: a key present only
    as closed history is ignored instead of getting a new active version.
    """
    cols = dimension_columns(key, t1, t2)
    n = _ts(now)
    u = updates.select(key, *t2, *t1).withColumns({"hash1": change_hash(t1), "hash2": change_hash(t2)})
    if not reactivate_inactive:
        closed_keys = target.where(F.col("active_flg") != 1).select(key).distinct()
        open_keys = target.where(F.col("active_flg") == 1).select(key)
        only_closed = closed_keys.join(open_keys, key, "left_anti")
        u = u.join(only_closed, key, "left_anti")
    # each side is told by a flag of its own: a null key is no sign of a missing side
    u = u.withColumn("__here", F.lit(True))
    active = target.where(F.col("active_flg") == 1).select(*cols, F.lit(True).alias("__here"))
    history = target.where(F.col("active_flg") != 1).select(*cols)

    j = active.alias("t").join(u.alias("u"), F.col(f"t.{key}").eqNullSafe(F.col(f"u.{key}")), "full_outer")
    t_missing = F.col("t.__here").isNull()
    u_missing = F.col("u.__here").isNull()
    t2_changed = ~F.col("t.hash2").eqNullSafe(F.col("u.hash2"))
    t1_changed = ~F.col("t.hash1").eqNullSafe(F.col("u.hash1"))

    def struct(exprs: list[Column]) -> Column:
        return F.struct(*[e.alias(c) for e, c in zip(exprs, cols)])

    keep = struct([F.col(f"t.{c}") for c in cols])
    new = struct(_new_version_cols(key, t1, t2, now, high_date))
    closed = struct([F.lit(0) if c == "active_flg" else n if c in ("effective_end_dt", "update_dt")
                     else F.col(f"t.{c}") for c in cols])
    t1_update = struct([F.col(f"u.{c}") if c in t1 or c == "hash1" else n if c == "update_dt"
                        else F.col(f"t.{c}") for c in cols])
    out = (F.when(u_missing, F.array(keep))
           .when(t_missing, F.array(new))
           .when(t2_changed, F.array(closed, new))
           .when(t1_changed, F.array(t1_update))
           .otherwise(F.array(keep)))
    merged = j.select(F.explode(out).alias("r")).select("r.*")
    return merged.unionByName(history)
