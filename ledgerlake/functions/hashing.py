"""Row hashing for change detection and surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator of the surrogate key's parts.
HASH_SEPARATOR = "~"


def change_hash(cols: Sequence[str]) -> Column:
    """Null-safe SHA-256 over a column list. Every value is written with its
    length before it and NULL as a mark of its own, so no two different rows
    give the same text, whatever characters they hold."""
    text = [F.col(c).cast("string") for c in cols]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def surrogate_key(natural_key: str | Column, version_ts: str | Column) -> Column:
    """Deterministic surrogate key: sha2(natural key ~ version start).

    Replaces the reference's uuid4 UDF, which is re-evaluated on every
    action and so yields different keys for the same row (no Python UDF).
    """
    v = F.col(version_ts) if isinstance(version_ts, str) else version_ts
    return _key_of(natural_key, _start_text(v))


def _start_text(v: Column) -> Column:
    return F.date_format(v, "yyyy-MM-dd HH:mm:ss")


def _key_of(natural_key: str | Column, start: Column) -> Column:
    k = F.col(natural_key) if isinstance(natural_key, str) else natural_key
    return F.sha2(F.concat_ws(HASH_SEPARATOR, k.cast("string"), start), 256)


_OTHER = 33  # zero bytes before a text that is no digest


def pack_key(skey: str | Column, natural_key: str | Column | None = None, version_ts: str | Column | None = None) -> Column:
    """A surrogate key as bytes, to be carried through shuffles: 32 for a lowercase
    hex SHA-256; any other text follows 33 zero bytes, so the length tells them apart.
    With its natural key and version start, a key that is their hash (``surrogate_key``)
    becomes the text of the start, which is shorter and the same for a whole load."""
    c = F.col(skey) if isinstance(skey, str) else skey
    packed = F.when(c.rlike("^[0-9a-f]{64}\\z"), F.unhex(c)).otherwise(F.concat(F.lit(bytes(_OTHER)), c.cast("binary")))
    if natural_key is None or version_ts is None:
        return packed
    v = F.col(version_ts) if isinstance(version_ts, str) else version_ts
    return F.when(v.isNotNull() & (c == surrogate_key(natural_key, v)), _start_text(v).cast("binary")).otherwise(packed)


def unpack_key(packed: str | Column, natural_key: str | Column | None = None) -> Column:
    """The text that ``pack_key`` packed; a version start needs the natural key again."""
    b = F.col(packed) if isinstance(packed, str) else packed
    n = F.octet_length(b)
    text = F.when(n == 32, F.lower(F.hex(b)))
    if natural_key is not None:
        text = text.when(n < 32, _key_of(natural_key, b.cast("string")))
    return text.otherwise(F.substring(b, _OTHER + 1, 1 << 30).cast("string"))
