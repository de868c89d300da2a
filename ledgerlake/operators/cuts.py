"""NTILE scores from the exact keys at which the tiles begin.

``NTILE(n) OVER (ORDER BY v, tie)`` needs no sorted copy of the table: a row's
tile is one more than the number of tiles 2..n whose first key isn't above the
row's own. Those n - 1 keys per score are found by selection:

1. a key is four whole numbers (``parts``): the value's upper and lower 32 bits,
   then the tie-breaker's; descending values are turned, NULLs get a place outside;
2. one job counts, for every open range of every score at once, the rows per bin
   (at most ``BINS`` a range) with the least and greatest parts found in the bin;
3. the bin that holds a cut becomes the cut's range; equal values leave one value
   in it, and the next part goes on. A bin with one row or one key ends the search.

A job reads only the columns of the order, adds up within each task and moves at
most ranges x ``BINS`` counts a task; the driver gets that many rows at most
(``BINS`` x scores x (n - 1)), whatever the table holds. A value that a third of
the rows share is one bin like any other. The jobs read ``df`` about three to
seven times, so give it a table that is written already (or ``materialize`` it).

The order must be total (a unique ``tie``), as for any reproducible NTILE: rows
equal in value and tie get the same tile. Values are whole numbers, decimals
within 64 bits when unscaled, dates or timestamps; others raise TypeError (use
``ntile.global_ntile``). NULLs stand first ascending and last descending, as in
Spark. An empty table has no cuts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of one open range in one job.
BINS = 2048

_PARTS = 4
_BELOW, _ABOVE = -(1 << 31) - 1, 1 << 31  # beyond the upper half of any 64-bit number


def whole(df: DataFrame, name: str) -> Column:
    """The column as a 64-bit number in the same order."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.DecimalType):
        return (c * F.lit(10 ** kind.scale)).cast("decimal(38,0)").cast("long") if kind.scale else c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"{name}: no cut values for {kind.simpleString()}")


def parts(df: DataFrame, name: str, descending: bool = False) -> list[Column]:
    """Upper and lower half of the column's number; ascending order of the pair is the wanted one."""
    v = whole(df, name)
    if descending:
        v = F.bitwise_not(v)  # turns the order without overflow
    null = _ABOVE if descending else _BELOW
    return [F.coalesce(F.shiftright(v, 32), F.lit(null).cast("long")), F.coalesce(v.bitwiseAND((1 << 32) - 1), F.lit(0).cast("long"))]


def starts(total: int, n: int) -> list[int]:
    """1-based row numbers at which tiles 2..n begin (those that have rows)."""
    q, r = divmod(total, n)
    out, at = [], 1
    for tile in range(1, min(n, total)):
        at += q + (tile <= r)
        out.append(at)
    return out


@dataclass
class _Cut:
    """A wanted row: the ``rank``-th of those whose first parts equal ``fixed`` and
    whose next part lies from ``low`` to ``high``."""

    score: int
    rank: int
    low: int
    high: int
    fixed: list[int] = field(default_factory=list)
    done: bool = False

    def range(self) -> tuple:
        return self.score, tuple(self.fixed), self.low, self.high

    def narrow(self, least: list[int], most: list[int], count: int) -> None:
        """Go on within rows whose parts lie from ``least`` to ``most``."""
        if count == 1:
            self.fixed, self.done = list(least), True
            return
        at = len(self.fixed)
        while at < _PARTS and least[at] == most[at]:
            at += 1
        self.fixed, self.done = list(least[:at]), at == _PARTS
        if not self.done:
            self.low, self.high = least[at], most[at]


def _width(low: int, high: int) -> int:
    return (high - low) // BINS + 1


def cut_keys(df: DataFrame, n: int, scores: list[list[Column]]) -> list[list[tuple[int, ...]]]:
    """Per score (its four parts) the keys of the rows at which tiles 2..n begin."""
    keyed = df.select(*[F.struct(*[c.alias(f"p{i}") for i, c in enumerate(s)]).alias(f"k{j}") for j, s in enumerate(scores)])
    edge = keyed.agg(F.count(F.lit(1)).alias("n"), *[f(f"k{j}.p{i}").alias(f"{w}{j}{i}") for j in range(len(scores))
                                                    for i in range(_PARTS) for w, f in (("l", F.min), ("h", F.max))]).first()
    cuts: list[list[_Cut]] = []
    for j in range(len(scores)):
        cuts.append([_Cut(j, rank, 0, 0) for rank in starts(edge["n"], n)])
        for cut in cuts[j]:
            cut.narrow([edge[f"l{j}{i}"] for i in range(_PARTS)], [edge[f"h{j}{i}"] for i in range(_PARTS)], edge["n"])
    while live := [c for cs in cuts for c in cs if not c.done]:
        ranges = sorted({c.range() for c in live})
        bins = _count(keyed, ranges)
        for cut in live:
            for count, least, most in bins[ranges.index(cut.range())]:
                if cut.rank <= count:
                    cut.narrow(least, most, count)
                    break
                cut.rank -= count
    return [[tuple(c.fixed) for c in cs] for cs in cuts]


def _count(keyed: DataFrame, ranges: list[tuple]) -> list[list[tuple]]:
    """Per range its bins that hold rows, in order: (rows, least parts, greatest parts).
    The ranges of a score don't overlap but where they are equal, so a row counts once a score."""
    placed = []
    for j in sorted({r[0] for r in ranges}):
        key, number, bin_ = F.col(f"k{j}"), F.lit(None).cast("int"), F.lit(None).cast("long")
        for x, (score, fixed, low, high) in enumerate(ranges):
            if score == j:
                here = key[f"p{len(fixed)}"]
                inside = here.between(low, high)
                for i, v in enumerate(fixed):
                    inside &= key[f"p{i}"] == v
                number = F.when(inside, F.lit(x)).otherwise(number)
                bin_ = F.when(inside, F.floor((here - F.lit(low)) / F.lit(_width(low, high)))).otherwise(bin_)
        placed.append(F.struct(number.alias("range"), bin_.alias("bin"), key.alias("key")))
    rows = keyed.select(F.inline(F.filter(F.array(*placed), lambda x: x["range"].isNotNull())))
    counted = rows.groupBy("range", "bin").agg(F.count(F.lit(1)).alias("n"), *[f(f"key.p{i}").alias(f"{w}{i}") for i in range(_PARTS)
                                                                             for w, f in (("l", F.min), ("h", F.max))])
    out: list[list[tuple]] = [[] for _ in ranges]
    for r in sorted(counted.collect(), key=lambda r: (r["range"], r["bin"])):  # at most BINS a range
        out[r["range"]].append((r["n"], [r[f"l{i}"] for i in range(_PARTS)], [r[f"h{i}"] for i in range(_PARTS)]))
    return out


def ntiles(df: DataFrame, n: int, scores: Mapping[str, tuple[str, bool]], tie: str) -> DataFrame:
    """Add ``NTILE(n) OVER (ORDER BY column [DESC], tie)`` under each name of
    ``scores`` (name -> column, descending), all from one set of jobs and in one projection."""
    keys = [parts(df, column, descending) + parts(df, tie) for column, descending in scores.values()]
    found = cut_keys(df, n, keys)
    tiles = {}
    for name, key, cuts in zip(scores, keys, found):
        own, tile = F.struct(*key), F.lit(1)
        for cut in cuts:
            tile = tile + (own >= F.struct(*[F.lit(v).cast("long") for v in cut])).cast("int")
        tiles[name] = tile
    return df.withColumns(tiles)
