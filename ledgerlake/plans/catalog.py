"""Registry of named analytics: Spark plan + SQL oracle + parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..model import GoldModel
from ..params import DEFAULT, Params


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[GoldModel, Params], DataFrame]
    oracle: Callable[[Params], str] | None
    params: Params = field(default=DEFAULT)
    # run straight on the raw tables instead of the gold model
    raw: Callable[[SparkSession, str, Params], DataFrame] | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.raw is not None:
            return self.raw(spark, sf_dir, self.params)
        return self.build(GoldModel.from_testdata(spark, sf_dir), self.params)

    def sql(self) -> str | None:
        return None if self.oracle is None else self.oracle(self.params)


REGISTRY: dict[str, Entry] = {}


def register(name: str, build, oracle, params: Params = DEFAULT, raw=None) -> None:
    if name in REGISTRY:
        raise ValueError(f"duplicate query {name}")
    REGISTRY[name] = Entry(name, build, oracle, params, raw)


def _load() -> None:
    if REGISTRY:
        return
    from . import registry_defs  # noqa: F401  (populates REGISTRY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: e.run for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: e.sql() for name, e in REGISTRY.items() if e.oracle is not None}


def publish_views(spark: SparkSession, model: GoldModel, names: list[str] | None = None,
                  prefix: str = "") -> list[str]:
    """Expose analytics as (session) temp views over a model, replacing
    ``CREATE OR REPLACE VIEW``; A16: read them back with ``spark.table``.
    Views stay lazy - each read re-plans against the current model."""
    _load()
    out = []
    for name in names or list(REGISTRY):
        e = REGISTRY[name]
        if e.build is None:
            continue
        e.build(model, e.params).createOrReplaceTempView(prefix + name)
        out.append(prefix + name)
    return out
