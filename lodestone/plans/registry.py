"""The catalogue of queries: name, inventory rows, Spark callable and the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.views import view, with_views


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, rows: str, inputs: str, oracle: str | None = None):
    """Register fn(*inputs) -> DataFrame; inputs and the oracle name driver tables or stand-in views."""
    names = tuple(inputs.split())

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(view(spark, sf_dir, n) for n in names))

        assert name not in CATALOG, name
        CATALOG[name] = Query(name, tuple(rows.split()), run, with_views(oracle, *names) if oracle else None)
        return fn

    return wrap
