"""Registered queries: one Spark plan and one DuckDB oracle per operator.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Every plan reads the driver's tables through the adapter views, over whole
tables.  Array results are rendered as sorted comma-joined text so both
engines hash them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.plans.views import AS_OF, Domain

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def flat(df: DataFrame) -> DataFrame:
    """Array columns → comma-joined text (arrays are already sorted)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


_DOMAINS: dict[tuple[str, str], Domain] = {}


def _domain(spark: SparkSession, sf_dir: str) -> Domain:
    """One set of adapter views per (session, folder): the lazy view plans are
    immutable, so queries share them instead of rebuilding them."""
    key = (spark._jsparkSession.sessionUUID(), sf_dir.rstrip("/"))
    d = _DOMAINS.get(key)
    if d is None:
        d = _DOMAINS[key] = Domain(spark, sf_dir)
    return d


def register(name: str, sql: str | None):
    def deco(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from nightjar.session import apply_core_conf
            apply_core_conf(spark)
            return flat(fn(_domain(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = (run, sql)
        return fn
    return deco


# Import the modules that register queries (side effect: fill QUERIES).
from nightjar.plans import q_analytics  # noqa: E402,F401
from nightjar.plans import q_listing  # noqa: E402,F401
from nightjar.plans import q_detect  # noqa: E402,F401
from nightjar.plans import q_changes  # noqa: E402,F401
from nightjar.plans import q_slo  # noqa: E402,F401
