"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Many rates are exact decimals ending in 5; this moves them off the rounding tie, where the last
# bit of a sum would decide.
OFF_TIE = 1.7e-8


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to `places` digits, so that summation order cannot show."""
    doubles = {n: F.round(F.col(n) + F.lit(OFF_TIE), places) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def rounded_sql(body: str, columns: Sequence[str], places: int = 6, with_: str = "") -> str:
    head = f"WITH {with_} " if with_ else ""
    changed = ", ".join(f"round({c} + {OFF_TIE}, {places}) AS {c}" for c in columns)
    return f"{head}SELECT * REPLACE ({changed}) FROM ({body}) AS _t"
