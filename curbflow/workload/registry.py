"""Where registered queries and their oracles live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The driver tables carry zone-less timestamps; epoch arithmetic needs a fixed zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero."""
    rounded = F.round(value, digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def tidied(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: tidy(F.col(name), digits) for name in names}) if names else df


def tidy_sql(*names: str, digits: int = 6) -> str:
    """The same rounding as a DuckDB ``REPLACE`` list."""
    return ", ".join(
        f"CASE WHEN round({n}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({n}, {digits}) END AS {n}"
        for n in names
    )


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
