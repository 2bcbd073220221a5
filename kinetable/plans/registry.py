"""Where the modules of queries register them, and what they share: tables of the driver, and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.functions import values as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("us", V.micros("ts"))


#: Added before rounding where values may lie halfway between two: engines differ there.
NUDGE = 1.3e-7


def rounded(df: DataFrame, places: int = 4, nudge: float = 0.0) -> DataFrame:
    """Doubles with a few places, longs for other whole numbers: equal in any engine."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c + nudge if nudge else c, places) + F.lit(0.0) if kind in ("double", "float") else c.cast("long") if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal") else c).alias(name))
    return df.select(*out)


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number within their user's, from 1."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return events(spark, sf_dir).withColumn("frame", i)
