"""Mappings, sessions and reviews as tables: append-only Parquet, read by filters and latest-wins views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session_id(*columns: str) -> F.Column:
    """12 hex digits that depend on the columns only."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, 12)


def long_mapping(anonymised: DataFrame, session_col: str = "session_id") -> DataFrame:
    """session, placeholder, type, original."""
    rows = anonymised.select(session_col, F.explode("mapping").alias("placeholder", "original"))
    return rows.withColumn("type", placeholder_type("placeholder"))


def placeholder_type(col: str) -> F.Column:
    """What stands in a placeholder before its last underscore; a prefix stays."""
    return F.regexp_replace(F.regexp_replace(F.col(col), "^<|>$", ""), "_[^_]*$", "")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def load_mapping(spark: SparkSession, path: str, session: str) -> DataFrame:
    """The session's rows; none for an unknown one. The filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col("session_id") == session)


def latest(df: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(ts))
    return df.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def recent(df: DataFrame, n: int = 5, key: str = "session_id", ts: str = "ts") -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(n)


def unexpired(df: DataFrame, now: F.Column, days: int = 7, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= now - F.expr(f"interval {days} days"))


def audit(df: DataFrame, args_col: str, result_col: str, args_most: int = 200, result_most: int = 500) -> DataFrame:
    """Log lines with long arguments and results cut and marked by dots."""
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(F.col(c), 1, n), F.lit("..."))).otherwise(F.col(c))
    return df.withColumn(args_col, short(args_col, args_most)).withColumn(result_col, short(result_col, result_most))
