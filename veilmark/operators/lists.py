"""Stop lists and other term tables: parsing, scopes, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """term: trimmed lower-case lines, once, without blank ones and those that begin with #."""
    t = F.trim(F.col(col))
    return lines.filter((t != "") & ~t.startswith("#")).select(F.lower(t).alias("term")).distinct()


def read_learned(spark: SparkSession, path: str) -> DataFrame:
    """domain, terms from JSON objects of lists by domain, a file each; a file that is no such object gives nothing."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("domain", "terms")).filter("terms IS NOT NULL")


def in_scope(learned: DataFrame, domain: str) -> DataFrame:
    """term of the general and the given domain from (domain, terms array)."""
    return learned.filter(F.col("domain").isin("general", domain)).select(F.explode("terms").alias("term")).select(F.lower("term").alias("term")).distinct()


def combined(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("term")
    for t in tables[1:]:
        out = out.unionByName(t.select("term"))
    return out.distinct()


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("term").distinct().join(right.select("term").distinct(), "term", "left_anti")
