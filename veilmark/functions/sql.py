"""The engine's tables, checks and search as temporary views and functions of a session's SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.functions import expressions as X
from veilmark.functions.catalog import recogniser_table, recognisers, stop_terms, type_table
from veilmark.operators.recognise import recognise_texts

#: Name, parameter type, result type, expression over t.
CHECKS = (
    ("pii_valid_isin", "BOOLEAN", X.valid_isin("t")),
    ("pii_valid_lei", "BOOLEAN", X.valid_lei("t")),
    ("pii_valid_iban", "BOOLEAN", X.valid_iban("t")),
    ("pii_valid_ssn", "BOOLEAN", X.valid_ssn("t")),
    ("pii_normalise", "STRING", X.normalised("t")),
    ("pii_placeholder_type", "STRING", "regexp_replace(regexp_replace(t, '^<|>$', ''), '_[^_]*$', '')"),
)


def register(spark: SparkSession, domain: str = "general") -> None:
    """Views pii_types, pii_recognisers and pii_stop_terms; functions of a text that check and normalise; pii_spans(text) and the table function pii_find(text)."""
    type_table(spark).createOrReplaceTempView("pii_types")
    recogniser_table(spark, domain).createOrReplaceTempView("pii_recognisers")
    spark.createDataFrame([(t,) for t in stop_terms(domain)], "term string").createOrReplaceTempView("pii_stop_terms")
    for name, result, expr in CHECKS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {result} RETURN {expr}")
    spark.udf.register("pii_spans", recognise_texts(recognisers(domain)))
    found = [(r.entity, p.name, p.regex, p.score) for r in recognisers(domain) for p in r.patterns]

    class Find:
        def __init__(self):
            self.compiled = [(t, n, re.compile(x), s) for t, n, x, s in found]

        def eval(self, text: str):
            for kind, name, pattern, score in self.compiled:
                for m in pattern.finditer(text or ""):
                    yield m.start(), m.end(), kind, m[0], score, name

    spark.udtf.register("pii_find", F.udtf(Find, returnType="start int, end int, type string, text string, score double, pattern string"))
