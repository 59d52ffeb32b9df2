"""Texts with identifiers of every kind, made from the customer table alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Both dialects read this: concat of literals and of digits from c_custkey (k).
TEMPLATE = [
    "Account number: ", ("10", 31), ", tax AB ", ("2", 1), " ", ("2", 3), " ", ("2", 7), " C and AB", ("6", 11), "C; passport ", ("9", 13), ", company number ", ("8", 17), " or SC", ("6", 19),
    ". MORGA", ("6", 23), "SM", ("2", 1), "IJ. NHS 943 476 ", ("4", 5), ", Steuer-ID ", ("11", 29), ", 65 ", ("6", 37), " M 00 7; NIR 1 85 12 75 108 ", ("3", 3), " 42; CNI ", ("12", 41),
    "; RSSMRA85M01H", ("3", 9), "Z; IT", ("11", 43), "; DNI ", ("8", 47), "Z; X", ("7", 53), "L; ATU", ("8", 59), " BE0", ("9", 61), " BG", ("9", 67), " CY", ("8", 71), "X CZ", ("8", 73), " DE", ("9", 79), " DK", ("8", 83), " EE", ("9", 89),
    " ESB", ("7", 97), "Q FI", ("8", 3), " FRAB", ("9", 5), " EL", ("9", 7), " HR", ("11", 9), " HU", ("8", 11), " IE1A", ("5", 13), "B LT", ("9", 15), " LU", ("8", 17), " LV", ("11", 19), " MT", ("8", 21), " NL", ("9", 23), "B01 PL", ("10", 25), " PT", ("9", 27),
    " RO", ("7", 29), " SE", ("12", 31), " SI", ("8", 33), " SK", ("10", 35), " GB", ("9", 37), " CHE", ("9", 39), "; CZ", ("7", 41), " C", ("8", 43), "; LEI 5493001KJTIIGC8Y", ("4", 45), "; ISIN US", ("10", 47), "; SWIFT DEUTDEFF and DEUTDEFF500; ",
    ("4", 1), "-", ("4", 3), "-", ("4", 5), ", sort code ", ("2", 1), "-", ("2", 3), "-", ("2", 5), "; NPI 1", ("9", 49), "; DEA AB", ("7", 51), "; Medicare 1EG4TE5MK73 E1G4TE5MK", ("2", 3), " ", ("9", 53), "A; patient ID ", ("7", 55), ", MRN-", ("7", 57), " MR ", ("6", 59), "; license number CA", ("5", 61), " D", ("6", 63),
    "; mail u", ("3", 1), "@mail.example.com, 1 (555) ", ("3", 3), "-", ("4", 5), ", 555-", ("3", 7), "-", ("4", 9), ", http://www.example.org/p/", ("4", 11), ", host 192.168.1.", ("1", 1), ", card 4111-", ("4", 3), "-", ("4", 5), "-", ("4", 7), ", iban GB82 WEST 1234 ", ("4", 9), " ", ("4", 11),
    ", wallet 1BoatSLRHtKNngkdXEeobR76b53LETt", ("2", 3), "y, ssn ", ("3", 9), "-", ("2", 3), "-", ("4", 13), ".",
]


def _digits(n: int, factor: int, k: str) -> str:
    return f"lpad(substring(cast({k} * {factor} + {factor * 7} as varchar(20)), 1, {n}), {n}, '0')"


def text_sql(k: str = "c_custkey") -> str:
    parts = ["'" + p.replace("'", "''") + "'" if isinstance(p, str) else _digits(int(p[0]), p[1], k) for p in TEMPLATE]
    return "concat(" + ", ".join(parts) + ")"


def planted_texts(customers: DataFrame) -> DataFrame:
    """doc_id (negative), text."""
    spark_text = text_sql().replace("varchar(20)", "string")
    return customers.selectExpr("-1 - c_custkey as doc_id", f"{spark_text} as text")
