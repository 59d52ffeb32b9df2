"""Operators on spans: small cases worked out by hand, and plain loops for the folds."""

import random
import time

import pytest

from veilmark.functions import expressions as X
from veilmark.functions.catalog import RECOGNISERS, TAGS, Pattern, Recogniser, recognisers, stop_terms
from veilmark.operators import chunking, overrides, pipeline
from veilmark.operators.pipeline import Settings
from veilmark.operators.recognise import Context, heuristic_names, recognise


def frame(spark, docs):
    """docs: (id, text, [(start, end, type, score)])."""
    rows = [(i, t, [(a, b, k, t[a:b], s, True, None, "p") for a, b, k, s in spans]) for i, t, spans in docs]
    return spark.createDataFrame(rows, f"doc_id long, text string, spans array<{X.SPAN}>")


def run(spark, docs, *steps):
    return {r.doc_id: [(s["start"], s["end"], s["type"], s["text"]) for s in r.spans] for r in pipeline.with_spans(frame(spark, docs), *steps).collect()}


def test_catalogue():
    assert len(TAGS) == 41 and len(RECOGNISERS) == 27 and sum(len(r.patterns) for r in RECOGNISERS) == 65
    assert {r.entity for r in recognisers("legal")}.isdisjoint({"LEI", "NPI"})
    assert stop_terms("legal", ("X",), {"general": ("Y",), "financial": ("Z",)})[:2] and {"x", "y"} <= set(stop_terms("legal", ("X",), {"general": ("Y",)}))


def test_overlaps_chain(spark):
    t = "x" * 40
    got = run(spark, [(1, t, [(0, 10, "A", 0.5), (8, 20, "A", 0.6), (18, 25, "A", 0.7)]), (2, t, [(0, 10, "A", 0.5), (5, 9, "A", 0.5)])], X.resolved("spans"))
    assert [(a, b) for a, b, *_ in got[1]] == [(18, 25)] and [(a, b) for a, b, *_ in got[2]] == [(0, 10)]


def test_overlaps_against_a_loop(spark):
    rng = random.Random(3)
    docs = [(i, "y" * 60, [(a := rng.randrange(50), a + rng.randrange(1, 10), rng.choice("AB"), rng.choice([0.5, 0.6, 0.7])) for _ in range(rng.randrange(9))]) for i in range(150)]
    got = run(spark, docs, X.resolved("spans"))
    for i, _, spans in docs:
        kept = []
        for s in sorted(spans, key=lambda s: (s[0], -s[3], -s[1], s[2])):
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
            elif s[3] > kept[-1][3]:
                kept[-1] = s
        assert [(a, b, k) for a, b, k, _ in got[i]] == [(a, b, k) for a, b, k, _ in kept]


def test_snap(spark):
    got = run(spark, [(1, "(Smith), x", [(0, 8, "A", 1.0)]), (2, "Johnson ate", [(0, 4, "A", 1.0)])], X.snapped("spans", "text"))
    assert got[1] == [(1, 6, "A", "Smith")] and got[2] == [(0, 7, "A", "Johnson")]


def test_snap_stays_behind_line_ends(spark):
    """A span at the start of a line doesn't grow over the line end before it, and signs before a last line separator stay."""
    got = run(spark, [(1, "Ann\nLeo x", [(4, 7, "A", 1.0)]), (2, "Ann\u2028Leo", [(4, 7, "A", 1.0)]), (3, "Ann.\u2028", [(0, 5, "A", 1.0)])], X.snapped("spans", "text"))
    assert got[1] == [(4, 7, "A", "Leo")] and got[2] == [(4, 7, "A", "Leo")] and got[3] == [(0, 5, "A", "Ann.\u2028")]


def test_snap_is_linear_in_the_words_before(spark):
    """A long word before a span isn't searched from each of its characters."""
    n = 300_000
    began = time.monotonic()
    got = run(spark, [(1, "a" * n + " b, x" + "c" * n, [(n + 1, n + 2, "A", 1.0), (n + 4, n + 5, "A", 1.0)])], X.snapped("spans", "text"))
    assert [(a, b) for a, b, *_ in got[1]] == [(n + 1, n + 2), (n + 4, 2 * n + 5)] and time.monotonic() - began < 15


def test_short_and_lines(spark):
    got = run(spark, [(1, "AB Ann Lee\nBob Ray", [(0, 2, "A", 1.0), (3, 18, "A", 1.0)])], X.not_short("spans"), X.by_line("spans"))
    assert got[1] == [(3, 10, "A", "Ann Lee"), (11, 18, "A", "Bob Ray")]


@pytest.mark.parametrize(
    "kind, text, ok",
    [("ISIN", "US0378331005", True), ("ISIN", "US0378331006", False), ("LEI", "5493001KJTIIGC8Y1R12", True), ("LEI", "5493001KJTIIGC8Y1R13", False), ("IBAN_CODE", "GB82 WEST 1234 5698 7654 32", True), ("IBAN_CODE", "GB29 LOYD 2014 5363 8472 91", False), ("US_SSN", "666-12-1234", False), ("US_SSN", "123-45-6789", True), ("OTHER", "x", True)],
)
def test_check_digits(spark, kind, text, ok):
    assert spark.createDataFrame([(kind, text)], "k string, t string").selectExpr(X.valid("k", "t")).first()[0] is ok


def test_rules(spark):
    q = lambda e, t: spark.createDataFrame([(t,)], "t string").selectExpr(e).first()[0]
    stop = X.array_of(["client", "purchase", "invoice"])
    assert q(X.in_stop_list("t", stop), "The Client") and q(X.in_stop_list("t", stop), "Сlient") and not q(X.in_stop_list("t", stop), "Smith")
    assert q(X.all_words_stop("t", stop), "Purchase and Invoice") and q(X.structural("t"), "Clause 7") and not q(X.structural("t"), "Clauses")
    assert q(X.normalised("t"), "  Acme   Corp., ") == "acme corp"


def test_lower_case_needs_a_sure_one(spark):
    t = "smith John Smith"
    drop = X.confirmed("spans")
    got = run(spark, [(1, t, [(0, 5, "PERSON", 0.55)]), (2, t, [(0, 5, "PERSON", 0.55), (6, 16, "PERSON", 0.8)])], drop)
    assert got[1] == [] and len(got[2]) == 2


def test_frequency(spark):
    t = "Ann " * 9
    spans = [(4 * k, 4 * k + 3, "PERSON", 0.9) for k in range(9)]
    got = run(spark, [(1, t, spans), (2, t, spans[:8])], X.not_frequent("spans", 8))
    assert got[1] == [] and len(got[2]) == 8


def test_families_and_substitution(spark):
    t = "Acme Corp; Globex; Acme; ACME CORP."
    spans = [(0, 9, "ORGANIZATION", 0.9), (11, 17, "ORGANIZATION", 0.9), (19, 23, "ORGANIZATION", 0.9), (25, 35, "ORGANIZATION", 0.9)]
    row = pipeline.restore(pipeline.anonymise(frame(spark, [(1, t, spans)]))).first()
    assert row.anonymized_text == "<ORG_1>; <ORG_2>; <ORG_1a>; <ORG_1>" and row.mapping["<ORG_1>"] == "Acme Corp" and row.entities_restored == 3
    assert row.restored_text == "Acme Corp; Globex; Acme; Acme Corp"
    many = [(i, i + 1, "PERSON", 0.9) for i in range(0)]
    assert pipeline.anonymise(frame(spark, [(2, "Bob met Bob", [(0, 3, "PERSON", 0.9), (8, 11, "PERSON", 0.9), *many])])).first().anonymized_text == "<PERSON_1> met <PERSON_1>"
    assert pipeline.anonymise(frame(spark, [(3, "Bob", [(0, 3, "PERSON", 0.9)])]), Settings(prefix="D2")).first().anonymized_text == "<D2_PERSON_1>"


def test_numbers_of_ties(spark):
    """Spans that differ in their text only have one order, in whatever order they come."""
    tied = [(0, 2, "A", t, 0.5, True, None, "p") for t in ("t2", "t4", "t0")]
    df = spark.createDataFrame([(1, tied), (2, tied[::-1])], f"doc_id long, spans array<{X.SPAN}>")
    got = [[(s["text"], s["placeholder"]) for s in r.n] for r in df.selectExpr(f"{X.family_numbers('spans')} as n").collect()]
    assert got[0] == got[1] == [("t0", "<A_1>"), ("t2", "<A_2>"), ("t4", "<A_3>")]


def test_restore_longest_first(spark):
    df = spark.createDataFrame([("hi <A_10> <A_1>", {"<A_10>": "x", "<A_1>": "y"})], "anonymized_text string, mapping map<string, string>")
    assert pipeline.restore(df).first().restored_text == "hi x y"


def test_chunks(spark):
    texts = ["x" * 10_000, "abcdefghi " * 1000, "", None, "short"]
    got = chunking.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {i: sorted((r.off, r.off + len(r.text)) for r in got if r.doc_id == i) for i in range(5)}
    assert by[0] == by[1] == [(0, 4000), (3750, 7750), (7500, 10000)] and by[2] == [(0, 0)] and by[3] == [] and by[4] == [(0, 5)]


def test_overrides(spark):
    df = frame(spark, [(1, "Bob and bob, Bob Ray, Bob", [(0, 3, "PERSON", 0.9), (8, 11, "PERSON", 0.9), (13, 20, "PERSON", 0.9)])])
    gone = spark.createDataFrame([(1, 0, 3, "PERSON")], "doc_id long, start int, end int, type string")
    assert [s["text"] for s in overrides.removed(df, gone).first().spans] == ["Bob Ray"]
    more = spark.createDataFrame([(1, "Bob", "PERSON"), (1, "", "X"), (2, "y", "X")], "doc_id long, text string, type string")
    got = overrides.added(overrides.removed(df, gone), more).first().spans
    assert [(s["start"], s["score"], s["reason"]) for s in got] == [(0, 1.0, "user_added"), (13, 0.9, None), (22, 1.0, "user_added")]


def test_detection(spark):
    docs = spark.createDataFrame([(1, "mail a.b@x.org, ISIN US0378331005 and US0378331006, Dr Ann Lee of Acme Trading Ltd"), (2, None), (3, ""), (4, "Account number: 12345678")], "doc_id long, text string")
    how = Settings(finders=(("names", heuristic_names),), context=Context())
    got = {r.doc_id: {(s["type"], s["text"]) for s in r.spans} for r in pipeline.detect(docs, how).collect()}
    assert {("EMAIL_ADDRESS", "a.b@x.org"), ("ISIN", "US0378331005"), ("PERSON", "Ann Lee"), ("ORGANIZATION", "Acme Trading Ltd")} <= got[1]
    assert ("ISIN", "US0378331006") not in got[1] and got[2] == got[3] == set()
    odd = (Recogniser("CODE", "custom", (Pattern("c", r"ZZ[0-9]+", 0.9), Pattern("bad", "(", 0.9))),)
    rows = recognise(spark.createDataFrame([(1, "ZZ12")], "doc_id long, text string"), custom=odd, types=("CODE",)).first().spans
    assert [s["text"] for s in rows] == ["ZZ12"]


def test_plan_has_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pipeline.anonymise(pipeline.detect(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_chain_is_computed_once(spark):
    """Filters on spans and numbers stay above the chain, which stands in the plan once."""
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    whole = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    base = pipeline.anonymise(pipeline.detect(docs))
    plain = whole(base.select("doc_id", "anonymized_text"))
    for df in (base.filter("size(numbered) > 0").select("doc_id", "anonymized_text"), pipeline.exploded(base)):
        assert whole(df).count("regexp_extract(substring") <= plain.count("regexp_extract(substring") and len(whole(df)) < 1.2 * len(plain)
