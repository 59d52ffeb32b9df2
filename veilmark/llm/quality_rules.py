"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one statistic of a text and votes good (1), bad (0) or abstains (-1). The vote
patterns of all documents are counted (there are at most 3 to the number of rules), a two-class model
with an accuracy of each rule for each class is fitted to these counts by EM, and each document gets the
posterior probability of being good.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cut

BLANKS = str.maketrans("", "", " \t\n\v\f\r")
SYMBOLS = "#*$%&|<>"


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then what the other rules need: n_upper_words, n_stop_ends, n_lines, most_common_word."""
    if not text:
        return (0,) * 9
    words = text.encode().split()
    n = len(words)
    chars = len(text.translate(BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and x.encode().strip(b" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        runs = list(zip(words, words[1:], words[2:]))
        if len(set(runs)) < len(runs):
            seen = Counter(runs)
            in_run = np.fromiter(map((1).__lt__, map(seen.__getitem__, runs)), bool, n - 2)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= in_run
            repeated = int(covered.sum())
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    ends = sum(x.rstrip().endswith((".", "!", "?", '"', ":", ";", "…")) for x in lines)
    most = max(Counter(words).values()) if n else 0
    return n, chars, symbols, dup, repeated, upper, ends, len(lines), most


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_ended_lines", "n_lines", "n_most_common")


@dataclass(frozen=True)
class Rule:
    """good: votes 1; bad: votes 0; neither, or null: abstains. Both are SQL over the statistics."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_symbols * 50 <= n_words", "n_symbols * 5 > n_words"),
    Rule("repeats", "100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("dup_lines", "n_lines > 2 AND n_dup_lines = 0", "n_dup_lines * 4 > n_lines"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 8 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("upper", "n_upper_words * 20 <= n_words", "n_upper_words * 4 > n_words"),
    Rule("ends", "n_ended_lines * 2 >= n_lines AND n_lines > 0", "n_ended_lines * 5 < n_lines"),
    Rule("one_word", "n_most_common * 10 <= n_words AND n_words >= 100", "n_most_common * 4 > n_words AND n_words >= 50"),
)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the statistics of the whole text (zeros for null) and the columns in `keep`; a row for each row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([statistics(t) for t in b.column(1).to_pylist()], np.int64).reshape(b.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(2, b.num_columns)), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(STATS)))], [id_col, *keep, *STATS])

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}{extra}, " + ", ".join(f"{c} bigint" for c in STATS))


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One digit a rule: 0 bad, 1 good, 2 abstains."""
    return F.concat(*(F.expr(f"CASE WHEN {r.bad} THEN '0' WHEN {r.good} THEN '1' ELSE '2' END") for r in rules))


def fit(counts: dict[str, int], prior: float = 0.7, rounds: int = 200, smooth: float = 1.0) -> dict[str, float]:
    """EM over counted vote patterns; the posterior of each pattern. Rules start as better than chance, which fixes the sense of the classes."""
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([[int(c) for c in p] for p in patterns])
    hot = np.stack([seen == v for v in (0, 1, 2)], axis=2).astype(float)
    like = np.array([[0.5, 0.15, 0.35], [0.1, 0.6, 0.3]])[:, None, :].repeat(seen.shape[1], 1)
    start = like.copy()
    for _ in range(rounds):
        log = np.einsum("prv,crv->pc", hot, np.log(like)) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        weight = np.stack([n * (1 - post), n * post])
        like = np.einsum("cp,prv->crv", weight, hot) + smooth * start
        like /= like.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + smooth) / (n.sum() + 2 * smooth), 1e-6, 1 - 1e-6))
    return dict(zip(patterns, post.tolist()))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, n_words, the base statistics, base_failed, votes, quality (the posterior) and kept.

    base_failed: under 50 words, or over half of them in repeated three-word windows. kept: not failed and
    posterior at least `least`. The model is fitted to the vote patterns of every document without a base
    failure; what reaches the driver is one count a pattern, at most 3 ** len(rules). A null or empty text
    has no words and fails; null ids, repeated rows stay; other columns go unless named in `keep`.
    """
    spark = docs.sparkSession
    stats = document_statistics(docs, id_col, text_col, keep)
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    # The statistics are few numbers a row, written once, as the model needs all of them before the first verdict.
    voted = cut(stats.withColumn("base_failed", failed).withColumn("votes", votes(rules)))
    counts = {r["votes"]: r["count"] for r in voted.filter("NOT base_failed").groupBy("votes").count().collect()}
    post = spark.createDataFrame([*fit(counts).items()], "votes string, quality double")
    known = voted.join(F.broadcast(post), "votes", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return known.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).select(id_col, *keep, *STATS[:5], "base_failed", "votes", "quality", "kept")
