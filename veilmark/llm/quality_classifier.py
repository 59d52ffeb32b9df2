"""Quality classifier: a linear-chain conditional random field that marks every line good or bad.

Each line has a few measures, put into bins; its score for "good" is a sum of weights over its own bins
and those of its two neighbours, and neighbouring lines are tied by a transition matrix. Forward-backward
gives the probability of "good" for each line; their mean weighted by line length, put on the scale of
the labels by a two-parameter logistic fit, is the document's quality.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import crc_mod, cut

SYMBOLS = re.compile(r"[#*$%&|<>@=_~^\\{}\[\]]")
MARKS = re.compile(r"[!?]")
STOPS = re.compile(r"[.,;:]")
DIGITS = re.compile(r"[0-9]")
#: Upper edges of the bins of each measure; what is above the last is one more bin.
EDGES = {
    "words": (0, 2, 4, 8, 16, 32, 64, 128, 512),
    "chars": (0, 10, 30, 60, 120, 240, 480, 960, 2000),
    "word_length": (1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14),
    "upper": (0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7, 0.9),
    "digits": (0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "symbols": (0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "marks": (0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "stops": (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.1),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "most_common": (0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7),
    "runs": (0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "short_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "foreign": (0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.4, 0.7),
    "shape": (0, 1, 2, 3, 4, 5, 6, 7, 8),
}
NAMES, BINS = tuple(EDGES), 10
_EDGES = np.array([EDGES[n] for n in NAMES])


def measures(line: str, repeated: bool) -> tuple[float, ...]:
    """The measures of one line with a word; its shape is ends with a stop + 2 * starts upper + 4 * seen before in the document."""
    words = line.split()
    n, c = len(words), len(line)
    seen = Counter(words)
    letters = c - line.count(" ")
    upper = sum(map(str.isupper, line)) if not line.islower() else 0
    runs = sum(map(str.__eq__, words, words[1:])) if len(seen) < n else 0
    short = sum([len(w) <= 3 for w in words])
    return (
        n,
        c,
        letters / n,
        upper / letters,
        len(DIGITS.findall(line)) / letters,
        len(SYMBOLS.findall(line)) / letters,
        len(MARKS.findall(line)) / letters,
        len(STOPS.findall(line)) / letters,
        len(seen) / n,
        max(seen.values()) / n,
        runs / n,
        short / n,
        (len(line.encode()) - c) / letters,
        (words[-1][-1] in ".!?\"'”»…") + 2 * words[0][0].isupper() + 4 * repeated,
    )


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins (lines x measures, uint8) and lengths of the lines that have a word; lines without one don't count."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        line = line.strip()
        if line:
            rows.append(measures(line, line in seen))
            seen.add(line)
            sizes.append(len(line))
    got = np.array(rows, float).reshape(len(rows), len(NAMES))
    return (got[:, :, None] > _EDGES[None]).sum(axis=2).astype(np.uint8), np.array(sizes, float)


@dataclass
class Chain:
    """weights: [previous, own, next][measure][bin], of "good" against "bad"; pair[a][b]: of b after a; scale: the logistic fit."""

    weights: np.ndarray
    first: np.ndarray
    pair: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    empty: float = 0.0

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Log-odds of each line before the chain; a line at an edge has no neighbour there."""
        at = np.arange(len(NAMES))
        per = self.weights[:, at, bins.astype(int)].sum(axis=2)
        out = per[1] + self.first[0]
        out[1:] += per[0][:-1]
        out[:-1] += per[2][1:]
        return out

    def marginals(self, bins: np.ndarray) -> np.ndarray:
        """Forward-backward over the two states, as log-odds."""
        own = self.scores(bins).tolist()
        (bb, bg), (gb, gg) = np.exp(self.pair).tolist()
        n, exp, log = len(own), math.exp, math.log
        ahead, back = [0.0] * n, [0.0] * n
        x = 0.0
        for t in range(n):
            if t:
                e = exp(min(max(x, -300.0), 300.0))
                x = log((e * gg + bg) / (e * gb + bb))
            x += own[t]
            ahead[t] = x
        x = 0.0
        for t in range(n - 2, -1, -1):
            e = exp(min(max(x + own[t + 1], -300.0), 300.0))
            x = log((e * gg + gb) / (e * bg + bb))
            back[t] = x
        return 1 / (1 + np.exp(-np.clip(np.array(ahead) + np.array(back), -300, 300)))

    def raw(self, bins: np.ndarray, sizes: np.ndarray) -> float:
        return float((self.marginals(bins) * sizes).sum() / sizes.sum())

    def score(self, bins: np.ndarray, sizes: np.ndarray) -> float:
        if not len(sizes):
            return self.empty
        p = min(max(self.raw(bins, sizes), 1e-4), 1 - 1e-4)
        return 1 / (1 + math.exp(-(self.scale[0] * math.log(p / (1 - p)) + self.scale[1])))


def _forward_backward(own: np.ndarray, pair: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" (n x t) and summed pair marginals (2 x 2) of padded sequences."""
    n, t = own.shape
    e = np.stack([np.zeros_like(own), own], axis=2)
    move = pair[None]
    ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    ahead[:, 0] = e[:, 0]
    for k in range(1, t):
        ahead[:, k] = e[:, k] + np.logaddexp(ahead[:, k - 1, 0, None] + move[:, 0], ahead[:, k - 1, 1, None] + move[:, 1])
    for k in range(t - 2, -1, -1):
        x = e[:, k + 1] + back[:, k + 1]
        got = np.logaddexp(move[:, :, 0] + x[:, None, 0], move[:, :, 1] + x[:, None, 1])
        back[:, k] = np.where((k + 1 < length)[:, None], got, 0.0)
    both = ahead + back
    good = 1 / (1 + np.exp(-np.clip(both[:, :, 1] - both[:, :, 0], -500, 500)))
    total = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    joint = ahead[:, :-1, :, None] + move[:, None] + (e + back)[:, 1:, None, :] - total[:, None, None, None]
    inside = np.arange(1, t)[None] < length[:, None]
    return good, (np.exp(np.minimum(joint, 0)) * inside[:, :, None, None]).sum(axis=(0, 1))


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 80, rate: float = 0.1, decay: float = 2e-3, longest: int = 64) -> Chain:
    """Maximum likelihood with a quadratic penalty by Adam. docs: bins, lengths, label; every line starts with its document's label.

    Long documents are cut into runs of `longest` lines for training. Each document weighs the same.
    """
    known = [(b, y) for b, _, y in docs if len(b)]
    chain = Chain(np.zeros((3, len(NAMES), BINS)), np.zeros(1), np.zeros((2, 2)), empty=0.0)
    if not known or len({y for _, y in known}) < 2:
        chain.scale = (0.0, 10.0 if known and known[0][1] else -10.0)
        return chain
    runs = [(b[k : k + longest], y, len(b)) for b, y in known for k in range(0, len(b), longest)]
    n, t = len(runs), max(len(b) for b, _, _ in runs)
    bins, length, y, weight = np.zeros((n, t, len(NAMES)), np.int64), np.zeros(n, int), np.zeros(n), np.zeros(n)
    for i, (b, label, whole) in enumerate(runs):
        bins[i, : len(b)], length[i], y[i], weight[i] = b, len(b), label, len(b) / whole
    inside = np.arange(t)[None] < length[:, None]
    at = np.arange(len(NAMES))
    flat = bins + at * BINS
    size = len(NAMES) * BINS
    params = [chain.weights, chain.first, chain.pair]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # Lines of a document share a label, so the observed transitions only say how sticky lines are.
    stay = np.zeros((2, 2))
    np.add.at(stay, (y.astype(int), y.astype(int)), np.maximum(length - 1, 0))
    own_at = flat[inside]
    line_weight = (weight / np.maximum(length, 1))[:, None].repeat(t, 1)[inside]
    lines = inside.sum()
    for step in range(1, rounds + 1):
        per = [np.where(inside, chain.weights[k].reshape(-1)[flat].sum(axis=2), 0.0) for k in range(3)]
        own = per[1] + chain.first[0] * inside
        own[:, 1:] += per[0][:, :-1] * inside[:, 1:]
        own[:, :-1] += per[2][:, 1:]
        own *= inside
        good, joint = _forward_backward(own, chain.pair, length)
        miss = np.where(inside, y[:, None] - good, 0.0) * (weight / np.maximum(length, 1))[:, None]
        grads = [np.zeros((3, size)), np.array([miss.sum()]) / len(known), (stay - joint) / lines * 0.1]
        shifted = [np.zeros_like(miss), miss, np.zeros_like(miss)]
        shifted[0][:, :-1] = miss[:, 1:]
        shifted[2][:, 1:] = miss[:, :-1]
        for k in range(3):
            g = np.bincount(own_at.ravel(), np.repeat(shifted[k][inside], len(NAMES)), size)
            grads[0][k] = g / len(known)
        grads[0] = grads[0].reshape(chain.weights.shape)
        for k, p in enumerate(params):
            g = grads[k] - decay / (1 if k < 2 else 0.05) * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    # The scale of the document's score: logistic regression on the log-odds of the weighted mean.
    x = np.array([chain.raw(b, s) for b, s, _ in docs if len(b)])
    x = np.clip(x, 1e-4, 1 - 1e-4)
    x, target = np.log(x / (1 - x)), np.array([label for b, _, label in docs if len(b)], float)
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.array([((target - p) * x).sum() - 0.01 * a, (target - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, c = a + d[0], c + d[1]
        if abs(d).max() < 1e-8:
            break
    chain.scale = (float(a), float(c))
    empties = [label for b, _, label in docs if not len(b)]
    chain.empty = (sum(empties) + 0.0) / (len(empties) + 2.0)
    return chain


def thinned(bins: np.ndarray, sizes: np.ndarray, most: int, run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """All lines, or of more than `most` evenly spread runs of neighbours, at most so many."""
    if len(bins) <= most:
        return bins, sizes
    runs = -(-len(bins) // run)
    kept = np.arange(len(bins)) // run % -(-runs // max(1, most // run)) == 0
    return bins[kept], sizes[kept]


def sample(docs: DataFrame, labels: DataFrame, bound: int, lines: int, id_col: str, text_col: str, label_col: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most `bound` labelled documents outside the held-out fold, the first by a hash of the id, with at most `lines` lines each; what reaches the driver is their bins.

    Of several texts of one id the one with the least bins is taken, so that the model is the same every time.
    """
    # One label a document: repeated rows agree on the majority, ties are bad.
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_mod(id_col, 4) != 2))
    known = known.groupBy(id_col).agg((F.avg(F.col(label_col).cast("double")) > 0.5).cast("int").alias("y"))
    chosen = cut(known.orderBy(F.xxhash64(F.lit("train"), id_col), id_col).limit(bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [thinned(*lines_of(t), lines) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([s.astype(np.float32).tobytes() for _, s in got], pa.binary())], ["id", "y", "bins", "sizes"])

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, bins binary, sizes binary")  # at most `bound` small rows
    rows = rows.groupBy("id").agg(F.min(F.struct("y", "bins", "sizes")).alias("r")).select("id", "r.*").orderBy("id").collect()
    return [(np.frombuffer(r["bins"], np.uint8).reshape(-1, len(NAMES)), np.frombuffer(r["sizes"], np.float32).astype(float), r["y"]) for r in rows]


def classify(docs: DataFrame, labels: DataFrame, bound: int = 2000, lines: int = 2048, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = (), suffix: str = "") -> DataFrame:
    """The id, columns in `keep`, held_out, score, predicted and n_lines for every row; whole texts, no shuffle of texts.

    `suffix` is put behind the new columns' names, where one in `keep` clashes with them.
    The model is fitted on at most `bound` labelled documents whose crc32(id) mod 4 is not 2, and at most `lines` lines of each; every document is scored whole. Only the text is
    looked at. A null or empty text has no lines and gets the share of good ones among labelled empty texts,
    smoothed (0 without such). Without labels of both kinds the score is the one label's side. Null
    ids are scored and not held out (their crc32 is that of an empty text); repeated rows stay.
    """
    chain = train(sample(docs, labels, bound, lines, id_col, text_col, label_col))
    score, counted = f"score{suffix}", f"n_lines{suffix}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lines_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(2, b.num_columns)), pa.array([chain.score(*x) for x in got], pa.float64()), pa.array([len(s) for _, s in got], pa.int64())], [id_col, *keep, score, counted])

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    scored = docs.select(id_col, text_col, *keep).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}{extra}, {score} double, {counted} bigint")
    return scored.select(id_col, *keep, (crc_mod(id_col, 4) == 2).alias(f"held_out{suffix}"), score, (F.col(score) >= least).cast("int").alias(f"predicted{suffix}"), counted)
