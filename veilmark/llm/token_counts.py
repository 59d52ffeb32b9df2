"""Token counts at every prefix, by dynamic programming over a byte-pair vocabulary with scores.

A BPE encoding cut between two tokens leaves two valid encodings, and a row of tokens is a valid
encoding if and only if each neighbouring pair of it is: a merge across a boundary would happen among
those two tokens alone as well. So exactly one token ends the encoding of each prefix, and

    count[i] = count[i - len(t)] + 1

for the one vocabulary entry t that ends at i and whose pair with the last token of prefix
i - len(t) is stable. Where no entry has white space behind a letter, no merge crosses the start of a
word, so the table of a text is put together from small tables of its words, which are kept.

A table is stored as its steps: a signed byte a character, what the character adds to the count (the longest entry bounds how
much it can take away). The running sum of a text's steps is the exact count at every prefix: the last one is the text's count,
and questions about truncation and budgets are answered from it (`count_at`, `fitting`) without the text or the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Kept(dict):
    """A function's results by key, for the keys seen lately: at the bound the older half goes."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            self[key] = out
        return out


class PrefixCounter:
    """Exact token counts of all prefixes under a sentencepiece BPE model with byte fallback.

    texts: normalised as the model's identity rule does (a marker before the text, markers for blanks).
    """

    def __init__(self, model_file: str, kept_words: int = 400_000):
        import ahocorasick
        import sentencepiece.sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        rule = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
            raise ValueError("prefix counts need a BPE model with the identity normaliser and a dummy prefix")
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4, 5)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a vocabulary entry spans words")
        self.longest = max(map(len, self.score))
        self.fallback = proto.trainer_spec.byte_fallback
        self.pieces = list(self.score)
        self.single = {p for p in self.pieces if len(p) == 1}
        if not self.single.issuperset("".join(self.pieces)):
            raise ValueError("a character has no entry of its own")
        self.ends = ahocorasick.Automaton()
        for k, piece in enumerate(self.pieces):
            self.ends.add_word(piece, (len(piece), k))
        self.ends.make_automaton()
        # Signs before which no merge reaches back over a letter or digit: words can be cut there, too.
        held = {p[i] for p in self.pieces for i in range(1, len(p)) if p[i - 1].isalnum()}
        cuts = "".join(re.escape(c) for c in map(chr, range(1, 128)) if not c.isalnum() and c != "_" and c not in held)
        self.cut = re.compile(rf"(?<=[^\W_])(?=[{cuts}])") if cuts else None
        if self.longest > 120:
            raise ValueError("an entry is too long for steps of a byte")
        part = Kept(lambda p: steps_of(self.table(p)), kept_words)
        self.steps = Kept(lambda w: b"".join(map(part.__getitem__, self.parts(SPACE + w))), kept_words)
        self.stable: dict[int, bool] = {}

    def merged(self, chars: str) -> list[str]:
        """The merge procedure itself, for strings of a few characters: best score first, then leftmost."""
        parts, score = list(chars), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are; -1 on the left: whether the right one alone does."""
        key = (left << 32) + right
        out = self.stable.get(key)
        if out is None:
            if len(self.stable) > 500_000:
                self.stable.clear()
            pair = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
            out = self.stable[key] = self.merged("".join(pair)) == pair
        return out

    def table(self, word: str) -> list[int]:
        """count[0..n] of one word's prefixes. A character outside the vocabulary, which never merges, costs its bytes (or one id without byte fallback)."""
        if not self.single.issuperset(word):
            return self.table_with_unknown(word)
        n, fits, stable = len(word), self.fits, self.stable
        count, last = [0] * (n + 1), [-2] * (n + 1)
        last[0] = -1
        for end, (size, k) in self.ends.iter(word):
            if last[end + 1] == -2:
                left = last[end + 1 - size]
                ok = stable.get((left << 32) + k)
                if ok or ok is None and fits(left, k):
                    count[end + 1], last[end + 1] = count[end + 1 - size] + 1, k
        return count

    def table_with_unknown(self, word: str) -> list[int]:
        out = [0]
        for known, run in groupby(word, self.single.__contains__):
            for c in ["".join(run)] if known else run:
                part = self.table(c) if known else [0, len(c.encode()) if self.fallback else 1]
                out += [out[-1] + x for x in part[1:]]
        return out

    def words(self, text: str) -> list[str]:
        """The marked text cut before each run of markers, which no merge crosses."""
        marked = SPACE + text.replace(" ", SPACE)
        return RUNS.findall(marked) if SPACE * 2 in marked else [SPACE + w for w in marked[1:].split(SPACE)]

    def parts(self, word: str) -> list[str]:
        """A word cut before the signs behind a letter that no merge reaches over."""
        return [word] if self.cut is None or word[1:].isalnum() else self.cut.split(word)

    def prefix_steps(self, text: str | None) -> np.ndarray:
        """The steps (int8) of all characters. The marker before the text comes with its first character."""
        if not text:
            return np.empty(0, np.int8)
        if SPACE in text or "  " in text or text[0] == " ":
            words = [w[1:] for w in self.words(text)]
        else:
            words = text.split(" ")
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, words)), np.int8)
        first = int(steps[0]) + int(steps[1])
        steps = steps[1:].copy()
        steps[0] = first
        return steps

    def prefixes(self, text: str | None) -> list[int]:
        """Token count of text[:i] for i = 0..len(text)."""
        return [0, *np.cumsum(self.prefix_steps(text), dtype=np.int64).tolist()]

    def measured(self, text: str | None, budget: int) -> tuple[int, int]:
        """The count of the whole text, and the characters of the longest prefix that fits the budget."""
        steps = self.prefix_steps(text)
        return int(steps.sum(dtype=np.int64)), fitting(steps, budget)


def steps_of(table: list[int]) -> bytes:
    return bytes([(b - a) & 255 for a, b in zip(table, table[1:])])


def count_at(steps: bytes | np.ndarray, n: int) -> int:
    """The token count of the first n characters."""
    return int((np.frombuffer(steps, np.int8) if isinstance(steps, bytes) else steps)[: max(n, 0)].sum(dtype=np.int64))


def fitting(steps: bytes | np.ndarray, budget: int) -> int:
    """The characters of the longest prefix with at most `budget` tokens."""
    steps = np.frombuffer(steps, np.int8) if isinstance(steps, bytes) else steps
    if np.maximum(steps, 0).sum(dtype=np.int64) <= budget:
        return len(steps)
    fit = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


@lru_cache(maxsize=4)
def counter(model_file: str) -> PrefixCounter:
    """One a worker process, so that tables of common words are kept between batches."""
    return PrefixCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars and prefix_steps for every row, one row out for each row in.

    prefix_steps: the stored table, a signed byte a code point, whose running sum is the token count at every prefix. fit_chars:
    characters of the longest prefix within the budget. A null or empty text has 0 bytes, 0 tokens and an empty table. A null
    id stays null, repeated rows stay repeated, other columns are left out. No shuffle; memory is bounded by one batch and
    the kept tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            texts = b.column(1).to_pylist()
            steps = [c.prefix_steps(t) for t in texts]
            counts = [int(x.sum(dtype=np.int64)) for x in steps]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > budget for n in counts], pa.bool_()),
                    pa.array([fitting(x, budget) for x in steps], pa.int64()),
                    pa.array([x.tobytes() for x in steps], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_steps"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, prefix_steps binary")


def answers(tables: DataFrame, chars: Column | None = None, budget: Column | None = None, steps_col: str = "prefix_steps") -> DataFrame:
    """tables with count_at_chars (tokens of the first so many characters) and chars_within (characters of the longest prefix with so many tokens), as asked, from the stored tables alone."""
    out = tables
    if chars is not None:
        at = F.pandas_udf(lambda s, n: pd.Series([None if x is None or pd.isna(k) else count_at(bytes(x), int(k)) for x, k in zip(s, n)], dtype="Int64"), "bigint")
        out = out.withColumn("count_at_chars", at(F.col(steps_col), chars))
    if budget is not None:
        within = F.pandas_udf(lambda s, n: pd.Series([None if x is None or pd.isna(k) else fitting(bytes(x), int(k)) for x, k in zip(s, n)], dtype="Int64"), "bigint")
        out = out.withColumn("chars_within", within(F.col(steps_col), budget))
    return out
