"""Pattern recognition: every match of every recogniser of a text as an array of spans, in one pass over the texts."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.catalog import Recogniser, recognisers
from veilmark.functions.expressions import FIELDS, SPAN

Finder = Callable[[str], list[tuple[int, int, str, float]]]


@dataclass(frozen=True)
class Context:
    """Boost for a context word among the preceding words: by `delta`, to `least` at least, one at most."""

    words: int = 5
    delta: float = 0.35
    least: float = 0.4


def words_before(text: str, start: int, n: int) -> str:
    """The last n whole words before a place, in lower case, joined by blanks."""
    reach = 16 * n
    while True:
        words = text[max(0, start - reach) : start].split()
        if len(words) > n or reach >= start:  # the first one may be cut, so it doesn't count
            return " ".join(words[-n:]).lower()
        reach *= 4


def boosted(text: str, start: int, score: float, context: tuple[str, ...], how: Context) -> float:
    before = words_before(text, start, how.words)
    return min(1.0, max(score + how.delta, how.least)) if any(c in before for c in context) else score


def recognise_texts(found: tuple[Recogniser, ...], context: Context | None = None, ignore_case: bool = False, finders: tuple[tuple[str, Finder], ...] = ()) -> Column:
    """A function of a text column that gives array<span>; to be used once on a column, as it isn't evaluated twice for free.

    A pattern that isn't valid is left out with a warning, like an item without a name. finders: further recognisers (name, function of a text).
    """
    flags = re.IGNORECASE if ignore_case else 0
    compiled = []
    for r in found:
        for p in r.patterns:
            try:
                compiled.append((r.entity, p.name, re.compile(p.regex, flags), p.score, tuple(c.lower() for c in r.context), r.group != "custom" and "[0-9]" in p.regex))
            except re.error as e:
                warnings.warn(f"pattern {p.name} of {r.entity} isn't valid and is left out: {e}", stacklevel=2)
    digit = re.compile("[0-9]")

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(texts: pa.Array) -> pa.Array:
        starts, ends, kinds, values, scores, names, offsets = [], [], [], [], [], [], [0]
        for text in texts.to_pylist():
            if text:
                has_digit = digit.search(text) is not None
                for entity, name, pattern, score, words, needs_digit in compiled:
                    if needs_digit and not has_digit:  # in the catalogue this class never stands in an optional part
                        continue
                    before = len(starts)
                    for m in pattern.finditer(text):
                        start, end = m.span()
                        starts.append(start)
                        ends.append(end)
                        values.append(m[0])
                        scores.append(round(boosted(text, start, score, words, context), 3) if context and words else score)
                    n = len(starts) - before
                    if n:
                        kinds += [entity] * n
                        names += [name] * n
                for name, finder in finders:
                    for start, end, kind, score in finder(text):
                        starts.append(start)
                        ends.append(end)
                        values.append(text[start:end])
                        scores.append(round(score, 3))
                        kinds.append(kind)
                        names.append(name)
            offsets.append(len(starts))
        n = len(starts)
        columns = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(scores, pa.float64()), pa.array([True] * n, pa.bool_()), pa.nulls(n, pa.string()), pa.array(names, pa.string())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(FIELDS)))

    return spans.asNondeterministic()


def recognise(docs: DataFrame, domain: str = "general", context: Context | None = None, custom: tuple[Recogniser, ...] = (), types: tuple[str, ...] | None = None, finders: tuple[tuple[str, Finder], ...] = (), text_col: str = "text") -> DataFrame:
    """docs with a column `spans`."""
    fn = recognise_texts(recognisers(domain, custom, types), context, finders=finders)
    return docs.withColumn("spans", fn(F.col(text_col)))


NAME = r"[A-ZÀ-Þ][a-zß-ÿ]+"
TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.? ({NAME}(?: {NAME}){{0,2}})")
COMPANY = re.compile(rf"\b({NAME}(?: {NAME}){{0,3}} (?:Ltd|Limited|Inc|LLC|LLP|GmbH|AG|SA|SE|Corp|Corporation|PLC|plc))\b")


def heuristic_names(text: str) -> list[tuple[int, int, str, float]]:
    """A stand-in for a name model, by rules: names behind a title are persons, capitalised words before a legal form are organisations."""
    return [(m.start(1), m.end(1), "PERSON", 0.85) for m in TITLED.finditer(text)] + [(m.start(1), m.end(1), "ORGANIZATION", 0.85) for m in COMPANY.finditer(text)]


#: Short lists for the stand-in; larger ones are a parameter of term_finder().
PLACES = """Amsterdam Athens Berlin Bern Brussels Bucharest Budapest Copenhagen Dublin Frankfurt Geneva Hamburg Helsinki Lisbon London Luxembourg Madrid
Milan Munich Nicosia Oslo Paris Prague Riga Rome Sofia Stockholm Tallinn Valletta Vienna Vilnius Warsaw Zagreb Zurich Austria Belgium Bulgaria Canada China
Croatia Cyprus Denmark Estonia Finland France Germany Greece Hungary India Ireland Italy Japan Latvia Lithuania Malta Netherlands Norway Poland Portugal Romania
Slovakia Slovenia Spain Sweden Switzerland Turkey Ukraine""".split() + ["New York", "San Francisco", "United Kingdom", "United States", "Hong Kong", "Los Angeles"]
GROUPS = """American Austrian Belgian British Bulgarian Canadian Chinese Croatian Cypriot Czech Danish Dutch Estonian Finnish French German Greek Hungarian Indian
Irish Italian Japanese Latvian Lithuanian Maltese Norwegian Polish Portuguese Romanian Russian Slovak Slovenian Spanish Swedish Swiss Turkish Ukrainian
Buddhist Catholic Christian Hindu Jewish Muslim Orthodox Protestant Sikh""".split()


def term_finder(terms: dict[str, list[str]], score: float = 0.85) -> Finder:
    """A finder of the terms of each type as whole words, the longest first; to be made from a term table of bounded size."""
    kinds = {t: kind for kind, ts in terms.items() for t in ts}
    found = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(kinds, key=lambda t: (-len(t), t)))) + r")\b") if kinds else None

    def find(text: str) -> list[tuple[int, int, str, float]]:
        return [(m.start(), m.end(), kinds[m[0]], score) for m in found.finditer(text)] if found else []

    return find


def term_table(terms: DataFrame, type_col: str = "type", term_col: str = "term", most: int = 200_000) -> dict[str, list[str]]:
    """The terms by type from a table, for term_finder(); a table of over `most` rows is an error, as a pattern isn't the way for it."""
    rows = terms.select(type_col, term_col).filter(F.col(term_col) != "").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} terms: join them as a table")
    out: dict[str, list[str]] = {}
    for kind, term in sorted(map(tuple, rows)):
        out.setdefault(kind, []).append(term)
    return out


#: Finders by the name that profiles use. A model is added as a function of a text that loads its weights once a process.
FINDERS: dict[str, Finder] = {"rules": heuristic_names, "gazetteer": term_finder({"LOCATION": PLACES, "NRP": GROUPS})}
