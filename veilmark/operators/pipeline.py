"""The whole way: recognise, resolve overlaps, filter, clean, number, substitute. All steps but the first are projections on one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import expressions as X
from veilmark.functions.catalog import SKIP_WORDS, Recogniser, stop_terms
from veilmark.operators.recognise import Context, Finder, recognise


@dataclass(frozen=True)
class Settings:
    """What a profile resolves to. context: the boost for context words, or None; without it the weakest patterns never reach the least score. compat: spans split at a line end stay unverified, so they are reported but not replaced."""

    domain: str = "general"
    min_score: float = 0.5
    extra_stop: tuple[str, ...] = ()
    custom: tuple[Recogniser, ...] = ()
    context: Context | None = Context()
    finders: tuple[tuple[str, Finder], ...] = ()
    types: tuple[str, ...] | None = None
    prefix: str = ""
    compat: bool = False
    validate_first: bool = False

    @property
    def most_frequent(self) -> int:
        return 12 if self.domain in ("financial", "healthcare") else 8


def with_spans(df: DataFrame, *steps: str) -> DataFrame:
    """Applies SQL expressions over `spans` (and `text`) one after another."""
    for step in steps:
        df = df.withColumn("spans", F.expr(step))
    return df


def false_positives(df: DataFrame, how: Settings) -> DataFrame:
    """Stop list, all words in it, structural references, lower-case words that nothing confirms; then frequency among what is left."""
    terms = sorted({*stop_terms(how.domain), *(t.lower() for t in how.extra_stop)})
    stop = X.array_of(terms)
    listed = f"{X.in_stop_list('s.text', 'sl')} OR {X.all_words_stop('s.text', 'sl')}"
    # A text with a digit is none of terms without one, nor are all its words.
    if not any("0" <= c <= "9" for t in (*terms, *SKIP_WORDS) for c in t):
        listed = f"(NOT s.text rlike '[0-9]' AND ({listed}))"
    drop = f"{listed} OR {X.structural('s.text')}"
    # What confirms a word is looked for among all spans, so that rule comes first.
    return with_spans(df, X.confirmed("spans"), X.let(stop, "sl", f"filter(spans, s -> NOT ({drop}))"), X.not_frequent("spans", how.most_frequent))


def clean(df: DataFrame, how: Settings, text_col: str = "text") -> DataFrame:
    """From raw spans to the final ones, in the order: overlaps, score, check digits, word edges, short ones, lines, rules; then overlaps again."""
    first = [X.resolved("spans"), X.at_least("spans", how.min_score), X.checked("spans")]
    if how.validate_first:
        first = [first[2], first[0], first[1]]
    df = with_spans(df, *first, X.snapped("spans", f"`{text_col}`"), X.not_short("spans"), X.by_line("spans", "null" if how.compat else "true"))
    return with_spans(false_positives(df, how), X.held(X.resolved("spans")))


def detect(docs: DataFrame, how: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """docs with `spans`: resolved, clean and in order. A null or empty text has none."""
    return clean(recognise(docs, how.domain, how.context, how.custom, how.types, how.finders, text_col), how, text_col)


def anonymise(detected: DataFrame, how: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """Adds numbered (the verified spans with placeholders), anonymized_text and mapping."""
    sure = "filter(spans, s -> coalesce(s.verified, false))"
    out = detected.withColumn("numbered", F.expr(X.held(X.family_numbers(sure, how.prefix))))
    return out.withColumn("anonymized_text", F.expr(X.substituted(f"`{text_col}`", "numbered"))).withColumn("mapping", F.expr(X.mapping_of("numbered")))


def restore(texts: DataFrame, text_col: str = "anonymized_text", mapping_col: str = "mapping") -> DataFrame:
    """Adds restored_text and entities_restored (the size of the mapping)."""
    return texts.withColumn("restored_text", F.expr(X.restored(f"`{text_col}`", f"`{mapping_col}`"))).withColumn("entities_restored", F.size(mapping_col).cast("bigint"))


def exploded(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The long form: a row a span."""
    return df.select(id_col, F.posexplode("spans").alias("span_no", "s")).select(id_col, "span_no", "s.*")


def summary(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row a document: totals, verified, unique placeholders and a map of counts by type."""
    types = "array_distinct(transform(numbered, s -> s.type))"
    return df.select(
        id_col,
        "anonymized_text",
        F.size("spans").cast("bigint").alias("total_entities"),
        F.size("numbered").cast("bigint").alias("entities_confirmed"),
        F.size("mapping").cast("bigint").alias("unique_entities"),
        F.expr(f"map_from_arrays({types}, transform({types}, t -> size(filter(numbered, s -> s.type = t))))").alias("by_type"),
        "mapping",
    )


def safe(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans without their texts, for review lists and logs."""
    return exploded(df, id_col).select(id_col, "start", "end", "type", "score", "verified", "reason")
