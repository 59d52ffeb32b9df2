"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: (its target share) x (documents wanted) / (its documents). A
document's number of copies is a Poisson variable with that mean, found by inverting the distribution at
a uniform number that is a hash of seed and id. A mean over PART is the sum of equal means of at most PART, each with
a number of its own, as sums of Poisson variables are Poisson and exp(-mean) must not vanish. The copies are dealt out by a hash, so that their
order is a uniform shuffle of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cut, fresh

#: 13 hex digits: what a double holds exactly.
HASH_RANGE = float(16**13)
#: The largest mean that is inverted at once: exp(-PART) is still a normal double.
PART = 700
#: Copies of a document that are numbered in one array.
RUN = 10_000


def uniform(seed: str, *columns: str) -> Column:
    """In [0, 1), from md5 of the seed and the columns as text (null: empty)."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(HASH_RANGE)


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, epochs: float, most: int | None) -> DataFrame:
    """A row a source: rate, parts, and cdf: the distribution function of a part at 0, 1, ... while a count above it is possible.

    weights: the target share of each source, in any unit; sources without one get none of the mixture, and
    None gives all sources the same share. A rate over `most`, if that is given, is an error, not a cap.
    """
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("size"))
    share = F.lit(1.0)
    if weights is not None:
        share = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("mix_source")], F.lit(0.0)).cast("double")
    one = cut(sizes.withColumn("share", share))
    shares, docs_in_all = one.agg(F.sum("share"), F.sum("size")).first()
    rate = F.expr(f"share / {float(shares or 0)!r}D * {float(docs_in_all or 0)!r}D / size") * F.lit(float(epochs)) if shares else F.lit(0.0)
    rated = one.select("mix_source", rate.alias("rate"))
    if most is not None:
        rated = rated.withColumn("rate", F.when(F.col("rate") <= most, F.col("rate")).otherwise(F.raise_error(F.lit(f"a source would be repeated over {most} times"))))
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("part", F.col("rate") / F.col("parts"))
    terms = F.expr("""transform(aggregate(sequence(1, cast(ceil(part + 12 * sqrt(part) + 40) as int)),
        named_struct('p', exp(-part), 'all', array(exp(-part))),
        (s, k) -> named_struct('p', s.p * part / k, 'all', concat(s.all, array(s.all[size(s.all) - 1] + s.p * part / k)))).all, x -> x)""")
    return rated.withColumn("cdf", terms).drop("part")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", most: int | None = None, copy_col: str | None = "copy") -> DataFrame:
    """All columns of docs, a row a copy, and the copy's number from 0 in `copy_col` if that is named (a column of that name is replaced).

    A null source is a source of its own; a null id draws like an empty text. Rows repeated with one id get the same count. An empty table gives an empty one. The join with the rates is by source, and the
    rates (a row a source, of at most about 1,100 numbers) are broadcast if they are fewer than 10,000
    sources; else Spark joins by shuffling. The shuffle moves each copy once, dealt by a hash of id and
    copy (rows without an id: of all their columns), so a source with a third of the rows is spread evenly.
    """
    table = cut(rates(docs, source_col, weights, epochs, most))
    few = table.select("mix_source").limit(10_001).count() <= 10_000
    name = copy_col or fresh(docs.columns, "mix_copy")
    base = [c for c in docs.columns if c != name]
    # What this adds stands in one column beside the document's own, so that no names clash.
    own = docs.select(F.struct(*docs.columns).alias("doc"))
    id_ = F.col(f"doc.`{id_col}`")
    own = own.withColumn("mix_id", F.coalesce(id_.cast("string"), F.lit("")))
    joined = own.withColumn("mix_u", uniform(seed, "mix_id")).join(F.broadcast(table) if few else table, F.col(f"doc.`{source_col}`").eqNullSafe(F.col("mix_source")))
    copies = F.expr("size(filter(cdf, x -> x <= mix_u))")
    many = not table.filter("parts > 1").isEmpty()
    if not many:
        numbers = F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1))
    else:
        # The first part has the number of an undivided mean, each other one of its own.
        more = F.expr(f"""CASE WHEN parts < 2 THEN 0 ELSE aggregate(sequence(1, parts - 1), 0, (n, k) -> n + aggregate(
            array(cast(conv(substring(md5(cast(concat({_sql(seed + "-part-")}, k, '|', mix_id) as binary)), 1, 13), 16, 10) as double) / {HASH_RANGE!r}D), 0, (m, u) -> size(filter(cdf, x -> x <= u)))) END""")
        copies = copies + more
        numbers = F.explode(F.expr(f"sequence(mix_from, least(mix_n, mix_from + {RUN}) - 1)"))
    out = joined.withColumn("mix_n", copies).filter("mix_n > 0")
    if many:
        out = out.select("doc", "mix_id", "mix_n", F.explode(F.expr(f"sequence(0, mix_n - 1, {RUN})")).alias("mix_from"))
    out = out.select("doc", "mix_id", numbers.alias("mix_copy"))
    place = F.when(id_.isNull(), F.xxhash64("doc")) if any_null(docs, id_col) else F.lit(None)
    out = out.withColumn("mix_row", place.cast("string")).withColumn("mix_key", uniform(seed + "-order", "mix_id", "mix_copy", "mix_row"))
    return out.repartition("mix_key").sortWithinPartitions("mix_key").select(*(F.col(f"doc.`{c}`").alias(c) for c in base), *([F.col("mix_copy").alias(name)] if copy_col else []))


def any_null(docs: DataFrame, column: str) -> bool:
    return not docs.filter(F.col(column).isNull()).isEmpty()


#: DuckDB SQL for mix() with equal shares, one epoch and the default seed; {columns} are those of documents.
SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
rated AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE / size::DOUBLE AS rate FROM sizes),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
steps AS (SELECT source, list(total) AS totals FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, ('0x' || substring(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d
)
SELECT {columns}, unnest(range(len(list_filter(totals, lambda x: x <= u)))) AS copy
FROM drawn JOIN steps ON drawn.source IS NOT DISTINCT FROM steps.source
"""
