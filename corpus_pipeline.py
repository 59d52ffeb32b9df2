"""A training corpus from `documents` in five stages, each written as Parquet and read again by the next.

Belongs to the llm folder and goes when it goes.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import mixing, near_dedup, quality_classifier, sentence_pieces, surrogates
from veilmark.llm.common import BATCH_ROWS, shared_dir, spread, tidy
from veilmark.llm.queries import KEY, model_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-chain classifier rejects (score under 0.7) go.

    A null or empty text has no lines and the score of labelled empty texts; a null id is scored like others; repeated
    rows share their fate; an empty table gives an empty one. Other columns stay, whatever their names.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    columns = docs.columns
    others = tuple(c for c in columns if c not in ("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(spread(docs), labels, keep=("text", *others), suffix="__line_chain").filter("predicted__line_chain = 1").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id.

    Texts that are null or without words are no copies and stay; of rows repeated with one id and text one stays; a row
    without an id goes if its group has one with an id. An empty table gives an empty one.
    """
    return near_dedup.deduplicated(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars follows the text.

    Every row stays, null and empty texts as they are; equal texts get equal surrogates.
    """
    out = surrogates.pseudonymise(docs, KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares by Poisson replication, one epoch, shuffled.

    A null source is a source; rows repeated with one id get as many copies each; a document may get none. Every
    column stays; an empty table gives an empty one.
    """
    return mixing.mix(docs, copy_col=None).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the id and the source; a row a row. A null or empty text has none."""
    return sentence_pieces.encode(docs, model_file(), keep=("source",))


def tidied(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, after what the stages before it have left in the driver is freed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", tidied(quality)),
    ("MinHash near-dedup", tidied(near_duplicates)),
    ("PII", tidied(personal_data)),
    ("mixing sources to target weights", tidied(mixture)),
    ("SentencePiece encoding", tidied(tokens)),
]

#: The stages need a trained model, minima and a tokenizer, which SQL has not; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
