"""Reading tables and texts by Spark's readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_KINDS = (".txt", ".md", ".csv", ".log", ".text")
KINDS = (*TEXT_KINDS, ".docx", ".pdf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; `documents` and `customer`, on whose texts the work is heavy, are dealt out over the cores where they have under 4 MB a core."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if name in ("documents", "customer") and size < cores * 4_000_000 else df


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id (from the path), text: a row a file, whole, UTF-8; a CSV file isn't parsed."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.filter(suffix("path").isin(*TEXT_KINDS)).select("path", F.xxhash64("path").alias("doc_id"), "text")


def suffix(col: str) -> F.Column:
    return F.lower(F.regexp_extract(F.col(col), r"(\.[^./]+)$", 1))


def find_files(spark: SparkSession, folder: str, pattern: str, most: int = 10) -> DataFrame:
    """path, length of at most `most` files under a folder, by path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "length").orderBy("path").limit(most)


def long_enough(df: DataFrame, least: int = 50, text_col: str = "text") -> DataFrame:
    return df.filter(F.length(F.trim(F.col(text_col))) >= least)


def pdf_texts(spark: SparkSession, path: str, pages: Callable[[bytes], list[str | None]], least: int = 50) -> DataFrame:
    """path, doc_id, text, error: page texts, from the extractor that is given, joined by a line feed; a page without one is empty. A text under `least` characters, or a file that the extractor refuses, is null with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for data in b["content"]:
                try:
                    text, error = "\n".join(p or "" for p in pages(bytes(data))), None
                except Exception as e:  # whatever an extractor raises is about this file
                    text, error = None, str(e) or type(e).__name__
                if text is not None and len(text.strip()) < least:
                    text, error = None, f"under {least} characters of text"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": b["path"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string, error string").select("path", F.xxhash64("path").alias("doc_id"), "text", "error")


def dispatch(spark: SparkSession, path: str, pdf_pages: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """Texts of a file or folder by its suffix; an unknown one is an error, as is PDF without an extractor of page texts."""
    kind = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind == ".docx":
        from veilmark.sources.documents import docx_texts

        return docx_texts(spark, path)
    if kind == ".pdf":
        if pdf_pages is None:
            raise NotImplementedError("PDF needs an extractor of page texts: dispatch(..., pdf_pages=...)")
        return pdf_texts(spark, path, pdf_pages)
    if kind and kind not in TEXT_KINDS:
        raise ValueError(f"unsupported kind of file: {kind}")
    return text_files(spark, path)
