"""Results as files under their own names, written by the tasks through Arrow's file systems, and sessions that replace themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_name(path: str) -> Column:
    """`{stem}_anonymized{suffix}` of a path; what was read from PDF is written as text."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_anonymized"), F.when(F.lower(suffix) == ".pdf", F.lit(".txt")).otherwise(suffix))


def write_files(df: DataFrame, folder: str, session_col: str = "session_id", name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """Writes each row's content (text as UTF-8, or binary) to `folder/veilmark_{session}/{name}`; gives path and n_bytes of what was written.

    A file is written under another name and then moved, so that a repeated task replaces it whole. The work is done
    when the result is computed; a row without content writes nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            rows = []
            for session, name, content in zip(b["s"], b["n"], b["c"]):
                if content is None:
                    continue
                data = content.encode() if isinstance(content, str) else bytes(content)
                here = f"{top}/veilmark_{session}"
                where.create_dir(here, recursive=True)
                draft = f"{here}/.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as f:
                    f.write(data)
                where.move(draft, f"{here}/{name}")
                rows.append((f"{here}/{name}", len(data)))
            yield pd.DataFrame(rows, columns=["path", "n_bytes"])

    return df.select(F.col(session_col).cast("string").alias("s"), F.col(name_col).alias("n"), F.col(content_col).alias("c")).mapInPandas(run, "path string, n_bytes bigint")


def replace_sessions(df: DataFrame, path: str, session_col: str = "session_id") -> None:
    """Writes rows by session; sessions that are in `df` are replaced as a whole when the job commits, others stay."""
    df.write.partitionBy(session_col).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
