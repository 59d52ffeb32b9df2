"""Overlapping chunks of long texts, for stages with a bounded input, and the way back to document offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_expr(text: str, size: int = 4000, overlap: int = 250) -> str:
    """array<struct<off, end>>: pieces of at most `size`; all but the last end behind the last blank of their final `overlap` characters."""
    state = "struct<pos: int, done: boolean, out: array<struct<off: int, end: int>>>"
    tail = f"substring({text}, st.pos + {size - overlap} + 1, {overlap})"
    cut = f"st.pos + {size - overlap} + CASE WHEN instr(reverse({tail}), ' ') > 0 THEN {overlap} - instr(reverse({tail}), ' ') + 1 ELSE {overlap} END"
    step = f"""CASE WHEN st.done THEN st
        WHEN st.pos + {size} >= length({text}) THEN named_struct('pos', st.pos, 'done', true, 'out', concat(st.out, array(named_struct('off', st.pos, 'end', length({text})))))
        ELSE named_struct('pos', ({cut}) - {overlap}, 'done', false, 'out', concat(st.out, array(named_struct('off', st.pos, 'end', {cut})))) END"""
    rounds = f"sequence(0, cast(length({text}) div {size - 2 * overlap} as int) + 1)"
    return f"aggregate({rounds}, cast(named_struct('pos', 0, 'done', false, 'out', array()) as {state}), (st, k) -> cast({step} as {state}), st -> st.out)"


def chunks(docs: DataFrame, size: int = 4000, overlap: int = 250, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, chunk_no, off, text. A null text has none, an empty one a single empty chunk."""
    with_spans = docs.select(F.col(id_col), F.col(text_col).alias("whole"), F.posexplode(F.expr(chunk_expr(f"`{text_col}`", size, overlap))).alias("chunk_no", "c"))
    return with_spans.select(id_col, "chunk_no", F.col("c.off").alias("off"), F.expr("substring(whole, c.off + 1, c.end - c.off)").alias("text"))


def to_document(spans: DataFrame) -> DataFrame:
    """Spans found in chunks (with off) in document offsets; the same place and type found in two chunks counts once with its best score."""
    moved = spans.withColumn("start", F.col("start") + F.col("off")).withColumn("end", F.col("end") + F.col("off"))
    return moved.groupBy("doc_id", "start", "end", "type").agg(F.max("score").alias("score"))
