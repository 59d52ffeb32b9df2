"""Exact top-k inner products over a bit-sliced index.

Vectors become integers floor(256 x). A block of rows keeps, for each dimension, one bitmap a binary digit of
the (shifted, so never negative) value; only the leading digits are kept as slices. For a query the slices are
added with their weights by bitmap arithmetic (full adders over whole bitmaps), which gives the digits of
a lower bound of every row's score at once. The k-th largest bound is found from the most significant slice
downward; rows within the error of the digits left out are resolved by their exact integer scores.

The index is written once, in blocks of bounded size. The queries are a table that is dealt to the blocks in small groups, so
that a task holds one block and one group; nothing is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import cut

#: Digits of each value that are left to the exact step.
LOW_DIGITS = 3


#: Bytes of a block's exact values, and of a group of queries.
BLOCK_BYTES, GROUP_BYTES = 32 << 20, 1 << 20
LONG = 2**63


def numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v array<double>, dim; without rows that take no part."""
    v = f"`{vec_col}`"
    fit = vectors.filter(f"`{id_col}` IS NOT NULL AND {v} IS NOT NULL AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x AS double)) < cast('Infinity' AS double))")
    return fit.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles: int64, or whole numbers of any size where that isn't enough."""
    if not len(flat) or np.abs(flat).max() < 2.0**54:
        return np.floor(256 * flat).astype(np.int64)
    return np.array([256 * int(x) if abs(x) >= 2.0**53 else math.floor(256 * x) for x in flat.tolist()], object)


def width_of(most: int) -> int:
    """Bytes of a signed number up to so much: 4, 8 or as many as it takes."""
    return 4 if most < 2**31 else 8 if most < LONG else most.bit_length() // 8 + 1


def packed(v: np.ndarray, width: int) -> bytes:
    if width <= 8:
        return v.astype(f"<i{width}").tobytes()
    return b"".join(int(x).to_bytes(width, "little", signed=True) for x in v.ravel())


def unpacked(data: bytes, width: int) -> np.ndarray:
    if width <= 8:
        return np.frombuffer(data, f"<i{width}").astype(np.int64)
    return np.array([int.from_bytes(data[k : k + width], "little", signed=True) for k in range(0, len(data), width)], object)


_INDEX = "block bigint, dim int, n int, digits int, width int, ids binary, exact binary, slices binary"


def plan_blocks(rows: DataFrame, every: int, block_rows: int) -> DataFrame:
    """dim, blocks, groups: in how many blocks the vectors of each length are kept, and in how many groups their queries are dealt.

    A block has about `block_rows` vectors or BLOCK_BYTES of exact values at most, and there are two a core at least.
    """
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    wide = F.greatest("dim", F.lit(1))
    most = F.least(F.lit(block_rows), F.greatest(F.floor(F.lit(BLOCK_BYTES) / (4 * wide)), F.lit(1)), F.greatest(F.floor(F.col("n") / cores), F.lit(64)))
    return sizes.select("dim", F.ceil(F.col("n") / most).alias("blocks"), F.greatest(F.ceil(F.col("q") * wide * 8 / GROUP_BYTES), F.lit(1)).alias("groups"))


def build_index(rows: DataFrame, shape: DataFrame, tasks: int) -> DataFrame:
    """A row a block of vectors of one dimension: a number, dim, n, digits, width, ids, exact (an integer matrix), slices (dimension-major bitmaps of the leading digits).

    shape: what plan_blocks() gives, a row a length of vectors, so it is small and broadcast.
    """

    def pack(block: int, dim: int, ids: list[int], v: np.ndarray) -> pa.RecordBatch:
        most = int(max(abs(v.max()), abs(v.min()))) if v.size else 0
        digits = max(LOW_DIGITS + 1, most.bit_length() + 1)
        u = v + (1 << (digits - 1))
        bits = [np.packbits((u[:, d] >> j & 1).astype(np.uint8), bitorder="little").tobytes() for d in range(dim) for j in range(LOW_DIGITS, digits)]
        width = width_of(most)
        row = (block, dim, len(ids), digits, width, np.array(ids, np.int64).tobytes(), packed(v, width), b"".join(bits))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["block", "dim", "n", "digits", "width", "ids", "exact", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []
        for b in batches:
            keys = list(zip(b.column(3).to_pylist(), b.column(2).to_pylist()))
            own, at = b.column(0).to_pylist(), 0
            while at < len(keys):
                if keys[at] != now:
                    if ids:
                        yield pack(*now, ids, np.concatenate(parts))
                    now, ids, parts = keys[at], [], []
                end = at + 1
                while end < len(keys) and keys[end] == now:
                    end += 1
                ids += own[at:end]
                parts.append(integers(b.column(1)[at:end].flatten().to_numpy(zero_copy_only=False)).reshape(end - at, now[1]))
                at = end
        if ids:
            yield pack(*now, ids, np.concatenate(parts))

    dealt = rows.join(F.broadcast(shape), "dim").select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"))
    return dealt.repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block").mapInArrow(run, _INDEX)


def add_slices(columns: list[list[int]]) -> list[int]:
    """Sums bitmaps given by weight (columns[w] counts 2 ** w each): the slices of the sums, least significant first."""
    out = []
    w = 0
    while w < len(columns):
        col = columns[w]
        while len(col) > 1:
            if w + 1 == len(columns):
                columns.append([])
            a, b = col.pop(), col.pop()
            x = a ^ b
            if col:
                c = col.pop()
                col.append(x ^ c)
                columns[w + 1].append((a & b) | (c & x))
            else:
                col.append(x)
                columns[w + 1].append(a & b)
        out.append(col[0] if col else 0)
        w += 1
    return out


def kth_largest(slices: list[int], rows: int, k: int) -> int:
    """The k-th largest sum among the rows of a bitmap that has at least k, from the most significant slice downward."""
    above, equal, value = 0, rows, 0
    for w in range(len(slices) - 1, -1, -1):
        have = equal & slices[w]
        if above + have.bit_count() >= k:
            equal, value = have, value | 1 << w
        else:
            above += have.bit_count()
            equal &= ~slices[w]
    return value


def at_least(slices: list[int], rows: int, bound: int) -> int:
    """The rows of a bitmap whose sum is at least `bound`."""
    if bound <= 0:
        return rows
    if bound >> len(slices):
        return 0
    more, equal = 0, rows
    for w in range(len(slices) - 1, -1, -1):
        if bound >> w & 1:
            equal &= slices[w]
        else:
            more |= equal & slices[w]
            equal &= ~slices[w]
    return more | equal


class Block:
    def __init__(self, dim: int, n: int, digits: int, width: int, ids: bytes, exact: bytes, slices: bytes):
        self.dim, self.n, self.kept, self.most = dim, n, digits - LOW_DIGITS, 1 << (digits - 1)
        self.ids = np.frombuffer(ids, np.int64)
        self.exact = unpacked(exact, width).reshape(n, dim)
        size, self.full = (n + 7) // 8, (1 << n) - 1
        maps = [int.from_bytes(slices[k : k + size], "little") for k in range(0, len(slices), size)]
        self.plus = [maps[d * self.kept : (d + 1) * self.kept] for d in range(dim)]
        self.place: dict[int, list[int]] = {}
        for r, i in enumerate(self.ids.tolist()):
            self.place.setdefault(i, []).append(r)

    def top(self, query: int, q: list[int], k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the query's k best rows here, its own id left out."""
        rows = self.full
        for r in self.place.get(query, ()):
            rows ^= 1 << r
        if rows.bit_count() > k:
            columns: list[list[int]] = [[] for _ in range(self.kept + max(map(int.bit_length, map(abs, q)), default=0) + 1)]
            for d, x in enumerate(q):
                maps = self.plus[d] if x >= 0 else [self.full ^ m for m in self.plus[d]]
                x, i = abs(x), 0
                while x:
                    if x & 1:
                        for j, m in enumerate(maps):
                            columns[i + j].append(m)
                    x >>= 1
                    i += 1
            sums = add_slices(columns)
            error = ((1 << LOW_DIGITS) - 1) * sum(map(abs, q))
            rows = at_least(sums, rows, kth_largest(sums, rows, k) - (error >> LOW_DIGITS) - 1)
        near = np.flatnonzero(np.unpackbits(np.frombuffer(rows.to_bytes((self.n + 7) // 8, "little"), np.uint8), count=self.n, bitorder="little"))
        exact = self.exact[near]
        if sum(map(abs, q)) * self.most < LONG:
            scores = (exact @ np.array(q, np.int64)).tolist()
        else:  # sums that a long doesn't hold
            scores = [sum(a * b for a, b in zip(v, q)) for v in exact.tolist()]
        order = sorted(range(len(near)), key=lambda r: (-scores[r], self.ids[near[r]]))[:k]
        return [int(self.ids[near[r]]) for r in order], [scores[r] for r in order]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = 65_536, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k largest inner products with all other rows.

    Ties go to the smaller id; fewer rows give fewer results. Rows with a null id or vector or a component
    that is null, NaN or infinite take no part; vectors meet those of their own length. Components and sums of any size are
    exact; a score that a long doesn't hold is written as the nearest long, behind or before those it is less or greater than. A query leaves out the
    rows with its own id; an id that is repeated with different vectors asks with its least one. An empty table gives an
    empty one; other columns go. Each query goes to every block of its length once, each block to one task, which keeps k rows a query.
    """
    rows = numbers(vectors, id_col, vec_col)
    shape = cut(plan_blocks(rows, every, block_rows))
    tasks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, shape.agg(F.sum("blocks")).first()[0] or 0)
    index = cut(build_index(rows, shape, tasks))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    group = queries.join(F.broadcast(shape), "dim").withColumn("g", F.pmod(F.xxhash64("vec_id"), F.col("groups")))
    packs = group.groupBy("dim", "g").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"), F.first("blocks").alias("blocks"))
    # A group's copies: one a block of its length.
    copies = packs.select("dim", "asked", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    kind = copies.schema["asked"].dataType
    both = index.withColumn("asked", F.lit(None).cast(kind)).unionByName(copies, allowMissingColumns=True)
    both = both.withColumn("later", F.col("asked").isNotNull()).repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number = None, None
        for b in batches:
            got: list[tuple[int, int, str]] = []
            for r in range(b.num_rows):
                block, dim, *parts, asked = (b.column(c)[r].as_py() for c in range(9))
                if asked is None:
                    here, number = Block(dim, *parts), (dim, block)
                elif number == (dim, block):
                    for a in asked:
                        q = integers(np.array(a["v"], float)).tolist()
                        got += [(a["vec_id"], i, str(s)) for i, s in zip(*here.top(a["vec_id"], q, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())], ["query_id", "vec_id", "exact"])

    found = both.select("block", "dim", "n", "digits", "width", "ids", "exact", "slices", "asked").mapInArrow(run, "query_id bigint, vec_id bigint, exact string")
    # Scores as longs, with those beyond behind the last one by their length and digits.
    score = F.coalesce(F.expr("try_cast(exact AS bigint)"), F.when(F.col("exact").startswith("-"), F.lit(-LONG)).otherwise(F.lit(LONG - 1)))
    size = F.when(F.expr("try_cast(exact AS bigint)").isNotNull(), F.lit(0)).otherwise(F.length("exact"))
    sign = F.when(F.col("exact").startswith("-"), -1).otherwise(1)
    digits = F.when(size == 0, F.lit("")).otherwise(F.col("exact"))
    found = found.select("query_id", "vec_id", score.alias("score"), (sign * size).alias("size"), F.when(sign > 0, digits).otherwise(F.translate(digits, "0123456789", "9876543210")).alias("digits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), F.desc("digits"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
