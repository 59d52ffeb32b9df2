"""Reading tables, checkpoints and word hashing that the operators of this folder share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that reach a Python worker at once; texts may be very long, so few.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, spread over the cores if it is one small file."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a scan of under 4 MB a core, which would have fewer tasks than the cluster has cores; other scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * 4_000_000 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return f"file://{tempfile.gettempdir()}/veilmark-shared"
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: plans stay short and a lost executor costs nothing done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veilmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing that is still to be computed reads it, and the shuffle files of plans that are done."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(conf).delete(path, True)
    tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that no plan refers to: it does so when the driver's garbage is collected, which may else take long.

    The SQL parser's tables, which long expressions make large (tens of MB that nothing else frees), go first; parsing fills them again.
    """
    spark._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter().clearDFA()
    for _ in range(2):  # what the first round frees may hold on to more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)


def fair_share(spark: SparkSession, rows: int) -> int:
    """The rows of one key that a task takes without standing out: a quarter of an even part, 256 at least."""
    return max(256, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def hot_keys(counts: DataFrame, key: str, count: str, fair: int) -> DataFrame:
    """key, salts: the keys with over `fair` rows, of which there are at most (all rows) / fair, that is four a partition."""
    return counts.filter(F.col(count) > fair).select(key, F.ceil(F.col(count) / fair).cast("bigint").alias("salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """left.join(right, key), where the rows of `left` with one of the `hot` keys are dealt out by `by` and meet copies of the key's row of `right`.

    The hot keys are broadcast; hot_keys() bounds them by the number of partitions, whatever the data.
    """
    few = F.broadcast(hot)
    one = left.join(few, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1)))).drop("salts")
    other = right.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return one.join(other, [key, "salt"], how).drop("salt")


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last; at the bound it starts anew, which changes no result."""

    def __init__(self, bound: int = 500_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; the whole sequence as one if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = mix(hashes[: n - size + 1] + np.uint64(size))
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return out


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column has it (in upper or lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column as text, modulo n; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
