"""Connected components by alternating large-star and small-star steps over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cut, fair_share, hot_keys, release, salted_join

#: Links that one task takes in a second or so.
ONE_TASK = 100_000


def _meet(rows: DataFrame, least: DataFrame, fair: int | None) -> DataFrame:
    """rows with the `m` of their u; the rows of a star's centre are dealt out where there are more than `fair`."""
    if fair is None:
        return rows.join(least.drop("c"), "u")
    return salted_join(rows, least.drop("c"), "u", hot_keys(least, "u", "c", fair), "v")


def _large(links: DataFrame, fair: int | None) -> DataFrame:
    """Every node hands the smallest of itself and its neighbours to its larger neighbours."""
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return _meet(both, least, fair).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame, fair: int | None) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and itself."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    # The link to the smallest neighbour itself becomes the node's own.
    return _meet(down, least, fair).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: a row for each node that has a link; the root is the smallest node of its component.

    Any ordered type serves for nodes. Null ends, loops and repeated links add nothing; an empty table gives
    an empty one. The smallest neighbour is found by an aggregation with partial sums and joined back; the links
    of a node with more than its share of them are dealt out in that join. Each round is written to the shared
    folder, and the one before it deleted. The rounds end at a fixed point, which the two steps reach
    after at most about log(nodes) squared of them.
    """
    now = cut(links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        # A set of stars is a fixed point: the marks of the sets before and after a round are the same.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = seen
        # Few links make one small partition, which needs no exchange; more are dealt out.
        few = seen[0] <= ONE_TASK
        fair = None if few else fair_share(now.sparkSession, 2 * seen[0])
        old = now
        now = cut(_small(_large(now.coalesce(1) if few else now, fair).distinct(), fair).distinct())
        release(old)
