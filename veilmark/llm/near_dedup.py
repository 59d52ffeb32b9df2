"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components.

1. A document's set of shingles gets a 128-bit fingerprint and K minima under random linear hashes.
   Documents with equal sets are one class from here on.
2. K minima make bands of a few; two classes with an equal band are candidates. In each bucket the smallest
   class is compared with every other, which is linear in the bucket.
3. Candidates must agree in enough minima, and then in their full sets; these links give components.
4. Buckets that still hold several components are searched whole: every pair of classes in different components
   is refused or makes a link. Pairs inside one component need no comparison, as they would change nothing, so
   the classes outside of the bucket's largest component are held against all its classes, in blocks of bounded size. A bucket of over
   LARGE classes is first cut by the other bands of its classes, so that only classes with two bands in common meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import WordHashes, cut, fair_share, hot_keys, mix, release, salted_join, shingles
from veilmark.llm.components import components

BLOCK, BLOCK_SIZE, LARGE = 512, 1_000_000, 65_536


class Minima:
    """K multiply-shift hashes (a x + b) >> 32 of 32-bit keys, with a and b of 64 bits from a fixed seed."""

    def __init__(self, k: int, seed: int = 20):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 2**64, k, np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 2**64, k, np.uint64)

    def of(self, hashes: np.ndarray, step: int = 1024) -> np.ndarray:
        """The least of each hash over a set, as uint32."""
        x = hashes >> np.uint64(32)
        out = np.full(len(self.a), np.uint64(2**32 - 1))
        for k in range(0, len(x), step):
            part = self.a[:, None] * x[None, k : k + step]
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1) >> np.uint64(32), out=out)
        return out.astype(np.uint32)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z in lower case."""
    return np.unique(shingles(hashes.of(text.encode().lower().split()), size)) if text else np.empty(0, np.uint64)


def sketch(docs: DataFrame, size: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), fp (fingerprint, null for an empty set), sig (minima); a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, minima = WordHashes(), Minima(k)
        for b in batches:
            n, fp, sig = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size, words)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minima.of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "fp", "sig"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, fp binary, sig binary")


def band_rows(classes: DataFrame, rows: int, bands: int) -> DataFrame:
    """band (a hash of its place and its minima), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, bands, rows).astype(np.uint64)
                key = mix(np.arange(bands, dtype=np.uint64)[None] + np.uint64(1))
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], ["band", "fp"])

    return classes.select("fp", "sig").mapInArrow(run, "band bigint, fp binary")


def agreement(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs u, v whose minima su, sv agree in at least `least` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u binary, v binary")


def hot_in(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of a written table."""
    return cut(hot_keys(rows.groupBy(key).count(), key, "count", fair_share(rows.sparkSession, rows.count())))


def only(table: DataFrame, wanted: DataFrame, few: int) -> DataFrame:
    """The rows of a table by fp whose fp is among the distinct ones of `wanted`, which are broadcast if they are at most `few`."""
    wanted = cut(wanted.select("fp").distinct())
    return table.join(F.broadcast(wanted) if wanted.limit(few + 1).count() <= few else wanted, "fp", "left_semi")


def with_both(pairs: DataFrame, table: DataFrame, column: str, x: str, y: str) -> DataFrame:
    """Pairs u, v with the column of both ends from a table by fp. Many pairs may share one v, which are dealt out."""
    one, other = table.select(F.col("fp").alias("u"), F.col(column).alias(x)), table.select(F.col("fp").alias("v"), F.col(column).alias(y))
    return salted_join(pairs.join(one, "u"), other, "v", hot_in(pairs, "v"), "u").select("u", "v", x, y)


def sets_of(wanted: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, few: int) -> DataFrame:
    """fp, items (sorted hashes, as bytes): the full sets of the classes in `wanted` (fp, low), made anew from their texts."""
    wanted = cut(wanted)
    ids = wanted.select("low").distinct()
    small = wanted.limit(few + 1).count() <= few
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("low")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [shingle_set(t, size, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["fp", "items"])

    # An id may stand for several texts, and several rows for one class: only wanted classes, one row each.
    sets = texts.mapInArrow(run, "fp binary, items binary")
    return cut(sets.join(F.broadcast(wanted.select("fp")) if small else wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("items").alias("items")))


def alike(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets meet 100 * intersection >= percent * union with the one; sets are sorted."""
    out = np.zeros(len(others), bool)
    start = 0
    while start < len(others):  # bounded memory with very long texts
        end, total = start, 0
        while end < len(others) and (end == start or total + len(others[end]) <= 4_000_000):
            total += len(others[end])
            end += 1
        flat = np.concatenate(others[start:end])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        sizes = np.array([len(o) for o in others[start:end]])
        common = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], sizes.cumsum()[:-1]]))
        out[start:end] = 100 * common >= percent * (len(one) + sizes - common)
        start = end
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [bool(alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], percent)[0]) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return with_both(pairs, sets, "items", "x", "y").mapInArrow(run, "u binary, v binary")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, fp, root, rest, blocks, rests of the buckets that hold several components. Of buckets with the same members one is enough.

    members: band, fp, n. rest: whether the class is outside of the bucket's largest component; blocks and rests: in how many
    blocks all classes and the rest are cut, of at most about BLOCK members and BLOCK_SIZE shingles. A bucket of over LARGE classes
    gives way to the buckets of its classes' pairs of bands: classes that are 80 % alike share one band only with a probability of 2.4e-6.
    """
    named = cut(members.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    pieces = lambda m, total: F.greatest(F.ceil(m / BLOCK), F.ceil(total / BLOCK_SIZE))

    def open_buckets(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("mark"))
        found = parts.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.sum(F.col("mark").cast("decimal(30,0)")).alias("mark"), F.max(F.struct("m", "total", "root")).alias("top")).filter("roots > 1")
        once = found.groupBy("m", "mark").agg(F.min(F.struct("band", "total", "top")).alias("b"))
        return cut(once.select("b.band", "m", F.col("b.top.root").alias("top"), pieces(F.col("m"), F.col("b.total")).alias("blocks"), pieces(F.col("m") - F.col("b.top.m"), F.col("b.total") - F.col("b.top.total")).alias("rests")))

    def inside(rows: DataFrame, buckets: DataFrame) -> DataFrame:
        hot = cut(hot_keys(buckets, "band", "m", fair_share(rows.sparkSession, rows.count())))
        return salted_join(rows, buckets.drop("m"), "band", hot, "fp").withColumn("rest", F.col("root") != F.col("top")).select("band", "fp", "root", "n", "rest", "blocks", "rests")

    buckets = open_buckets(named)
    small = inside(named, buckets.filter(F.col("m").between(3, LARGE)))
    large = buckets.filter(F.col("m") > LARGE)
    if large.isEmpty():
        return small
    first = inside(named, large).select(F.col("band").alias("band1"), "fp", "root", "n")
    both = first.join(members.select("fp", F.col("band").alias("band2")), "fp").filter("band1 != band2")
    both = cut(both.select(F.xxhash64(F.least("band1", "band2"), F.greatest("band1", "band2")).alias("band"), "fp", "root", "n").distinct())
    return small.unionByName(inside(both, open_buckets(both)))


def _bytes(classes: DataFrame) -> DataFrame:
    """fp, sig: the lowest byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s[::4] for s in b.column(1).to_pylist()], pa.binary())], ["fp", "sig"])

    return classes.select("fp", "sig").mapInArrow(run, "fp binary, sig binary")


def rest_of_buckets(opened: DataFrame, classes: DataFrame, sets: DataFrame, least: int, percent: int, few: int) -> DataFrame:
    """Links u, v between components within one bucket, enough of them to connect what any link in the bucket connects.

    A group is a block of a bucket's rest (i) and a block of all its classes (j). Every pair in different components is held against
    each other: first sizes and a byte of each minimum, then the full sets. Only links leave a group, fewer than its components.
    A class is in a group for each block of the rest, and one of the rest in a group for each block as well.
    """
    small = _bytes(only(classes.select("fp", "sig"), opened, few))
    rows = opened.join(small, "fp").join(sets, "fp")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("left", F.when(F.col("rest"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("rests"))))
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j")))
    more = F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.col("rest") & (j != F.col("mine"))), lambda j: F.struct(F.col("left").alias("i"), j.alias("j")))
    rows = rows.withColumn("at", F.explode(F.concat(every, more))).select("band", "at.i", "at.j", "mine", "left", "fp", "root", "sig", "items")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), -1)
        comp, fps = pd.factorize(group["root"])[0], group["fp"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
        sizes = np.array([len(s) for s in sets])
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        right = np.flatnonzero(group["mine"].to_numpy() == j)
        got = []
        for k in np.flatnonzero(group["left"].to_numpy() == i):
            near = right[(comp[right] != comp[k]) & (100 * np.minimum(sizes[right], sizes[k]) >= percent * np.maximum(sizes[right], sizes[k]))]
            near = near[(sig[near] == sig[k]).sum(axis=1) >= least]
            if len(near):
                for x in near[alike(sets[k], [sets[x] for x in near], percent)]:
                    if comp[x] != comp[k]:
                        got.append((fps[k], fps[x]))
                        comp[comp == comp[x]] = comp[k]
        return pd.DataFrame(got, columns=["u", "v"])

    return rows.groupBy("band", "i", "j").applyInPandas(search, "u binary, v binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 5, bands: int = 40, id_col: str = "doc_id", text_col: str = "text", few: int = 500_000) -> DataFrame:
    """The id, n_shingles, component_id and kept for every row.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; the set holds the distinct `size`-word shingles,
    or the whole sequence if it is shorter. Links: 100 * intersection >= percent * union, on full sets. At
    80 % similarity five rows and 40 bands miss a pair with a probability of 1.2e-7. Texts that are null or
    without words link with nothing. component_id: the smallest id reachable (nulls last); kept: the row has
    that id. A null id joins its group and stays only if the whole group has no id. Repeated rows are
    one class. Sizes checked before broadcasts: `few` ids.
    """
    k = rows * bands
    least = int(k * percent / 100 - 6 * np.sqrt(k * percent / 100 * (1 - percent / 100)))
    base = cut(sketch(docs, size, k, id_col, text_col))
    full = base.filter("fp IS NOT NULL")
    classes = cut(full.groupBy("fp").agg(F.min("id").alias("low"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    members = band_rows(classes, rows, bands)
    pivots = cut(members.groupBy("band").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    n_classes = classes.count()
    if pivots.limit(few + 1).count() <= few:
        members = members.join(F.broadcast(pivots), "band")
    else:
        members = salted_join(members, pivots, "band", cut(hot_keys(pivots, "band", "m", fair_share(docs.sparkSession, n_classes * bands))), "fp")
    members = cut(members)
    candidates = cut(members.filter("fp != v").select(F.col("fp").alias("u"), "v").distinct())
    ends = lambda p: p.select(F.col("u").alias("fp")).union(p.select(F.col("v").alias("fp")))
    pairs = cut(agreement(with_both(candidates, only(classes, ends(candidates), few), "sig", "su", "sv"), least))
    sets = sets_of(only(classes.select("fp", "low"), ends(pairs), few), docs, size, id_col, text_col, few)
    links = cut(verified(pairs, sets, percent))
    release(candidates, pairs, sets)
    labels = components(links)
    opened = cut(open_members(members.filter("m > 2").select("band", "fp").join(classes.select("fp", "n"), "fp"), labels))
    if not opened.isEmpty():
        sets = sets_of(only(classes.select("fp", "low"), opened, few), docs, size, id_col, text_col, few)
        more = cut(rest_of_buckets(opened, classes, sets, least, percent, few))
        release(sets)
        if not more.isEmpty():
            labels = components(labels.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    release(members, opened)
    lows = classes.select("fp", "low")
    named = labels.join(lows, labels["node"] == lows["fp"]).select("fp", "root", "low")
    smallest = named.groupBy("root").agg(F.min("low").alias("group_low"), F.count(F.lit(1)).alias("size"))
    stars = cut(hot_keys(smallest, "root", "size", fair_share(docs.sparkSession, n_classes)))
    group = salted_join(named.select("fp", "root"), smallest.drop("size"), "root", stars, "fp").select("fp", "group_low")
    known = lows.join(group, "fp", "left").select("fp", F.coalesce("group_low", "low").alias("component_id"))
    # Many rows may share one text, and as many may have none.
    hot = cut(hot_keys(classes, "fp", "copies", fair_share(docs.sparkSession, base.count())))
    with_words = salted_join(full.select("id", "n", "fp"), known, "fp", hot, "id").select("id", "n", "component_id")
    out = with_words.unionByName(base.filter("fp IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = 500_000, **how) -> DataFrame:
    """The rows of docs with one document of each group, all columns. Rows repeated with one id and one text become one."""
    found = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, few=few, **how))
    gone = found.filter(~F.col("kept")).select(F.col(id_col).alias("gone_id")).distinct()
    small = gone.limit(few + 1).count() <= few
    out = docs.join(F.broadcast(gone) if small else gone, F.col(id_col).eqNullSafe(F.col("gone_id")), "left_anti")
    twice = found.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("twice_id"))
    if twice.isEmpty():
        return out
    same = F.col(id_col).eqNullSafe(F.col("twice_id"))
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))


#: DuckDB SQL for near_duplicates() with two-word shingles and 80 %: all pairs that share one of their rarest shingles, held against each other whole.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS ws FROM documents
),
s AS (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
df AS (SELECT x, count(*) AS k FROM e GROUP BY x),
ranked AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY k, x) AS r FROM e JOIN df USING (x)),
prefix AS (SELECT doc_id, n, x FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
met AS (SELECT a, b, len(list_intersect(sa.g, sb.g)) AS i, len(sa.g) + len(sb.g) AS t FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b),
links AS (SELECT a, b FROM met WHERE 100 * i >= 80 * (t - i) UNION ALL SELECT b, a FROM met WHERE 100 * i >= 80 * (t - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
root AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN root USING (doc_id)
"""
