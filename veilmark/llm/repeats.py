"""Passages that repeat across documents: paragraph MinHash banding with exact verification and components.

Repeated passages seldom begin at a line, so paragraphs are found by content: of every 26 neighbouring five-word
shingles the one with the least hash is an anchor, and the 25 words from an anchor are a paragraph. Any
passage of 50 words that two documents share has such a paragraph in common, wherever it stands. The first and the
last 25 words of a text are paragraphs too, so a repeated text has some from 25 words on, up to both its ends. A
paragraph is known by a 64-bit fingerprint of its shingles, which is checked by the first band; paragraphs with equal ones are one class. Four
minima, each a band of its own, find nearly equal classes (at a similarity of 0.8 all but 0.2 % of the pairs);
all classes of a bucket are searched, in blocks of bounded size, for pairs of different documents that are alike on their
full sets of shingles. Links give clusters, and in a cluster that reaches over documents the first paragraph is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilmark.llm.common import WordHashes, cut, fair_share, hot_keys, mix, release, salted_join, shingles
from veilmark.llm.components import components

SHINGLE, WORDS, BANDS = 5, 25, 4
ANCHOR = WORDS + 1
#: Classes of a bucket that are searched at once, and pairs that are compared at once.
BLOCK, LOT = 8192, 100_000
_KEYS = tuple(f"k{i}" for i in range(BANDS))
_BAND_KEYS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def least_of_runs(x: np.ndarray, run: int, pick=np.minimum) -> np.ndarray:
    """The least (or most) of every run of `run` neighbours, from running minima of blocks in both directions."""
    n = len(x) - run + 1
    fill = np.uint64(2**64 - 1) if pick is np.minimum else np.uint64(0)
    padded = np.full(-(-len(x) // run) * run, fill)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, run)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[run - 1 : run - 1 + n])


def anchors(h: np.ndarray) -> np.ndarray:
    """Places that hold the least shingle hash of some run of ANCHOR shingles (of all, if there are fewer), where a whole paragraph follows; the first and the last such place as well."""
    last = len(h) + SHINGLE - 1 - WORDS
    if last < 0:
        return np.empty(0, np.int64)
    mixed = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    if len(h) <= ANCHOR:
        got = np.flatnonzero(mixed == mixed.min())
    else:
        least = least_of_runs(mixed, ANCHOR)
        around = np.concatenate([np.zeros(ANCHOR - 1, np.uint64), least, np.zeros(ANCHOR - 1, np.uint64)])
        got = np.flatnonzero(least_of_runs(around, ANCHOR, np.maximum) == mixed)
    return np.union1d(got[got <= last], [0, last])


def paragraph_sets(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of shingle hashes for each paragraph."""
    return h[at[:, None] + np.arange(WORDS - SHINGLE + 1)]


def band_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row a band: of each paragraph the shingle that is least after mixing with the band's key."""
    k = _BAND_KEYS[:, None]
    return mix(h[None] ^ k)[:, at[:, None] + np.arange(WORDS - SHINGLE + 1)].min(axis=2) ^ k


def fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's shingles that doesn't depend on their order: a sum of mixed hashes. Its lowest bit is 0, to be free for a mark."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x2545F4914F6CDD1D)))])
    return (mix(sums[at + WORDS - SHINGLE + 1] - sums[at]) & ~np.uint64(1)).view(np.int64)


def hashed(text: str | None, words: WordHashes) -> np.ndarray:
    h = words.of(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    return shingles(h, SHINGLE) if len(h) >= WORDS else np.empty(0, np.uint64)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at (word), fp, and the band keys k0, k1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            ids, at, fps, keys = [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                h = hashed(t, words)
                places = anchors(h)
                if len(places):
                    ids.append(np.full(len(places), row))
                    at.append(places)
                    fps.append(fingerprints(h, places))
                    keys.append(band_keys(h, places))
            if ids:
                bands = np.concatenate(keys, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(fps)), *map(pa.array, bands)],
                    ["id", "at", "fp", *_KEYS],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, at int, fp bigint, " + ", ".join(f"{k} bigint" for k in _KEYS))


def _sets_of(docs: DataFrame, wanted: DataFrame, few: int) -> DataFrame:
    """fp, items: the shingles of one paragraph of each class in `wanted` (low, fp, and raw if that differs), made anew from the texts (id, text); raw is the paragraph's own fingerprint."""
    own = "raw" in wanted.columns
    places = cut(wanted.groupBy(F.col("low").alias("want_id")).agg(F.collect_list("raw" if own else "fp").alias("raws"), *([F.collect_list("fp").alias("fps")] if own else [])))
    # Eight bytes each; texts are shuffled only where there are more.
    small = wanted.limit(max(0, 4 * few + 1)).count() <= 4 * few
    rows = docs.join(F.broadcast(places) if small else places, F.col("id") == F.col("want_id")).select("text", "raws", "fps" if own else F.lit(None).cast("array<bigint>").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            fps, items = [], []
            for t, raws, names in zip(*(b.column(c).to_pylist() for c in range(3))):
                h = hashed(t, words)
                at = anchors(h)
                if len(at):
                    # An id may stand for several texts: only places with a wanted fingerprint count.
                    asked, own = np.array(raws, np.int64), fingerprints(h, at)
                    order = np.argsort(own, kind="stable")
                    k = np.minimum(np.searchsorted(own[order], asked), len(own) - 1)
                    there = own[order][k] == asked
                    if there.any():
                        fps.append(np.array(names or raws, np.int64)[there])
                        items.append(paragraph_sets(h, at[order][k][there]))
            if fps:
                flat = np.concatenate(items)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel().view(np.int64)))], ["fp", "items"])

    return rows.mapInArrow(run, "fp bigint, items array<bigint>").groupBy("fp").agg(F.first("items").alias("items"))


def _pairs(group: np.ndarray, small: np.ndarray, spare: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that share one of their `small` values (spare ones don't count), in bounded lots."""
    n, k = small.shape
    row = np.repeat(np.arange(n), k)[~spare.ravel()]
    value = small.ravel()[~spare.ravel()]
    order = np.lexsort((row, value, group[row]))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (group[row[1:]] != group[row[:-1]])
    starts = np.flatnonzero(new)
    after = np.append(starts[1:], len(row))[np.cumsum(new) - 1] - np.arange(len(row)) - 1  # rows of the run behind each
    done = np.cumsum(after)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + LOT, "right")))
        m = after[at:end]
        left = np.repeat(np.arange(at, end), m)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        if len(left):
            yield row[left], row[right]
        at = end


def _links(group: np.ndarray, side: np.ndarray, across: np.ndarray, doc: np.ndarray, sets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows u, v that connect what any alike pair of one group connects. In a group that is `across`, pairs are of different sides; doc 0: several.

    Alike sets of n and m values have `percent` of the greater in common, so they share one of the
    n - ceil(percent n) + 1 first values of either in any order; here that of how rare they are among the rows, so that
    a phrase that the whole group has makes no pairs.
    """
    sets = np.sort(sets, axis=1)
    n, width = sets.shape
    spare = np.zeros(sets.shape, bool)
    spare[:, 1:] = sets[:, 1:] == sets[:, :-1]
    size = width - spare.sum(axis=1)
    # Repeated values give way to ones that no other row has, behind the others.
    if spare.any():
        for r in np.flatnonzero(spare.any(axis=1)):
            kept = sets[r][~spare[r]]
            sets[r, : size[r]] = kept
            sets[r, size[r] :] = mix(np.arange(size[r], width, dtype=np.uint64) + np.uint64(r * width) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            spare[r] = np.arange(width) >= size[r]
    values, place, count = np.unique(sets, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    sets = rank[place].reshape(n, width)
    sets[spare] = len(values) + np.arange(int(spare.sum()))
    sets.sort(axis=1)
    prefix = size - -(-percent * size // 100) + 1
    head = int(prefix.max())
    comp = np.arange(n)
    us, vs = [], []
    for a, b in _pairs(group, sets[:, :head], np.arange(head) >= prefix[:, None]):
        ok = (comp[a] != comp[b]) & ~((doc[a] == doc[b]) & (doc[a] != 0)) & ~(across[a] & (side[a] == side[b]))
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        both = np.sort(np.concatenate([sets[a], sets[b]], axis=1), axis=1)
        common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
        ok = 100 * common >= percent * (size[a] + size[b] - common)
        a, b = a[ok], b[ok]
        while len(a):
            # The greater component of each link joins the least that it is linked with, until no link leads out of one.
            x, y = np.maximum(comp[a], comp[b]), np.minimum(comp[a], comp[b])
            order = np.lexsort((y, x))
            first = order[np.r_[True, x[order][1:] != x[order][:-1]]]
            us.append(a[first])
            vs.append(b[first])
            to = np.arange(n)
            to[x[first]] = y[first]
            while (to[to] != to).any():
                to = to[to]
            comp = to[comp]
            out = comp[a] != comp[b]
            a, b = a[out], b[out]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def links_of_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links u, v of alike classes of different documents within each bucket, enough to connect what any link of the bucket connects.

    members: key, m (its classes), fp, doc (null: several). A bucket of over BLOCK classes is cut in blocks, and each pair of blocks is a group of its own.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    rows = dealt.join(sets, "fp").select("key", "i", "j", "mine", "fp", F.coalesce("doc", F.lit(0)).alias("doc"), "items")

    def search(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(held).combine_chunks()
        key, i, j, side, fp, doc = (t.column(c).to_numpy() for c in range(6))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        end = len(key) if last else int(np.flatnonzero(new)[-1])  # the last group may go on
        if not end:
            return None, held
        flat = pa.compute.list_flatten(t.column(6).slice(0, end)).to_numpy().view(np.uint64).reshape(end, -1)
        u, v = _links(np.cumsum(new)[:end], side[:end], (i != j)[:end], doc[:end], flat, percent)
        return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"]), t.slice(end).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, 2 * BLOCK
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= due:
                out, held = search(held, False)
                n = sum(h.num_rows for h in held)
                due = n + 2 * BLOCK
                if out is not None:
                    yield out
        if held:
            yield search(held, True)[0]

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u bigint, v bigint")


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column | None]:
    """id and text, where a row without an id has a stand-in from its text that sorts behind all ids, and a condition that tells stand-ins (None: there are none)."""
    rows, key = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col(id_col)
    if docs.filter(key.isNull()).isEmpty():
        return rows, None
    if isinstance(docs.schema[id_col].dataType, StringType):
        return rows.withColumn("id", F.coalesce("id", F.concat(F.lit("\U0010ffff"), F.md5("text")))), F.col("id").startswith("\U0010ffff")
    first = 2**62
    return rows.withColumn("id", F.coalesce(F.col("id").cast("bigint"), F.lit(first) + F.shiftrightunsigned(F.xxhash64("text"), 2))), F.col("id") >= first


def _classes(all_: DataFrame) -> DataFrame:
    """fp, low and high (ids), the band keys, and last: the greatest first band key, which is k0 where all paragraphs of the class are equal."""
    return cut(all_.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high"), *(F.min(k).alias(k) for k in _KEYS), F.max("k0").alias("last")))


def _met(classes: DataFrame, fair: int) -> DataFrame:
    """key, m, fp, low, doc of the classes that have a band key with another class and document. doc: a mark of the document of a class that only one has.

    Keys go to one task each, in one shuffle of three numbers a row, but for those that a sample of the classes shows to be very frequent: their
    facts are summed before they are shuffled, and their rows stay where they are. The sample decides only which way a key takes.
    """
    # The lowest bit of a class says that several documents have it.
    bands = classes.select(F.col("fp").bitwiseOR((F.col("low") != F.col("high")).cast("bigint")).alias("of"), "low", F.explode(F.array(*_KEYS)).alias("key"))
    one_in = 16
    seen = bands.filter(F.pmod(F.xxhash64("of"), F.lit(one_in)) == 0).groupBy("key").count()
    hot = cut(seen.filter(F.col("count") > max(16, fair // one_in)).select("key"))  # at most (all rows) / fair
    several = F.col("of").bitwiseAND(F.lit(1)) == 1
    facts = {"m": F.count(F.lit(1)), "f0": F.min("of"), "f1": F.max("of"), "d0": F.min("low"), "d1": F.max("low"), "s": F.max(several)}
    of_key = Window.partitionBy("key")
    cold = bands if hot.isEmpty() else bands.join(F.broadcast(hot), "key", "left_anti")
    rows = cold.repartition("key").select("key", "of", "low", *(f.over(of_key).alias(n) for n, f in facts.items()))
    if cold is not bands:
        stay = bands.join(F.broadcast(hot), "key", "left_semi")
        rows = rows.unionByName(stay.join(F.broadcast(stay.groupBy("key").agg(*(f.alias(n) for n, f in facts.items()))), "key"))
    # A key that one class or one document alone has makes no pair, as a document isn't compared with itself.
    return rows.filter("f0 != f1 AND (s OR d0 != d1)").select("key", "m", F.col("of").bitwiseAND(F.lit(-2)).alias("fp"), "low", F.when(~several, F.xxhash64("low")).alias("doc"))


def repeated_passages(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", few: int = 1_000_000) -> DataFrame:
    """doc id, start_word, end_word, n_words, component_id and kept: a row for each repeated passage of each document.

    Words are [^\\x20\\x09-\\x0D]+, A-Z in lower case. A passage is a run of overlapping paragraphs with a cluster
    over several documents and with one answer; component_id is the smallest id among those that hold it, kept says that this is that document.
    Texts that are null, empty or under 25 words have none. Rows repeated with one id don't count as several
    documents. Rows without an id are documents by their text, behind all ids (whole numbers under 2 ** 62, or texts); their id, and a component_id that
    is one of theirs, is null. An empty table gives an empty one; other columns go. Each broadcast is of at most `few` rows of three numbers, or four times as many numbers (some 50 MB);
    beyond, Spark joins by shuffling, with rows of very frequent paragraphs dealt out.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    docs, unnamed = _addressed(docs, id_col, text_col)
    all_ = cut(paragraphs(docs, "id", "text"))
    # Copies of a paragraph become one row before anything else is shuffled.
    classes, names = _classes(all_), None
    if not classes.filter("k0 != last").isEmpty():  # unequal paragraphs with one fingerprint: all get another one, from their bands too
        whole, all_ = all_, cut(all_.withColumn("raw", F.col("fp")).withColumn("fp", F.xxhash64("fp", *_KEYS).bitwiseAND(F.lit(-2))))
        release(whole, classes)
        classes, names = _classes(all_), cut(all_.groupBy("fp").agg(F.min("raw").alias("raw")))
    # Band keys are most of both tables, and are needed no more.
    whole, all_ = all_, cut(all_.select("id", "at", "fp"))
    release(whole)
    members = cut(_met(classes, fair_share(spark, BANDS * classes.count())))
    whole, classes = classes, cut(classes.select("fp", "low", "high"))
    release(whole)
    wanted = members.select("low", "fp").distinct()
    wanted = cut(wanted.join(names, "fp") if names is not None else wanted)
    sets = _sets_of(docs, wanted, few)
    links = cut(links_of_buckets(members.drop("low"), sets, percent))
    release(members, wanted)
    labels = cut(components(links).select(F.col("node").alias("fp"), "root"))
    small = labels.limit(few + 1).count() <= few
    # Only classes of several documents and classes with a link can belong to a repeated passage.
    marked = classes.join(F.broadcast(labels) if small else labels, "fp", "left").filter("root IS NOT NULL OR low != high")
    named = cut(marked.select("fp", "low", "high", F.coalesce("root", "fp").alias("root")))
    groups = named.groupBy("root").agg(F.min("low").alias("component_id"), F.max("high").alias("top"), F.count(F.lit(1)).alias("size")).filter("component_id != top")
    groups = cut(groups)
    repeated = cut(salted_join(named, groups, "root", cut(hot_keys(groups, "root", "size", fair_share(spark, named.count()))), "fp").select("fp", "component_id"))
    rows = all_.select("id", "at", "fp")
    if repeated.limit(few + 1).count() <= few:
        hits = rows.join(F.broadcast(repeated), "fp")
    else:
        hits = salted_join(rows, repeated, "fp", cut(hot_keys(all_.groupBy("fp").count(), "fp", "count", fair_share(spark, all_.count()))), "id")
    # Runs of overlapping paragraphs with the same answer are one passage.
    per_doc = hits.groupBy("id", "component_id").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    starts = F.expr(f"filter(ats, (x, i) -> i = 0 OR x > ats[i - 1] + {WORDS})")
    ends = F.expr(f"filter(ats, (x, i) -> i = size(ats) - 1 OR ats[i + 1] > x + {WORDS})")
    spans = per_doc.select("id", "component_id", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("s"))
    id_, component = F.col("id"), F.col("component_id")
    if unnamed is not None:
        spans = spans.withColumn("stood_in", unnamed).withColumnRenamed("id", "own").withColumn("id", component).withColumn("others", unnamed).drop("id").withColumnRenamed("own", "id")
        id_, component = F.when(F.col("stood_in"), None).otherwise(id_), F.when(F.col("others"), None).otherwise(component)
    a, b = F.col("s.a"), F.col("s.b") + WORDS
    return spans.select(id_.cast(kind).alias(id_col), a.alias("start_word"), b.alias("end_word"), (b - a).alias("n_words"), component.cast(kind).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; white space before a removed word goes with it."""
    import re

    gone = np.zeros(max(b for _, b in spans), bool)
    for a, b in spans:
        gone[a:b] = True
    out, at = [], 0
    for k, m in enumerate(re.finditer(r"[^ \t-\r]+", text)):
        if k >= len(gone):
            break
        if not gone[k]:
            out.append(text[at : m.end()])
        at = m.end()
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id and text of every row, without the passages that aren't kept. Joined by id; texts are shuffled."""
    cuts = spans.filter(~F.col("kept")).groupBy(F.col(id_col).alias("cut_id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("cuts"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(cuts, F.col("id") == F.col("cut_id"), "left").select("id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [without(t, [(c["start_word"], c["end_word"]) for c in cs]) if t and cs else t for t, cs in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, text string")
