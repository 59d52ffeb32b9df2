"""The engine's operators as named queries over the driver's tables; plans.oracles has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions import expressions as X
from veilmark.functions.catalog import BUILTIN, RECOGNISERS, type_table
from veilmark.operators import chunking, lists, overrides, pipeline, store
from veilmark.operators.pipeline import Settings
from veilmark.operators.recognise import Context, recognise, term_finder, term_table
from veilmark.plans.planted import planted_texts
from veilmark.sources.readers import long_enough, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every type in `documents` found, resolved, numbered and replaced."""
    done = pipeline.anonymise(pipeline.detect(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "anonymized_text", F.size("numbered").cast("bigint").alias("n_entities"))


# --- recognisers ------------------------------------------------------------------------------------------------


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, and a text with planted identifiers for each customer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(planted_texts(table(spark, sf_dir, "customer")))


def raw_spans(spark: SparkSession, sf_dir: str, entities: tuple[str, ...] | None, context: Context | None = None) -> DataFrame:
    found = recognise(texts(spark, sf_dir), types=entities, context=context)
    return pipeline.exploded(found).select("doc_id", "type", "pattern", "start", F.col("text").alias("value"), "score")


def _detect(entity: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw_spans(spark, sf_dir, (entity,))

    run.__name__ = f"detect_{entity.lower()}"
    query(run)


for _r in (*RECOGNISERS, *BUILTIN):
    _detect(_r.entity)


@query
def detect_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_spans(spark, sf_dir, None).groupBy("type", "pattern").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("start").cast("bigint")).alias("sum_start"))


@query
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_spans(spark, sf_dir, ("FINANCIAL_ACCOUNT", "UK_CRN", "MEDICAL_RECORD_NUMBER"), Context())


# --- sources ----------------------------------------------------------------------------------------------------


@query
def src_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query
def src_min_text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_enough(table(spark, sf_dir, "documents"), 500).select("doc_id")


NOTES = "# parties\n Seller \nBUYER\n\n  #x\nseller\nthe Agent\n"


@query
def stoplist_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "nation").select(F.explode(F.split(F.concat(F.lit(NOTES), F.col("n_name"), F.lit("\n# "), F.col("n_name")), "\n")).alias("value"))
    return lists.parse_lines(lines)


@query
def stoplist_learned_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") == 0, "general").when(F.col("n_regionkey") == 1, "legal").otherwise("financial").alias("domain"), "n_name")
    return lists.in_scope(raw.groupBy("domain").agg(F.collect_list("n_name").alias("terms")), "legal")


@query
def custom_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON lists; those without name or pattern, and what is no list, are left out; defaults filled in."""
    j = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("""CASE WHEN n_nationkey % 5 = 0 THEN '{"name": "x"}' WHEN n_nationkey % 5 = 1 THEN concat('[{"name": "', n_name, '"}, 3]')
        ELSE concat('[{"name": "', n_name, '", "pattern": "P[0-9]+"}, {"pattern": "y"}, {"name": "z', n_nationkey, '", "pattern": "z+", "score": 0.9}]') END""").alias("j"))
    from veilmark.sources.configs import parse_patterns

    return parse_patterns(j, "j").select("n_nationkey", "name", "pattern", "score", "language")


# --- spans from lineitem: many overlapping ranges a document -----------------------------------------------------

SPANS = """struct(cast((l_partkey * 7 + l_linenumber * 13) % 60 as int) as start, cast((l_partkey * 7 + l_linenumber * 13) % 60 + 3 + cast(l_quantity as int) % 20 as int) as end,
    CASE l_linenumber % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'ISIN' ELSE 'EMAIL_ADDRESS' END as type,
    concat('t', l_suppkey % 5) as text, round(0.3 + l_discount * 5, 3) as score, true as verified, cast(null as string) as reason, concat('p', l_linenumber) as pattern)"""


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(SPANS).alias("s"))
    return rows.groupBy("doc_id").agg(F.collect_list("s").alias("spans")).withColumn("spans", F.expr(f"cast(spans as array<{X.SPAN}>)"))


def shown(df: DataFrame) -> DataFrame:
    return pipeline.exploded(df).select("doc_id", "start", "end", "type", "pattern", "score")


@query
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "cast(l_partkey % 6 as int) as start", "cast(l_partkey % 6 + 4 as int) as end", "CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END as type", "l_discount as score", "cast(l_linenumber % 2 * 3 as int) as off")
    return chunking.to_document(rows)


@query
def dedup_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pipeline.with_spans(line_spans(spark, sf_dir), X.resolved("spans")))


@query
def min_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pipeline.with_spans(line_spans(spark, sf_dir), X.at_least("spans", 0.5)))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of documents whose spans count as verified from a score of 0.5 on."""
    sure = pipeline.with_spans(line_spans(spark, sf_dir).withColumn("text", F.lit("")), f"transform(spans, s -> {X.span('s', verified='s.score >= 0.5D')})")
    return pipeline.summary(pipeline.anonymise(sure))


@query
def by_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("doc_id", F.explode("by_type").alias("type", "n"))


@query
def doc_entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("doc_id", F.col("total_entities").alias("total"), F.col("entities_confirmed").alias("confirmed"), F.col("unique_entities").alias("uniq"))


@query
def fp_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand over twice among a document's named spans go."""
    return shown(pipeline.with_spans(line_spans(spark, sf_dir), X.not_frequent("spans", 2)))


@query
def fp_frequency_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of the domains: a document a supplier, whose names stand in it from once to many times."""
    name = F.concat(F.lit("n"), F.expr("cast(sqrt(l_partkey % 2500) as int)"))
    s = F.struct(F.col("l_orderkey").cast("int").alias("start"), (F.col("l_orderkey") + 1).cast("int").alias("end"), F.when(F.col("l_linenumber") == 7, "ISIN").otherwise("PERSON").alias("type"), name.alias("text"), F.lit(0.9).alias("score"), F.lit(True).alias("verified"), F.lit(None).cast("string").alias("reason"), F.col("l_linenumber").cast("string").alias("pattern"))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.collect_list(s).alias("spans")).withColumn("spans", F.expr(f"cast(spans as array<{X.SPAN}>)"))
    one = lambda domain: pipeline.exploded(pipeline.with_spans(docs, X.not_frequent("spans", Settings(domain=domain).most_frequent))).select(F.lit(domain).alias("domain"), "doc_id", "start", "type", "pattern", F.col("text").alias("value"))
    return one("general").unionByName(one("financial"))


@query
def assign_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal (type, text) share a number, given in order of the first start."""
    n = line_spans(spark, sf_dir).withColumn("numbered", F.expr(X.held(X.family_numbers("spans")))).select("doc_id", F.explode("numbered").alias("s"))
    return n.select("doc_id", "s.type", "s.text", F.regexp_extract("s.placeholder", "_([0-9]+)>$", 1).cast("bigint").alias("number")).distinct()


@query
def override_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pipeline.with_spans(line_spans(spark, sf_dir), X.ordered("spans"))
    first = base.filter("doc_id % 3 = 0").select("doc_id", F.col("spans")[0]["start"].alias("start"), F.col("spans")[0]["end"].alias("end"), F.col("spans")[0]["type"].alias("type"))
    return shown(overrides.removed(base, first))


# --- check digits -------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query
def validate_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "concat('US', lpad(cast(p_partkey * 37 as string), 8, '0'), substring('ABCDEFGHIJ', cast(p_partkey % 10 as int) + 1, 1), cast(p_size % 10 as string))"
    return _parts(spark, sf_dir).selectExpr("p_partkey", f"{t} as code").selectExpr("p_partkey", "code", f"{X.valid_isin('code')} as ok")


@query
def validate_lei(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "concat('5493', lpad(cast(p_partkey * 7919 as string), 12, '0'), substring('KLMNOPQRST', cast(p_partkey % 10 as int) + 1, 1), 'Z', lpad(cast(p_partkey % 97 + 2 as string), 2, '0'))"
    return _parts(spark, sf_dir).selectExpr("p_partkey", f"{t} as code").selectExpr("p_partkey", "code", f"{X.valid_lei('code')} as ok")


@query
def validate_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "concat('GB', lpad(cast(p_partkey % 97 + 2 as string), 2, '0'), ' WEST ', lpad(cast(p_partkey * 31 as string), 8, '0'), ' ', lpad(cast(p_size as string), 6, '0'))"
    return _parts(spark, sf_dir).selectExpr("p_partkey", f"{t} as code").selectExpr("p_partkey", "code", f"{X.valid_iban('code')} as ok")


@query
def validate_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "concat(lpad(cast(p_partkey % 1000 as string), 3, '0'), '-', lpad(cast(p_size % 12 as string), 2, '0'), '-', lpad(cast(p_partkey % 7 * 1111 as string), 4, '0'))"
    return _parts(spark, sf_dir).selectExpr("p_partkey", f"{t} as code").selectExpr("p_partkey", "code", f"{X.valid_ssn('code')} as ok")


# --- spans cut from texts -------------------------------------------------------------------------------------------


def _cut_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spans a document at fixed places (in short texts at their end), mostly inside words or across lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def one(a: str, n: str, t: str) -> str:
        start, end = f"least({a}, length(text))", f"least({a} + {n}, length(text))"
        return f"named_struct('start', {start}, 'end', {end}, 'type', '{t}', 'text', substring(text, {start} + 1, {end} - {start}), 'score', 0.7D, 'verified', true, 'reason', cast(null as string), 'pattern', '{t}')"

    spans = f"cast(array({one('3', '9', 'PERSON')}, {one('cast(length(text) div 2 as int)', '12', 'LOCATION')}, {one('cast(doc_id % 25 as int)', 'cast(doc_id % 13 + 1 as int)', 'NRP')}) as array<{X.SPAN}>)"
    return docs.withColumn("spans", F.expr(f"CASE WHEN text IS NOT NULL THEN {spans} END"))


def _shown_text(df: DataFrame) -> DataFrame:
    return pipeline.exploded(df).select("doc_id", "pattern", "start", "end", F.col("text").alias("value"))


@query
def snap_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_text(pipeline.with_spans(_cut_spans(spark, sf_dir), X.snapped("spans", "text")))


@query
def drop_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_text(pipeline.with_spans(_cut_spans(spark, sf_dir), X.not_short("spans")))


@query
def newline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    whole = "cast(array(named_struct('start', 0, 'end', length(text), 'type', 'PERSON', 'text', text, 'score', 0.7D, 'verified', true, 'reason', cast(null as string), 'pattern', 'w')) as array<" + X.SPAN + ">)"
    return pipeline.exploded(pipeline.with_spans(docs.withColumn("spans", F.expr(whole)), X.by_line("spans"))).select("doc_id", "start", "end", F.md5("text").alias("digest"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the rules: nation names, roles and references with articles and look-alikes."""
    forms = "array(n_name, concat('The ', 'Client'), 'Сlient', concat('Clause ', n_nationkey), 'Purchase and Invoice', lower(n_name), concat('an ', 'Agent ', n_name), 'of the', concat('section', n_name))"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.expr(forms)).alias("k", "t"))
    return rows


STOP = ["client", "purchase", "invoice", "agent", "france", "germany"]


@query
def fp_stoplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).filter("NOT " + X.in_stop_list("t", X.array_of(STOP))).select("n_nationkey", "k", "t")


@query
def fp_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).filter("NOT " + X.all_words_stop("t", X.array_of(STOP))).select("n_nationkey", "k", "t")


@query
def fp_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).filter("NOT " + X.structural("t")).select("n_nationkey", "k", "t")


@query
def fp_lowercase_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "named_struct('start', k, 'end', k + 1, 'type', 'PERSON', 'text', t, 'score', CASE WHEN k % 2 = 0 AND n_nationkey % 3 != 0 THEN 0.7D ELSE 0.5D END, 'verified', true, 'reason', cast(null as string), 'pattern', cast(k as string))"
    docs = _words(spark, sf_dir).groupBy(F.col("n_nationkey").alias("doc_id")).agg(F.collect_list(F.expr(s)).alias("spans")).withColumn("spans", F.expr(f"cast(spans as array<{X.SPAN}>)"))
    return _shown_text(pipeline.with_spans(docs, X.confirmed("spans")))


@query
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).selectExpr("p_partkey", "concat('  ', p_name, '  ', p_type, '\\t', p_brand, ';:., ') as raw").selectExpr("p_partkey", f"{X.normalised('raw')} as norm")


# --- chunks ---------------------------------------------------------------------------------------------------------


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_no", "off", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query
def chunk_offset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is its chunks, each without what the one before has had."""
    c = chunking.chunks(table(spark, sf_dir, "documents"))
    ends = c.withColumn("end", F.col("off") + F.length("text")).withColumn("had", F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("chunk_no")), F.lit(0)))
    piece = ends.select("doc_id", F.struct("chunk_no", F.expr("substring(text, had - off + 1)").alias("p")).alias("c"))
    return piece.groupBy("doc_id").agg(F.md5(F.array_join(F.expr("transform(array_sort(collect_list(c)), x -> x.p)"), "")).alias("digest"))


# --- placeholders -----------------------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a brand: names of parts, many of which contain one another."""
    s = "named_struct('start', cast(p_partkey as int) * 100, 'end', cast(p_partkey as int) * 100 + 50, 'type', CASE WHEN p_partkey % 3 = 0 THEN 'ORGANIZATION' ELSE 'PERSON' END, 'text', CASE p_partkey % 4 WHEN 0 THEN split(p_name, ' ')[0] WHEN 1 THEN p_name WHEN 2 THEN upper(split(p_name, ' ')[0]) ELSE concat(split(p_name, ' ')[1], '.') END, 'score', 0.9D, 'verified', true, 'reason', cast(null as string), 'pattern', 'n')"
    return _parts(spark, sf_dir).groupBy(F.col("p_brand").alias("doc_id")).agg(F.collect_list(F.expr(s)).alias("spans")).withColumn("spans", F.expr(f"cast(spans as array<{X.SPAN}>)"))


def _numbered(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    return _names(spark, sf_dir).withColumn("numbered", F.expr(X.family_numbers("spans", prefix)))


@query
def assign_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("doc_id", F.explode("numbered").alias("s")).select("doc_id", "s.start", "s.placeholder")


@query
def assign_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, "D2").select("doc_id", F.explode("numbered").alias("s")).select("doc_id", "s.placeholder").distinct()


@query
def assign_para_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers given by paragraph, and from right to left inside one."""
    s = pipeline.exploded(line_spans(spark, sf_dir)).withColumn("para", F.expr("cast(substring(pattern, 2) as int) % 3"))
    w = Window.partitionBy("doc_id", "type").orderBy("para", F.desc("start"), "pattern")
    return s.withColumn("number", F.row_number().over(w).cast("bigint")).select("doc_id", "pattern", "type", "number")


@query
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = pipeline.exploded(line_spans(spark, sf_dir)).select("type").union(_words(spark, sf_dir).select(F.col("t").alias("type"))).distinct()
    tags = type_table(spark)  # one row a type
    return kinds.join(F.broadcast(tags), "type", "left").select("type", F.coalesce("tag", "type").alias("tag"))


@query
def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _numbered(spark, sf_dir).select(F.col("doc_id").alias("session_id"), F.expr(X.mapping_of("numbered")).alias("mapping"))
    return store.long_mapping(m)


@query
def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_table(spark, sf_dir).filter(F.col("session_id") == "Brand#11")


@query
def mapping_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _numbered(spark, sf_dir, "D2").select(F.explode("numbered").alias("s")).select("s.placeholder").distinct()
    return p.select("placeholder", store.placeholder_type("placeholder").alias("type"))


# --- substitution and restoring ----------------------------------------------------------------------------------------


def _all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.anonymise(pipeline.detect(texts(spark, sf_dir)))


@query
def anonymize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with all its entities replaced, as a digest, and how many entities there are."""
    return _all_types(spark, sf_dir).select("doc_id", F.md5("anonymized_text").alias("digest"), F.size("numbered").cast("bigint").alias("n"))


@query
def detect_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.exploded(pipeline.detect(texts(spark, sf_dir))).select("doc_id", "start", "end", "type", F.col("text").alias("value"), "score")


@query
def scan_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.safe(pipeline.detect(texts(spark, sf_dir))).select("doc_id", "start", "end", "type", "score", "verified")


@query
def gazetteer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a term table (nations as they are written, and regions) in sentences about customers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    terms = nation.select(F.lit("LOCATION").alias("type"), F.col("n_name").alias("term")).unionByName(region.select(F.lit("NRP").alias("type"), F.col("r_name").alias("term")))
    told = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    docs = told.selectExpr("c_custkey as doc_id", "concat('From ', n_name, 'x to ', n_name, ', in ', r_name, '; ', c_mktsegment) as text")
    found = recognise(docs, types=(), finders=(("terms", term_finder(term_table(terms))),))
    return pipeline.exploded(found).select("doc_id", "start", "end", "type", F.col("text").alias("value"), "score")


@query
def review_reapply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of planted texts: the first span goes and `example` is added; reviews that aren't approved and JSON that isn't valid change nothing."""
    docs = pipeline.detect(planted_texts(table(spark, sf_dir, "customer")), Settings(types=("EMAIL_ADDRESS", "US_SSN", "ISIN")))
    asked = """CASE pmod(doc_id, 4) WHEN 0 THEN '{"remove": [0], "add": [{"text": "example", "type": "ORGANIZATION", "start": 0, "end": 7}]}' WHEN 1 THEN '{"remove": [0]}' WHEN 2 THEN '{oops' ELSE '{"remove": [0]}' END"""
    reviews = docs.selectExpr("doc_id", "CASE WHEN pmod(doc_id, 4) = 3 THEN 'pending' ELSE 'approved' END as status", f"{asked} as overrides")
    return pipeline.exploded(overrides.reapply(docs, reviews)).select("doc_id", "start", "end", "type", F.col("text").alias("value"), "reason")


@query
def sql_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions and views of the session's SQL."""
    from veilmark.functions.sql import register

    register(spark)
    codes = _parts(spark, sf_dir).selectExpr("p_partkey", "concat('GB', lpad(cast(p_partkey % 97 + 2 as string), 2, '0'), ' WEST ', lpad(cast(p_partkey * 31 as string), 8, '0'), ' ', lpad(cast(p_size as string), 6, '0')) as code", "concat('  ', p_name, ' ', p_type, ';, ') as raw", "p_brand", "p_size")
    return codes.selectExpr("p_partkey", "pii_valid_iban(code) as ok", "pii_normalise(raw) as norm", "pii_placeholder_type(concat('<', p_brand, '_PERSON_', p_size, '>')) as kind")


@query
def restore_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of placeholders of which one is the beginning of another."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('hi <A_1', c_custkey % 10, '> and <A_1> of <B_', c_nationkey, '>') as anonymized_text", "map('<A_1>', c_name, concat('<A_1', c_custkey % 10, '>'), c_mktsegment, concat('<B_', c_nationkey, '>'), 'x <A_1> y') as mapping")
    return pipeline.restore(rows).select("c_custkey", "restored_text")


@query
def roundtrip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pipeline.restore(_all_types(spark, sf_dir))
    return done.select("doc_id", F.md5("restored_text").alias("digest"))


@query
def restore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pipeline.restore(_all_types(spark, sf_dir))
    return done.select("doc_id", "entities_restored")


@query
def apply_mapping_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("m", F.expr("map('<X_1>', 'the', '<X_2>', 'the an', '<X_3>', 'de la')"))
    return docs.select("doc_id", F.md5(F.expr(X.replaced_literally("text", "m"))).alias("digest"))


@query
def override_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pipeline.detect(texts(spark, sf_dir))
    terms = docs.select("doc_id", F.lit("example").alias("text"), F.lit("ORGANIZATION").alias("type")).unionByName(docs.select("doc_id", F.lit("of the").alias("text"), F.lit("PERSON").alias("type")))
    return pipeline.exploded(overrides.added(docs, terms)).select("doc_id", "start", "end", "type", "score", "reason")


@query
def line_style_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.sources.documents import line_styles

    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('## Part ', doc_id, '\\n', 'SECTION ', doc_id, '\\n', text, '\\n#### x\\n###### y')").alias("text"))
    return line_styles(docs)


@query
def audit_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("args"), F.col("text").alias("result"))
    return store.audit(log, "args", "result").select("doc_id", "args", "result")


# --- state -----------------------------------------------------------------------------------------------------------


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('s', o_custkey) as session_id", "o_orderdate as ts", "o_orderkey")


@query
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("ts"))
    return store.recent(s).selectExpr("session_id", "date_format(ts, 'yyyy-MM-dd') as day")


@query
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).agg(F.max(F.struct("ts", "o_orderkey", "session_id")).alias("m")).select("m.session_id")


@query
def review_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last review of each session wins."""
    s = _sessions(spark, sf_dir).withColumn("ts", F.struct("ts", "o_orderkey"))
    return store.latest(s).select("session_id", "o_orderkey")


@query
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unexpired(_sessions(spark, sf_dir), F.to_timestamp(F.lit("1997-01-08")), 7).select("session_id", "o_orderkey")


@query
def learn_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _parts(spark, sf_dir).selectExpr("CASE WHEN p_size % 2 = 0 THEN 'legal' ELSE 'general' END as domain", "concat(' ', p_type, ' ') as text")
    return overrides.learned(r)


@query
def review_add_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _parts(spark, sf_dir).selectExpr("p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END as text", "cast(p_size - 5 as int) as start", "cast(p_partkey % 30 as int) as end")
    return overrides.valid_additions(r).select("p_partkey", "start", "end")


def _terms(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter(where).select(F.lower("n_name").alias("term"))


@query
def stoplist_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.combined(*(_terms(spark, sf_dir, f"n_nationkey % {k} = 0") for k in (2, 3, 5)))


@query
def stoplist_learned_minus_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.without(_terms(spark, sf_dir, "n_nationkey % 2 = 0"), _terms(spark, sf_dir, "n_nationkey % 3 = 0"))


@query
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the sizes of their lists, by name."""
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.concat(F.lit("r"), F.col("n_regionkey")).alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("extra")).select("name", F.size("extra").cast("bigint").alias("terms"), F.element_at("extra", 1).alias("first_term")).orderBy("name")


@query
def profile_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit("/"), "p_brand"), "[^\\p{L}\\p{N}_-]", "_").alias("safe"))


@query
def pii_rollup_lang_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: counts of found spans by language, source and type with all subtotals."""
    d = recognise(table(spark, sf_dir, "documents"), types=("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD"))
    rows = d.select("lang", "source", F.explode("spans").alias("s")).select("lang", "source", "s.type")
    return rows.rollup("lang", "source", "type").agg(F.count(F.lit(1)).alias("n"))
