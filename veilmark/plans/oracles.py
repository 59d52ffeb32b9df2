"""The queries of plans.queries in SQL for another engine, written from their meaning."""

from __future__ import annotations

from veilmark.functions.catalog import BUILTIN, NAMED, RECOGNISERS, SKIP_WORDS, TAGS, Recogniser, recognisers, stop_terms
from veilmark.plans.planted import text_sql
from veilmark.plans.queries import NOTES, STOP


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


# RE2's \b knows ASCII letters only, so other Latin letters are masked by a word character of the same length.
TEXTS = f"""texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - c_custkey, {text_sql()} FROM customer),
masked AS (SELECT doc_id, text, regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ɏ]', '_', 'g') AS m FROM texts)"""


def matches(rs: tuple[Recogniser, ...]) -> str:
    """Rows doc_id, type, pattern, start, value, score."""
    one = lambda r, p: f"SELECT doc_id, text, {q(r.entity)} AS type, {q(p.name)} AS pattern, {p.score}::DOUBLE AS score, string_split_regex(m, {q(p.regex)}) AS gaps, regexp_extract_all(m, {q(p.regex)}) AS hits FROM masked WHERE regexp_matches(m, {q(p.regex)})"
    found = " UNION ALL ".join(one(r, p) for r in rs for p in r.patterns)
    return f"""{TEXTS}, found AS ({found}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found),
spans AS (SELECT doc_id, type, pattern, score, text, (list_sum(list_transform(gaps[1:k], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: len(h))), 0))::INTEGER AS start, len(hits[k])::INTEGER AS n FROM each),
raw AS (SELECT doc_id, type, pattern, start, substring(text, start + 1, n) AS value, score, text FROM spans)"""


def chosen(*entities: str) -> tuple[Recogniser, ...]:
    return tuple(r for r in recognisers() if r.entity in entities)


ORACLES: dict[str, str] = {}
for _r in (*RECOGNISERS, *BUILTIN):
    ORACLES[f"detect_{_r.entity.lower()}"] = f"WITH {matches((_r,))} SELECT doc_id, type, pattern, start, value, score FROM raw"
ORACLES["detect_all_patterns"] = f"WITH {matches(recognisers())} SELECT type, pattern, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(start)::BIGINT AS sum_start FROM raw GROUP BY type, pattern"



def boosted(rs: tuple[Recogniser, ...]) -> str:
    """CTE near: the rows of raw with the score after the boost of a context word among the five words before. 2,000 characters hold more than five words of any table."""
    words = "CASE type " + " ".join(f"WHEN {q(r.entity)} THEN {values(c.lower() for c in r.context)}" for r in rs if r.context) + " ELSE [] END"
    return f"""before AS (SELECT *, list_filter(regexp_split_to_array(lower(substring(text, greatest(start - 2000, 0) + 1, least(start, 2000))), '\\s+'), lambda w: w != '') AS ws FROM raw),
told AS (SELECT *, array_to_string(ws[greatest(len(ws) - 4, 1):], ' ') AS b FROM before),
near AS (SELECT doc_id, type, pattern, start, value, text, round(CASE WHEN len(list_filter({words}, lambda c: contains(b, c))) > 0 THEN least(1.0, greatest(score + 0.35, 0.4)) ELSE score END, 3)::DOUBLE AS score FROM told)"""


_CTX = chosen("FINANCIAL_ACCOUNT", "UK_CRN", "MEDICAL_RECORD_NUMBER")
ORACLES["context_boost"] = f"WITH {matches(_CTX)}, {boosted(_CTX)} SELECT doc_id, type, pattern, start, value, score FROM near"

ORACLES["src_text_corpus"] = "SELECT doc_id, lang, source, length(text) AS n, md5(text) AS digest FROM documents"
ORACLES["src_min_text_guard"] = "SELECT doc_id FROM documents WHERE length(trim(text)) >= 500"
ORACLES["stoplist_parse"] = f"""SELECT DISTINCT lower(trim(l)) AS term FROM (SELECT unnest(string_split({q(NOTES)} || n_name || chr(10) || '# ' || n_name, chr(10))) AS l FROM nation)
WHERE trim(l) != '' AND NOT starts_with(trim(l), '#')"""
ORACLES["stoplist_learned_scope"] = "SELECT DISTINCT lower(n_name) AS term FROM nation WHERE n_regionkey IN (0, 1)"
ORACLES["custom_patterns"] = """SELECT n_nationkey, n_name AS name, 'P[0-9]+' AS pattern, 0.7::DOUBLE AS score, 'en' AS language FROM nation WHERE n_nationkey % 5 > 1
UNION ALL SELECT n_nationkey, 'z' || n_nationkey, 'z+', 0.9::DOUBLE, 'en' FROM nation WHERE n_nationkey % 5 > 1"""

LINES = """s AS (SELECT l_orderkey AS doc_id, ((l_partkey * 7 + l_linenumber * 13) % 60)::INTEGER AS start, ((l_partkey * 7 + l_linenumber * 13) % 60 + 3 + floor(l_quantity)::BIGINT % 20)::INTEGER AS "end",
  CASE l_linenumber % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'ISIN' ELSE 'EMAIL_ADDRESS' END AS type,
  't' || (l_suppkey % 5) AS text, round(0.3 + l_discount * 5, 3) AS score, 'p' || l_linenumber AS pattern FROM lineitem)"""
SHOWN = 'doc_id, start, "end", type, pattern, score'


def fold(source: str, ident: str = "doc_id", mark: str = "") -> str:
    """CTEs ord, folded and kept(ident, s), with `mark` behind their names: the overlap fold over rows of `source` with start, end, type, score, pattern."""
    return f"""ord{mark} AS (SELECT {ident} AS id, row_number() OVER (PARTITION BY {ident} ORDER BY start, score DESC, "end" DESC, type, pattern) AS rn, {{'a': start, 'b': "end", 'type': type, 'pattern': pattern, 'score': score, 'text': text}} AS s FROM {source}),
folded{mark} AS (SELECT id, rn, [s] AS kept FROM ord{mark} WHERE rn = 1
  UNION ALL SELECT o.id, o.rn, CASE WHEN o.s.a >= f.kept[-1].b THEN list_append(f.kept, o.s) WHEN o.s.score > f.kept[-1].score THEN list_append(f.kept[1:len(f.kept) - 1], o.s) ELSE f.kept END
  FROM folded{mark} f JOIN ord{mark} o ON o.id = f.id AND o.rn = f.rn + 1),
kept{mark} AS (SELECT id, unnest(arg_max(kept, rn)) AS s FROM folded{mark} GROUP BY id)"""


ORACLES["chunk_dedup"] = """SELECT l_orderkey AS doc_id, (l_partkey % 6 + l_linenumber % 2 * 3)::INTEGER AS start, (l_partkey % 6 + 4 + l_linenumber % 2 * 3)::INTEGER AS "end",
CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS type, max(l_discount) AS score FROM lineitem GROUP BY ALL"""
ORACLES["dedup_overlaps"] = f'WITH RECURSIVE {LINES}, {fold("s")} SELECT id AS doc_id, s.a AS start, s.b AS "end", s.type AS type, s.pattern AS pattern, s.score AS score FROM kept'
ORACLES["min_score_filter"] = f"WITH {LINES} SELECT {SHOWN} FROM s WHERE score >= 0.5"
ORACLES["by_type_counts"] = f"WITH {LINES} SELECT doc_id, type, count(*)::INTEGER AS n FROM s WHERE score >= 0.5 GROUP BY ALL"
ORACLES["doc_entity_totals"] = f"WITH {LINES} SELECT doc_id, count(*) AS total, count(*) FILTER (score >= 0.5) AS confirmed, count(DISTINCT type || '|' || text) FILTER (score >= 0.5) AS uniq FROM s GROUP BY doc_id"
ORACLES["fp_frequency_limits"] = """WITH n AS (SELECT l_suppkey AS doc_id, l_orderkey::INTEGER AS start, CASE WHEN l_linenumber = 7 THEN 'ISIN' ELSE 'PERSON' END AS type, l_linenumber::VARCHAR AS pattern, 'n' || floor(sqrt(l_partkey % 2500))::INTEGER AS value FROM lineitem),
c AS (SELECT *, count(*) FILTER (type = 'PERSON') OVER (PARTITION BY doc_id, value) AS k FROM n)
SELECT domain, doc_id, start, type, pattern, value FROM c, (VALUES ('general', 8), ('financial', 12)) v(domain, most) WHERE NOT (type = 'PERSON' AND k > most)"""
ORACLES["fp_frequency"] = f"""WITH {LINES}, n AS (SELECT *, type IN {tuple(NAMED)} AS nm FROM s),
c AS (SELECT *, count(*) FILTER (nm) OVER (PARTITION BY doc_id, text) AS k FROM n) SELECT {SHOWN} FROM c WHERE NOT (nm AND k > 2)"""
ORACLES["assign_exact"] = f"""WITH {LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC, "end" DESC, type, pattern) AS rn FROM s),
f AS (SELECT doc_id, type, text, min(rn) AS first FROM o GROUP BY ALL)
SELECT doc_id, type, text, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS number FROM f"""
ORACLES["override_remove"] = f"""WITH {LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC, "end" DESC, type, pattern) AS rn FROM s),
gone AS (SELECT DISTINCT o.doc_id, o.type, o.text FROM o JOIN (SELECT * FROM o WHERE rn = 1 AND doc_id % 3 = 0) f USING (doc_id, start, "end", type))
SELECT {SHOWN} FROM s ANTI JOIN gone USING (doc_id, type, text)"""
ORACLES["assign_para_order"] = f"""WITH {LINES} SELECT doc_id, pattern, type, row_number() OVER (PARTITION BY doc_id, type ORDER BY substring(pattern, 2)::INTEGER % 3, start DESC, pattern) AS number FROM s"""

_CODE = {
    "isin": "'US' || lpad((p_partkey * 37)::VARCHAR, 8, '0') || substring('ABCDEFGHIJ', (p_partkey % 10)::INTEGER + 1, 1) || (p_size % 10)::VARCHAR",
    "lei": "'5493' || lpad((p_partkey * 7919)::VARCHAR, 12, '0') || substring('KLMNOPQRST', (p_partkey % 10)::INTEGER + 1, 1) || 'Z' || lpad((p_partkey % 97 + 2)::VARCHAR, 2, '0')",
    "iban": "'GB' || lpad((p_partkey % 97 + 2)::VARCHAR, 2, '0') || ' WEST ' || lpad((p_partkey * 31)::VARCHAR, 8, '0') || ' ' || lpad(p_size::VARCHAR, 6, '0')",
    "ssn": "lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((p_size % 12)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 7 * 1111)::VARCHAR, 4, '0')",
}
_SPELL = "array_to_string(list_transform(string_split({t}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ord(c) - 55)::VARCHAR END), '')"
ORACLES["validate_isin"] = f"""WITH c AS (SELECT p_partkey, {_CODE['isin']} AS code FROM part), d AS (SELECT *, list_reverse(string_split({_SPELL.format(t='code')}, '')) AS ds FROM c)
SELECT p_partkey, code, list_sum(list_transform(ds, lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER ELSE (2 * x::INTEGER) // 10 + (2 * x::INTEGER) % 10 END)) % 10 = 0 AS ok FROM d"""
ORACLES["validate_lei"] = f"WITH c AS (SELECT p_partkey, {_CODE['lei']} AS code FROM part) SELECT p_partkey, code, {_SPELL.format(t='code')}::HUGEINT % 97 = 1 AS ok FROM c"
ORACLES["validate_iban"] = f"""WITH c AS (SELECT p_partkey, {_CODE['iban']} AS code FROM part), b AS (SELECT *, replace(code, ' ', '') AS t FROM c), r AS (SELECT *, substring(t, 5) || substring(t, 1, 4) AS u FROM b)
SELECT p_partkey, code, {_SPELL.format(t='u')}::HUGEINT % 97 = 1 AS ok FROM r"""
ORACLES["validate_ssn"] = f"""WITH c AS (SELECT p_partkey, {_CODE['ssn']} AS code FROM part)
SELECT p_partkey, code, substring(code, 1, 3) NOT IN ('000', '666') AND substring(code, 1, 1) != '9' AND substring(code, 5, 2) != '00' AND substring(code, 8) != '0000' AS ok FROM c"""

CUTS = """d AS (SELECT doc_id, text, length(text)::INTEGER AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, n, 3 AS a, 9 AS w, 'PERSON' AS pattern FROM d UNION ALL SELECT doc_id, text, n, n // 2, 12, 'LOCATION' FROM d
  UNION ALL SELECT doc_id, text, n, (doc_id % 25)::INTEGER, (doc_id % 13 + 1)::INTEGER, 'NRP' FROM d),
c AS (SELECT doc_id, text, least(a, n) AS a, least(a + w, n) AS b, pattern FROM p)"""
ORACLES["snap_boundaries"] = f"""WITH {CUTS},
g AS (SELECT *, CASE WHEN regexp_matches(substring(text, b, 1), '[\\p{{L}}\\p{{N}}]') THEN b + length(regexp_extract(substring(text, b + 1), '^[\\p{{L}}\\p{{N}}]+')) ELSE b END AS y,
  CASE WHEN regexp_matches(substring(text, a + 1, 1), '[\\p{{L}}\\p{{N}}]') THEN a - length(regexp_extract(substring(text, 1, a), '[\\p{{L}}\\p{{N}}]+$')) ELSE a END AS x FROM c),
w AS (SELECT *, substring(text, x + 1, y - x) AS t FROM g),
r AS (SELECT *, rtrim(t, '.,;:)]''" ' || chr(9) || chr(10) || chr(13)) AS t1 FROM w)
SELECT doc_id, pattern, (x + length(t1) - length(ltrim(t1, '([''" #/' || chr(9) || chr(10) || chr(13))))::INTEGER AS start, (x + length(t1))::INTEGER AS "end", ltrim(t1, '([''" #/' || chr(9) || chr(10) || chr(13)) AS value FROM r"""
ORACLES["drop_short"] = f"""WITH {CUTS}, t AS (SELECT *, substring(text, a + 1, b - a) AS value FROM c)
SELECT doc_id, pattern, a AS start, b AS "end", value FROM t WHERE length(trim(value, ' ' || chr(9) || chr(10) || chr(13))) > 2"""
ORACLES["newline_split"] = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM d WHERE len(ls) > 1),
l AS (SELECT doc_id, ls[k] AS l, coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)), 0) AS pos, trim(ls[k], ' ' || chr(9) || chr(13)) AS t FROM e)
SELECT doc_id, (pos + instr(l, t) - 1)::INTEGER AS start, (pos + instr(l, t) - 1 + length(t))::INTEGER AS "end", md5(t) AS digest FROM l WHERE length(t) > 2
UNION ALL SELECT doc_id, 0, length(text)::INTEGER, md5(text) FROM d WHERE len(ls) = 1"""

WORDS = """forms AS (SELECT n_nationkey, [n_name, 'The Client', 'Сlient', 'Clause ' || n_nationkey, 'Purchase and Invoice', lower(n_name), 'an Agent ' || n_name, 'of the', 'section' || n_name] AS f FROM nation),
w AS (SELECT n_nationkey, k::INTEGER AS k, f[k + 1] AS t FROM forms, range(9) r(k))"""
_STOP = values(STOP)
_LATIN = "translate(lower(t), 'саеорхвмтн', 'caeopxbmth')"
ORACLES["fp_stoplist"] = f"""WITH {WORDS} SELECT n_nationkey, k, t FROM w WHERE NOT (list_contains({_STOP}, lower(t)) OR list_contains({_STOP}, {_LATIN})
OR list_contains({_STOP}, trim(regexp_replace(lower(t), '^(the |a |an )', ''))) OR list_contains({_STOP}, trim(regexp_replace({_LATIN}, '^(the |a |an )', ''))))"""
ORACLES["fp_all_words"] = f"""WITH {WORDS}, x AS (SELECT *, list_filter(string_split(lower(t), ' '), lambda v: v != '' AND NOT list_contains({values(SKIP_WORDS)}, v)) AS ws FROM w)
SELECT n_nationkey, k, t FROM x WHERE len(list_filter(ws, lambda v: NOT list_contains({_STOP}, v))) > 0"""
ORACLES["fp_structural"] = f"WITH {WORDS} SELECT n_nationkey, k, t FROM w WHERE NOT regexp_matches(lower(t), '^(schedule|clause|section|article|appendix|annex|exhibit|part|recital)\\s+[0-9]')"
ORACLES["fp_lowercase_unconfirmed"] = f"""WITH {WORDS}, sure AS (SELECT DISTINCT n_nationkey, unnest(list_append(string_split(lower(t), ' '), lower(t))) AS t FROM w WHERE k % 2 = 0 AND n_nationkey % 3 != 0)
SELECT n_nationkey AS doc_id, k::VARCHAR AS pattern, k AS start, (k + 1)::INTEGER AS "end", t AS value FROM w
WHERE NOT (NOT contains(t, ' ') AND lower(t[1]) = t[1] AND NOT EXISTS (SELECT 1 FROM sure WHERE sure.n_nationkey = w.n_nationkey AND sure.t = lower(w.t)))"""
ORACLES["normalize_key"] = """SELECT p_partkey, regexp_replace(rtrim(trim(lower('  ' || p_name || '  ' || p_type || chr(9) || p_brand || ';:., ')), '.,;:'), '\\s+', ' ', 'g') AS norm FROM part"""

CHUNKS = """RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, 0 AS k, 0 AS pos, CASE WHEN n <= 4000 THEN n ELSE 3750 + CASE WHEN contains(substring(text, 3751, 250), ' ') THEN 251 - instr(reverse(substring(text, 3751, 250)), ' ') ELSE 250 END END AS e FROM d
  UNION ALL SELECT c.doc_id, k + 1, e - 250, CASE WHEN e - 250 + 4000 >= n THEN n ELSE e - 250 + 3750 + CASE WHEN contains(substring(text, e - 250 + 3751, 250), ' ') THEN 251 - instr(reverse(substring(text, e - 250 + 3751, 250)), ' ') ELSE 250 END END
  FROM c JOIN d USING (doc_id) WHERE e < n)"""
ORACLES["chunk_documents"] = f"WITH {CHUNKS} SELECT doc_id, k::INTEGER AS chunk_no, pos::INTEGER AS off, (e - pos)::INTEGER AS n, md5(substring(text, pos + 1, e - pos)) AS digest FROM c JOIN d USING (doc_id)"
ORACLES["chunk_offset_roundtrip"] = "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL"

_NORM = "regexp_replace(rtrim(lower(t), '.,;:'), '\\s+', ' ', 'g')"
_TAG = "CASE type " + " ".join(f"WHEN {q(t)} THEN {q(g)}" for t, g in TAGS.items()) + " ELSE type END"


def family(source: str) -> str:
    """CTEs up to named(doc_id, type, norm, p): the names of the forms of `source` (doc_id, start, type, t)."""
    return f"""o AS (SELECT doc_id, type, {_NORM} AS norm, min(start) AS first FROM {source} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS rn FROM o),
f AS (SELECT doc_id, type, 0::BIGINT AS rn, []::STRUCT(norm VARCHAR, num BIGINT, variants BIGINT)[] AS roots, []::STRUCT(norm VARCHAR, num BIGINT, v BIGINT)[] AS done FROM (SELECT DISTINCT doc_id, type FROM r)
  UNION ALL SELECT doc_id, type, rn, CASE WHEN hit IS NULL THEN list_append(roots, {{'norm': norm, 'num': len(roots) + 1, 'variants': 0}})
      ELSE list_transform(roots, lambda x: CASE WHEN x.num = hit.num THEN {{'norm': x.norm, 'num': x.num, 'variants': x.variants + 1}} ELSE x END) END,
    list_append(done, {{'norm': norm, 'num': coalesce(hit.num, len(roots) + 1), 'v': coalesce(hit.variants + 1, 0)}})
  FROM (SELECT f.doc_id, f.type, r.rn, f.roots, f.done, r.norm, list_filter(f.roots, lambda x: length(x.norm) >= 4 AND length(r.norm) >= 4 AND (contains(x.norm, r.norm) OR contains(r.norm, x.norm)))[1] AS hit
    FROM f JOIN r ON r.doc_id = f.doc_id AND r.type = f.type AND r.rn = f.rn + 1)),
last AS (SELECT doc_id, type, unnest(arg_max(done, rn)) AS d FROM f GROUP BY doc_id, type),
named AS (SELECT doc_id, type, d.norm AS norm, {_TAG} || '_' || d.num || CASE WHEN d.v = 0 THEN '' WHEN d.v <= 26 THEN chr((96 + d.v)::INTEGER) ELSE '_' || d.v END || '>' AS p FROM last)"""


FAMILY = f"""RECURSIVE n AS (SELECT p_brand AS doc_id, (p_partkey * 100)::INTEGER AS start, CASE WHEN p_partkey % 3 = 0 THEN 'ORGANIZATION' ELSE 'PERSON' END AS type,
  CASE p_partkey % 4 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN p_name WHEN 2 THEN upper(string_split(p_name, ' ')[1]) ELSE string_split(p_name, ' ')[2] || '.' END AS t FROM part),
{family("n")}"""
ORACLES["assign_family"] = f"WITH {FAMILY} SELECT n.doc_id, n.start, '<' || p AS placeholder FROM n JOIN named ON named.doc_id = n.doc_id AND named.type = n.type AND named.norm = {_NORM}"
ORACLES["assign_prefix"] = f"WITH {FAMILY} SELECT doc_id, '<D2_' || p AS placeholder FROM named"
_MAP = f"{FAMILY}, firsts AS (SELECT n.doc_id, n.type, {_NORM} AS norm, arg_min(t, start) AS original FROM n GROUP BY ALL), m AS (SELECT doc_id AS session_id, '<' || p AS placeholder, original, regexp_replace(p, '_[^_]*>$', '') AS type FROM named JOIN firsts USING (doc_id, type, norm))"
ORACLES["mapping_table"] = f"WITH {_MAP} SELECT session_id, placeholder, original, type FROM m"
ORACLES["mapping_lookup"] = f"WITH {_MAP} SELECT session_id, placeholder, original, type FROM m WHERE session_id = 'Brand#11'"
ORACLES["mapping_types"] = f"WITH {FAMILY} SELECT DISTINCT '<D2_' || p AS placeholder, 'D2_' || regexp_replace(p, '_[^_]*>$', '') AS type FROM named"
ORACLES["tag_lookup"] = f"WITH {LINES}, {WORDS}, k AS (SELECT type FROM s UNION SELECT t FROM w) SELECT type, {_TAG} AS tag FROM k"

# All types through the whole pipeline. Matches begin and end at letters or digits, so the word edges stay; none has a line feed, and none is of a named type.
_MOD97 = "list_reduce([0::BIGINT] || list_transform(string_split({t}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE (ord(c) - 55)::BIGINT END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
_BARE = "upper(replace(value, ' ', ''))"
_LUHN = f"list_sum(list_transform(list_reverse(string_split({_SPELL.format(t='value')}, '')), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER ELSE (2 * x::INTEGER) // 10 + (2 * x::INTEGER) % 10 END)) % 10 = 0"
_OK = f"""CASE type WHEN 'ISIN' THEN {_LUHN} WHEN 'LEI' THEN {_MOD97.format(t='value')} = 1
  WHEN 'IBAN_CODE' THEN regexp_full_match({_BARE}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,30}}') AND {_MOD97.format(t=f"substring({_BARE}, 5) || left({_BARE}, 4)")} = 1
  WHEN 'US_SSN' THEN substring(value, 1, 3) NOT IN ('000', '666') AND substring(value, 1, 1) != '9' AND substring(value, 5, 2) != '00' AND substring(value, 8) != '0000' ELSE true END"""
_STOPPED = f"(list_contains({values(stop_terms())}, lower(value)) OR len(list_filter(string_split_regex(lower(value), '\\s+'), lambda w: w != '' AND NOT list_contains({values([*stop_terms(), *SKIP_WORDS])}, w))) = 0)"


def piped(rs: tuple[Recogniser, ...], source: str = "") -> str:
    """CTEs up to done(doc_id, start, end, type, value, score): what the whole pipeline finds."""
    return f"""RECURSIVE {matches(rs)}, {boosted(rs)},
r0 AS (SELECT doc_id, type, pattern, start, (start + length(value))::INTEGER AS "end", value AS text, score FROM near {source}), {fold("r0")},
done AS (SELECT * FROM (SELECT id AS doc_id, s.a AS start, s.b AS "end", s.type AS type, s.text AS value, s.score AS score FROM kept) WHERE score >= 0.5 AND {_OK} AND NOT {_STOPPED})"""


PIPE = piped(recognisers())
ORACLES["detect_pipeline"] = f"WITH {PIPE} SELECT * FROM done"
ORACLES["scan_preview"] = f'WITH {PIPE} SELECT doc_id, start, "end", type, score, true AS verified FROM done'
_NUM = f"""{PIPE}, n AS (SELECT doc_id, start, "end", type, value AS t FROM done), {family("n")},
p AS (SELECT n.doc_id, n.start, n."end", '<' || p AS placeholder FROM n JOIN named ON named.doc_id = n.doc_id AND named.type = n.type AND named.norm = {_NORM})"""
ORACLES["anonymize_text"] = f"""WITH {_NUM}, l AS (SELECT doc_id, list({{'a': start, 'b': "end", 'p': placeholder}} ORDER BY start) AS ps FROM p GROUP BY doc_id)
SELECT texts.doc_id, md5(CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(ps) + 1), lambda k: substring(text, CASE WHEN k = 1 THEN 1 ELSE ps[k - 1].b + 1 END, ps[k].a - CASE WHEN k = 1 THEN 0 ELSE ps[k - 1].b END) || ps[k].p), '') || substring(text, ps[-1].b + 1) END) AS digest, coalesce(len(ps), 0) AS n
FROM texts LEFT JOIN l USING (doc_id)"""
ORACLES["roundtrip_identity"] = f"WITH {TEXTS} SELECT doc_id, md5(text) AS digest FROM texts"
ORACLES["restore_counts"] = f"WITH {_NUM} SELECT texts.doc_id, count(DISTINCT placeholder) AS entities_restored FROM texts LEFT JOIN p ON p.doc_id = texts.doc_id GROUP BY texts.doc_id"
ORACLES["gazetteer_terms"] = """WITH d AS (SELECT c_custkey AS doc_id, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT doc_id, (10 + length(n_name))::INTEGER AS start, (10 + 2 * length(n_name))::INTEGER AS "end", 'LOCATION' AS type, n_name AS value, 0.85::DOUBLE AS score FROM d
UNION ALL SELECT doc_id, (15 + 2 * length(n_name))::INTEGER, (15 + 2 * length(n_name) + length(r_name))::INTEGER, 'NRP', r_name, 0.85::DOUBLE FROM d"""
_REVIEWED = chosen("EMAIL_ADDRESS", "US_SSN", "ISIN")
ORACLES["review_reapply"] = f"""WITH {piped(_REVIEWED, "WHERE doc_id < 0")},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS rn, (doc_id % 4 + 4) % 4 AS m FROM done), gone AS (SELECT doc_id, type, lower(value) AS t FROM o WHERE rn = 1 AND m IN (0, 1)),
left_ AS (SELECT doc_id, start, "end", type, value, score FROM o WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = o.doc_id AND gone.type = o.type AND gone.t = lower(o.value))),
parts AS (SELECT doc_id, string_split(text, 'example') AS ps FROM texts WHERE doc_id < 0 AND (doc_id % 4 + 4) % 4 = 0 AND contains(text, 'example')),
occ AS (SELECT doc_id, (list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * 7)::INTEGER AS start FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM parts)),
more AS (SELECT * FROM occ WHERE NOT EXISTS (SELECT 1 FROM left_ e WHERE e.doc_id = occ.doc_id AND e.start <= occ.start AND occ.start + 7 <= e."end"))
SELECT doc_id, start, "end", type, value, NULL AS reason FROM left_ UNION ALL SELECT doc_id, start, start + 7, 'ORGANIZATION', 'example', 'user_added' FROM more"""
ORACLES["sql_checks"] = f"""WITH c AS (SELECT p_partkey, p_name, p_type, p_brand, {_CODE['iban']} AS code FROM part), b AS (SELECT *, replace(code, ' ', '') AS t FROM c), r AS (SELECT *, substring(t, 5) || substring(t, 1, 4) AS u FROM b)
SELECT p_partkey, {_SPELL.format(t='u')}::HUGEINT % 97 = 1 AS ok, regexp_replace(rtrim(trim(lower('  ' || p_name || ' ' || p_type || ';, ')), '.,;:'), '\\s+', ' ', 'g') AS norm, p_brand || '_PERSON' AS kind FROM r"""
ORACLES["restore_text"] = """SELECT c_custkey, replace(CASE WHEN c_nationkey < 10 THEN a ELSE a END, '<A_1>', c_name) AS restored_text FROM (
SELECT c_custkey, c_nationkey, c_name, replace(replace('hi <A_1' || c_custkey % 10 || '> and <A_1> of <B_' || c_nationkey || '>', '<A_1' || c_custkey % 10 || '>', c_mktsegment), '<B_' || c_nationkey || '>', CASE WHEN c_nationkey < 10 THEN '<B>' ELSE 'x <A_1> y' END) AS a FROM customer) WHERE c_nationkey >= 10
UNION ALL SELECT c_custkey, replace(replace(replace('hi <A_1' || c_custkey % 10 || '> and <A_1> of <B_' || c_nationkey || '>', '<A_1' || c_custkey % 10 || '>', c_mktsegment), '<A_1>', c_name), '<B_' || c_nationkey || '>', 'x <A_1> y') FROM customer WHERE c_nationkey < 10"""
ORACLES["apply_mapping_literal"] = "SELECT doc_id, md5(replace(replace(replace(text, 'the an', '<X_2>'), 'de la', '<X_3>'), 'the', '<X_1>')) AS digest FROM documents"

ORACLES["override_add"] = f"""WITH {PIPE}, e AS (SELECT doc_id, start, "end", type, score, value AS text, 'p' AS pattern FROM done),
terms AS (SELECT * FROM (VALUES ('example', 'ORGANIZATION'), ('of the', 'PERSON')) v(term, type)),
parts AS (SELECT doc_id, term, type, string_split(text, term) AS ps FROM texts, terms WHERE contains(text, term)),
occ AS (SELECT doc_id, term, type, (list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * length(term))::INTEGER AS start FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM parts)),
new AS (SELECT doc_id, start, (start + length(term))::INTEGER AS "end", type, 1.0::DOUBLE AS score, term AS text, '' AS pattern FROM occ WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = occ.doc_id AND e.start <= occ.start AND occ.start + length(term) <= e."end")),
both_ AS (SELECT * FROM e UNION ALL SELECT * FROM new), {fold("both_", mark="2")}
SELECT id AS doc_id, s.a AS start, s.b AS "end", s.type AS type, s.score AS score, CASE WHEN s.pattern = '' THEN 'user_added' END AS reason FROM kept2"""
ORACLES["line_style_classify"] = """WITH d AS (SELECT doc_id, string_split('## Part ' || doc_id || chr(10) || 'SECTION ' || doc_id || chr(10) || text || chr(10) || '#### x' || chr(10) || '###### y', chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS k, ls FROM d), t AS (SELECT doc_id, k::INTEGER AS line_no, trim(ls[k + 1]) AS t FROM l), m AS (SELECT *, length(t) - length(ltrim(t, '#')) AS marks FROM t)
SELECT doc_id, line_no, CASE WHEN t = '' THEN 'blank' WHEN marks > 0 THEN 'heading' || least(marks, 4) WHEN length(t) < 100 AND upper(t) = t AND regexp_matches(t, '\\p{L}') THEN 'heading2' ELSE 'body' END AS style,
md5(CASE WHEN marks > 0 THEN trim(ltrim(t, '#')) ELSE t END) AS digest FROM m"""
ORACLES["audit_truncate"] = "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS args, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS result FROM documents"

_SESS = "s AS (SELECT 's' || o_custkey AS session_id, o_orderdate AS ts, o_orderkey FROM orders)"
ORACLES["recent_sessions"] = f"WITH {_SESS}, m AS (SELECT session_id, max(ts) AS ts FROM s GROUP BY session_id) SELECT session_id, strftime(ts, '%Y-%m-%d') AS day FROM m ORDER BY ts DESC, session_id LIMIT 5"
ORACLES["latest_session"] = f"WITH {_SESS} SELECT session_id FROM s ORDER BY ts DESC, o_orderkey DESC, session_id DESC LIMIT 1"
ORACLES["review_latest"] = f"WITH {_SESS} SELECT session_id, o_orderkey FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, o_orderkey DESC) = 1"
ORACLES["ttl_expire"] = f"WITH {_SESS} SELECT session_id, o_orderkey FROM s WHERE ts >= TIMESTAMP '1997-01-01'"
ORACLES["learn_terms"] = "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'legal' ELSE 'general' END AS domain, lower(trim(p_type)) AS term FROM part"
ORACLES["review_add_validate"] = "SELECT p_partkey, (p_size - 5)::INTEGER AS start, (p_partkey % 30)::INTEGER AS \"end\" FROM part WHERE p_partkey % 7 != 0 AND p_name != '' AND p_size >= 5 AND p_partkey % 30 > p_size - 5"
ORACLES["stoplist_combined"] = "SELECT DISTINCT lower(n_name) AS term FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 OR n_nationkey % 5 = 0"
ORACLES["stoplist_learned_minus_custom"] = "SELECT lower(n_name) AS term FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT lower(n_name) FROM nation WHERE n_nationkey % 3 = 0"
ORACLES["profile_summary"] = "SELECT 'r' || n_regionkey AS name, count(*) AS terms, min(n_name) AS first_term FROM nation GROUP BY n_regionkey"
ORACLES["profile_safe_name"] = "SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe FROM part"
_ROLL = chosen("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD")
ORACLES["pii_rollup_lang_source_type"] = f"WITH {matches(_ROLL)} SELECT lang, source, type, count(*) AS n FROM raw JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source, type)"
