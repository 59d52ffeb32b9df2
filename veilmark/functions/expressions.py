"""Spark SQL expressions for span work: check digits, normal forms, boundaries, rules, numbering. Strings in, strings out.

Spans are an array column of structs (start, end, type, text, score, verified, reason, pattern), so that every step
on one document is a projection without a shuffle.
"""

from __future__ import annotations

from veilmark.functions.catalog import ARTICLES, LOOK_ALIKE, NAMED, SKIP_WORDS, STRUCTURAL, TAGS

SPAN = "struct<start: int, end: int, type: string, text: string, score: double, verified: boolean, reason: string, pattern: string>"
FIELDS = ("start", "end", "type", "text", "score", "verified", "reason", "pattern")


def q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(words) -> str:
    return f"array({', '.join(map(q, words))})" if words else "cast(array() as array<string>)"


def let(value: str, name: str, body: str) -> str:
    """Binds a name to a value inside an expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def held(expr: str) -> str:
    """The expression, in a form that the optimiser doesn't copy: filters on a column made of it stay above it, so that it is computed once."""
    return f"CASE WHEN spark_partition_id() < 0 THEN null ELSE {expr} END"


def span(of: str, **changed: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {changed.get(f, f'{of}.{f}')}" for f in FIELDS) + ")"


def _mod97(digits: str) -> str:
    """Remainder by 97 of a string of letters and digits, letters as 10 to 35."""
    value = "CASE WHEN mc BETWEEN '0' AND '9' THEN ascii(mc) - 48 ELSE ascii(mc) - 55 END"
    return f"aggregate(filter(split({digits}, ''), mc -> mc != ''), 0, (ma, mc) -> (ma * CASE WHEN mc BETWEEN '0' AND '9' THEN 10 ELSE 100 END + {value}) % 97)"


def luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    return f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (la, li) -> la + {let(f'cast(substring({digits}, length({digits}) + 1 - li, 1) as int)', 'ld', 'CASE WHEN li % 2 = 1 THEN ld WHEN ld > 4 THEN 2 * ld - 9 ELSE 2 * ld END')}) % 10 = 0"


def valid_isin(t: str) -> str:
    spelled = f"array_join(transform(filter(split({t}, ''), ic -> ic != ''), ic -> CASE WHEN ic BETWEEN '0' AND '9' THEN ic ELSE cast(ascii(ic) - 55 as string) END), '')"
    return f"({t} rlike '^[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]\\\\z' AND {let(spelled, 'isp', luhn('isp'))})"


def valid_lei(t: str) -> str:
    return f"({t} rlike '^[A-Z0-9]{{18}}[0-9]{{2}}\\\\z' AND {_mod97(t)} = 1)"


def valid_iban(t: str) -> str:
    bare = f"upper(replace({t}, ' ', ''))"
    return let(bare, "ibn", f"(ibn rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,30}}\\\\z' AND {_mod97('concat(substring(ibn, 5), left(ibn, 4))')} = 1)")


def valid_ssn(t: str) -> str:
    """Area not 000, 666 or from 900, group not 00, serial not 0000."""
    return f"({t} rlike '^[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}\\\\z' AND {let(f'''replace({t}, '-', '')''', 'sn', '''left(sn, 3) NOT IN ('000', '666') AND left(sn, 1) != '9' AND substring(sn, 4, 2) != '00' AND right(sn, 4) != '0000' ''')})"


def valid(type_: str, text: str) -> str:
    """True for types without a check digit."""
    return f"CASE {type_} WHEN 'ISIN' THEN {valid_isin(text)} WHEN 'LEI' THEN {valid_lei(text)} WHEN 'IBAN_CODE' THEN {valid_iban(text)} WHEN 'US_SSN' THEN {valid_ssn(text)} ELSE true END"


def normalised(t: str) -> str:
    """Lower case, trimmed, no punctuation at the end, white space as one blank."""
    return f"regexp_replace(regexp_replace(trim(BOTH ' \\t\\n\\r' FROM lower({t})), '[.,;:]+\\\\z', ''), '\\\\s+', ' ')"


def bare(t: str) -> str:
    """Lower case and trimmed."""
    return f"lower(trim(BOTH ' \\t\\n\\r' FROM {t}))"


def placed_before(a: str, b: str) -> str:
    """Total order of spans: start, better score, longer, type, pattern, text."""
    keys = [(f"{a}.start", f"{b}.start"), (f"-{a}.score", f"-{b}.score"), (f"-{a}.end", f"-{b}.end"), (f"{a}.type", f"{b}.type"), (f"coalesce({a}.pattern, '')", f"coalesce({b}.pattern, '')"), (f"coalesce({a}.text, '')", f"coalesce({b}.text, '')")]
    return "CASE " + " ".join(f"WHEN {x} < {y} THEN -1 WHEN {x} > {y} THEN 1" for x, y in keys) + " ELSE 0 END"


def ordered(spans: str) -> str:
    return f"array_sort({spans}, (oa, ob) -> {placed_before('oa', 'ob')})"


def resolved(spans: str) -> str:
    """Left fold in order: a span that overlaps the last kept one takes its place if its score is higher, else goes."""
    return f"""aggregate({ordered(spans)}, cast(array() as array<{SPAN}>), (kept, s) -> CASE
        WHEN size(kept) = 0 OR s.start >= element_at(kept, -1).end THEN concat(kept, array(s))
        WHEN s.score > element_at(kept, -1).score THEN concat(slice(kept, 1, size(kept) - 1), array(s)) ELSE kept END)"""


def at_least(spans: str, least: float) -> str:
    return f"filter({spans}, s -> s.score >= {least!r}D)"


def checked(spans: str) -> str:
    return f"filter({spans}, s -> {valid('s.type', 's.text')})"


def snapped(spans: str, text: str) -> str:
    """Grown to the edges of words, then without signs at the ends: closing ones on the right, opening ones on the left."""
    # A span grows only where a character of a word stands on both sides of its edge. The left part is searched from behind, as a
    # search for its last word from the front would try every word of the text before.
    word = lambda at: f"substring({text}, {at}, 1) rlike '[\\\\p{{L}}\\\\p{{N}}]'"
    right = f"CASE WHEN {word('s.end + 1')} THEN length(regexp_extract(substring({text}, s.end + 1), '^[\\\\p{{L}}\\\\p{{N}}]+', 0)) ELSE 0 END"
    left = f"CASE WHEN s.start > 0 AND {word('s.start')} THEN length(regexp_extract(reverse(left({text}, s.start)), '^[\\\\p{{L}}\\\\p{{N}}]+', 0)) ELSE 0 END"
    inside_right, inside_left = word("s.end"), word("s.start + 1")
    grown_end = f"s.end + CASE WHEN {inside_right} THEN {right} ELSE 0 END"
    grown_start = f"s.start - CASE WHEN {inside_left} THEN {left} ELSE 0 END"
    # \z is the end of the text; $ would stand before a last line end as well.
    cut_right = "length(gw) - length(regexp_replace(gw, '[.,;:)\\\\]\\'\" \\\\t\\\\n\\\\r]+\\\\z', ''))"
    cut_left = "length(gw) - length(regexp_replace(gw, '^[(\\\\[\\'\" \\\\t\\\\n\\\\r#/]+', ''))"
    final = let(f"greatest(ge - ({cut_right}), gs)", "fe", let(f"least(gs + ({cut_left}), fe)", "fs", span("s", start="fs", end="fe", text=f"substring({text}, fs + 1, fe - fs)")))
    full = let(f"cast({grown_end} as int)", "ge", let(f"cast({grown_start} as int)", "gs", let(f"substring({text}, gs + 1, ge - gs)", "gw", final)))
    # A span from a word's first character to a word's last one, as most are, stays as it is: one look at it and its neighbours.
    w, no = "[\\\\p{L}\\\\p{N}]", "[^\\\\p{L}\\\\p{N}]"
    whole = f"length(wn) = s.end - s.start + 2 AND substring(wn, 2, s.end - s.start) = s.text AND wn rlike '(?s)^{no}{w}(?:.*{w})?{no}\\\\z'"
    stays = let("substring(pt, s.start + 1, s.end - s.start + 2)", "wn", whole)
    return let(f"concat(' ', {text}, ' ')", "pt", f"transform({spans}, s -> CASE WHEN s.start < s.end AND {stays} THEN {span('s')} ELSE {full} END)")


def not_short(spans: str) -> str:
    return f"filter({spans}, s -> length(trim(BOTH ' \\t\\n\\r' FROM s.text)) > 2)"


def by_line(spans: str, verified: str = "true") -> str:
    """A span over several lines becomes one for each line of over two characters, behind the others."""
    whole = f"filter({spans}, s -> NOT contains(s.text, '\\n'))"
    lines = "split(s.text, '\\n', -1)"
    before = "s.start + i + aggregate(slice(ls, 1, i), 0, (n, x) -> n + length(x))"
    trimmed = "trim(BOTH ' \\t\\r' FROM l)"
    at = f"({before} + instr(l, {trimmed}) - 1)"
    one = span("s", start=f"cast({at} as int)", end=f"cast({at} + length({trimmed}) as int)", text=trimmed, verified=f"cast({verified} as boolean)")
    split = f"flatten(transform(filter({spans}, s -> contains(s.text, '\\n')), s -> {let(lines, 'ls', f'filter(transform(ls, (l, i) -> {one}), p -> length(p.text) > 2)')}))"
    return f"concat({whole}, {split})"


def stop_forms(t: str) -> str:
    """The text's forms that a stop list is asked for: itself, with Latin look-alikes, without an article, both."""
    latin = f"translate(ws, '{LOOK_ALIKE[0]}', '{LOOK_ALIKE[1]}')"
    article = f"'^({'|'.join(ARTICLES)})'"
    return let(bare(t), "ws", let(f"lower({latin})", "wl", f"array(ws, wl, trim(regexp_replace(ws, {article}, '')), trim(regexp_replace(wl, {article}, '')))"))


def in_stop_list(t: str, stop: str) -> str:
    return f"arrays_overlap({stop_forms(t)}, {stop})"


def all_words_stop(t: str, stop: str) -> str:
    words = f"filter(split({bare(t)}, '\\\\s+'), w -> w != '' AND NOT array_contains({array_of(SKIP_WORDS)}, w))"
    return let(words, "aw", f"(size(aw) = 0 OR forall(aw, w -> array_contains({stop}, w)))")


def structural(t: str) -> str:
    return f"{bare(t)} rlike {q(STRUCTURAL)}"


def named(type_: str) -> str:
    return f"{type_} IN ({', '.join(map(q, NAMED))})"


def confirmed(spans: str) -> str:
    """Without named spans of one word in lower case that no span of score 0.6 or more in the document holds, whole or as a word."""
    sure = f"array_distinct(flatten(transform(filter({spans}, c -> c.score >= 0.6D), c -> {let(bare('c.text'), 'ct', 'concat(array(ct), split(ct, chr(32)))')})))"
    lone = f"({named('s.type')} AND NOT s.text rlike '\\\\s' AND left(s.text, 1) rlike '\\\\p{{Ll}}')"
    return f"CASE WHEN exists({spans}, s -> {lone}) THEN {let(sure, 'su', f'filter({spans}, s -> NOT ({lone} AND NOT array_contains(su, {bare('s.text')})))')} ELSE {spans} END"


def not_frequent(spans: str, most: int) -> str:
    """Without named spans whose text stands over `most` times among the document's named spans."""
    texts = f"array_sort(transform(filter({spans}, o -> {named('o.type')}), o -> {bare('o.text')}))"
    often = f"array_distinct(filter(tx, (t, i) -> i >= {most} AND tx[i - {most}] = t))"
    drop = f"CASE WHEN size(fq) = 0 THEN {spans} ELSE filter({spans}, s -> NOT ({named('s.type')} AND array_contains(fq, {bare('s.text')}))) END"
    return let(let(texts, "tx", often), "fq", drop)


def family_numbers(spans: str, prefix: str = "") -> str:
    """array<struct<start, end, type, text, norm, placeholder>> in order of start.

    A (type, normal form) seen before has its placeholder again. A form that contains a root's form of its type, or is contained in it
    (both of 4 characters or more), is a variant of the first such root: the root's number and a letter (from the 27th on
    an underscore and the number). Else it is a new root with the type's next number. The fold is over the distinct forms
    of each type, not over the spans.
    """
    state = "struct<roots: array<struct<norm: string, variants: int>>, out: array<struct<key: string, name: string>>>"
    tag = f"coalesce(map_from_arrays({array_of(TAGS)}, {array_of(TAGS.values())})[ty], ty)"  # looked up once a type
    kin = "CASE WHEN length(nm) >= 4 THEN array_position(transform(st.roots, r -> length(r.norm) >= 4 AND (contains(r.norm, nm) OR contains(nm, r.norm))), true) ELSE 0 END"
    suffix = "CASE WHEN vr = 0 THEN '' WHEN vr <= 26 THEN chr(96 + vr) ELSE concat('_', vr) END"
    entry = f"named_struct('key', nm, 'name', concat('<', {q(prefix + '_') if prefix else q('')}, tg, '_', CASE WHEN kn > 0 THEN kn ELSE size(st.roots) + 1 END, {suffix}, '>'))"
    roots = "CASE WHEN kn > 0 THEN transform(st.roots, (r, i) -> CASE WHEN i = kn - 1 THEN named_struct('norm', r.norm, 'variants', vr) ELSE r END) ELSE concat(st.roots, array(named_struct('norm', nm, 'variants', 0))) END"
    step = let(kin, "kn", let("CASE WHEN kn > 0 THEN st.roots[cast(kn as int) - 1].variants + 1 ELSE 0 END", "vr", f"named_struct('roots', {roots}, 'out', concat(st.out, array({entry})))"))
    start = f"cast(named_struct('roots', array(), 'out', array()) as {state})"
    of_type = f"aggregate(array_distinct(transform(filter(nd, x -> x.s.type = ty), x -> x.norm)), {start}, (st, nm) -> cast({step} as {state}), st -> st.out)"
    names = let(let(tag, "tg", of_type), "on", "named_struct('keys', transform(on, o -> o.key), 'names', transform(on, o -> o.name))")
    tables = f"transform(tys, ty -> {names})"
    one = "named_struct('start', x.s.start, 'end', x.s.end, 'type', x.s.type, 'text', x.s.text, 'norm', x.norm, 'placeholder', tb.names[cast(array_position(tb.keys, x.norm) as int) - 1])"
    placed = f"transform(nd, x -> {let('tt[cast(array_position(tys, x.s.type) as int) - 1]', 'tb', one)})"
    return let(f"transform({ordered(spans)}, s -> named_struct('s', s, 'norm', {normalised('s.text')}))", "nd", let("array_distinct(transform(nd, x -> x.s.type))", "tys", let(tables, "tt", placed)))


def substituted(text: str, numbered: str) -> str:
    """The text with each numbered span replaced; spans are in order and don't overlap."""
    fold = f"named_struct('at', s.end, 'out', concat(st.out, substring({text}, st.at + 1, s.start - st.at), s.placeholder))"
    return f"aggregate({numbered}, named_struct('at', 0, 'out', ''), (st, s) -> {fold}, st -> concat(st.out, substring({text}, st.at + 1)))"


def mapping_of(numbered: str) -> str:
    """Map from placeholder to the text first seen for it."""
    first = f"transform(dp, p -> {numbered}[cast(array_position(ps, p) as int) - 1].text)"
    return let(f"transform({numbered}, s -> s.placeholder)", "ps", let("array_distinct(ps)", "dp", f"map_from_arrays(dp, {first})"))


def restored(text: str, mapping: str) -> str:
    """Every placeholder replaced by its value, the longest first (ties by name)."""
    entries = f"array_sort(map_entries({mapping}), (a, b) -> CASE WHEN length(a.key) > length(b.key) THEN -1 WHEN length(a.key) < length(b.key) THEN 1 WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"
    return f"aggregate({entries}, {text}, (t, e) -> replace(t, e.key, e.value))"


def replaced_literally(text: str, mapping: str) -> str:
    """Every value replaced by its placeholder, the longest value first, in one pass each."""
    entries = f"array_sort(map_entries({mapping}), (a, b) -> CASE WHEN length(a.value) > length(b.value) THEN -1 WHEN length(a.value) < length(b.value) THEN 1 WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"
    return f"aggregate({entries}, {text}, (t, e) -> CASE WHEN e.value = '' THEN t ELSE replace(t, e.value, e.key) END)"
