"""Personal data replaced by keyed surrogates of the same type and format, in SQL functions only.

One regular expression finds all entities of a text; the text is cut at them and put together again with
surrogates. A surrogate is a function of the key, the type and the value in a normal form, so equal
values get equal surrogates everywhere, however they are written, and it is written in the layout of
the value it stands for:

- phone, card and national numbers: the digits go through a keyed Feistel permutation; country code, first
  digit of a card and its check digit (right or wrong as before) are kept in sense;
- IP addresses: a permutation of the 32 bits; IBANs: country kept, digits permuted, check digits made anew;
- e-mail addresses, keys and tokens: each letter or digit by one of its class (upper, lower, digit, hex, or
  its script), from a keyed stream; a domain's stream depends on the domain only;
- persons: a title stays; the surname is one value and the given name with its gender another, so "Mr Smith",
  "Dr Smith" and "John Smith" keep one surname: a made-up one of the same script, and a given name of the same
  gender and script. Persons are found by a title, by a given name of the lists, by words that announce a name
  ("my name is", "Author:"), and before an address in angle brackets. A surname that stands alone in a text is not searched for.

All distinct values of the corpus are then checked: where two would share their surrogates, or one would be a real value
of its type in the corpus (of given names: its own), the larger value tries again with the next attempt number. What still clashes after
`rounds` of that gets its type and a keyed hash in square brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cut, fresh, release

FIRST = {
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Hans Klaus Peter Stefan Pierre Jean Louis Antoine Carlos Miguel José Pablo Marco Paolo Lars Jan".split(),
    ("f", "latin"): "Mary Anna Susan Linda Emma Sarah Laura Julia Greta Ingrid Petra Claudia Marie Claire Camille Sophie Carmen Lucía Elena Isabel Giulia Chiara Karin Ida".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Γιάννης Κώστας Παύλος".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
}
TITLES = {
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor", "Sir", "Signor"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Signora"),
    ("m", "cyrillic"): ("Господин", "господин"),
    ("f", "cyrillic"): ("Госпожа", "госпожа"),
    ("m", "greek"): ("Κύριος", "κύριος"),
    ("f", "greek"): ("Κυρία", "κυρία"),
}
SYLLABLES = {
    "latin": "bar ben cor dal den fal gar har kel lan mar nor ost per rad sol tan ver wal zim".split(),
    "cyrillic": "бар бел вол гор дор зим кал лан мар нов ост пет рад сол тан тур чер шир яр".split(),
    "greek": "αρ βελ γαρ δορ ζιμ καλ λαν μαρ νερ ορ πετ ραδ σολ ταν φιλ χαρ".split(),
}
#: First letter and number of letters in a row of other scripts.
LETTERS = {"Greek": (0x3B1, 25), "Hebrew": (0x5D0, 27), "Arabic": (0x628, 19), "Armenian": (0x561, 38), "Georgian": (0x10D0, 33), "Devanagari": (0x915, 37), "Thai": (0xE01, 46), "Hiragana": (0x3041, 83), "Katakana": (0x30A1, 83), "Hangul": (0xAC00, 256), "Han": (0x4E00, 256)}
NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in FIRST.values() for n in ns)
_CUE = "(?<=[Mm]y name is |[Jj]e m'appelle |[Ii]ch heiße |[Mm]e llamo |[Nn]ame: |Author: |Contact: |Patient: |Customer: |From: |Signed-off-by: )"

#: Type and pattern, in the order in which they are tried at one place. Runs have no upper bound where the value has none; they can't be retried, so matching is linear.
PATTERNS: dict[str, str] = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "KEY": NOT_BEFORE + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk|ghp|gho|ghs|glpat|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)" + NOT_AFTER,
    "TOKEN": NOT_BEFORE + r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + NOT_AFTER,
    "IBAN": NOT_BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + NOT_AFTER,
    "SSN": NOT_BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + NOT_AFTER,
    "IP": r"(?<![\p{L}\p{N}.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?![\p{L}\p{N}]|\.[0-9])",
    "PHONE": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}" + NOT_AFTER + "|" + r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}" + NOT_AFTER + "|" + r"(?<![\p{L}\p{N}.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}" + NOT_AFTER,
    "CARD": r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}" + NOT_AFTER,
    "PERSON": NOT_BEFORE + rf"(?:(?:{_TITLE}|Dr|Prof)\.? (?:{_NAME})(?: {_NAME})?|(?:{_GIVEN}) {_NAME})" + NOT_AFTER + rf"|{_CUE}{_NAME} {_NAME}" + NOT_AFTER + "|" + NOT_BEFORE + rf"{_NAME} {_NAME}(?= <[^<>@\\s]++@)",
}
PATTERNS["PERSON"] = r"(?=[\p{Lu}гκ])(?:" + PATTERNS["PERSON"] + ")"
#: Only texts with a digit or an at sign are searched for what needs one; names, keys and tokens need neither.
ANY = "|".join(PATTERNS.values())
NO_MAIL = r"(?=[0-9a-z\p{Lu}гκ+(])(?:" + "|".join(p for t, p in PATTERNS.items() if t != "EMAIL") + ")"
NO_DIGIT = NOT_BEFORE + r"(?=[\p{Lu}гκa-gprsx])(?:" + "|".join(PATTERNS[t] for t in ("KEY", "TOKEN", "PERSON")) + ")"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _type(m: str) -> str:
    """The type of a mention; what only its surroundings tell is a person."""
    return "CASE " + " ".join(f"WHEN {m} rlike {q('^(?:' + p + ')$')} THEN '{t}'" for t, p in PATTERNS.items() if t != "PERSON") + " ELSE 'PERSON' END"


def _any_of(word: str, words: list[str] | tuple[str, ...]) -> str:
    return f"{word} IN ({', '.join(map(q, words))})"


def _country(m: str) -> str:
    """The country code of a phone number, or nothing."""
    return f"regexp_extract({m}, '^\\\\+([0-9]{{1,3}})(?=[ .(-])', 1)"


def _norm(t: str, m: str) -> str:
    """What makes two mentions the same: letters and digits without layout. Of a person it is the surname."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return f"""CASE {t} WHEN 'PHONE' THEN concat({_country(m)}, '+', substring({digits}, length({_country(m)}) + 1))
        WHEN 'SSN' THEN {digits} WHEN 'CARD' THEN {digits}
        WHEN 'IBAN' THEN replace({m}, ' ', '') WHEN 'EMAIL' THEN lower({m})
        WHEN 'PERSON' THEN substring_index({m}, ' ', -1) ELSE {m} END"""


def _title(m: str) -> str:
    return f"regexp_extract({m}, {q(f'^(?:{_TITLE}|Dr|Prof)[.]? ')}, 0)"


def _given(m: str) -> str:
    """gender:given name of a person, or an empty text."""
    names = f"substring({m}, length({_title(m)}) + 1)"
    return _one(f"CASE WHEN contains(gv, ' ') THEN concat({_gender(m)}, ':', substring_index(gv, ' ', 1)) ELSE '' END", names, "gv")


def _gender(m: str) -> str:
    word = f"regexp_replace(split({m}, ' ')[0], '[.]$', '')"
    cases = [f"WHEN {_any_of(word, (*TITLES[k], *FIRST[k]))} THEN '{k[0]}'" for k in FIRST]
    given = [f"WHEN {_any_of(f'split({m}, chr(32))[1]', FIRST[k])} THEN '{k[0]}'" for k in FIRST]
    return f"CASE {' '.join(cases + given)} ELSE 'n' END"


def _stream(seed: str, n: str, var: str) -> str:
    """Blocks of 64 hex digits from the seed, two digits for each of n characters at least. A long seed is hashed first, so that work stays linear."""
    own = f"CASE WHEN {n} > 4000 THEN sha2({seed}, 256) ELSE {seed} END"
    return _one(f"transform(sequence(0, cast({n} * 2 div 64 as int)), {var} -> sha2(concat({var}o, '|', {var}), 256))", own, f"{var}o")


def _number(hexes: str) -> str:
    return f"cast(conv({hexes}, 16, 10) as bigint)"


def _feistel(digits: str, seed: str, v: str) -> str:
    """A keyed permutation of the strings of as many digits (two at least; shorter ones stay)."""
    return f"""CASE WHEN length({digits}) < 2 THEN {digits} ELSE aggregate(sequence(0, 5),
        named_struct('l', substring({digits}, 1, length({digits}) div 2), 'r', substring({digits}, length({digits}) div 2 + 1)),
        ({v}s, {v}k) -> named_struct('l', {v}s.r, 'r', lpad(cast(
            pmod(cast({v}s.l as bigint) + {_number(f"substring(sha2(concat({seed}, '|', {v}k, '|', {v}s.r), 256), 1, 12)")}, cast(rpad('1', length({v}s.l) + 1, '0') as bigint))
            as string), length({v}s.l), '0')),
        {v}s -> concat({v}s.l, {v}s.r)) END"""


def _luhn(payload: str, v: str) -> str:
    """The check digit that belongs behind a payload."""
    d = f"cast(substring({payload}, length({payload}) - {v}i, 1) as int)"
    return f"pmod(-aggregate(sequence(0, length({payload}) - 1), 0, ({v}a, {v}i) -> {v}a + CASE WHEN {v}i % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END), 10)"


def _by_class(text: str, stream: str, v: str, hexes: bool = False, scripts: bool = False) -> str:
    """Each letter or digit of a text by one of its class (with `scripts`, not only those of ASCII); other signs stay."""
    c, n = f"{v}c", _number(f"substring({v}b[cast({v}j div 32 as int)], 2 * ({v}j % 32) + 1, 2)")
    lower, upper, cyr = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя"
    pick = lambda s: f"substring('{s}', cast({n} % {len(s)} as int) + 1, 1)"
    hex_case = f"WHEN {c} rlike '[0-9a-f]' THEN {pick('0123456789abcdef')} WHEN {c} rlike '[0-9A-F]' THEN {pick('0123456789ABCDEF')}" if hexes else ""
    more = ""
    if scripts:
        rows = " ".join(f"WHEN {c} rlike '\\\\p{{Is{name}}}' THEN decode(unhex(lpad(hex({first} + {n} % {size}), 4, '0')), 'UTF-16BE')" for name, (first, size) in LETTERS.items())
        more = f"WHEN {c} < chr(128) THEN {c} WHEN {c} rlike '\\\\p{{IsCyrillic}}' THEN {pick(cyr)} {rows} WHEN {c} rlike '\\\\p{{N}}' THEN {pick('0123456789')} WHEN {c} rlike '\\\\p{{Lu}}' THEN {pick(upper)} WHEN {c} rlike '\\\\p{{L}}' THEN {pick(lower)}"
    each = f"""array_join(transform(split({text}, ''), ({v}c, {v}j) -> CASE {hex_case}
        WHEN {c} rlike '[0-9]' THEN {pick('0123456789')} WHEN {c} rlike '[A-Z]' THEN {pick(upper)} WHEN {c} rlike '[a-z]' THEN {pick(lower)} {more} ELSE {c} END), '')"""
    return _one(each, stream, f"{v}b")


def _script(text: str) -> str:
    return f"CASE WHEN {text} rlike '\\\\p{{IsCyrillic}}' THEN 'cyrillic' WHEN {text} rlike '\\\\p{{IsGreek}}' THEN 'greek' ELSE 'latin' END"


def _made_up(hashed: str, n: str, script: str) -> str:
    """A word of n syllables of a script."""
    number = _number(f"substring(sha2(concat({hashed}, ps), 256), 1, 8)")
    pick = " ".join(f"WHEN '{s}' THEN element_at(array({', '.join(map(q, words))}), cast({number} % {len(words)} as int) + 1)" for s, words in SYLLABLES.items())
    return f"initcap(array_join(transform(sequence(1, {n}), ps -> CASE {script} {pick} END), ''))"


def _surname(seed: str, norm: str, attempt: str) -> str:
    """A made-up surname of the same script; each further attempt has a longer one."""
    return _one(_one(_made_up("ph", f"3 + {attempt}", "sc"), _script(norm), "sc"), f"sha2({seed}, 256)", "ph")


def _first_name(seed: str, norm: str, attempt: str) -> str:
    """A given name of the gender before the colon (of either, if that isn't known) and of the same script; from the fifth attempt on with a second part, each a longer one."""
    number = _number("substring(ph, 1, 8)")
    pools = {(g, s): FIRST[g, s] for g, s in FIRST} | {("n", s): FIRST["m", s] + FIRST["f", s] for _, s in FIRST}
    pick = " ".join(f"WHEN sc = '{s}' AND left({norm}, 1) = '{g}' THEN element_at(array({', '.join(map(q, words))}), cast({number} % {len(words)} as int) + 1)" for (g, s), words in pools.items())
    second = f"CASE WHEN {attempt} > 3 THEN concat('-', {_made_up('ph', f'{attempt} - 2', 'sc')}) ELSE '' END"
    return _one(_one(f"concat(CASE {pick} END, {second})", _script(norm), "sc"), f"sha2({seed}, 256)", "ph")


def _tag(t: str, own: str) -> str:
    """What stands for a value that finds no surrogate of its format."""
    return f"concat('[', {t}, ' ', substring(sha2({own}, 256), 1, 20), ']')"


def _given_surrogate(key: str, norm: str, attempt: str) -> str:
    """What _surrogate() gives for a given name."""
    own = f"concat({q(key)}, '|GIVEN|', {attempt}, '|', {norm})"
    return f"CASE WHEN {attempt} < 0 THEN {_tag(q('GIVEN'), own)} ELSE {_first_name(own, norm, attempt)} END"


def _surrogate(key: str, t: str, norm: str, attempt: str) -> str:
    """The surrogate of a value in normal form, in normal form."""
    salt = f"concat({q(key)}, '|', {t}, '|', {attempt})"
    own = f"concat({salt}, '|', {norm})"
    country, number = f"substring_index({norm}, '+', 1)", f"substring_index({norm}, '+', -1)"
    payload, check = f"substring({norm}, 2, length({norm}) - 2)", f"cast(right({norm}, 1) as int)"
    before = f"concat(left({norm}, 1), {payload})"
    card = f"""aggregate(array(concat(left({norm}, 1), {_feistel(payload, salt, 'c')})), '', (ca, cx) ->
        concat(cx, cast(pmod({_luhn('cx', 'd')} + {check} - {_luhn(before, 'e')}, 10) as string)))"""
    octet = lambda k: f"cast(split({norm}, '[.]')[{k}] as bigint)"
    ip = f"""aggregate(sequence(0, 5), named_struct('l', {octet(0)} * 256 + {octet(1)}, 'r', {octet(2)} * 256 + {octet(3)}),
        (i1, ik) -> named_struct('l', i1.r, 'r', pmod(i1.l + {_number(f"substring(sha2(concat({salt}, '|', ik, '|', i1.r), 256), 1, 12)")}, 65536L)),
        i1 -> concat_ws('.', i1.l div 256, i1.l % 256, i1.r div 256, i1.r % 256))"""
    account = f"substring({norm}, 5)"
    value = "CASE WHEN ib rlike '[0-9]' THEN ib ELSE cast(ascii(ib) - 55 as string) END"
    mod97 = f"aggregate(split(concat(bx, left({norm}, 2), '00'), ''), 0, (ia, ib) -> CASE WHEN ib = '' THEN ia ELSE cast((ia * CASE WHEN ib rlike '[0-9]' THEN 10 ELSE 100 END + cast({value} as int)) % 97 as int) END)"
    iban = f"""aggregate(array({_by_class(account, _stream(own, f'length({account})', 'bs'), 'b')}), '', (ba, bx) ->
        concat(left({norm}, 2), lpad(cast(98 - {mod97} as string), 2, '0'), bx))"""
    local, domain = f"substring_index({norm}, '@', 1)", f"substring_index({norm}, '@', -1)"
    host = f"left({domain}, length({domain}) - length(substring_index({domain}, '.', -1)))"
    site = f"concat({q(key)}, '|SITE|', {domain})"
    longer = f"concat({local}, repeat('a', cast(greatest({attempt} - 3, 0) as int)))"  # few letters have few surrogates
    email = f"concat({_by_class(longer, _stream(own, f'length({longer})', 'es'), 'el', scripts=True)}, '@', {_by_class(host, _stream(site, f'length({host})', 'hs'), 'eh')}, substring_index({domain}, '.', -1))"
    prefix = f"regexp_extract({norm}, '^(?:AKIA|ASIA|[a-z]+[-_]|eyJ)', 0)"
    rest = f"substring({norm}, length({prefix}) + 1)"
    return f"""CASE WHEN {attempt} < 0 THEN {_tag(t, own)} WHEN {t} = 'PHONE' THEN concat({country}, '+', {_feistel(number, salt, 'p')})
        WHEN {t} = 'SSN' THEN {_feistel(norm, salt, 'n')} WHEN {t} = 'CARD' THEN {card} WHEN {t} = 'IP' THEN {ip} WHEN {t} = 'IBAN' THEN {iban}
        WHEN {t} = 'EMAIL' THEN {email} WHEN {t} = 'KEY' THEN concat({prefix}, {_by_class(rest, _stream(own, f'length({rest})', 'ks'), 'k')})
        WHEN {t} = 'TOKEN' THEN {_by_class(norm, _stream(own, f'length({norm})', 'ts'), 't', True)}
        WHEN {t} = 'PERSON' THEN {_surname(own, norm, attempt)} ELSE {norm} END"""


def _written(t: str, m: str, s: str) -> str:
    """A surrogate in the layout of the mention m: its separators, case and title."""
    c = f"substring({m}, wj, 1)"
    place = f"length(regexp_replace(left({m}, wj), '[^0-9A-Za-z]', ''))"
    digits = f"regexp_replace({s}, '[^0-9A-Z]', '')"
    filled = f"array_join(transform(sequence(1, length({m})), wj -> CASE WHEN {c} rlike '[0-9A-Z]' THEN substring({digits}, {place}, 1) ELSE {c} END), '')"
    cased = f"array_join(zip_with(split({m}, ''), split({s}, ''), (wa, wb) -> CASE WHEN wa rlike '\\\\p{{Lu}}' THEN upper(wb) ELSE wb END), '')"
    return f"""CASE WHEN {s} LIKE '[%]' THEN {s} WHEN {t} IN ('PHONE', 'SSN', 'CARD', 'IBAN') THEN {filled} WHEN {t} = 'EMAIL' THEN {cased} ELSE {s} END"""


def _one(expr: str, value: str, name: str) -> str:
    """Binds a name to a value inside an expression."""
    return f"transform(array({value}), {name} -> {expr})[0]"


def _cases(text: str, call: str) -> str:
    """A call with the least pattern that a text needs; {p} is its place."""
    return f"CASE WHEN contains({text}, '@') THEN {call.format(p=q(ANY))} WHEN {text} rlike '[0-9]' THEN {call.format(p=q(NO_MAIL))} ELSE {call.format(p=q(NO_DIGIT))} END"


def hits(text: str) -> str:
    """All entities of a text, in order."""
    return _cases(text, f"regexp_extract_all({text}, {{p}}, 0)")


def mentions(text_col: str) -> Column:
    """array<struct<type, norm>> of a text, in order; a person is a surname and, if it has one, a given name."""
    own = "named_struct('type', mt, 'norm', " + _norm("mt", "mm") + ")"
    given = _one("CASE WHEN gn = '' THEN array() ELSE array(named_struct('type', 'GIVEN', 'norm', gn)) END", _given("mm"), "gn")
    each = _one(f"CASE WHEN mt = 'PERSON' THEN concat(array({own}), {given}) ELSE array({own}) END", _type("mm"), "mt")
    return F.expr(f"flatten(transform({hits(f'`{text_col}`')}, mm -> {each}))")


def values(docs: DataFrame, key: str, id_col: str, text_col: str, rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """The mentions (id, type, norm; distinct) and the values that need an attempt other than 0 (type, norm, attempt), both in the shared folder."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(mentions(text_col)).alias("e"))
    found = cut(found.select("id", "e.type", "e.norm").distinct())
    every = found.select("type", "norm").distinct().withColumn("attempt", F.lit(0))
    told = F.expr(f"CASE WHEN type = 'GIVEN' THEN {_given_surrogate(key, 'norm', 'attempt')} ELSE {_surrogate(key, 'type', 'norm', 'attempt')} END")
    now = cut(every.withColumn("s", told))
    # A surrogate must be no real value of its type; a given name only not the person's own, as lists of names are short.
    reals = now.select("type", F.col("norm").alias("s"))
    meant = F.when(F.col("type") == "GIVEN", F.concat(F.substring("norm", 1, 2), F.col("s"))).otherwise(F.col("s"))
    for left in range(rounds, -1, -1):
        first = now.groupBy("type", "s").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        clash = now.join(first, ["type", "s"]).filter("norm != owner.norm").select("type", "norm")
        own = now.filter((F.col("type") == "GIVEN") & (meant == F.col("norm"))).select("type", "norm")
        real = now.filter("type != 'GIVEN'").join(reals, ["type", "s"], "left_semi").select("type", "norm")
        bad = cut(clash.union(own).union(real).distinct().withColumn("bad", F.lit(1)))
        if bad.isEmpty():
            break
        step = F.col("attempt") + F.coalesce("bad", F.lit(0)) if left else F.when(F.col("bad") == 1, -1).otherwise(F.col("attempt"))
        again = now.join(bad, ["type", "norm"], "left").withColumn("attempt", step)
        now = cut(again.withColumn("s", F.when(F.col("bad") == 1, told).otherwise(F.col("s"))).drop("bad"))
    return found, now.filter("attempt != 0").select("type", "norm", "attempt")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities", few: int = 500_000) -> DataFrame:
    """All columns of docs with surrogates in the text, and the number of mentions in `count_col` if it is named (with an underscore behind it, if docs has that column).

    A null text stays null and counts 0; an empty one stays empty; an empty table gives an empty one. Ids serve only to find the rows that hold a value with a further
    attempt, so null and repeated ids are allowed, and repeated rows get equal texts. Those rows' attempts are broadcast if they are at most
    `few` rows, else joined by shuffling. Texts are not shuffled otherwise. Of two entities that begin at one place the earlier
    type of PATTERNS is taken. The same key gives the same surrogates for the same corpus.
    """
    found, again = values(docs, key, id_col, text_col)
    some = not again.isEmpty()
    again_id, again_map, all_hits = (fresh(docs.columns, c) for c in ("again_id", "again_map", "surrogate_hits"))
    if some:
        small = again.limit(few + 1).count() <= few
        attempts = found.join(F.broadcast(again) if small else again, ["type", "norm"]).groupBy(F.col("id").alias(again_id)).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "type", "norm"), "attempt"))).alias(again_map))
        attempts = cut(attempts)
        near = attempts.limit(few + 1).count() <= few
        docs_in = docs.join(F.broadcast(attempts) if near else attempts, F.col(id_col).eqNullSafe(F.col(again_id)), "left")
    else:
        docs_in = docs
    release(found)
    text = f"`{text_col}`"
    attempt = lambda t, norm: f"coalesce(try_element_at(`{again_map}`, concat_ws('|', {t}, {norm})), 0)" if some else "0"
    one = _one(_one(_one(_written("mt", "mm", "ms"), _surrogate(key, "mt", "mn", "ma"), "ms"), attempt("mt", "mn"), "ma"), _norm("mt", "mm"), "mn")
    first = _one(_one(f"CASE WHEN gn = '' THEN '' ELSE concat({_given_surrogate(key, 'gn', 'ga')}, ' ') END", attempt(q("GIVEN"), "gn"), "ga"), _given("mm"), "gn")
    one = _one(f"concat(CASE WHEN mt = 'PERSON' THEN concat({_title('mm')}, {first}) ELSE '' END, {one})", _type("mm"), "mt")
    gaps = _cases(text, f"split({text}, {{p}}, -1)")
    put = f"array_join(flatten(zip_with({gaps}, `{all_hits}`, (g, mm) -> CASE WHEN mm IS NULL THEN array(g) ELSE array(g, {one}) END)), '')"
    docs_in = docs_in.withColumn(all_hits, F.expr(hits(text)))
    out = {c: F.col(c) for c in docs.columns}
    out[text_col] = F.expr(f"CASE WHEN size(`{all_hits}`) > 0 THEN {put} ELSE {text} END")
    if count_col:
        out[fresh(docs.columns, count_col)] = F.expr(f"cast(greatest(coalesce(size(`{all_hits}`), 0), 0) as bigint)")
    return docs_in.select(*(c.alias(n) for n, c in out.items()))
