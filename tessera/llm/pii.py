r"""PII by format-preserving Feistel pseudonyms, in DataFrame functions alone.

Numbers and dates that pass their validity test are permuted, under a key, within their own format:
the same value gets the same pseudonym in every document, two values never share one, and the text
around them stays as it is.

    kind    found as                                         permuted
    email   local@domain.tld, letters of any script          letters and digits of the local part
    phone   +1 (ddd) ddd-dddd, ddd-ddd-dddd and the like     the digits after the country code
    ipv4    four numbers up to 255                           the 32-bit address
    card    13 to 19 digits that pass the Luhn test          all digits but the last, which is computed anew
    ssn     ddd-dd-dddd with issuable parts                  the nine digits, again until the parts are issuable
    iban    country, check digits, account (mod 97 holds)    the account's digits; check digits are computed anew
    date    yyyy-mm-dd or dd.mm.yyyy, dd/mm/yyyy that exist  the day within its 400 years, again until its year has four digits
    secret  32 or more hex digits                            the hex digits

A digit string of radix r is a Feistel network with ROUNDS rounds on its two halves: each digit of one
half is shifted, modulo r, by a digit drawn from SHA-256 of the key, the kind, the round and the other
half. Days are split as 773 x 189, which is exactly the cycle's 146,097 days. Where values are few (e-mail names, days) the
network is undone, a fixed step taken and the network done again: a permutation that leaves no value as it is.
Letters beyond ASCII are moved within their 128 code points, to a small letter or numeral, by a step drawn from the key,
the ASCII part's pseudonym and the letters moved before.

Numbers next to a card belong to the same run of digit groups; the card is the part of whole groups that passes
the test (see cut_sql). An IBAN ends where its country's length says, or after the last group with which it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

KEY, ROUNDS, CYCLE, ROWS_A, ROWS_B = "pii-key-1", 8, 146_097, 773, 189
#: Days from 0001-01-01 to 1970-01-01, and to 9999-12-31.
DAY_ONE, LAST_DAY, STEPS = 719_162, 3_652_058, 32
ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"

EMAIL = r"[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
#: Characters of an IBAN by country.
LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BF BJ CF CG CI CM FR GR IT MC MG ML MR NE SM SN", 28: "AL AZ BY CY DO DZ GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in LENGTHS.items())
IBAN = rf"(?<![0-9A-Za-z])(?:(?:{_KNOWN})|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?)(?![0-9A-Za-z])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d]|[./-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
#: A run of digit groups of any length, up to where a value of another form begins; cards are parts of it.
CARD = rf"(?<![\d.-])(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{PHONE}|{SSN}|{DATE})\d++)*+"
ANY = "|".join([EMAIL, SECRET, IBAN, IPV4, DATE, SSN, PHONE, CARD])


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole(pattern: str) -> str:
    return _q(f"^(?:{pattern})$")


def luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a digit string expression."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + case when i % 2 = 0 then {d} when {d} < 5 then 2 * {d} else 2 * {d} - 9 end)"


def feistel(value: str, kind: str, radix: int, key: str, rounds: int = ROUNDS, inverse: bool = False) -> str:
    """SQL: a keyed permutation of the strings of value's length over the first radix digits of ALNUM, or its inverse."""
    alphabet = _q(ALNUM[:radix])
    moving, other, sign = ("s.a", "s.b", "-") if inverse else ("s.b", "s.a", "+")
    stream = "concat(" + ", ".join(f"sha2(concat_ws('|', {_q(key)}, {_q(kind)}, r, length({moving}), {other}, {n}), 256)" for n in range(3)) + ")"
    # a half's digits shifted by the stream's; then the halves change places
    moved = f"""array_join(transform(sequence(1, length({moving})), i -> substr({alphabet},
        1 + cast(pmod(locate(substr({moving}, i, 1), {alphabet}) - 1 {sign} cast(conv(substr({stream}, 2 * i - 1, 2), 16, 10) as int), {radix}) as int), 1)), '')"""
    moved = f"case when length({moving}) = 0 then {moving} else {moved} end"
    halves = f"'a', {other}, 'b', {moved}" if inverse else f"'a', {moved}, 'b', {other}"
    return f"""case when length({value}) = 0 then '' else aggregate(sequence({f'{rounds}, 1, -1' if inverse else f'1, {rounds}'}),
        named_struct('a', substr({value}, 1, cast(length({value}) / 2 as int)), 'b', substr({value}, cast(length({value}) / 2 as int) + 1)),
        (s, r) -> named_struct({halves}),
        s -> concat(s.a, s.b)) end"""


def moved_always(value: str, kind: str, radix: int, key: str) -> str:
    """SQL: a keyed permutation that moves every string: the network undone, the last digit raised by one, the network done."""
    alphabet = _q(ALNUM[:radix])
    raised = f"concat(substr(v, 1, length(v) - 1), substr({alphabet}, locate(substr(v, -1), {alphabet}) % {radix} + 1, 1))"
    step = _let(raised, feistel("u", kind, radix, key), "u")
    return f"case when length({value}) = 0 then '' else {_let(feistel(value, kind, radix, key, inverse=True), step, 'v')} end"


def other_letters(value: str, seed: str, key: str) -> str:
    """SQL: value with its letters and numerals beyond ASCII moved, each to another, by a permutation of such strings."""
    draw = f"(2 * (cast(conv(substr(sha2(concat_ws('|', {_q(key)}, 'letter', {seed}, i, s), 256), 1, 6), 16, 10) as int) % 64) + 1)"
    # an odd step comes by all 128 code points, at last by the letter itself
    steps = f"transform(sequence(1, 128), t -> decode(unhex(lpad(hex(x - x % 128 + (x % 128 + t * {draw}) % 128), 8, '0')), 'UTF-32'))"
    found = f"element_at(filter({steps}, c -> c rlike '^[\\\\p{{L}}\\\\p{{N}}]$' and c = lower(c)), 1)"
    moved = _let(value, f"""aggregate(sequence(1, length(w)), '', (s, i) -> concat(s, case when substr(w, i, 1) rlike '^[\\\\p{{L}}\\\\p{{N}}]$' and ascii(substr(w, i, 1)) > 127
        then {_let("ascii(substr(w, i, 1))", found, "x")} else substr(w, i, 1) end))""", "w")
    return f"case when {value} rlike '[^\\x00-\\x7F]' then {moved} else {value} end"


def walk(value: str, step: str, good: str) -> str:
    """SQL: step of value, taken again (on w) until good holds of w."""
    return f"aggregate(sequence(1, {STEPS}), {value}, (w, t) -> case when t > 1 and {good} then w else {step} end)"


def fill(mask: str, digits: str, kinds: str) -> str:
    """SQL: mask with its characters of the class `kinds` replaced by those of digits, in turn."""
    used = f"length(regexp_replace(substr({mask}, 1, i), '[^{kinds}]', ''))"
    return f"array_join(transform(sequence(1, length({mask})), i -> case when substr({mask}, i, 1) rlike '[{kinds}]' then substr({digits}, {used}, 1) else substr({mask}, i, 1) end), '')"


def _let(value: str, body: str, name: str) -> str:
    """SQL: body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _day(expr: str, key: str) -> str:
    """SQL: a day number from 0001-01-01 to 9999-12-31 moved within its 400 years, to another such day."""
    draw = "cast(conv(substr(sha2(concat_ws('|', {k}, 'date', r, {x}), 256), 1, 12), 16, 10) as bigint)"

    def network(day: str, inverse: bool) -> str:
        sign = "-" if inverse else "+"
        a = f"pmod(s.a {sign} {draw.format(k=_q(key), x='s.b')}, {ROWS_A})"
        b = f"pmod(s.b {sign} {draw.format(k=_q(key + ':b'), x='s.a')}, {ROWS_B})"
        return f"""aggregate(sequence({f'{ROUNDS}, 1, -1' if inverse else f'1, {ROUNDS}'}), named_struct('a', cast({day} div {ROWS_B} as bigint), 'b', cast({day} % {ROWS_B} as bigint)),
            (s, r) -> case when r % 2 = 1 then named_struct('a', {a}, 'b', s.b) else named_struct('a', s.a, 'b', {b}) end,
            s -> cast(s.a * {ROWS_B} + s.b as int))"""

    once = _let(network(f"(w % {CYCLE})", True), f"w - w % {CYCLE} + {network(f'((d + 1) % {CYCLE})', False)}", "d")
    return f"(cast({walk(f'cast({expr} + {DAY_ONE} as int)', f'cast({once} as int)', f'w <= {LAST_DAY}')} as int) - {DAY_ONE})"


def cut_sql(value: str) -> str:
    """SQL: the parts of a string that ANY matched, of which pseudonym_sql() takes each by itself.

    Of a run of digit groups, the cards are parts: first single groups and groups as cards are printed, then parts
    of groups of four digits or more and the first 13 to 19 digits; longer ones first, then from the left.
    """
    digits = "regexp_replace(array_join(slice(g, i, j - i + 1), ''), '[^0-9]', '')"
    form = "array_join(transform(slice(g, i, j - i + 1), x -> cast(length(regexp_replace(x, '[^0-9]', '')) as string)), '-')"
    rank = f"""case when i = j or f in ('4-4-4-4', '4-6-5', '4-6-4') then 0
        when f rlike '^([4-9]|1[0-9])(-([4-9]|1[0-9]))*$' or f rlike '^4-4-4(-4)?-[1-3]$' then 1
        when i = 1 and (j = size(g) or length(d) + length(regexp_replace(g[j], '[^0-9]', '')) > 19) then 2 end"""
    one = _let(digits, f"""case when length(d) between 13 and 19 then {_let(form, f"named_struct('rank', {rank}, 'short', -length(d), 'i', i, 'j', j, 'd', d)", 'f')} end""", "d")
    every = f"flatten(transform(sequence(1, size(g)), i -> transform(sequence(i, least(size(g), i + 18)), j -> {one})))"
    good = f"array_sort(filter({every}, c -> c.rank is not null and {luhn_sum('c.d')} % 10 = 0))"
    cards = f"""aggregate({good}, cast(array() as array<struct<i: int, j: int>>), (s, c) -> case when exists(s, x -> x.i <= c.j and c.i <= x.j) then s
        else concat(s, array(named_struct('i', c.i, 'j', c.j))) end)"""
    text = "array_join(slice(g, c.i, c.j - c.i + 1), '')"
    parts = f"""filter(flatten(transform(sequence(1, size(g)), k -> case when exists(a, c -> c.i = k)
        then element_at(transform(filter(a, c -> c.i = k), c -> array(regexp_replace({text}, '[ -]$', ''), regexp_extract({text}, '([ -]?)$', 1))), 1)
        when exists(a, c -> c.i < k and k <= c.j) then cast(array() as array<string>) else array(g[k - 1]) end)), x -> x <> '')"""
    run = _let(f"regexp_extract_all({value}, '([0-9]+[ -]?)', 1)", _let(cards, parts, "a"), "g")
    short = f"filter(transform(sequence(size(g), 1), k -> array_join(slice(g, 1, k), ' ')), x -> {_iban_ok('x')})"
    iban = _let(f"split({value}, ' ')", f"coalesce({_let(short, f'case when size(a) > 0 then filter(array(a[0], substr({value}, length(a[0]) + 1)), x -> length(x) > 0) end', 'a')}, array({value}))", "g")
    taken = f"{value} rlike {_whole(f'{DATE}|{SSN}|{PHONE}')}"
    return f"""case when {value} rlike '^[0-9]+[ -]' and not {value} rlike '[^0-9 -]' and not {taken} then {run}
        when {value} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]* ' then {iban} else array({value}) end"""


_NUMERAL = "aggregate(sequence(1, length(w)), 0, (s, i) -> case when substr(w, i, 1) rlike '[0-9]' then (s * 10 + cast(substr(w, i, 1) as int)) % 97 else (s * 100 + ascii(substr(w, i, 1)) - 55) % 97 end)"


def _iban_ok(value: str) -> str:
    """SQL: whether a string has an IBAN's length and check digits."""
    bare = f"replace({value}, ' ', '')"
    return f"(length({bare}) between 15 and 34 and {_let(f'concat(substr({bare}, 5), substr({bare}, 1, 4))', f'{_NUMERAL} = 1', 'w')})"


def pseudonym_sql(value: str, key: str = KEY) -> str:
    """SQL: struct(kind, text) for a string that ANY matched; kind is null where no validity test holds."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    bare = f"replace({value}, ' ', '')"

    def pair(kind: str, text: str) -> str:
        return f"named_struct('kind', '{kind}', 'text', {text})"

    local = f"regexp_replace(lower(substring_index({value}, '@', 1)), '[^a-z0-9]', '')"
    # the pseudonym is computed once and bound to p before it is filled in
    name = other_letters(fill(f"lower(substring_index({value}, '@', 1))", "p", "a-z0-9"), "p", key)
    email = _let(_let(local, moved_always("w", "email", 36, key), "w"), f"concat({name}, '@', substring_index({value}, '@', -1))", "p")
    secret = _let(f"lower({value})", feistel("w", "secret", 16, key), "w")
    secret = f"case when {value} rlike '[A-F]' then upper({secret}) else {secret} end"
    check = "lpad(cast(98 - " + _let(f"concat(p, substr({bare}, 1, 2), '00')", _NUMERAL, "w") + " as string), 2, '0')"
    account = _let(_let(f"regexp_replace(substr({bare}, 5), '[^0-9]', '')", feistel("w", "iban", 10, key), "w"), fill(f"substr({bare}, 5)", "q", "0-9"), "q")
    iban = _let(account, _let(f"concat(substr({bare}, 1, 2), {check}, p)", fill(value, "q", "A-Z0-9"), "q"), "p")
    hexed = f"array_join(transform(split({value}, '[.]'), x -> lower(lpad(hex(cast(x as int)), 2, '0'))), '')"
    address = _let(_let(hexed, feistel("w", "ipv4", 16, key), "w"), "concat_ws('.', transform(sequence(0, 3), i -> cast(conv(substr(p, 2 * i + 1, 2), 16, 10) as string)))", "p")
    octets = f"forall(split({value}, '[.]'), x -> cast(x as int) <= 255)"
    iso = f"coalesce(try_to_date({value}, 'yyyy-MM-dd'), try_to_date({value}, 'dd.MM.yyyy'), try_to_date({value}, 'dd/MM/yyyy'))"
    forms = " ".join(f"when {value} like '{like}' then date_format(n, '{form}')" for like, form in (("%-%", "yyyy-MM-dd"), ("%.%", "dd.MM.yyyy")))
    date = _let(f"date_from_unix_date({_day(f'unix_date({iso})', key)})", f"case {forms} else date_format(n, 'dd/MM/yyyy') end", "n")
    issuable = "substr({0}, 1, 3) not in ('000', '666') and substr({0}, 1, 1) <> '9' and substr({0}, 4, 2) <> '00' and substr({0}, 6) <> '0000'"
    ssn = _let(walk(digits, feistel("w", "ssn", 10, key), issuable.format("w")), fill(value, "p", "0-9"), "p")
    ssn_ok = issuable.format(digits)
    country = f"substr({digits}, 1, length({digits}) - 10)"
    phone = _let(_let(f"substr({digits}, -10)", f"concat({country}, {feistel('w', 'phone', 10, key)})", "w"), fill(value, "p", "0-9"), "p")
    body = _let(f"substr({digits}, 1, length({digits}) - 1)", feistel("w", "card", 10, key), "w")
    last = f"cast((10 - {_let('''concat(p, '0')''', luhn_sum('z'), 'z')} % 10) % 10 as string)"
    card = _let(body, fill(value, f"concat(p, {last})", "0-9"), "p")
    luhn_ok = _let(digits, f"{luhn_sum('w')} % 10 = 0", "w")
    return f"""case
        when {value} rlike {_whole(EMAIL)} then {pair('email', email)}
        when {value} rlike {_whole('[0-9a-f]{32,128}|[0-9A-F]{32,128}')} then {pair('secret', secret)}
        when {value} rlike '^[A-Z][A-Z]' then case when {_iban_ok(value)} then {pair('iban', iban)} end
        when {value} rlike {_whole(r'[0-9]{1,3}([.][0-9]{1,3}){3}')} then case when {octets} then {pair('ipv4', address)} end
        when {value} rlike {_whole(r'[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}')} then case when {iso} >= date'0001-01-01' then {pair('date', date)} end
        when {value} rlike {_whole(r'[0-9]{3}-[0-9]{2}-[0-9]{4}')} then case when {ssn_ok} then {pair('ssn', ssn)} end
        when length({digits}) between 10 and 13 and {value} rlike '[ .()+-]' and {value} rlike {_whole(PHONE)} then {pair('phone', phone)}
        when length({digits}) between 13 and 19 and {luhn_ok} then {pair('card', card)}
        end"""


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text with pseudonyms, n_private, and kinds (kinds found, in order of text) of every row.

    A null text stays null, with n_private 0; texts without private values come back unchanged. Repeated
    rows are treated each; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    # Most texts have neither a digit nor an @: they pass a plain character test and no more.
    maybe = F.col("t").rlike("[0-9@]|[0-9a-f]{32}")
    hits = F.when(maybe, F.regexp_extract_all("t", F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("cuts", hits)
    rows = rows.withColumn("cuts", F.expr(f"transform(cuts, v -> {cut_sql('v')})"))
    rows = rows.withColumn("hits", F.flatten("cuts"))
    rows = rows.withColumn("new", F.expr(f"transform(hits, v -> {pseudonym_sql('v', key)})"))
    # between the parts of a match is nothing
    gaps = F.expr(f"concat(flatten(transform(cuts, (v, i) -> concat(array(split(t, {_q(ANY)}, -1)[i]), array_repeat('', size(v) - 1)))), array(element_at(split(t, {_q(ANY)}, -1), -1)))")
    rows = rows.withColumn("found", F.filter("new", lambda x: x.isNotNull()))
    swapped = F.expr("concat(gaps[0], array_join(transform(sequence(1, size(hits)), i -> concat(coalesce(new[i - 1].text, hits[i - 1]), gaps[i])), ''))")
    rows = rows.withColumn("gaps", F.when(F.size("found") > 0, gaps))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.size("found") > 0, swapped).otherwise(F.col("t")).alias("text"),
        F.coalesce(F.size("found"), F.lit(0)).alias("n_private"),
        F.transform(F.coalesce("found", F.array().cast("array<struct<kind:string,text:string>>")), lambda x: x.kind).alias("kinds"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"))
