"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Found and validated are: e-mail addresses, IPv4 addresses (four numbers up to 255), dates (that exist,
from 1800 to 2098), social security numbers (no area 000, 666 or from 900, no group 00, no serial 0000),
card numbers of 13 to 19 digits with a right check digit, and hexadecimal keys of 32 to 64 digits.
Telephone numbers go by their layout: North American ones (3-3-4), French ones (five pairs, from 01 to 09),
and international ones of 8 to 15 digits behind a plus sign. What fails its test stays; so do national
numbers of other layouts and dates with month names or of two-digit years.

Of slash dates the month comes first if that is a date, else the day: the latter are permuted among
themselves (the network is applied until its value is one again), so no two dates get one pseudonym.

A value is permuted within its format: digits stay digits, letters keep their case, separators their
places; a card number ends in a right check digit again, a date becomes a date of the same layout, an
address an address. The network is a bijection for each kind and length, so equal values stay equal in
all documents, different ones differ, and whoever has the key can undo it. Long values are permuted
in blocks. Country codes, mail domains and what stands around stay.

DataFrame and SQL functions only; rows are independent, so nothing is shuffled.

Defined results: a null text stays null, with nothing found. Repeated rows are treated alike. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The network is applied so often at most; two in five values lie outside, so a value needs more with
#: probability 0.4^64, and would keep its layout and be permuted all the same.
WALK = 64
#: The layouts, in the order in which they are tried.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,6}){2,6}(?![0-9])|(?<![0-9+])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9]|[ .-][0-9])",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
DIGITS, LOWER, UPPER, HEX, HEX_UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"
#: Symbols of a block: its numbers stay under 2^62.
BLOCK = {10: 16, 16: 12, 26: 12}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(key: str, tag: str, x: str, m1: str, m2: str) -> str:
    """SQL that permutes the number x under m1 * m2: its halves take turns in adding a keyed digest of the
    other and of ``tag``."""
    f = lambda half: f"cast(conv(substring(sha2(concat_ws('|', {_sql(key)}, {tag}, cast(r AS string), cast({half} AS string)), 256), 1, 15), 16, 10) AS bigint)"
    step = f"if(r % 2 = 0, named_struct('a', (s.a + {f('s.b')} % {m1}) % {m1}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {f('s.a')} % {m2}) % {m2}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', ({x}) div {m2}, 'b', ({x}) % {m2}), (s, r) -> {step}, s -> s.a * {m2} + s.b)"


def _sequence(key: str, kind: str, q: str, alphabet: str) -> str:
    """SQL that permutes the string q over the alphabet, in blocks."""
    radix = len(alphabet)
    power = lambda n: f"cast(power({radix}, {n}) AS bigint)"
    size = BLOCK[radix]
    number = f"aggregate(split(p, ''), 0L, (n, c) -> n * {radix} + instr({_sql(alphabet)}, c) - 1)"
    tag = f"concat('{kind}{radix}:', char_length(q), ':', i)"
    permuted = _bound(number, "x", _feistel(key, tag, "x", power("char_length(p) div 2"), power("char_length(p) - char_length(p) div 2")))
    spelled = f"array_join(transform(sequence(1, char_length(p)), j -> substring({_sql(alphabet)}, cast(y div {power('char_length(p) - j')} % {radix} AS int) + 1, 1)), '')"
    block = _bound(f"substring(q, i * {size} + 1, {size})", "p", _bound(permuted, "y", spelled))
    return _bound(q, "q", f"if(q = '', '', array_join(transform(sequence(0, (char_length(q) - 1) div {size}), i -> {block}), ''))")


def _placed(m: str, cls: str, symbols: str) -> str:
    """SQL that puts the symbols, in order, where m has characters of the class."""
    return _bound(
        f"named_struct('m', {m}, 's', {symbols})", "z",
        f"aggregate(split(z.m, ''), named_struct('t', '', 'k', 1), (a, c) -> if(c rlike '{cls}', named_struct('t', concat(a.t, substring(z.s, a.k, 1)), 'k', a.k + 1), named_struct('t', concat(a.t, c), 'k', a.k)), a -> a.t)",
    )


def _classes(key: str, kind: str, m: str, classes: dict[str, str]) -> str:
    """SQL that permutes the characters of each class of m among themselves."""
    for cls, alphabet in classes.items():
        m = _bound(m, "m0", _placed("m0", cls, _sequence(key, kind, f"regexp_replace(m0, '[^{cls[1:]}', '')", alphabet)))
    return m


def _luhn(digits: str, doubled: int) -> str:
    """SQL for the check sum of a string of digits; ``doubled``: whether the last one counts double."""
    d = "cast(c AS int)"
    return f"aggregate(transform(reverse(split({digits}, '')), (c, i) -> if(i % 2 = {1 - doubled}, 2 * {d} - if({d} > 4, 9, 0), {d})), 0, (s, x) -> s + x)"


def pseudonym_sql(m: str, key: str) -> str:
    """SQL for a struct (kind, value) of the match m; kind is null if m fails its test."""
    is_kind = {k: f"{m} rlike {_sql('^(?:' + p + ')$')}" for k, p in KINDS.items()}
    ip_number = f"aggregate(split({m}, '\\\\.'), 0L, (n, c) -> n * 256 + cast(c AS bigint))"
    ip = _bound(_feistel(key, "'ip'", ip_number, "65536L", "65536L"), "y", "concat_ws('.', cast(y div 16777216 AS string), cast(y div 65536 % 256 AS string), cast(y div 256 % 256 AS string), cast(y % 256 AS string))")
    # layout and ISO spelling; of slash dates those that are none with the month first have the day first
    month_first = f"concat_ws('-', substring({m}, 7, 4), substring({m}, 1, 2), substring({m}, 4, 2))"
    day_first = f"concat_ws('-', substring({m}, 7, 4), substring({m}, 4, 2), substring({m}, 1, 2))"
    layout = f"CASE WHEN {m} LIKE '%-%' THEN 'yyyy-MM-dd' WHEN {m} LIKE '%.%' THEN 'dd.MM.yyyy' WHEN try_cast({month_first} AS date) IS NOT NULL THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END"
    iso = f"CASE WHEN {m} LIKE '%-%' THEN {m} WHEN {m} LIKE '%.%' THEN {day_first} WHEN try_cast({month_first} AS date) IS NOT NULL THEN {month_first} ELSE {day_first} END"
    day = f"cast(datediff(try_cast({iso} AS date), DATE'1800-01-01') AS bigint)"
    # 330 * 330 days from 1800: until 2098
    on = lambda x: f"date_add(DATE'1800-01-01', cast({x} AS int))"
    step = _feistel(key, "'date'", "w.x", "330L", "330L")
    late = f"aggregate(sequence(1, {WALK}), named_struct('x', {day}, 'n', 0), (w, i) -> if(w.n > 0 AND day({on('w.x')}) > 12, w, named_struct('x', {step}, 'n', 1)), w -> w.x)"
    once = _bound(f"named_struct('x', {day})", "w", step)
    permuted = on(f"if(l = 'dd/MM/yyyy', {late}, {once})")
    date = _bound(layout, "l", f"date_format({permuted}, l)")
    number = {"[0-9]": DIGITS}
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    body = _sequence(key, "card", f"substring({digits}, 1, char_length({digits}) - 1)", DIGITS)
    card = _placed(m, "[0-9]", _bound(body, "b", f"concat(b, cast((10 - {_luhn('b', 1)} % 10) % 10 AS string))"))
    local = f"substring_index({m}, '@', 1)"
    email = f"concat({_classes(key, 'email', local, {'[0-9]': DIGITS, '[a-z]': LOWER, '[A-Z]': UPPER})}, '@', substring_index({m}, '@', -1))"
    # country and French area codes stay: up to the first separator, or one digit (1, 7) or two where none follows
    prefix = f"regexp_extract({m}, '^([+]1[ .-]?(?=[(0-9]{{3}})|[+][0-9]{{1,3}}(?=[ .(-])|[+][17]|[+][0-9]{{2}}|0[1-9](?=(?:[ .-][0-9]{{2}}){{4}}$))?', 1)"
    phone = f"concat({prefix}, {_classes(key, 'phone', f'substring({m}, char_length({prefix}) + 1)', number)})"
    # areas from 001 to 899 but 666, groups from 01, serials from 0001
    rank = f"(cast(substring(d, 1, 3) AS bigint) - if(substring(d, 1, 3) > '666', 2, 1)) * 99 + cast(substring(d, 4, 2) AS bigint) - 1"
    ssn_number = _bound(digits, "d", f"({rank}) * 9999 + cast(substring(d, 6, 4) AS bigint) - 1")
    area = "cast(y div 989901 AS int) + 1"
    ssn = _bound(_feistel(key, "'ssn'", ssn_number, "88902L", "9999L"), "y", f"format_string('%03d-%02d-%04d', {area} + if({area} >= 666, 1, 0), cast(y div 9999 % 99 AS int) + 1, cast(y % 9999 AS int) + 1)")
    hexa = f"if({m} rlike '[A-F]', {_sequence(key, 'hex', m, HEX_UPPER)}, {_sequence(key, 'hex', m, HEX)})"
    found = lambda kind, value: f"named_struct('kind', '{kind}', 'value', {value})"
    return f"""CASE
        WHEN {is_kind["email"]} THEN {found("email", email)}
        WHEN {is_kind["ip"]} AND forall(split({m}, '\\\\.'), c -> cast(c AS int) <= 255) THEN {found("ip", ip)}
        WHEN {is_kind["date"]} AND {day} BETWEEN 0 AND 108899 THEN {found("date", date)}
        WHEN {is_kind["ssn"]} AND NOT {m} rlike '^(000|666|9)|-00-|-0000$' THEN {found("ssn", ssn)}
        WHEN {is_kind["phone"]} AND char_length({digits}) BETWEEN 8 AND 15 THEN {found("phone", phone)}
        WHEN {is_kind["hex"]} AND {m} rlike '[0-9]' THEN {found("hex", hexa)}
        WHEN {is_kind["card"]} AND {_luhn(digits, 0)} % 10 = 0 THEN {found("card", card)}
        ELSE named_struct('kind', cast(null AS string), 'value', {m}) END"""


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, text with pseudonyms, found: an array of (kind, pseudonym), in order."""
    every = _sql("|".join(KINDS.values()))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    # texts without a digit or an at sign hold no such value
    d = d.withColumn("m", F.expr(f"if(t rlike '[0-9@]', regexp_extract_all(t, {every}, 0), cast(array() AS array<string>))"))
    d = d.withColumn("p", F.expr(f"transform(coalesce(m, cast(array() AS array<string>)), m -> {pseudonym_sql('m', secret)})"))
    joined = f"array_join(transform(split(t, {every}, -1), (x, i) -> concat(x, coalesce(get(p, i).value, ''))), '')"
    return d.select(F.col("key").alias(key), F.expr(f"if(t IS NULL OR size(p) = 0, t, {joined})").alias("text"), F.expr("filter(p, x -> x.kind IS NOT NULL)").alias("found"))
