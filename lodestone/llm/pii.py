"""Operator 10 [native]: format-preserving pseudonyms of personal numbers, dates and addresses.

Each value found is checked first (check digits, ranges, the calendar) and then sent through a keyed Feistel network within
its format: a card number becomes another valid card number, a date another date, and letters and digits stay letters and
digits. The network is a permutation, so different values stay different, and equal ones stay equal in all documents.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
ROUNDS = 10
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_DAY = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Steps in the order of precedence: kind, where a value may begin, the longest that it may be there, and what the search
#: goes past before it looks for the next one.
_STEPS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])", r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}", ""),
    ("iban", _EDGE, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}" + _END, r"[A-Z]{2}[0-9]{2}[A-Z0-9]*+"),
    ("ip", _EDGE + r"(?<![0-9]\.)", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _END + r"(?!\.[0-9])", "[0-9]++"),
    ("date", _EDGE, _DAY + _END, "[0-9]++"),
    ("ssn", _EDGE, r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END, "[0-9]++"),
    ("phone", r"(?<![\p{L}\p{N}+])", r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + _END, "[+(0-9][0-9]*+"),
    ("card", _EDGE, _CARD + _END, "[0-9]++"),  # in the groups that cards are printed in
    ("card", _EDGE, _CARD + _END, "[0-9]++"),  # in any groups of three digits and more
)
#: Stand for values found while later kinds are searched: a noncharacter and one for the step; in a text it is doubled.
_MARK, _OWN = "﷐", "﷑"


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _number(seed: str) -> str:
    """60 bits of a keyed digest."""
    return f"cast(conv(substr(sha2({seed}, 256), 1, 15), 16, 10) AS BIGINT)"


def _shift(x: str, seed: str) -> str:
    """x with each ASCII letter and digit moved on within its class, each by a byte of the digest of seed."""
    byte = f"cast(conv(substr(sha2({seed}, 256), 1 + 2 * (p % 32), 2), 16, 10) AS INT)"
    move = lambda low, high, n: f"WHEN c BETWEEN '{low}' AND '{high}' THEN chr({ord(low)} + (ascii(c) - {ord(low)} + {byte}) % {n})"
    return f"array_join(transform(filter(split({x}, ''), c -> c <> ''), (c, p) -> CASE {move('0', '9', 10)} {move('a', 'z', 26)} {move('A', 'Z', 26)} ELSE c END), '')"


def _permute(x: str, key: str, kind: str) -> str:
    """Feistel over a string: the halves take turns, each moved by a digest of the other."""
    seed = lambda half: f"concat({key}, '|{kind}|', i, '|', {half})"
    step = f"IF(i % 2 = 0, named_struct('l', {_shift('h.l', seed('h.r'))}, 'r', h.r), named_struct('l', h.l, 'r', {_shift('h.r', seed('h.l'))}))"
    n = f"char_length({x}) div 2"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({x}, 1, cast({n} AS INT)), 'r', substr({x}, cast({n} AS INT) + 1)), (h, i) -> {step}, h -> concat(h.l, h.r))"


def _permute_number(x: str, a: int, b: int, key: str, kind: str, shown: str) -> str:
    """Feistel over the numbers below a * b as pairs of a residue of a and one of b; shown is SQL of the result, n."""
    seed = lambda half: f"concat({key}, '|{kind}|', i, '|', {half})"
    step = f"IF(i % 2 = 0, named_struct('l', (h.l + {_number(seed('h.r'))}) % {a}, 'r', h.r), named_struct('l', h.l, 'r', (h.r + {_number(seed('h.l'))}) % {b}))"
    start = f"named_struct('l', cast({x} AS BIGINT) div {b}, 'r', cast({x} AS BIGINT) % {b})"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (h, i) -> {step}, h -> {shown.replace('%n', f'(h.l * {b} + h.r)')})"


def _mod97(x: str) -> str:
    """An IBAN's number modulo 97, of its characters in the order that the check needs."""
    value = "CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE ascii(c) - 48 END"
    return f"aggregate(filter(split({x}, ''), c -> c <> ''), 0, (s, c) -> (s * IF(c BETWEEN 'A' AND 'Z', 100, 10) + {value}) % 97)"


def _in_place(form: str, values: str) -> str:
    """Puts the letters and digits of the second string, in order, where the first has letters or digits."""
    chars = f"filter(split({form}, ''), c -> c <> '')"
    step = f"named_struct('t', concat(s.t, IF(c RLIKE '[A-Z0-9]', substr({values}, s.k, 1), c)), 'k', s.k + IF(c RLIKE '[A-Z0-9]', 1, 0))"
    return f"aggregate({chars}, named_struct('t', '', 'k', 1), (s, c) -> {step}, s -> s.t)"


def _days(m: str) -> str:
    """Days from 1900-01-01 to a date; NULL if the calendar has no such day."""
    day = ", ".join(f"try_to_timestamp({m}, '{form}')" for form in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"))
    return f"datediff(cast(coalesce({day}) AS DATE), DATE'1900-01-01')"


def _octet(m: str, k: int) -> str:
    return f"cast(split({m}, '[.]')[{k}] AS INT)"


#: Days from 1900 to 2099: 17 * 4297.
_SPAN = (17, 4297)
_BARE = "replace({}, ' ', '')"


def _ends(valid: str) -> str:
    """The length of the longest beginning p of the candidate c that ends with a group and is valid; 0 if none is."""
    group = "filter(sequence(1, length(c)), e -> e = length(c) OR substr(c, e + 1, 1) IN (' ', '-', '.'))"
    return f"coalesce(array_max(filter({group}, e -> transform(array(substr(c, 1, e)), p -> {valid})[0])), 0)"


def _whole(valid: str) -> str:
    return f"IF({valid}, length(c), 0)"


_LUHN = f"length({_digits('p')}) BETWEEN 13 AND 19 AND luhn_check({_digits('p')})"
_PRINTED = r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: For each step, how much of the candidate c is a value, checked.
_CHECKS = (
    "length(c)",
    _ends(f"length({_BARE.format('p')}) >= 15 AND {_mod97(f"concat(substr({_BARE.format('p')}, 5), substr({_BARE.format('p')}, 1, 4))")} = 1"),
    _whole(" AND ".join(f"{_octet('c', k)} < 256" for k in range(4))),
    _whole(f"c RLIKE '[./].*[./]|-' AND c NOT RLIKE '[.].*/|/.*[.]' AND {_days('c')} BETWEEN 0 AND {_SPAN[0] * _SPAN[1] - 1}"),
    _whole("c NOT RLIKE '^(000|666|9)|-00-|-0000$'"),
    f"IF(c LIKE '+%', {_ends(f'length({_digits("p")}) BETWEEN 8 AND 15')}, length(c))",
    _ends(f"{_LUHN} AND p RLIKE {_sql(_PRINTED)}"),
    _ends(f"{_LUHN} AND p RLIKE '^[0-9]{{3,}}([ -][0-9]{{3,}})+$'"),
)


def _pseudonym(kind: str, key: str) -> str:
    """SQL of what takes the place of the value w.m; key is SQL, too."""
    m = "w.m"
    if kind == "email":
        return f"concat({_permute("lower(substring_index(w.m, '@', 1))", key, 'email')}, '@', substring_index(w.m, '@', -1))"
    if kind == "iban":
        account = _permute(f"substr({_BARE.format(m)}, 5)", key, "iban")
        checked = f"transform(array({account}), b -> concat(substr(w.m, 1, 2), lpad(98 - {_mod97("concat(b, substr(w.m, 1, 2), '00')")}, 2, '0'), b))[0]"
        return f"transform(array({checked}), v -> {_in_place(m, 'v')})[0]"
    if kind == "ip":
        octets = "concat_ws('.', shiftright(%n, 24), shiftright(%n, 16) & 255, shiftright(%n, 8) & 255, %n & 255)"
        return _permute_number(f"((({_octet(m, 0)} * 256L + {_octet(m, 1)}) * 256L + {_octet(m, 2)}) * 256L + {_octet(m, 3)})", 1 << 16, 1 << 16, key, "ip", octets)
    if kind == "date":
        return _permute_number(_days(m), *_SPAN, key, "date", "date_format(date_add(DATE'1900-01-01', cast(%n AS INT)), CASE WHEN w.m LIKE '____-%' THEN 'yyyy-MM-dd' WHEN w.m LIKE '%/%' THEN 'MM/dd/yyyy' ELSE 'dd.MM.yyyy' END)")
    if kind == "ssn":
        # areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999
        area = "cast(substr(w.m, 1, 3) AS INT)"
        number = f"((({area} - IF({area} > 666, 2, 1)) * 99 + cast(substr(w.m, 5, 2) AS BIGINT) - 1) * 9999 + cast(substr(w.m, 8, 4) AS BIGINT) - 1)"
        return _permute_number(number, 898 * 99, 9999, key, "ssn", "format_string('%03d-%02d-%04d', %n div 989901 + IF(%n div 989901 >= 665, 2, 1), %n div 9999 % 99 + 1, %n % 9999 + 1)")
    if kind == "phone":
        country, rest = (f"regexp_extract(w.m, r'^([+][0-9]{{1,3}}(?=[ .(-])|[+][0-9]|)(.*)$', {k})" for k in (1, 2))
        return f"concat({country}, transform(array({_permute(_digits(rest), key, 'phone')}), v -> {_in_place(rest, 'v')})[0])"
    # the check digit of a card stands last and is found anew
    number = _digits(m)
    body = f"transform(array({_permute(f'substr({number}, 1, length({number}) - 1)', key, 'card')}), b -> concat(b, filter(sequence(0, 9), d -> luhn_check(concat(b, d)))[0]))[0]"
    return f"transform(array({body}), v -> {_in_place(m, 'v')})[0]"


def _woven(parts: str, between: str) -> str:
    return f"array_join(flatten(zip_with({parts}, {between}, (a, b) -> array(a, coalesce(b, '')))), '')"


def _marked(text: str, pattern: str, check: str, mark: str) -> str:
    """SQL of a struct: t, the text with a mark for each value, and v, the values in order.

    A candidate may begin at each place where the pattern matches, whatever was found before it; of valid ones that overlap
    the first counts. Stretches are what lies between the beginnings of valid ones, so the work is linear in the text.
    """
    sizes = f"transform(regexp_extract_all({text}, {pattern}, 1), c -> {check})"
    flat = f"flatten(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (a, b) -> IF(b IS NULL, array(a), array(a, b))))"
    begin = "IF(k = 0, 0, 2 * x.at[k - 1] + 1)"
    stretches = f"transform(sequence(0, size(x.at)), k -> array_join(slice(x.flat, {begin} + 1, IF(k = size(x.at), size(x.flat), 2 * x.at[k] + 1) - {begin}), ''))"
    found = f"transform(array(named_struct('n', {sizes}, 'flat', {flat})), y -> named_struct('n', filter(y.n, z -> z > 0), 'at', filter(transform(y.n, (z, i) -> IF(z > 0, i, -1)), i -> i >= 0), 'flat', y.flat))[0]"
    cut = f"transform(array({found}), x -> named_struct('n', x.n, 's', {stretches}))[0]"
    # over is how much of a stretch the last value found covers; a value that begins below it is left out
    step = "named_struct('over', greatest(0, IF(acc.over > 0, acc.over, x.n[k - 1]) - length(x.s[k])), 'd', concat(acc.d, array(named_struct('own', acc.over = 0, 'skip', IF(acc.over > 0, acc.over, x.n[k - 1])))))"
    taken = f"aggregate(sequence(1, size(x.n)), named_struct('over', 0, 'd', cast(array() AS ARRAY<STRUCT<own: BOOLEAN, skip: INT>>)), (acc, k) -> {step}, acc -> acc.d)"
    shown = f"concat(x.s[0], array_join(transform(d, (q, k) -> concat(IF(q.own, '{mark}', ''), substr(x.s[k + 1], q.skip + 1))), ''))"
    # a value may reach beyond its stretch
    values = "transform(filter(transform(d, (q, k) -> named_struct('own', q.own, 'k', k + 1)), q -> q.own), q -> substr(array_join(slice(x.s, q.k + 1, 40), ''), 1, x.n[q.k - 1]))"
    return f"transform(array({cut}), x -> IF(size(x.n) = 0, named_struct('t', {text}, 'v', cast(array() AS ARRAY<STRING>)), transform(array({taken}), d -> named_struct('t', {shown}, 'v', {values}))[0]))[0]"


def _secret(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery over one row: so neither plans nor logs show it."""
    jvm = spark.sparkContext._jvm
    one = spark._jsparkSession.createDataset(jvm.java.util.Collections.singletonList(key), jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(one.toDF(), spark).scalar()


def pseudonyms(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with pseudonyms in the column text, and with counts a column n_<kind> with the count of each kind replaced.

    Kinds: email (the part before @, without regard to case), iban (check digits), ip (octets), date (yyyy-mm-dd,
    dd.mm.yyyy, mm/dd/yyyy, 1900 to 2099), ssn (ranges), phone (with + and 8 to 15 digits, or ten digits in groups), card
    (13 to 19 digits with a right check digit). A number with more groups behind or before it is found by its longest
    beginning that passes the check, cards first in the groups that they are printed in, then in groups of three and more. What fails its check stays as it
    is, and so do a null text (counts 0), an empty one, and all else in a text. Each row is taken by itself, repeated ones
    alike; an empty table stays empty; columns of docs that are named like a count are replaced. key is the secret.
    """
    if not key:
        raise ValueError("the key must not be empty")
    secret, now = fresh(docs, "_secret"), fresh(docs, "_text")
    out = docs.withColumn(secret, _secret(docs.sparkSession, key)).withColumn(now, F.replace(F.col(text), F.lit(_MARK), F.lit(_MARK + _OWN)))
    found = []
    for k, ((kind, edge, form, token), check) in enumerate(zip(_STEPS, _CHECKS, strict=True)):
        pattern = _sql(f"{edge}(?=({form})){token}" if token else f"{edge}({form})")
        step, mark = fresh(docs, f"_step{k}"), _MARK + chr(ord(_OWN) + 1 + k)
        guard = f"{now} RLIKE {pattern}" if kind != "email" else f"{now} LIKE '%@%'"
        out = out.withColumn(step, F.expr(f"IF({guard}, {_marked(now, pattern, check, mark)}, named_struct('t', {now}, 'v', cast(array() AS ARRAY<STRING>)))"))
        out = out.withColumn(now, F.expr(f"{step}.t"))
        found.append((kind, f"{step}.v", mark))
    for kind, values, mark in found:
        renamed = f"transform({values}, m -> transform(array(named_struct('m', m)), w -> {_pseudonym(kind, secret)})[0])"
        out = out.withColumn(now, F.expr(f"IF(size({values}) > 0, {_woven(f"split({now}, '{mark}', -1)", renamed)}, {now})"))
    whole = F.replace(F.col(now), F.lit(_MARK + _OWN), F.lit(_MARK))
    sums = {f"n_{k}": F.expr(" + ".join(f"cast(size({v}) AS BIGINT)" for kind, v, _ in found if kind == k)) for k in KINDS} if counts else {}
    sums = {k: F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(v) for k, v in sums.items()}
    return out.withColumns({text: whole, **sums}).drop(secret, now, *(fresh(docs, f"_step{k}") for k in range(len(_STEPS))))
