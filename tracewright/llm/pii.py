"""Operator 1: format-preserving Feistel pseudonyms for personal data in text.

Values are found by pattern, validated (checksums, calendar, number ranges) and
replaced by a keyed permutation of their own format, so equal values stay equal
in every document and the pseudonym passes the same validation (a phone marked by
``+1`` or parentheses may have any ten digits; bare groups of digits need an area
and an exchange of 200 to 999):

=======  ==========================================================  ======================
kind     validated by                                                kept
=======  ==========================================================  ======================
card     13 to 19 digits, Luhn                                       first digit, grouping, Luhn
ssn      area, group and serial ranges                               separators, ranges
phone    ``+1``, parentheses or North American ranges                prefix, punctuation, ranges
ip       four octets of 0 to 255                                     four octets
date     calendar days of 1800-01-01 to 2199-12-31, ISO form         form, calendar
email    mailbox and domain syntax                                   domain, character classes
secret   AKIA access key ids, ``password=``, ``token = "..."``       label, character classes
=======  ==========================================================  ======================

A number is cut into a pair (left, right) of a mixed-radix domain of a*b values;
a round adds a keyed hash of one half to the other modulo its radix, which is a
permutation of exactly the valid values. Texts of letters and digits get the
same network with a shift inside each character's class. The work is a map over
rows: one pattern scan, then higher-order functions over the values found, with
no exchange and no Python.

Defined results: a null text stays null with zero counts, an empty text stays
empty; what a pattern finds but validation rejects stays as it is; a row without
an id is treated like any other; repeated rows give repeated results. Only the id
and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "secret", "phone", "ssn", "card", "ip", "date")
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd)[ ]?[=:][ ]?[^\s\"']{6,}|\b(?:token|secret|api_key)[ ]?[=:][ ]?\"[^\s\"]{8,}\")",
    "phone": r"(?:(?<![\w+])\+1[ .-]?)?(?<![\w(])(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
}
#: Longer forms first where two could start at one place.
PATTERN = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "date", "ssn", "phone", "card", "ip"))
#: What every value holds: only an email and an access key id of letters need no digit, ``=`` or ``:``.
MAY_HOLD = r"[\d@=:]|AKIA"
_LONG = "long"


def _lit(n: int) -> Column:
    return F.lit(n).cast(_LONG)


def _feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str, inverse: bool) -> Column:
    """Struct (l, r) of the permuted pair; left is below a, right below b."""
    a = _lit(a) if isinstance(a, int) else a
    b = _lit(b) if isinstance(b, int) else b
    start = F.struct(left.cast(_LONG).alias("l"), right.cast(_LONG).alias("r"))
    sign = -1 if inverse else 1

    def turn(acc: Column, i: Column) -> Column:
        f = lambda half: F.xxhash64(F.lit(key), F.lit(kind), i, half)
        even = i % 2 == 0
        new_l = F.pmod(acc["l"] + sign * F.pmod(f(acc["r"]), a), a)
        new_r = F.pmod(acc["r"] + sign * F.pmod(f(acc["l"]), b), b)
        return F.struct(F.when(even, new_l).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(new_r).alias("r"))

    turns = F.sequence(_lit(ROUNDS - 1), _lit(0), _lit(-1)) if inverse else F.sequence(_lit(0), _lit(ROUNDS - 1))
    return F.aggregate(turns, start, turn)


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order by those of ``digits``."""
    return F.aggregate(
        F.split(template, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda acc, c: F.when(
            (c >= "0") & (c <= "9"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))),
        lambda acc: acc["s"],
    )


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _part(s: Column, at: Column | int, n: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(s, at, n)


def _shifted(s: Column, tweak: Column, turn: Column, key: str, sign: int) -> Column:
    """Each letter and digit of ``s`` moved inside its class by a keyed hash of ``tweak``."""

    def one(c: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(key), F.lit("text"), turn, i, tweak)
        code = F.ascii(c)
        move = lambda low, n: F.char((F.pmod(code - low + sign * F.pmod(h, F.lit(n)), F.lit(n)) + low).cast("int"))
        return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _text_feistel(s: Column, tweak: Column, key: str, inverse: bool) -> Column:
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(_part(s, 1, half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    sign = -1 if inverse else 1

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l2 = _shifted(acc["l"], F.concat(tweak, F.lit("|"), acc["r"]), i, key, sign)
        r2 = _shifted(acc["r"], F.concat(tweak, F.lit("|"), acc["l"]), i, key, sign)
        return F.struct(F.when(even, l2).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(r2).alias("r"))

    turns = F.sequence(_lit(3), _lit(0), _lit(-1)) if inverse else F.sequence(_lit(0), _lit(3))
    return F.aggregate(turns, start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _luhn_rest(body: Column) -> Column:
    """Luhn sum of ``body`` as it stands before a check digit, modulo 10."""

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["s"] + F.when(acc["k"] % 2 == 0, twice).otherwise(d)).alias("s"), (acc["k"] + 1).alias("k"))

    chars = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), add, lambda acc: acc["s"] % 10)


def _check_digit(body: Column) -> Column:
    return ((10 - _luhn_rest(body)) % 10).cast("string")


def _phone_rest(d: Column) -> Column:
    return F.right(d, F.lit(10))


def _in_ranges(r: Column) -> Column:
    """Whether area and exchange of ten digits are 200 to 999."""
    return (_part(r, 1, 1) >= "2") & (_part(r, 4, 1) >= "2")


def valid(kind: str, v: Column) -> Column:
    """Whether a value found by the pattern of ``kind`` is one."""
    d = _digits(v)
    if kind == "card":
        return F.length(d).between(13, 19) & (F.right(d, F.lit(1)) == _check_digit(_part(d, 1, F.length(d) - 1))) & (_part(d, 1, 1) != "0")
    if kind == "ssn":
        area, group, serial = (_part(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
        return area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    if kind == "phone":
        return v.startswith("+1") | v.startswith("(") | _in_ranges(_phone_rest(d))
    if kind == "ip":
        octets = F.split(v, r"\.")
        return F.forall(octets, lambda o: o.cast("int") <= 255) & F.forall(octets, lambda o: (F.length(o) == 1) | ~o.startswith("0"))
    if kind == "date":
        return F.try_to_date(v, "yyyy-MM-dd").isNotNull() & v.between("1800-01-01", "2199-12-31")
    return F.lit(True)


def pseudonym(kind: str, v: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a valid value of ``kind``; ``inverse`` gives the value back."""
    d = _digits(v)
    if kind == "card":
        n = F.length(d)
        k1 = F.floor((n - 2) / 2).cast("int")
        k2 = n - 2 - k1
        power = lambda k: F.pow(F.lit(10.0), k).cast(_LONG)
        p = _feistel(F.substring(d, F.lit(2), k1), F.substring(d, k1 + 2, k2), power(k1), power(k2), key, kind, inverse)
        body = F.concat(_part(d, 1, 1), _pad(p["l"], k1), _pad(p["r"], k2))
        return _refill(v, F.concat(body, _check_digit(body)))
    if kind == "ssn":
        area, group, serial = (_part(d, a, n).cast(_LONG) for a, n in ((1, 3), (4, 2), (6, 4)))
        place = area - 1 - F.when(area > 666, 1).otherwise(0)
        p = _feistel(place + 898 * (group - 1), serial - 1, 898 * 99, 9999, key, kind, inverse)
        place = p["l"] % 898
        area = place + 1 + F.when(place >= 665, 1).otherwise(0)
        return _refill(v, F.concat(_pad(area, 3), _pad(F.floor(p["l"] / 898) + 1, 2), _pad(p["r"] + 1, 4)))
    if kind == "phone":
        # numbers in the ranges and all others are permuted apart, so a number has one pseudonym in every form
        r = _phone_rest(d)
        area, exchange, inside = _part(r, 1, 3).cast(_LONG), _part(r, 4, 3).cast(_LONG), _in_ranges(r)
        other = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        left = F.when(inside, (area - 200) + 800 * (exchange - 200)).otherwise(other)
        p = _feistel(left, _part(r, 7, 4), F.when(inside, _lit(640_000)).otherwise(_lit(360_000)), 10_000, key, kind, inverse)
        low = p["l"] < 200_000
        area = F.when(inside, p["l"] % 800 + 200).when(low, F.floor(p["l"] / 1000)).otherwise(F.floor((p["l"] - 200_000) / 200) + 200)
        exchange = F.when(inside, F.floor(p["l"] / 800) + 200).when(low, p["l"] % 1000).otherwise((p["l"] - 200_000) % 200)
        return _refill(v, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _pad(area, 3), _pad(exchange, 3), _pad(p["r"], 4)))
    if kind == "ip":
        o = F.transform(F.split(v, r"\."), lambda x: x.cast(_LONG))
        p = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536, key, kind, inverse)
        two = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
        return F.concat(two(p["l"]), F.lit("."), two(p["r"]))
    if kind == "date":
        first = F.lit("1800-01-01").cast("date")
        day = F.datediff(F.try_to_date(v, "yyyy-MM-dd"), first)
        p = _feistel(F.floor(day / 773), day % 773, 189, 773, key, kind, inverse)  # 400 years have 189 * 773 days
        return F.date_format(F.date_add(first, (p["l"] * 773 + p["r"]).cast("int")), "yyyy-MM-dd")
    if kind == "email":
        at = F.instr(v, "@")
        host = F.substring(v, at, F.length(v))
        return F.concat(_text_feistel(F.substring(v, F.lit(1), at - 1), F.lower(host), key, inverse), host)
    label = F.regexp_extract(v, r"^(AKIA|[A-Za-z_]+[ ]?[=:][ ]?\"?)", 1)
    return F.concat(label, _text_feistel(F.substring(v, F.length(label) + 1, F.length(v)), F.lower(label), key, inverse))


def kind_of(v: Column) -> Column:
    """Kind of a value that ``PATTERN`` found, null if validation rejects it."""
    shape = F.when(v.contains("@") & v.rlike("^" + PATTERNS["email"] + "$"), "email").when(v.rlike(r"^[A-Za-z]"), "secret")
    shape = shape.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    shape = shape.when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(v.rlike(r"^(\+1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), "phone")
    shape = shape.otherwise("card")
    checked = F.lit(None).cast("string")
    for kind in KINDS:
        checked = F.when((shape == kind) & valid(kind, v), kind).otherwise(checked)
    return checked


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """(id, text, n_values, n_<kind> ...) of every row, with the values replaced.

    ``inverse`` restores the texts from their pseudonyms with the same key.
    """
    text = F.col("text")
    found = F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = d.withColumn("found", found)

    def swap(v: Column) -> Column:
        return F.transform(F.array(kind_of(v)), lambda k: F.struct(k.alias("kind"), _swapped(k, v, key, inverse).alias("new")))[0]

    d = d.withColumn("swapped", F.when(F.size("found") > 0, F.transform("found", swap)))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("swapped"), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s["new"], F.lit("")))), "")
    count = lambda kind: F.coalesce(F.size(F.filter("swapped", lambda s: s["kind"] == kind)), F.lit(0)).cast("int")
    counts = [F.when(F.col("swapped").isNull(), 0).otherwise(count(k)).cast("int").alias(f"n_{k}") for k in KINDS]
    out = d.select(F.col("id").alias(id_col), F.when(F.col("swapped").isNull(), text).otherwise(joined).alias(text_col), *counts)
    return out.withColumn("n_values", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).cast("int"))


def _swapped(kind: Column, v: Column, key: str, inverse: bool) -> Column:
    new = v
    for k in KINDS:
        new = F.when(kind == k, pseudonym(k, v, key, inverse)).otherwise(new)
    return new
