"""Format-preserving pseudonyms: validated numbers, dates and mail names are permuted by a keyed Feistel network.

A value maps to a pair (left, right) below a pair of bounds that its format fixes; eight rounds add keyed digests
of one half to the other, modulo its bound. That is a permutation of the format's values, so equal values stay equal
across documents, different ones stay different, and lengths do not change:

- payment cards (13 to 19 digits, Luhn-valid): first digit kept, last recomputed, the others permuted
- North American phone numbers: area, exchange and line; the country code is kept. Where +1, "1-", "1." or brackets mark
  the number, area and exchange are 000-999; else both are 200-999. Numbers with an area below 200, those with only an
  exchange below 200, and all others are permuted among themselves, so no two share a pseudonym
- other numbers in international form (+, 8 to 15 digits): the last six digits
- social security numbers: valid areas, groups and serials
- IPv4 addresses: all four octets; the text may get longer or shorter here alone
- dates (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy or mm/dd/yyyy; years 1600 to 9599): the day within its 400-year cycle
- mail addresses: letters and digits of the name; the domain is kept

What fits no format, or fails its validation, stays as it is. Everything is Spark SQL; no Python runs on executors.
Null texts stay null, empty ones empty. Rows are independent, so ties, repeats and empty tables need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
MARKED = r"(?<![0-9A-Za-z+(])(?:(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?|(?:\+1[ .-]?|1[.-])[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{7,14}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
PATTERN = "|".join((MAIL, IPV4, DATE, SSN, PHONE, MARKED, ABROAD, CARD))
ROUNDS = 8
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HALF = 12


def _number(c: Column) -> Column:
    return c.cast("bigint")


def _div(v: Column, by: Column) -> Column:
    """Whole quotient of numbers that are not negative, exact beyond 2 ** 53."""
    return ((v - F.pmod(v, by)).cast("decimal(20,0)") / by.cast("decimal(20,0)")).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: Column) -> Column:
    """struct(l, r): the pair permuted within [0, a) x [0, b)."""

    def digest(i: Column, x: Column, m: Column) -> Column:
        raw = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), x.cast("string")).cast("binary"), 256)
        return F.pmod(_number(F.conv(F.substring(raw, 1, 15), 16, 10)), m)

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s.l + digest(i, s.r, a), a).alias("l"), s.r.alias("r"))
        odd = F.struct(s.l.alias("l"), F.pmod(s.r + digest(i, s.l, b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_number(left).alias("l"), _number(right).alias("r")), step)


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _alphabet(c: Column) -> Column:
    out = F.lit(_CLASSES[0])
    for chars, pattern in ((_CLASSES[1], "[a-z]"), (_CLASSES[2], "[A-Z]")):
        out = F.when(c.rlike(pattern), chars).otherwise(out)
    return out


def _radix(c: Column) -> Column:
    return F.length(_alphabet(c)).cast("bigint")


def _value(chars: Column) -> Column:
    """struct(v, m): the characters as a mixed-radix number, and the number of such numbers."""
    one = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("m"))
    return F.aggregate(chars, one, lambda s, c: F.struct((s.v * _radix(c) + F.call_function("instr", _alphabet(c), c) - 1).cast("bigint").alias("v"), (s.m * _radix(c)).alias("m")))


def _spell(chars: Column, v: Column) -> Column:
    """The number as characters of the same classes."""
    start = F.struct(F.lit("").alias("t"), _number(v).alias("v"))
    step = lambda s, c: F.struct(F.concat(F.substring(_alphabet(c), (F.pmod(s.v, _radix(c)) + 1).cast("int"), F.lit(1)), s.t).alias("t"), _div(s.v, _radix(c)).alias("v"))
    return F.aggregate(F.reverse(chars), start, step, lambda s: s.t)


def permute_chars(text: Column, key: Column, tweak: str) -> Column:
    """Letters and digits permuted within their classes, in blocks of at most twice `_HALF` characters."""

    def block(chars: Column, k: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        left, right = F.slice(chars, F.lit(1), half), F.slice(chars, half + 1, F.size(chars) - half)

        def mapped(p: Column) -> Column:
            out = feistel(p.a.v, p.b.v, p.a.m, p.b.m, key, F.concat(F.lit(tweak + "/"), k.cast("string")))
            return _let(out, lambda o: F.concat(_spell(left, o.l), _spell(right, o.r)))

        return _let(F.struct(_value(left).alias("a"), _value(right).alias("b")), mapped)

    def all_blocks(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.floor((F.size(chars) - 1) / (2 * _HALF)), F.lit(0)).cast("int"))
        return F.array_join(F.transform(at, lambda k: block(F.slice(chars, k * (2 * _HALF) + 1, F.lit(2 * _HALF)), k)), "")

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(F.length(text) == 0, text).otherwise(_let(chars, all_blocks))


def refill(form: Column, chars: Column, pattern: str) -> Column:
    """`form` with its characters that match `pattern` replaced by those of `chars` in turn."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    put = lambda s, c: F.when(c.rlike(pattern), F.struct(F.concat(s.t, F.substring(chars, s.k, F.lit(1))).alias("t"), (s.k + 1).alias("k"))).otherwise(F.struct(F.concat(s.t, c).alias("t"), s.k.alias("k")))
    return F.aggregate(F.split(form, ""), start, put, lambda s: s.t)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that end with the check digit."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _pad(v: Column, n: int) -> Column:
    return F.lpad(v.cast("string"), n, "0")


def _card(m: Column, digits: Column, key: Column) -> Column:
    n = F.length(digits)

    def renewed(body: Column) -> Column:
        return refill(m, F.concat(body, F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")), "[0-9]")

    body = F.concat(F.substring(digits, 1, 1), permute_chars(F.substring(digits, F.lit(2), n - 2), key, "card"))
    return F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, _let(body, renewed)).otherwise(m)


def _phone(m: Column, digits: Column, key: Column) -> Column:
    own = F.substring(digits, F.length(digits) - 9, F.lit(10))
    area, rest = _number(F.substring(own, 1, 3)), _number(F.substring(own, 4, 7))
    low, low_exchange = area < 200, (area >= 200) & (rest < 2_000_000)
    area_from, areas = F.when(low, 0).otherwise(200), F.when(low, 200).otherwise(800)
    rest_from = F.when(low | low_exchange, 0).otherwise(2_000_000)
    rests = F.when(low, 10_000_000).when(low_exchange, 2_000_000).otherwise(8_000_000)
    out = feistel(area - area_from, rest - rest_from, areas, rests, key, F.lit("phone"))
    return _let(out, lambda o: refill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), _pad(o.l + area_from, 3), _pad(o.r + rest_from, 7)), "[0-9]"))


def _abroad(m: Column, digits: Column, key: Column) -> Column:
    n = F.length(digits)
    return F.concat(F.lit("+"), F.substring(digits, F.lit(1), n - 6), permute_chars(F.substring(digits, n - 5, F.lit(6)), key, "abroad"))


def _ssn(m: Column, digits: Column, key: Column) -> Column:
    area, group, serial = (_number(F.substring(digits, *x)) for x in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area < 666, 1).otherwise(2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    new = _let(out, lambda o: F.concat(_pad(o.l + F.when(o.l < 665, 1).otherwise(2), 3), F.lit("-"), _pad(_div(o.r, F.lit(9999)) + 1, 2), F.lit("-"), _pad(F.pmod(o.r, F.lit(9999)) + 1, 4)))
    return F.when(valid, new).otherwise(m)


def _ip(m: Column, key: Column) -> Column:
    o = [_number(F.element_at(F.split(m, r"\."), i)) for i in (1, 2, 3, 4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    text = lambda v: F.concat_ws(".", _div(v, F.lit(256)).cast("string"), F.pmod(v, F.lit(256)).cast("string"))
    return F.when(valid, _let(out, lambda r: F.concat_ws(".", text(r.l), text(r.r)))).otherwise(m)


def _date(m: Column, digits: Column, key: Column) -> Column:
    year_first = m.rlike("^[0-9]{4}")
    day_first = F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2)).try_cast("date")
    month_first = F.when(m.contains("/"), F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 1, 2), F.substring(digits, 3, 2)).try_cast("date"))
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date")
    seen = F.when(year_first, F.struct(iso.alias("d"), F.lit("yyyyMMdd").alias("f")))
    seen = seen.when(day_first.isNotNull(), F.struct(day_first.alias("d"), F.lit("ddMMyyyy").alias("f"))).otherwise(F.struct(month_first.alias("d"), F.lit("MMddyyyy").alias("f")))

    def moved(s: Column) -> Column:
        first = F.make_date(F.year(s.d) - F.pmod(F.year(s.d), F.lit(400)), F.lit(1), F.lit(1))
        k = F.date_diff(s.d, first).cast("bigint")
        out = feistel(_div(k, F.lit(773)), F.pmod(k, F.lit(773)), F.lit(189), F.lit(773), key, F.lit("date"))
        day = _let(out, lambda o: F.date_add(first, (o.l * 773 + o.r).cast("int")))
        y, mo, d = (lambda x: _pad(F.year(x), 4)), (lambda x: _pad(F.month(x), 2)), (lambda x: _pad(F.dayofmonth(x), 2))
        spelt = _let(day, lambda x: F.when(s.f == "yyyyMMdd", F.concat(y(x), mo(x), d(x))).when(s.f == "ddMMyyyy", F.concat(d(x), mo(x), y(x))).otherwise(F.concat(mo(x), d(x), y(x))))
        return F.when(F.year(s.d).between(1600, 9599), _let(spelt, lambda t: refill(m, t, "[0-9]"))).otherwise(m)

    return F.coalesce(_let(seen, moved), m)


def _mail(m: Column, key: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    own = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    return F.concat(_let(permute_chars(own, key, "mail"), lambda t: refill(name, t, "[A-Za-z0-9]")), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match of PATTERN."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _mail(m, key))
        .when(whole(IPV4), _ip(m, key))
        .when(whole(DATE), _date(m, digits, key))
        .when(whole(SSN), _ssn(m, digits, key))
        .when(whole(f"{PHONE}|{MARKED}"), _phone(m, digits, key))
        .when(whole(ABROAD), _abroad(m, digits, key))
        .otherwise(_card(m, digits, key))
    )


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """`docs` with private values replaced in `text_col`; with `found_col`, also how many were replaced."""
    text, secret = F.col(text_col), F.lit(key)
    may = text.rlike("[0-9@]")
    matches, renamed = fresh(docs, "matches"), fresh(docs, "renamed")
    out = docs.withColumn(matches, F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    some = F.size(matches) > 0
    out = out.withColumn(renamed, F.when(some, F.transform(F.col(matches), lambda m: pseudonym(m, secret))))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col(renamed), lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    out = out.withColumn(text_col, F.when(some, joined).otherwise(text))
    if found_col:
        changed = F.size(F.filter(F.zip_with(F.col(matches), F.col(renamed), lambda a, b: a != b), lambda x: x))
        out = out.withColumn(found_col, F.when(some, changed).otherwise(0).cast("long"))
    return out.drop(matches, renamed)
