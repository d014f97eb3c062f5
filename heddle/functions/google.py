"""GoogleSQL scalar functions as Column expressions, where Spark's own differ in name or meaning.

All of them stay in the JVM. Arguments are Columns; constants may be plain values where a function says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# numbers

_LEAST, _MOST = -(2**63), 2**63 - 1


def to_int64(x: Column) -> Column:
    """CAST(FLOAT64 AS INT64): halves go away from zero, where Spark cuts off."""
    return F.round(x, 0).cast("long")


def div(a: Column, b: Column) -> Column:
    """Whole quotient of 64-bit integers, cut off towards zero; a zero divisor is an error."""
    a, b = a.cast("long"), b.cast("long")
    return F.try_divide((a - a % b).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("long")


def ieee_divide(a: Column, b: Column) -> Column:
    """Division that gives infinities and NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_add(a: Column, b: Column) -> Column:
    """Sum of 64-bit integers, NULL where it overflows. It's looked up beforehand: try_add throws and catches an exception in each such row."""
    a, b = a.cast("long"), b.cast("long")
    return F.when(F.when(b > 0, a <= F.lit(_MOST) - b).otherwise(a >= F.lit(_LEAST) - b), a + b)


def safe_subtract(a: Column, b: Column) -> Column:
    """Difference of 64-bit integers, NULL where it overflows, as in safe_add."""
    a, b = a.cast("long"), b.cast("long")
    return F.when(F.when(b > 0, a >= F.lit(_LEAST) + b).otherwise(a <= F.lit(_MOST) + b), a - b)


def safe_multiply(a: Column, b: Column) -> Column:
    """Product of 64-bit integers, NULL where it overflows, as in safe_add: whole quotients of the limits bound the other factor."""
    a, b = a.cast("long"), b.cast("long")
    least, most = (F.call_function("div", F.lit(x), b) for x in (_LEAST, _MOST))
    return F.when(F.when(b > 0, a.between(least, most)).when(b < -1, a.between(most, least)).when(b == -1, a > _LEAST).otherwise(b == 0), a * b)


def safe_negate(x: Column) -> Column:
    return F.try_subtract(F.lit(0).cast("long"), x)


def greatest(*xs: Column) -> Column:
    """NULL if any argument is, NaN if any is NaN: Spark passes over nulls."""
    return F.when(reduce(lambda a, b: a | b, (x.isNull() for x in xs)), None).otherwise(F.greatest(*xs))


def least(*xs: Column) -> Column:
    """NULL if any argument is, NaN if any is NaN: for Spark NaN is the largest number."""
    low, high = F.least(*xs), F.greatest(*xs)
    return F.when(reduce(lambda a, b: a | b, (x.isNull() for x in xs)), None).when(F.isnan(high.cast("double")), high).otherwise(low)


def least_text(*xs: Column) -> Column:
    """LEAST of values that aren't numbers."""
    return F.when(reduce(lambda a, b: a | b, (x.isNull() for x in xs)), None).otherwise(F.least(*xs))


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero; numbers that are too large to have such digits, infinities and NaN stay."""
    x, scale = x.cast("double"), F.lit(10.0**digits)
    cut = F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)).cast("double") / scale
    return F.when((F.abs(x * scale) >= 2.0**53) | F.isnan(x), x).otherwise(cut)


def _domain(name: str, good: Column, value: Column) -> Column:
    """value where good, NULL for NULL, else GoogleSQL's error."""
    return F.when(good, value).when(~good, F.raise_error(F.lit(f"argument of {name} is outside its domain")).cast("double"))


def acos(x: Column) -> Column:
    return _domain("ACOS", (F.abs(x) <= 1) | F.isnan(x), F.acos(x))


def asin(x: Column) -> Column:
    return _domain("ASIN", (F.abs(x) <= 1) | F.isnan(x), F.asin(x))


def acosh(x: Column) -> Column:
    return _domain("ACOSH", x >= 1, F.acosh(x))


def asinh(x: Column) -> Column:
    return F.asinh(x)


def atanh(x: Column) -> Column:
    return _domain("ATANH", (F.abs(x) < 1) | F.isnan(x), F.atanh(x))


def ln(x: Column) -> Column:
    return _domain("LN", x > 0, F.ln(x))


def sqrt(x: Column) -> Column:
    return _domain("SQRT", (x >= 0) | F.isnan(x), F.sqrt(x))


def corr(x: Column, y: Column) -> Column:
    """The aggregate CORR: NaN, not an error, where one side is constant; NULL without two pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) < 2, None).when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread))


def is_inf(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def is_nan(x: Column) -> Column:
    """NULL for NULL: Spark's isnan says false."""
    return F.when(x.isNotNull(), F.isnan(x))


def range_bucket(point: Column, bounds: Column) -> Column:
    """How many bounds are at most the point."""
    return F.when(point.isNotNull(), F.size(F.filter(bounds, lambda b: b <= point))).cast("long")


def shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n) if n < 64 else F.when(x.isNotNull(), F.lit(0).cast("long"))


def shift_right(x: Column, n: int) -> Column:
    """Logical, and 0 from 64 on: Spark counts modulo 64."""
    return F.shiftrightunsigned(x, n) if n < 64 else F.when(x.isNotNull(), F.lit(0).cast("long"))


def equal(a: Column, b: Column) -> Column:
    """FLOAT64 equality: NaN equals nothing, itself included."""
    return F.when(a.isNull() | b.isNull(), None).otherwise((a == b) & ~F.isnan(a) & ~F.isnan(b))


def cot(x: Column) -> Column:
    return F.cot(x)


def coth(x: Column) -> Column:
    return F.lit(1.0) / F.tanh(x)


def csch(x: Column) -> Column:
    return F.lit(1.0) / F.sinh(x)


def sech(x: Column) -> Column:
    return F.lit(1.0) / F.cosh(x)


# strings


def split(s: Column, by: str = ",") -> Column:
    """Splits at a literal text; Spark's split takes a pattern. An empty text splits into one empty text."""
    if by == "":
        return F.when(s == "", F.array(F.lit(""))).otherwise(F.split(s, ""))
    return F.split(s, "\\Q" + by.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def substr(s: Column, at: int, n: int | None = None) -> Column:
    """1-based; a negative place counts from the end and stops at the beginning, 0 is 1."""
    size = F.length(s)
    start = F.lit(max(at, 1)) if at >= 0 else F.greatest(size + at + 1, F.lit(1))
    return F.substring(s, start, size if n is None else F.lit(n))


def initcap(s: Column, delimiters: str = " \t\r\n") -> Column:
    """Upper-cases each first letter after a delimiter and lower-cases the others."""
    letters = F.split(F.lower(s), "")
    marks = F.lit(delimiters)
    cased = F.transform(letters, lambda c, i: F.when((i == 0) | F.contains(marks, F.get(letters, i - 1)), F.upper(c)).otherwise(c))
    return F.when(s == "", s).otherwise(F.array_join(cased, ""))


def instr(s: Column, part: Column, position: int = 1, occurrence: int = 1) -> Column:
    """Where the nth occurrence from a position on begins, 0 if there is none; occurrences may overlap."""
    at = F.lit(position - 1)
    for _ in range(occurrence):
        found = F.position(part, s, at + 1)
        at = F.when(at < 0, F.lit(-1)).when(found > 0, found).otherwise(F.lit(-1))
    return F.when(s.isNull() | part.isNull(), None).otherwise(F.when(at > 0, at).otherwise(F.lit(0))).cast("long")


def starts_with(s: Column, part: Column) -> Column:
    return F.startswith(s, part)


def contains_substr(s: Column, part: str) -> Column:
    return F.contains(F.lower(s), F.lit(part.lower()))


def to_hex(b: Column) -> Column:
    """Lower case, where Spark's hex is upper."""
    return F.lower(F.hex(b))


def code_points(s: Column) -> Column:
    """TO_CODE_POINTS: from the UTF-32 bytes."""
    raw = F.hex(F.encode(s, "UTF-32"))
    return F.when(s == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.length(s) - 1), lambda i: F.conv(F.substring(raw, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    )


def from_code_points(a: Column) -> Column:
    """CODE_POINTS_TO_STRING: NULL if any code point is."""
    raw = F.array_join(F.transform(a, lambda c: F.lpad(F.hex(c), 8, "0")), "")
    return F.when(F.exists(a, lambda c: c.isNull()), None).otherwise(F.decode(F.unhex(raw), "UTF-32"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def to_base32(b: Column) -> Column:
    """Five bits a character, padded with = to eight."""
    bits = F.array_join(F.transform(F.split(F.hex(b), ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    n = F.octet_length(b)
    chars = F.ceil(n * 8 / 5).cast("int")
    padded = F.rpad(bits, (chars * 5), "0")
    out = F.transform(F.sequence(F.lit(0), chars - 1), lambda i: F.substring(F.lit(_BASE32), F.conv(F.substring(padded, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(n == 0, F.lit("")).otherwise(F.rpad(F.array_join(out, ""), (F.ceil(n / 5) * 8).cast("int"), "="))


def from_base32(s: Column) -> Column:
    """The bytes of whole groups of eight bits; padding is passed over."""
    bare = F.rtrim(s, F.lit("="))
    bits = F.array_join(F.transform(F.split(bare, ""), lambda c: F.lpad(F.conv((F.position(c, F.lit(_BASE32)) - 1).cast("string"), 10, 2), 5, "0")), "")
    n = F.floor(F.length(bare) * 5 / 8).cast("int")
    hexed = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(s.isNull(), None).when(n == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(hexed, "")))


def from_hex(s: Column) -> Column:
    """An odd number of digits gets a leading zero; other characters are an error."""
    bad = ~F.rlike(s, F.lit("^[0-9a-fA-F]*$"))
    return F.when(bad, F.raise_error(F.lit("no hexadecimal digits")).cast("binary")).otherwise(F.unhex(s))


def chr_(c: Column) -> Column:
    """CHR: the character of any code point; 0 gives an empty text, NULL NULL."""
    return F.when(c == 0, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32"))


def unicode(s: Column) -> Column:
    """The first code point, 0 for an empty text."""
    return F.when(s == "", F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.encode(F.left(s, F.lit(1)), "UTF-32")), 16, 10).cast("long"))


def code_points_to_bytes(a: Column) -> Column:
    """Numbers from 0 to 255 as bytes; NULL if any is, an error for others."""
    bad = F.exists(a, lambda c: (c < 0) | (c > 255))
    joined = F.unhex(F.array_join(F.transform(a, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return F.when(F.exists(a, lambda c: c.isNull()), None).when(bad, F.raise_error(F.lit("no byte")).cast("binary")).otherwise(joined)


def safe_convert_bytes_to_string(b: Column) -> Column:
    """What isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def trim(s: Column, chars: str = " \t\r\n\x0b\x0c") -> Column:
    return F.btrim(s, F.lit(chars))


def regexp_extract(s: Column, pattern: str, position: int = 1, occurrence: int = 1) -> Column:
    """The nth match from a position on, or its group if the pattern has one; NULL where there is none."""
    import re

    groups = re.compile(pattern).groups
    found = F.regexp_extract_all(F.substring(s, position, 2**31 - 1), F.lit(pattern), F.lit(1 if groups else 0))
    return F.get(found, F.lit(occurrence - 1))


def regexp_instr(s: Column, pattern: str, position: int = 1, occurrence: int = 1) -> Column:
    """Where the nth match from a position on begins, 0 if there is none: the pieces before it are as long as what precedes it."""
    tail = F.substring(s, position, 2**31 - 1)
    found, pieces = F.regexp_extract_all(tail, F.lit(pattern), F.lit(0)), F.split(tail, pattern, occurrence + 1)
    before = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda t, x: t + F.length(x))
    at = before(pieces, occurrence) + before(found, occurrence - 1) + position if occurrence > 1 else before(pieces, 1) + position
    return F.when(s.isNull(), None).when(F.size(found) >= occurrence, at).otherwise(0).cast("long")


def regexp_replace(s: Column, pattern: str, replacement: str) -> Column:
    """Groups are \\1 to \\9 in the replacement, as in RE2; a dollar sign is itself."""
    import re

    return F.regexp_replace(s, F.lit(pattern), F.lit(re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))))


def if_error(x: Column, otherwise: Column) -> Column:
    """IFERROR for an expression that has a form giving NULL in place of its errors (a try_ function)."""
    return F.coalesce(x, otherwise)


def array_to_string(a: Column, by: str, null_text: str | None = None) -> Column:
    return F.array_join(a, by) if null_text is None else F.array_join(a, by, null_text)


# arrays


def array_slice(a: Column, first: int, last: int) -> Column:
    """0-based and inclusive; negative places count from the end; what lies outside is cut off."""
    n = F.size(a)
    lo = F.lit(first) if first >= 0 else F.greatest(n + first, F.lit(0))
    hi = F.least(F.lit(last), n - 1) if last >= 0 else n + last
    return F.when(a.isNotNull(), F.slice(a, lo + 1, F.greatest(hi - lo + 1, F.lit(0))))


def array_first(a: Column) -> Column:
    """An empty array is an error."""
    return F.when(F.size(a) == 0, F.raise_error(F.lit("the array is empty"))).otherwise(F.get(a, F.lit(0)))


def array_last(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.raise_error(F.lit("the array is empty"))).otherwise(F.get(a, F.size(a) - 1))


def subscript(a: Column, at: int, from_one: bool = False, safe: bool = False) -> Column:
    """a[OFFSET(at)], or ORDINAL with from_one; outside the array an error, NULL if safe."""
    i = F.lit(at - from_one)
    inside = (i >= 0) & (i < F.size(a))
    out = F.when(inside, F.get(a, F.greatest(i, F.lit(0))))
    return out if safe else out.when(~inside, F.raise_error(F.lit("no such element")))


def array_is_distinct(a: Column) -> Column:
    return F.size(a) == F.size(F.array_distinct(a))


def generate_array(start: Column, end: Column, step: int = 1) -> Column:
    """Empty, not an error, where the step leads away from the end."""
    away = (end < start) if step > 0 else (end > start)
    safe_end = F.when(away, start).otherwise(end)
    return F.when(away, F.array().cast("array<bigint>")).otherwise(F.sequence(start, safe_end, F.lit(step).cast("long")))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """A vector of length zero has no direction: an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.raise_error(F.lit("cosine distance of a zero vector")).cast("double")).otherwise(F.lit(1.0) - F.try_divide(dot, size))


# dates and times

_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def date_diff(a: Column, b: Column, part: str) -> Column:
    """Boundaries of the part between b and a; weeks begin on Sunday, ISOWEEK on Monday."""
    part = part.upper()
    if part == "DAY":
        return F.datediff(a, b).cast("long")
    if part in ("WEEK", "ISOWEEK"):
        shift = 3 if part == "ISOWEEK" else 4  # day 0 was a Thursday
        weeks = lambda d: F.floor((F.unix_date(d) + shift) / 7)
        return (weeks(a) - weeks(b)).cast("long")
    index = lambda d: F.floor((F.year(d) * 12 + F.month(d) - 1) / _MONTHS[part])
    return (index(a) - index(b)).cast("long")


def date_add(d: Column, n: int, part: str) -> Column:
    part = part.upper()
    if part in _MONTHS:
        return F.add_months(d, n * _MONTHS[part])
    return F.date_add(d, n * (7 if part == "WEEK" else 1))


def date_trunc(d: Column, part: str) -> Column:
    part = part.upper()
    if part == "WEEK":  # back to Sunday
        return F.date_sub(d, (F.dayofweek(d) - 1).cast("int"))
    return F.trunc(d, {"ISOWEEK": "week"}.get(part, part.lower()))


def timestamp_diff(a: Column, b: Column, part: str) -> Column:
    """Whole units between two timestamps, cut off towards zero."""
    micros = {"MICROSECOND": 1, "MILLISECOND": 10**3, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}[part.upper()]
    diff = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return F.when(diff >= 0, F.floor(diff / micros)).otherwise(F.ceil(diff / micros)).cast("long") if micros > 1 else diff


def bucket(ts: Column, seconds: int) -> Column:
    """TIMESTAMP_BUCKET with an interval of seconds, aligned to the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def year_is(d: Column, year: int) -> Column:
    """EXTRACT(YEAR FROM d) = year as a range, which reaches the scan and prunes files and partitions."""
    return (d >= F.lit(f"{year}-01-01").cast("date")) & (d < F.lit(f"{year + 1}-01-01").cast("date"))


# errors


def error(message: str) -> Column:
    return F.raise_error(F.lit(message))


def safe_cast(x: Column, kind: str) -> Column:
    return x.try_cast(kind)
