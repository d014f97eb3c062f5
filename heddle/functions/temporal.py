"""GoogleSQL's dates, times and intervals: %-formats, parts, truncation, arithmetic and intervals' justification.

DATE is Spark's date, DATETIME timestamp_ntz, TIMESTAMP timestamp. A TIME is its microseconds since midnight, an INTERVAL that mixes
months, days and time a struct of months, days and micros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"MICROSECOND": 1, "MILLISECOND": 10**3, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
DAY = MICROS["DAY"]
_WEEKDAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")
_COMPOUND = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "x": "%m/%d/%y", "X": "%H:%M:%S", "c": "%a %b %e %H:%M:%S %Y", "h": "%b", "r": "%I:%M:%S %p"}
_PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a"}


def _pieces(text: str) -> list[str]:
    """A format's % codes (E4Y and E3S among them) and the texts between them."""
    out, i = [], 0
    while i < len(text):
        if text[i] != "%" or i + 1 == len(text):
            out.append(text[i])
            i += 1
            continue
        n = 1
        if text[i + 1] == "E":
            n = 3 if i + 3 < len(text) else 2
        code = text[i + 1 : i + 1 + n]
        out += _pieces(_COMPOUND[code]) if code in _COMPOUND else ["%" + code]
        i += 1 + n
    return out


def _week_start(d: Column, first: int) -> Column:
    """The last day on or before d that is the weekday first (0: Sunday)."""
    return F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - first, F.lit(7)).cast("int"))


def week_number(d: Column, first: int = 0) -> Column:
    """WEEK(first): 0 before the year's first such weekday."""
    january = F.trunc(d, "year")
    return F.floor((F.datediff(_week_start(d, first), january) + 7) / 7).cast("long")


def iso_year(d: Column) -> Column:
    return F.year(F.date_add(_week_start(d, 1), 3)).cast("long")


def format_datetime(t: Column, text: str) -> Column:
    """FORMAT_DATE, FORMAT_DATETIME and FORMAT_TIMESTAMP (in UTC): t is a date or timestamp, text has % codes."""
    d = t.cast("date")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    special = {
        "%%": F.lit("%"), "%e": F.lpad(F.dayofmonth(d).cast("string"), 2, " "), "%Q": F.quarter(d).cast("string"), "%u": (F.weekday(d) + 1).cast("string"), "%w": (F.dayofweek(d) - 1).cast("string"),
        "%G": F.lpad(iso_year(d).cast("string"), 4, "0"), "%V": two(F.weekofyear(d)), "%U": two(week_number(d)), "%W": two(week_number(d, 1)), "%C": two(F.floor(F.year(d) / 100)), "%s": F.unix_seconds(t.cast("timestamp")).cast("string"),
        "%k": F.lpad(F.hour(t).cast("string"), 2, " "), "%l": F.lpad(F.date_format(t, "h"), 2, " "), "%n": F.lit("\n"), "%t": F.lit("\t"), "%P": F.lower(F.date_format(t, "a")), "%Z": F.lit("UTC"), "%z": F.lit("+0000"), "%Ez": F.lit("+00:00"),
        "%E4Y": F.date_format(t, "yyyy"), "%E3S": F.date_format(t, "ss.SSS"), "%E6S": F.date_format(t, "ss.SSSSSS"),
    }
    out: list[Column] = []
    for p in _pieces(text):
        if p in special:
            out.append(special[p])
        elif p[0] == "%" and p[1:] in _PATTERNS:
            out.append(F.date_format(t, _PATTERNS[p[1:]]))
        elif len(p) > 1:
            raise ValueError(f"unknown format element {p}")
        else:
            out.append(F.lit(p))
    return F.concat(*out) if out else F.lit("")


def parse_datetime(s: Column, text: str) -> Column:
    """PARSE_DATETIME: a text that doesn't fit is an error. Missing parts are those of 1970-01-01 00:00:00."""
    pattern = ""
    for p in _pieces(text):
        code = {"e": "d", "E4Y": "yyyy", "%": "%"}.get(p[1:], _PATTERNS.get(p[1:])) if len(p) > 1 else None
        if len(p) > 1 and code is None:
            raise ValueError(f"unknown format element {p}")
        if code:
            pattern += code
        elif p == "'":
            pattern += "''"
        elif p.isalpha() and pattern.endswith("'") and not pattern.endswith("''"):  # the text goes on
            pattern = pattern[:-1] + p + "'"
        else:
            pattern += f"'{p}'" if p.isalpha() else p
    return F.to_timestamp(s, pattern).cast("timestamp_ntz")


def parse_date(s: Column, text: str) -> Column:
    return parse_datetime(s, text).cast("date")


def extract(t: Column, part: str) -> Column:
    """EXTRACT(part FROM t), DAYOFWEEK from 1 on Sunday, WEEK and WEEK(day), ISOWEEK, ISOYEAR, and parts of the time of day."""
    part, d = part.upper(), t.cast("date")
    if part.startswith("WEEK("):
        return week_number(d, _WEEKDAYS.index(part[5:-1]))
    micros = lambda: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(10**6))
    found = {
        "YEAR": lambda: F.year(d), "QUARTER": lambda: F.quarter(d), "MONTH": lambda: F.month(d), "DAY": lambda: F.dayofmonth(d), "DAYOFWEEK": lambda: F.dayofweek(d), "DAYOFYEAR": lambda: F.dayofyear(d), "WEEK": lambda: week_number(d), "ISOWEEK": lambda: F.weekofyear(d), "ISOYEAR": lambda: iso_year(d),
        "HOUR": lambda: F.hour(t), "MINUTE": lambda: F.minute(t), "SECOND": lambda: F.second(t), "MILLISECOND": lambda: F.floor(micros() / 1000), "MICROSECOND": micros,
    }
    return found[part]().cast("long")


def trunc(t: Column, part: str, kind: str) -> Column:
    """DATE_TRUNC, DATETIME_TRUNC, TIMESTAMP_TRUNC: kind is the result's type."""
    part, d = part.upper(), t.cast("date")
    if part in ("WEEK", "ISOWEEK") or part.startswith("WEEK("):
        return _week_start(d, 1 if part == "ISOWEEK" else 0 if part == "WEEK" else _WEEKDAYS.index(part[5:-1])).cast(kind)
    if part == "ISOYEAR":
        return _week_start(F.make_date(iso_year(d).cast("int"), F.lit(1), F.lit(4)), 1).cast(kind)
    return (F.trunc(d, part) if part in MONTHS else F.date_trunc(part, t)).cast(kind)


def add(t: Column, n: Column, part: str, kind: str) -> Column:
    """DATE_ADD and its kin; months are cut to the month's last day. Subtract by adding -n."""
    part = part.upper()
    if part in MONTHS:
        moved = F.add_months(t.cast("date"), (n * MONTHS[part]).cast("int"))
        if kind == "date":
            return moved
        t = t.cast("timestamp")
        clock = F.unix_micros(t) - F.unix_micros(t.cast("date").cast("timestamp"))
        return F.timestamp_micros(F.unix_micros(moved.cast("timestamp")) + clock).cast(kind)
    if kind == "date":
        return F.date_add(t, (n * (7 if part == "WEEK" else 1)).cast("int"))
    return F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + n.cast("long") * (7 * DAY if part == "WEEK" else MICROS[part])).cast(kind)


def diff(a: Column, b: Column, part: str) -> Column:
    """DATETIME_DIFF: boundaries of the part between b and a, negative if a is earlier."""
    part = part.upper()
    if part in MONTHS or part == "ISOYEAR":
        month = lambda t: iso_year(t.cast("date")) if part == "ISOYEAR" else F.floor((F.year(t) * 12 + F.month(t) - 1) / MONTHS[part])
        return (month(a) - month(b)).cast("long")
    if part == "ISOWEEK" or part.startswith("WEEK"):
        first = 1 if part == "ISOWEEK" else 0 if part == "WEEK" else _WEEKDAYS.index(part[5:-1])
        return F.floor(F.datediff(_week_start(a.cast("date"), first), _week_start(b.cast("date"), first)) / 7).cast("long")
    count = lambda t: F.floor((F.unix_micros(t.cast("timestamp")) - F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(MICROS[part]))) / MICROS[part])
    return (count(a) - count(b)).cast("long")


def last_day(d: Column, part: str = "MONTH") -> Column:
    """LAST_DAY of the month, quarter, year, week, WEEK(day), ISOWEEK or ISOYEAR."""
    part, d = part.upper(), d.cast("date")
    if part in MONTHS:
        return F.date_sub(F.add_months(F.trunc(d, part), MONTHS[part]), 1)
    if part == "ISOYEAR":
        return F.date_sub(_week_start(F.make_date((iso_year(d) + 1).cast("int"), F.lit(1), F.lit(4)), 1), 1)
    return F.date_add(trunc(d, part, "date"), 6)


def generate_dates(start: Column, end: Column, n: int = 1, part: str = "DAY") -> Column:
    """GENERATE_DATE_ARRAY: empty where the step leads away from the end; months count from the start, so ends of months don't drift."""
    step = MONTHS.get(part.upper())
    if step is None:
        days = n * (7 if part.upper() == "WEEK" else 1)
        away = (end < start) if days > 0 else (end > start)
        return F.when(start.isNull() | end.isNull(), None).when(away, F.array().cast("array<date>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.datediff(F.when(away, start).otherwise(end), start) / days).cast("int")), lambda i: F.date_add(start, i * days)))
    span = F.abs(F.months_between(end, start)).cast("int") + 1
    steps = F.transform(F.sequence(F.lit(0), F.floor(span / abs(n * step)).cast("int") + 1), lambda i: F.add_months(start, i * (n * step)))
    return F.when(start.isNull() | end.isNull(), None).otherwise(F.filter(steps, lambda d: (d <= end) if n > 0 else (d >= end)))


def generate_timestamps(start: Column, end: Column, n: int, part: str) -> Column:
    step = n * MICROS[part.upper()]
    a, b = F.unix_micros(start.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    away = (b < a) if step > 0 else (b > a)
    return F.when(a.isNull() | b.isNull(), None).when(away, F.array().cast("array<timestamp>")).otherwise(F.transform(F.sequence(a, F.when(away, a).otherwise(b), F.lit(step).cast("long")), lambda x: F.timestamp_micros(x)))


# TIME


def time(h: Column, m: Column, s: Column) -> Column:
    bad = (h < 0) | (h > 23) | (m < 0) | (m > 59) | (s < 0) | (s > 59)
    return F.when(bad, F.raise_error(F.lit("no such time")).cast("long")).otherwise((h.cast("long") * 3600 + m * 60 + s) * 10**6)


def time_of(t: Column) -> Column:
    return F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(DAY))


def time_add(t: Column, n: Column, part: str) -> Column:
    """Wraps around midnight."""
    return F.pmod(t + n.cast("long") * MICROS[part.upper()], F.lit(DAY))


def time_diff(a: Column, b: Column, part: str) -> Column:
    unit = MICROS[part.upper()]
    return (F.floor(a / unit) - F.floor(b / unit)).cast("long")


def time_trunc(t: Column, part: str) -> Column:
    return t - F.pmod(t, F.lit(MICROS[part.upper()]))


def format_time(t: Column, text: str = "%H:%M:%S") -> Column:
    return format_datetime(F.timestamp_micros(t).cast("timestamp_ntz"), text)


# INTERVAL


def make_interval(year: Column | int = 0, month: Column | int = 0, day: Column | int = 0, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0) -> Column:
    y, mo, d, h, mi, s = (x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second))
    return F.struct((y * 12 + mo).cast("long").alias("months"), d.cast("long").alias("days"), ((h.cast("long") * 3600 + mi * 60 + s) * 10**6).cast("long").alias("micros"))


def _carried(high: Column, low: Column, unit: int) -> tuple[Column, Column]:
    """Whole units of low carried to high, both then of one sign."""
    whole = high * F.lit(unit).cast("long") + low
    low = whole % unit
    return ((whole - low) / unit).cast("long"), low


def justify_hours(i: Column) -> Column:
    days, micros = _carried(i["days"], i["micros"], DAY)
    return F.struct(i["months"].alias("months"), days.alias("days"), micros.alias("micros"))


def justify_days(i: Column) -> Column:
    months, days = _carried(i["months"], i["days"], 30)
    return F.struct(months.alias("months"), days.alias("days"), i["micros"].alias("micros"))


def justify_interval(i: Column) -> Column:
    """Both, with the whole as a number of microseconds in days of 24 hours and months of 30 days."""
    whole = (i["months"] * 30 + i["days"]) * DAY + i["micros"]
    micros = whole % DAY
    days = ((whole - micros) / DAY).cast("long")
    return F.struct(((days - days % 30) / 30).cast("long").alias("months"), (days % 30).alias("days"), micros.alias("micros"))


def interval_text(i: Column) -> Column:
    """As CAST(i AS STRING) has it: Y-M D H:M:S, each group with a sign of its own."""
    m, t = F.abs(i["months"]), F.abs(i["micros"])
    sign = lambda x: F.when(x < 0, "-").otherwise("")
    part = F.pmod(t, F.lit(10**6))
    fraction = F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.when(part % 1000 == 0, F.lpad((part / 1000).cast("long").cast("string"), 3, "0")).otherwise(F.lpad(part.cast("string"), 6, "0"))))
    whole = F.floor(t / 10**6)
    return F.concat(sign(i["months"]), F.floor(m / 12).cast("string"), F.lit("-"), (m % 12).cast("string"), F.lit(" "), i["days"].cast("string"), F.lit(" "), sign(i["micros"]), F.floor(whole / 3600).cast("string"), F.lit(":"), (F.floor(whole / 60) % 60).cast("string"), F.lit(":"), (whole % 60).cast("string"), fraction)
