"""DATETIME, TIME and INTERVAL functions.

A DATETIME is a timestamp without zone. A TIME is its text, HH:MM:SS with a fraction where there is one, so that order
and equality of texts are those of times; an INTERVAL is a struct of months, days and microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import FUNCTIONS, col, function, pattern_of

#: Microseconds of the parts that have a fixed length.
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000}
DAY_MICROS = 24 * MICROS["HOUR"]
#: Months of the calendar's parts.
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def _ntz(x) -> Column:
    return col(x).cast("timestamp_ntz")


def _since(x) -> Column:
    """Microseconds of a datetime since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _ntz(x))


def _floor(x: Column, size: int) -> Column:
    return ((x - F.pmod(x, F.lit(size))) / size).cast("long")


@function
def datetime(year, month=None, day=None, hour=0, minute=0, second=0):
    """Of its parts; or of a date and a time, or of a timestamp or date alone."""
    if day is not None:
        return F.make_timestamp_ntz(col(year), col(month), col(day), col(hour), col(minute), col(second))
    return _ntz(year) if month is None else F.concat(F.date_format(col(year), "yyyy-MM-dd "), col(month)).cast("timestamp_ntz")


@function
def datetime_add(x, n, part: str):
    """Months keep to the last day of shorter ones."""
    return F.timestamp_add(part.upper(), col(n), _ntz(x))


@function
def datetime_sub(x, n, part: str):
    return datetime_add(x, -col(n), part)


def _ordinal(x, part: str) -> Column:
    """The number of the part that a datetime lies in."""
    part = part.upper()
    if part in MICROS:
        return _floor(_since(x), MICROS[part])
    if part in MONTHS:
        return F.floor((F.year(_ntz(x)) * 12 + F.month(_ntz(x)) - 1) / MONTHS[part]).cast("long")
    days = F.unix_date(_ntz(x).cast("date")).cast("long")
    if part in ("DAY", "WEEK", "ISOWEEK"):
        # 1970-01-01 was a Thursday; weeks begin on Sunday, ISO weeks on Monday
        return {"DAY": days, "WEEK": _floor(days + 4, 7), "ISOWEEK": _floor(days + 3, 7)}[part]
    raise ValueError(f"there is no part {part}")


@function
def datetime_diff(x, y, part: str):
    """How many boundaries of the part lie between y and x."""
    return _ordinal(x, part) - _ordinal(y, part)


@function
def datetime_trunc(x, part: str):
    part = part.upper()
    if part in MICROS:
        return F.timestamp_add("MICROSECOND", -F.pmod(_since(x), F.lit(MICROS[part])), _ntz(x))
    if part in ("WEEK", "ISOWEEK"):
        return F.date_sub(_ntz(x).cast("date"), F.pmod(F.unix_date(_ntz(x).cast("date")) + (4 if part == "WEEK" else 3), F.lit(7))).cast("timestamp_ntz")
    return F.trunc(_ntz(x).cast("date"), part).cast("timestamp_ntz") if part != "DAY" else _ntz(x).cast("date").cast("timestamp_ntz")


@function
def datetime_bucket(x, n: int, part: str, origin: str = "1950-01-01 00:00:00"):
    """The start of the bucket of n parts, counted from the origin."""
    start, part = F.lit(origin).cast("timestamp_ntz"), part.upper()
    if part in MONTHS:
        size = n * MONTHS[part]
        months = F.floor(_ordinal(x, "MONTH") - F.year(start) * 12 - F.month(start) + 1)
        return F.timestamp_add("MONTH", months - F.pmod(months, F.lit(size)), start)
    size = n * (DAY_MICROS if part == "DAY" else MICROS[part])
    return F.timestamp_add("MICROSECOND", -F.pmod(_since(x) - _since(start), F.lit(size)), _ntz(x))


@function
def parse_datetime(format_: str, x):
    return F.to_timestamp_ntz(col(x), F.lit(pattern_of(format_)))


@function
def format_datetime(format_: str, x):
    return F.date_format(_ntz(x), pattern_of(format_))


# times of day


def _clock(micros: Column) -> Column:
    """The text of microseconds since midnight, over which days wrap."""
    m = F.pmod(micros, F.lit(DAY_MICROS))
    two = lambda size, most: F.lpad(F.pmod(F.floor(m / size), F.lit(most)).cast("string"), 2, "0")
    rest = F.pmod(m, F.lit(1_000_000))
    fraction = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 6, "0"), F.lit("0"))))
    return F.concat(two(MICROS["HOUR"], 24), F.lit(":"), two(MICROS["MINUTE"], 60), F.lit(":"), two(MICROS["SECOND"], 60), fraction)


def _midnight(x) -> Column:
    """Microseconds since midnight of a time."""
    x = col(x)
    part = lambda i: F.get(F.split(x, ":"), F.lit(i))
    second = F.split(part(2), r"\.")
    fraction = F.rpad(F.coalesce(F.get(second, F.lit(1)), F.lit("0")), 6, "0").cast("long")
    return part(0).cast("long") * MICROS["HOUR"] + part(1).cast("long") * MICROS["MINUTE"] + F.get(second, F.lit(0)).cast("long") * MICROS["SECOND"] + fraction


@function
def time(hour, minute=None, second=None):
    """Of its parts; or of a timestamp or datetime."""
    if minute is None:
        return _clock(_since(hour))
    return _clock(col(hour).cast("long") * MICROS["HOUR"] + col(minute).cast("long") * MICROS["MINUTE"] + col(second).cast("long") * MICROS["SECOND"])


@function
def time_add(x, n, part: str):
    """Over midnight it begins anew."""
    return _clock(_midnight(x) + col(n).cast("long") * MICROS[part.upper()])


@function
def time_sub(x, n, part: str):
    return time_add(x, -col(n), part)


@function
def time_diff(x, y, part: str):
    """How many boundaries of the part lie between y and x."""
    return _floor(_midnight(x), MICROS[part.upper()]) - _floor(_midnight(y), MICROS[part.upper()])


@function
def time_trunc(x, part: str):
    m = _midnight(x)
    return _clock(m - F.pmod(m, F.lit(MICROS[part.upper()])))


@function
def extract_time(part: str, x):
    """HOUR, MINUTE, SECOND, and the thousandths or millionths of the second."""
    part, m = part.upper(), _midnight(x)
    most = {"HOUR": 24, "MINUTE": 60, "SECOND": 60}.get(part)
    return F.pmod(_floor(m, MICROS[part]), F.lit(most)) if most else _floor(F.pmod(m, F.lit(1_000_000)), MICROS[part])


@function
def parse_time(format_: str, x):
    return _clock(_since(F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), col(x)), F.lit("yyyy-MM-dd " + pattern_of(format_)))))


@function
def format_time(format_: str, x):
    return F.date_format(F.concat(F.lit("1970-01-01 "), col(x)).cast("timestamp_ntz"), pattern_of(format_))


# now; one moment for the whole query

FUNCTIONS["current_timestamp"] = F.current_timestamp
FUNCTIONS["current_date"] = lambda zone=None: F.current_date() if zone is None else F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone).cast("date")
FUNCTIONS["current_datetime"] = F.localtimestamp
FUNCTIONS["current_time"] = lambda: _clock(_since(F.localtimestamp()))


@function
def date(x, month=None, day=None):
    """Of its parts, or of a timestamp, datetime or text."""
    return F.make_date(col(x), col(month), col(day)) if day is not None else col(x).cast("date")


@function
def timestamp(x, zone: str | None = None):
    """Of a text, date or datetime, read in a zone."""
    made = col(x).cast("timestamp")
    return made if zone is None else F.to_utc_timestamp(F.from_utc_timestamp(made, F.current_timezone()), zone)


@function
def string(x):
    """A date, datetime or timestamp as text."""
    return col(x).cast("string")


@function
def generate_timestamp_array(start, end, step: str):
    """step: such as "6 HOUR"."""
    return F.sequence(col(start).cast("timestamp"), col(end).cast("timestamp"), F.expr(f"INTERVAL {step}"))


# intervals


def _interval(months, days, micros) -> Column:
    return F.struct(months.cast("long").alias("months"), days.cast("long").alias("days"), micros.cast("long").alias("micros"))


@function
def make_interval(year=0, month=0, day=0, hour=0, minute=0, second=0):
    return _interval(col(year) * 12 + col(month), col(day), col(hour).cast("long") * MICROS["HOUR"] + col(minute).cast("long") * MICROS["MINUTE"] + col(second).cast("long") * MICROS["SECOND"])


def _toward_zero(x: Column, size: int) -> Column:
    return F.when(x >= 0, F.floor(x / size)).otherwise(F.ceil(x / size)).cast("long")


@function
def extract_interval(part: str, x):
    """Years and months of the months, days, and hours, minutes and seconds of the microseconds, each with its sign."""
    part, x = part.upper(), col(x)
    if part in ("YEAR", "MONTH"):
        years = _toward_zero(x["months"], 12)
        return years if part == "YEAR" else x["months"] - years * 12
    if part == "DAY":
        return x["days"]
    whole = _toward_zero(x["micros"], MICROS[part])
    above = {"MINUTE": 60, "SECOND": 60, "MILLISECOND": 1_000, "MICROSECOND": 1_000_000}.get(part)
    return whole if above is None else whole - _toward_zero(whole, above) * above


def _carried(low: Column, high: Column, size: int) -> tuple[Column, Column]:
    """(low, high) with whole sizes of low moved up and both of one sign."""
    moved = _toward_zero(low, size)
    low, high = low - moved * size, high + moved
    fix = F.when((high > 0) & (low < 0), 1).when((high < 0) & (low > 0), -1).otherwise(0)
    return low + fix * size, high - fix


@function
def justify_days(x):
    """30 days are a month."""
    x = col(x)
    days, months = _carried(x["days"], x["months"], 30)
    return _interval(months, days, x["micros"])


@function
def justify_hours(x):
    """24 hours are a day."""
    x = col(x)
    micros, days = _carried(x["micros"], x["days"], DAY_MICROS)
    return _interval(x["months"], days, micros)


@function
def justify_interval(x):
    """Both; the parts end up with one sign."""
    x = col(x)
    micros, days = _carried(x["micros"], x["days"], DAY_MICROS)
    days, months = _carried(days, x["months"], 30)
    fix = F.when((months > 0) & (micros < 0), 1).when((months < 0) & (micros > 0), -1).otherwise(0)
    return _interval(months, days - fix, micros + fix * DAY_MICROS)


@function
def interval_add(x, y):
    x, y = col(x), col(y)
    return _interval(x["months"] + y["months"], x["days"] + y["days"], x["micros"] + y["micros"])


@function
def interval_multiply(x, n):
    x, n = col(x), col(n)
    return _interval(x["months"] * n, x["days"] * n, x["micros"] * n)


@function
def datetime_plus(x, interval):
    """A datetime moved by an interval: months first, then days, then the rest."""
    i = col(interval)
    return F.timestamp_add("MICROSECOND", i["micros"], F.timestamp_add("DAY", i["days"], F.timestamp_add("MONTH", i["months"], _ntz(x))))


@function
def datetime_minus(x, y):
    """The interval between two datetimes, in microseconds, with whole days apart."""
    return justify_hours(_interval(F.lit(0), F.lit(0), _since(x) - _since(y)))
