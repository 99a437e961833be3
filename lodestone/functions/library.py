"""Scalar and aggregate functions with the engine's semantics where they differ from Spark's, as column builders.

Names are those of the SQL surface in lower case; `call("safe_divide", a, b)` or `safe_divide(a, b)`. Everything is a
composition of built-in functions, so that plans stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def function(make: Callable[..., Column]) -> Callable[..., Column]:
    FUNCTIONS[make.__name__.rstrip("_")] = make
    return make


def call(name: str, *args) -> Column:
    if name.lower() not in FUNCTIONS:
        raise KeyError(f"there is no function {name}")
    return FUNCTIONS[name.lower()](*args)


def col(x) -> Column:
    """A column by name, or the column itself; other values are literals."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def failing(message: str) -> Column:
    return F.raise_error(F.lit(message))


for _name, _make in {
    # same meaning as the built-in function
    "abs": F.abs, "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atan2": F.atan2, "atanh": F.atanh,
    "cbrt": F.cbrt, "cos": F.cos, "cosh": F.cosh, "cot": F.cot, "csc": F.csc, "sec": F.sec, "exp": F.exp, "sin": F.sin, "sinh": F.sinh,
    "tan": F.tan, "tanh": F.tanh, "pow": F.pow, "power": F.pow, "rand": F.rand, "is_nan": F.isnan,
    "ascii": F.ascii, "byte_length": F.octet_length, "octet_length": F.octet_length, "char_length": F.char_length, "character_length": F.char_length,
    "concat": F.concat, "ends_with": F.endswith, "starts_with": F.startswith, "lower": F.lower, "upper": F.upper, "reverse": F.reverse,
    "repeat": F.repeat, "soundex": F.soundex, "to_base64": F.base64, "from_base64": F.unbase64, "from_hex": F.unhex,
    "md5": lambda x: F.unhex(F.md5(col(x))), "sha1": lambda x: F.unhex(F.sha1(col(x))), "sha256": lambda x: F.unhex(F.sha2(col(x), 256)), "sha512": lambda x: F.unhex(F.sha2(col(x), 512)),
    "coalesce": F.coalesce, "nullif": F.nullif, "ifnull": F.ifnull, "bit_count": F.bit_count,
    "array_length": lambda x: F.size(col(x)).cast("long"), "array_reverse": F.reverse, "array_concat": F.concat, "array_to_string": lambda x, sep, null=None: F.array_join(col(x), sep, null),
    "unix_date": F.unix_date, "date_from_unix_date": F.date_from_unix_date, "unix_seconds": F.unix_seconds, "unix_millis": F.unix_millis, "unix_micros": F.unix_micros,
    "timestamp_seconds": F.timestamp_seconds, "timestamp_millis": F.timestamp_millis, "timestamp_micros": F.timestamp_micros, "last_day": F.last_day,
    "sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "countif": F.count_if, "logical_and": F.bool_and, "logical_or": F.bool_or, "bit_and": F.bit_and,
    "bit_or": F.bit_or, "bit_xor": F.bit_xor, "max_by": F.max_by, "min_by": F.min_by, "any_value": F.any_value, "corr": F.corr, "covar_pop": F.covar_pop,
    "covar_samp": F.covar_samp, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop, "variance": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop,
    "approx_count_distinct": lambda x: F.approx_count_distinct(col(x), 0.01),
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist, "ntile": F.ntile,
    "lag": F.lag, "lead": F.lead, "first_value": F.first, "last_value": F.last, "nth_value": F.nth_value,
}.items():
    FUNCTIONS[_name] = _make


# numbers


@function
def ceil(x):
    """A float, as the surface has it."""
    return F.ceil(col(x)).cast("double")


FUNCTIONS["ceiling"] = ceil


@function
def floor(x):
    return F.floor(col(x)).cast("double")


@function
def coth(x):
    return 1 / F.tanh(col(x))


@function
def csch(x):
    return 1 / F.sinh(col(x))


@function
def sech(x):
    return 1 / F.cosh(col(x))


@function
def div(x, y):
    """Integer division that truncates towards zero."""
    return F.call_function("div", col(x), col(y))


@function
def mod(x, y):
    return col(x) % col(y)


@function
def ieee_divide(x, y):
    a, b = col(x).cast("double"), col(y).cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


@function
def is_inf(x):
    return F.abs(col(x)) == float("inf")


@function
def ln(x):
    """Fails outside the domain, where Spark gives null."""
    return F.when(col(x) <= 0, failing("LN of a number that isn't positive")).otherwise(F.log(col(x)))


@function
def log(x, base=None):
    """Natural, or of (x, base): the base comes second."""
    return ln(x) if base is None else ln(x) / ln(base)


@function
def log10(x):
    return F.when(col(x) <= 0, failing("LOG10 of a number that isn't positive")).otherwise(F.log10(col(x)))


@function
def sqrt(x):
    return F.when(col(x) < 0, failing("SQRT of a negative number")).otherwise(F.sqrt(col(x)))


def _null_if_any(made: Column, args) -> Column:
    some = F.lit(False)
    for x in args:
        some = some | col(x).isNull()
    return F.when(~some, made)


@function
def greatest(*xs):
    """Null if any argument is."""
    return _null_if_any(F.greatest(*map(col, xs)), xs)


@function
def least(*xs):
    return _null_if_any(F.least(*map(col, xs)), xs)


@function
def round_(x, digits=0):
    """Half away from zero; a float for whole digits too."""
    return F.round(col(x), digits).cast("double")


@function
def trunc(x, digits=0):
    scale = 10.0**digits
    scaled = col(x) * scale
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("double") / scale


@function
def sign(x):
    return F.signum(col(x))


@function
def range_bucket(point, edges: list):
    """How many of the sorted edges are at or under the point; null for a null point."""
    count = sum((F.when(col(point) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(col(point).isNotNull(), count.cast("long"))


@function
def safe_add(x, y):
    return F.try_add(col(x), col(y))


@function
def safe_subtract(x, y):
    return F.try_subtract(col(x), col(y))


@function
def safe_multiply(x, y):
    return F.try_multiply(col(x), col(y))


@function
def safe_divide(x, y):
    return F.try_divide(col(x).cast("double"), col(y).cast("double"))


@function
def safe_negate(x):
    return F.try_subtract(F.lit(0).cast("long"), col(x))


def _dot(x, y) -> Column:
    return F.aggregate(F.zip_with(col(x), col(y), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


@function
def euclidean_distance(x, y):
    squares = F.zip_with(col(x), col(y), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


@function
def cosine_distance(x, y):
    return 1 - _dot(x, y) / (F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)))


@function
def dot_product(x, y):
    return _dot(x, y)


@function
def int64(x):
    """A float to an integer, halves away from zero."""
    return F.round(col(x)).cast("long")


@function
def safe_cast(x, kind: str):
    return col(x).try_cast(kind)


# texts


@function
def length(x):
    return F.char_length(col(x)).cast("long")


@function
def chr_(x):
    return F.when(col(x) == 0, F.lit("")).otherwise(F.char(col(x)))


@function
def unicode(x):
    return F.when(col(x) == "", F.lit(0)).otherwise(F.conv(F.hex(F.encode(F.substring(col(x), 1, 1), "UTF-32")), 16, 10).cast("long"))


@function
def contains_substr(x, part):
    """Ignoring case."""
    return F.contains(F.lower(col(x).cast("string")), F.lower(F.lit(part)))


@function
def edit_distance(x, y, most=None):
    """Levenshtein; with a bound, the bound itself where the distance is over it."""
    if most is None:
        return F.levenshtein(col(x), col(y)).cast("long")
    found = F.levenshtein(col(x), col(y), most)
    return F.when(found < 0, F.lit(most)).otherwise(found).cast("long")


@function
def initcap(x, delimiters: str = " \t\n\r\f\v[](){}/|<>!?@\"^#$&~_,.:;*%+-"):
    """The first letter of each part in upper case, the rest in lower; parts end at delimiters."""
    quoted = "".join("\\" + c if c in "[]^-\\&~" else c for c in delimiters)
    parts = F.regexp_extract_all(F.lower(col(x)), F.lit(f"[{quoted}]+|[^{quoted}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


@function
def instr(x, part, position=1, occurrence=1):
    """From the given place on, the n-th occurrence; 0 where there is none. Positions are positive here."""
    found = F.locate(part, col(x), position)
    for _ in range(occurrence - 1):
        found = F.when(found > 0, F.call_function("locate", F.lit(part), col(x), found + 1)).otherwise(0)
    return found.cast("long")


@function
def strpos(x, part):
    return F.instr(col(x), part).cast("long")


@function
def left(x, n):
    return F.substring(col(x), 1, n)


@function
def right(x, n):
    return F.right(col(x), F.lit(n))


@function
def lpad(x, n, fill=" "):
    return F.lpad(col(x), n, fill)


@function
def rpad(x, n, fill=" "):
    return F.rpad(col(x), n, fill)


# The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@function
def trim(x, chars=WHITE_SPACE):
    return F.btrim(col(x), F.lit(chars))


@function
def ltrim(x, chars=WHITE_SPACE):
    return F.ltrim(col(x), F.lit(chars))


@function
def rtrim(x, chars=WHITE_SPACE):
    return F.rtrim(col(x), F.lit(chars))


@function
def substr(x, position, n=None):
    """Position 0 is 1; a position before the start is the start."""
    size, at = F.char_length(col(x)), col(position)
    start = F.when(at < 0, F.greatest(size + at + 1, F.lit(1))).otherwise(F.greatest(at, F.lit(1)))
    return F.substr(col(x), start, F.lit(1 << 30) if n is None else col(n))


FUNCTIONS["substring"] = substr


@function
def split(x, delimiter=","):
    """By a literal text; an empty text is one empty part."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in delimiter)
    return F.split(col(x), quoted, -1) if delimiter else F.split(col(x), "")


@function
def replace(x, old, new):
    return F.replace(col(x), F.lit(old), F.lit(new)) if old else col(x)


@function
def translate(x, source, target):
    return F.translate(col(x), source, target)


@function
def regexp_contains(x, pattern):
    return F.regexp(col(x), F.lit(pattern))


@function
def regexp_extract(x, pattern, group=None):
    """The first group if there is one, else the match; null where nothing matches."""
    group = (1 if _has_group(pattern) else 0) if group is None else group
    return F.when(F.regexp(col(x), F.lit(pattern)), F.regexp_extract(col(x), pattern, group))


FUNCTIONS["regexp_substr"] = regexp_extract


def _has_group(pattern: str) -> bool:
    import re

    return re.compile(pattern).groups > 0


@function
def regexp_extract_all(x, pattern):
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(1 if _has_group(pattern) else 0))


@function
def regexp_instr(x, pattern):
    return F.regexp_instr(col(x), F.lit(pattern)).cast("long")


@function
def regexp_replace(x, pattern, new):
    r"""\1 stands for a group."""
    import re

    return F.regexp_replace(col(x), pattern, re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$")))


@function
def to_hex(x):
    return F.lower(F.hex(col(x)))


@function
def to_code_points(x):
    """Of a text its code points, none for the empty one."""
    parts = F.regexp_extract_all(F.hex(F.encode(col(x), "UTF-32")), F.lit(".{8}"), F.lit(0))
    return F.transform(parts, lambda c: F.conv(c, 16, 10).cast("long"))


@function
def code_points_to_string(x):
    # decoding takes a first U+FEFF for a mark; this one goes instead of a text's own
    digits = F.array_join(F.transform(col(x), lambda c: F.lpad(F.hex(c), 8, "0")), "")
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), digits)), "UTF-32")


@function
def safe_convert_bytes_to_string(x):
    return F.make_valid_utf8(col(x).cast("string"))


# dates and times; weeks begin on Sunday unless named otherwise

_DAYS = {"SUNDAY": 1, "MONDAY": 2, "TUESDAY": 3, "WEDNESDAY": 4, "THURSDAY": 5, "FRIDAY": 6, "SATURDAY": 7}


def _week_start(x: Column, part: str) -> Column:
    day = _DAYS[part[5:-1]] if part.startswith("WEEK(") else 1
    return F.date_sub(x, F.pmod(F.dayofweek(x) - day, F.lit(7)))


@function
def date_trunc(x, part: str):
    part, x = part.upper(), col(x)
    if part == "DAY":
        return x.cast("date")
    if part == "ISOWEEK":
        return F.trunc(x, "WEEK").cast("date")
    if part.startswith("WEEK"):
        return _week_start(x.cast("date"), part)
    if part == "ISOYEAR":
        return F.trunc(F.next_day(F.date_sub(F.trunc(F.date_add(F.trunc(x, "WEEK"), 3), "YEAR"), 1), "Thu"), "WEEK").cast("date")
    return F.trunc(x, part).cast("date")


@function
def date_diff(x, y, part: str = "DAY"):
    """Boundaries of the part between two dates."""
    part, x, y = part.upper(), col(x).cast("date"), col(y).cast("date")
    months = lambda d: F.year(d) * 12 + F.month(d)
    if part == "DAY":
        made = F.date_diff(x, y)
    elif part == "MONTH":
        made = months(x) - months(y)
    elif part == "QUARTER":
        made = (F.year(x) * 4 + F.quarter(x)) - (F.year(y) * 4 + F.quarter(y))
    elif part == "YEAR":
        made = F.year(x) - F.year(y)
    elif part == "ISOYEAR":
        made = F.extract(F.lit("YEAROFWEEK"), x) - F.extract(F.lit("YEAROFWEEK"), y)
    else:
        made = F.date_diff(date_trunc(x, part), date_trunc(y, part)) / 7
    return made.cast("long")


@function
def date_add(x, n, part: str = "DAY"):
    """Month ends stay month ends where a day doesn't exist."""
    part, x, n = part.upper(), col(x).cast("date"), col(n).cast("int")
    unit = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
    return F.add_months(x, n * unit[part]) if part in unit else F.date_add(x, n * (7 if part == "WEEK" else 1))


@function
def date_sub(x, n, part: str = "DAY"):
    return date_add(x, -col(n), part)


@function
def extract(part: str, x):
    part, x = part.upper(), col(x)
    if part == "DAYOFWEEK":
        made = F.dayofweek(x)
    elif part == "WEEK" or part.startswith("WEEK("):
        first = F.trunc(x, "YEAR")
        begun = _week_start(x.cast("date"), part)
        start = _week_start(F.date_add(first, 6), part)
        made = F.floor(F.date_diff(begun, start) / 7) + 1
    elif part == "ISOWEEK":
        made = F.weekofyear(x)
    elif part == "ISOYEAR":
        made = F.extract(F.lit("YEAROFWEEK"), x)
    elif part == "MICROSECOND":
        made = F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(1_000_000))
    elif part == "MILLISECOND":
        made = F.floor(F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(1_000_000)) / 1000)
    elif part == "SECOND":
        made = F.second(x)
    elif part == "DAYOFYEAR":
        made = F.dayofyear(x)
    else:
        made = F.extract(F.lit(part), x)
    return made.cast("long")


_MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


@function
def timestamp_diff(x, y, part: str):
    """Whole intervals, towards zero."""
    size, apart = _MICROS[part.upper()], _micros(col(x)) - _micros(col(y))
    return F.when(apart >= 0, F.floor(apart / size)).otherwise(F.ceil(apart / size)).cast("long")


@function
def timestamp_add(x, n, part: str):
    """Parts of a fixed length, days at most: an absolute time has no months."""
    return F.timestamp_micros(_micros(col(x)) + col(n).cast("long") * _MICROS[part.upper()])


@function
def timestamp_sub(x, n, part: str):
    return timestamp_add(x, -col(n), part)


@function
def timestamp_trunc(x, part: str):
    part = part.upper()
    return F.date_trunc(part, col(x)) if part not in ("WEEK",) and not part.startswith(("WEEK(", "ISO")) else date_trunc(x, part).cast("timestamp")


@function
def date_bucket(x, n: int, part: str = "DAY", origin: str = "1950-01-01"):
    """The start of the bucket of n days or months that holds the date."""
    x, start = col(x).cast("date"), F.to_date(F.lit(origin))
    if part.upper() in ("MONTH", "QUARTER", "YEAR"):
        size = n * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part.upper()]
        apart = date_diff(x, start, "MONTH") - F.when(F.dayofmonth(x) < F.dayofmonth(start), 1).otherwise(0)
        return F.add_months(start, (F.floor(apart / size) * size).cast("int"))
    size = n * (7 if part.upper() == "WEEK" else 1)
    return F.date_add(start, (F.floor(F.date_diff(x, start) / size) * size).cast("int"))


@function
def timestamp_bucket(x, micros: int, origin: str = "1950-01-01 00:00:00"):
    start = _micros(F.to_timestamp(F.lit(origin)))
    return F.timestamp_micros(F.floor((_micros(col(x)) - start) / micros) * micros + start)


#: Format elements with a counterpart in Spark's patterns (fixed by the format language).
_ELEMENTS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "y": "yy", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "E6S": "ss.SSSSSS", "E3S": "ss.SSS"}


def pattern_of(format_: str) -> str:
    """A date format with % elements as a Spark pattern."""
    import re

    out = []
    for element, text in re.findall(r"%(E\dS|.)|([^%]+)", format_):
        if element and element not in _ELEMENTS and element != "%":
            raise ValueError(f"no counterpart of %{element}")
        out.append(_ELEMENTS.get(element) or "'" + ("%" if element else text.replace("'", "''")) + "'")
    return "".join(out)


@function
def format_date(format_: str, x):
    return F.date_format(col(x), pattern_of(format_))


FUNCTIONS["format_timestamp"] = FUNCTIONS["format_datetime"] = format_date


@function
def parse_date(format_: str, x):
    return F.to_date(col(x), pattern_of(format_))


@function
def parse_timestamp(format_: str, x):
    return F.to_timestamp(col(x), pattern_of(format_))


# arrays


@function
def array_first(x):
    return F.element_at(col(x), 1)


@function
def array_last(x):
    return F.element_at(col(x), -1)


@function
def array_slice(x, start: int, end: int):
    """Places from 0, both ends included; negative ones count from the end."""
    size = F.size(col(x))
    a = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    b = F.lit(end) if end >= 0 else size + end
    return F.slice(col(x), a + 1, F.greatest(F.least(b, size - 1) - a + 1, F.lit(0)))


@function
def generate_array(start, end, step=1):
    """Empty where the step leads away from the end."""
    a, b, s = col(start), col(end), col(step)
    fits = F.when(s > 0, a <= b).otherwise(a >= b)
    return F.when(a.isNull() | b.isNull() | s.isNull(), None).when(fits, F.sequence(a, b, s)).otherwise(F.slice(F.array(a), 1, 0))


@function
def generate_date_array(start, end, n=1, part: str = "DAY"):
    return F.sequence(col(start).cast("date"), col(end).cast("date"), F.expr(f"INTERVAL {n} {part}"))


@function
def array_at(x, place: int, safe: bool = False):
    """x[OFFSET(place)]; out of bounds is an error, or null if safe."""
    return F.get(col(x), F.lit(place)) if safe else F.element_at(col(x), place + 1)


@function
def array_includes(x, value):
    return F.coalesce(F.array_contains(col(x), value), F.lit(False))


# aggregates


@function
def min_(x):
    """NaN wins over numbers, as in max."""
    nan = F.max(F.isnan(col(x).cast("double")).cast("int"))
    return F.when(nan == 1, F.lit(float("nan"))).otherwise(F.min(col(x)))


def _gathered(x, distinct: bool, nulls: bool, order, limit: int | None) -> Column:
    """An array of x's values; order: columns, or (column, "desc"), to sort by; empty for no rows."""
    value = col(x)
    if order:
        keys, down = [], False
        for k in order:
            k, way = k if isinstance(k, tuple) else (k, "asc")
            keys.append(col(k))
            down = way == "desc"
        fields = [*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("v")]
        found = F.sort_array(F.collect_list(F.struct(*fields)), not down)
    else:
        found = F.collect_list(F.struct(value.alias("v")))
    found = found if nulls else F.filter(found, lambda s: s["v"].isNotNull())
    values = F.transform(found, lambda s: s["v"])
    values = F.array_distinct(values) if distinct else values
    return F.slice(values, 1, limit) if limit else values


@function
def array_agg(x, distinct: bool = False, ignore_nulls: bool = False, order=(), limit: int | None = None):
    """Keeps nulls unless told otherwise; null for no rows."""
    found = _gathered(x, distinct, not ignore_nulls, order, limit)
    return F.when(F.size(found) > 0, found)


@function
def string_agg(x, delimiter: str = ",", distinct: bool = False, order=(), limit: int | None = None):
    """The values that aren't null, joined; null for none. Without an order it isn't defined."""
    found = _gathered(x, distinct, False, order, limit)
    return F.when(F.size(found) > 0, F.array_join(found, delimiter))


def value_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By keys, `runs`: a group's values in their order as an array of (value, n), equal ones as one entry of n.

    It stands for array_agg(value, order=[value]) where a group has many rows and few different values: counted by
    two groupings, no row of it is held one by one.
    """
    counted = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("runs"))


def runs_size(runs) -> Column:
    """How many values runs stand for, nulls included."""
    return F.aggregate(col(runs), F.lit(0).cast("long"), lambda s, r: s + r["n"])


def runs_string(runs, delimiter: str = ",") -> Column:
    """string_agg(value, delimiter, order=[value]) of runs."""
    kept = F.filter(col(runs), lambda r: r["value"].isNotNull())
    text = lambda r: F.concat(F.repeat(F.concat(r["value"], F.lit(delimiter)), (r["n"] - 1).cast("int")), r["value"])
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, text), delimiter))


@function
def array_concat_agg(x, order=(), limit: int | None = None):
    """Null arrays are skipped; null for no rows."""
    found = _gathered(x, False, False, order, limit)
    return F.when(F.size(found) > 0, F.flatten(found))


@function
def approx_quantiles(x, n: int):
    """n + 1 values, the least and the largest among them."""
    return F.percentile_approx(col(x), [i / n for i in range(n + 1)], 10_000)


@function
def percentile_cont(x, fraction: float):
    return F.percentile(col(x), fraction)


@function
def percentile_disc(x: str, fraction: float):
    """The first value whose cumulative share reaches the fraction, exactly; x: a column's name or SQL."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {x})")


# ranges: structs (start, end), half open; null: unbounded


@function
def range_(start, end):
    return F.struct(col(start).alias("start"), col(end).alias("end"))


def _before(a: Column, b: Column) -> Column:
    """An end after a start, where null is unbounded."""
    return F.coalesce(a > b, F.lit(True))


@function
def range_contains(x, value):
    """Of a value that isn't a range."""
    x, value = col(x), col(value)
    return F.when(x.isNotNull() & value.isNotNull(), F.coalesce(x["start"] <= value, F.lit(True)) & _before(x["end"], value))


@function
def range_contains_range(x, y):
    """Whether all of y is in x."""
    x, y = col(x), col(y)
    first = x["start"].isNull() | F.coalesce(x["start"] <= y["start"], F.lit(False))
    last = x["end"].isNull() | F.coalesce(y["end"] <= x["end"], F.lit(False))
    return F.when(x.isNotNull() & y.isNotNull(), first & last)


@function
def range_overlaps(x, y):
    x, y = col(x), col(y)
    return _before(x["end"], y["start"]) & _before(y["end"], x["start"])


@function
def range_intersect(x, y):
    """An error if they have nothing in common; null if one is null."""
    x, y = col(x), col(y)
    both = F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["end"], y["end"]).alias("end"))
    apart = ~(_before(x["end"], y["start"]) & _before(y["end"], x["start"]))
    return F.when(x.isNull() | y.isNull(), None).when(apart, failing("ranges that don't overlap have no intersection")).otherwise(both)


@function
def generate_range_array(x, step: str, include_last_partial: bool = True):
    """A bounded range cut into ranges of an interval such as "1 MONTH"."""
    x = col(x)
    starts = F.filter(F.sequence(x["start"], x["end"], F.expr(f"INTERVAL {step}")), lambda t: t < x["end"])
    cut = F.transform(starts, lambda t: F.struct(t.alias("start"), F.least(t + F.expr(f"INTERVAL {step}"), x["end"]).alias("end")))
    return cut if include_last_partial else F.filter(cut, lambda r: r["start"] + F.expr(f"INTERVAL {step}") <= x["end"])


@function
def range_start(x):
    return col(x)["start"]


@function
def range_end(x):
    return col(x)["end"]


# addresses


@function
def net_host(x):
    """The host of a URL, with or without scheme; null where there is none."""
    found = F.regexp_extract(F.btrim(col(x), F.lit(WHITE_SPACE)), r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(found, F.lit(""))


# Public suffixes of two labels that net_public_suffix knows besides all last labels.
TWO_LABEL_SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr",
    "edu.au", "gov.au", "gov.br", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.uk", "or.jp", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
)


@function
def net_public_suffix(x, two_labels=TWO_LABEL_SUFFIXES):
    """The suffix under which names are registered; the list of those with two labels is a parameter. Null without a dot."""
    host = F.lower(net_host(x))
    last = F.regexp_extract(host, r"([^.]+)$", 1)
    pair = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(host.rlike(r"^[^.\[]+(\.[^.]+)+$") & ~host.rlike(r"^[\d.]+$"), F.when(pair.isin(*two_labels), pair).otherwise(last))


@function
def net_reg_domain(x, two_labels=TWO_LABEL_SUFFIXES):
    """The public suffix with one label before it; null where there is none."""
    host, suffix = net_host(x), net_public_suffix(x, two_labels)
    before = F.substr(host, F.lit(1), F.char_length(host) - F.char_length(suffix) - 1)
    label = F.regexp_extract(before, r"([^.]+)$", 1)
    return F.when(label != "", F.substr(host, F.char_length(host) - F.char_length(suffix) - F.char_length(label), F.lit(1 << 20)))


def _ip_bytes(x) -> Column:
    """IPv4: four bytes; IPv6: sixteen; null for anything else."""
    x = F.btrim(col(x))
    four = F.split(x, r"\.")
    part = r"(?:\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])"
    v4 = F.when(x.rlike(rf"^{part}(?:\.{part}){{3}}$"), F.unhex(F.array_join(F.transform(four, lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), "")))
    halves = F.split(x, "::")
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    given = F.size(left) + F.size(right)
    whole = F.when(x.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)).otherwise(left)
    fits = x.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & ~x.rlike(r"[0-9A-Fa-f]{5}|::.*::|:::|^:[^:]|[^:]:$") & F.when(x.contains("::"), given < 8).otherwise(given == 8)
    return F.coalesce(v4, F.when(fits, F.unhex(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))))


@function
def net_safe_ip_from_string(x):
    return _ip_bytes(x)


@function
def net_ip_from_string(x):
    """The bytes of an IPv4 or IPv6 address; an error for other texts."""
    return F.when(col(x).isNull(), None).otherwise(F.coalesce(_ip_bytes(x), failing("not an IP address").cast("binary")))


@function
def net_ip_net_mask(n_bytes: int, prefix):
    """The mask of n_bytes bytes whose first bits are set."""
    ones = F.concat(F.repeat(F.lit("1"), col(prefix)), F.repeat(F.lit("0"), 8 * n_bytes - col(prefix)))
    return F.unhex(F.concat(*(F.lpad(F.conv(F.substr(ones, F.lit(8 * i + 1), F.lit(8)), 2, 16), 2, "0") for i in range(n_bytes))))


@function
def net_ip_trunc(x, prefix: int):
    """The address with all bits after the first `prefix` cleared."""
    x = col(x)
    byte = lambda i: F.conv(F.hex(F.substring(x, i + 1, 1)), 16, 10).cast("int")
    cut = lambda n: F.unhex(F.concat(*(F.lpad(F.hex(byte(i).bitwiseAND(F.lit(255 & ~((1 << max(0, min(8, 8 * (i + 1) - prefix))) - 1)))), 2, "0") for i in range(n))))
    return F.when(F.octet_length(x) == 4, cut(4)).otherwise(cut(16))


@function
def net_ipv4_to_int64(x):
    return F.conv(F.hex(col(x)), 16, 10).cast("long")


@function
def net_ipv4_from_int64(x):
    return F.unhex(F.lpad(F.hex(col(x)), 8, "0"))


@function
def net_ip_to_string(x):
    return F.concat_ws(".", *(F.conv(F.hex(F.substring(col(x), i, 1)), 16, 10) for i in range(1, 5)))


# floats as the surface compares them


@function
def float_equal(x, y):
    """NaN equals nothing."""
    return (col(x) == col(y)) & ~F.isnan(col(x)) & ~F.isnan(col(y))


def float_order(x) -> list[Column]:
    """Sort keys: nulls, then NaN, then numbers."""
    return [col(x).isNotNull().cast("int"), (~F.isnan(col(x))).cast("int"), col(x)]
