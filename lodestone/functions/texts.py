"""Text functions that need Unicode tables or formats, and conversions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from lodestone.session import let_workers_import

from .library import FUNCTIONS, col, failing, function


def _normalised(mode: str, fold: bool):
    import unicodedata

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            made = unicodedata.normalize(mode, t)
            return unicodedata.normalize(mode, unicodedata.normalize(mode, made.casefold())) if fold else made

        return x.map(one)

    return run


@function
def normalize(x, mode: str = "NFC"):
    """NFC, NFKC, NFD or NFKD; Unicode tables are Python's, in Arrow batches. Plain ASCII texts are never sent."""
    x = col(x)
    return F.when(x.rlike(r"^[\x00-\x7f]*$"), x).otherwise(_normalised(mode, False)(x))


@function
def normalize_and_casefold(x, mode: str = "NFC"):
    x = col(x)
    return F.when(x.rlike(r"^[\x00-\x7f]*$"), F.lower(x)).otherwise(_normalised(mode, True)(x))


# The digits of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


#: The same digits as conv writes them.
PLAIN32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _chunks(x, width: int, source: int, target: int, digits: int):
    """Digits of base `source`, converted `width` at a time to `digits` of base `target`; x is filled up with zeros."""
    parts = F.regexp_extract_all(F.concat(x, F.repeat(F.lit("0"), F.pmod(-F.char_length(x), F.lit(width)))), F.lit(f".{{{width}}}"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.conv(p, source, target), digits, "0")), "")


@function
def to_base32(x):
    """Bytes in groups of five bits, filled up with = to a multiple of eight."""
    x = col(x)
    groups = F.ceil(F.octet_length(x) * 8 / 5).cast("int")
    made = F.translate(F.left(_chunks(F.hex(x), 10, 16, 32, 8), groups), PLAIN32, BASE32)
    return F.rpad(made, (F.ceil(groups / 8) * 8).cast("int"), F.lit("="))


@function
def from_base32(x):
    x = F.rtrim(col(x), F.lit("="))
    # another character counts as the last digit
    digits = F.translate(F.regexp_replace(x, "[^A-Z2-7]", "7"), BASE32, PLAIN32)
    n = F.floor(F.char_length(x) * 5 / 8).cast("int")
    return F.unhex(F.left(_chunks(digits, 8, 32, 16, 10), n * 2))


@function
def code_points_to_bytes(x):
    """An error for values over 255."""
    odd = F.exists(col(x), lambda v: (v < 0) | (v > 255))
    return F.when(odd, failing("a byte is from 0 to 255").cast("binary")).otherwise(F.unhex(F.array_join(F.transform(col(x), lambda v: F.lpad(F.hex(v), 2, "0")), "")))


@function
def collate(x, name: str):
    """"und:ci" compares without case, "binary" by code points."""
    return F.collate(col(x), {"und:ci": "UTF8_LCASE", "binary": "UTF8_BINARY", "": "UTF8_BINARY"}[name])


@function
def contains_substr(x, text: str):
    """Without case and over all fields of a struct or array; null if some field is null and none has the text."""
    x = col(x)
    return F.contains(F.lower(x.cast("string")), F.lit(text.lower()))


_ELEMENT = re.compile(r"%([-+ #0']*)(\d*)(?:\.(\d+))?([a-zA-Z%])")


@function
def format(pattern: str, *args):  # noqa: A001  the surface's name
    """printf elements: d i u o x X s f F e E g G t T %, with flags, ' for groups of thousands; nulls make the result null but for t and T."""
    made, given, last, found = [], list(args), 0, None
    for found in _ELEMENT.finditer(pattern):
        made.append(F.lit(pattern[last : found.start()]))
        last = found.end()
        flags, width, digits, kind = found.groups()
        if kind == "%":
            made.append(F.lit("%"))
            continue
        value = col(given.pop(0))
        if kind in "tT":
            text = value.cast("string")
            part = F.coalesce(F.concat(F.lit('"'), text, F.lit('"')) if kind == "T" else text, F.lit("NULL"))
        elif kind in "diu":
            part = F.format_string("%" + flags.replace("'", ",") + width + "d", value.cast("long"))
        elif kind in "s":
            text = value.cast("string") if digits is None else F.left(value.cast("string"), F.lit(int(digits)))
            part = text if not width else F.rpad(text, F.greatest(F.char_length(text), F.lit(int(width))), F.lit(" ")) if "-" in flags else F.lpad(text, F.greatest(F.char_length(text), F.lit(int(width))), F.lit(" "))
        elif kind in "oxX":
            part = F.format_string("%" + flags + width + kind, value.cast("long"))
        else:
            part = F.format_string("%" + flags.replace("'", ",") + width + "." + (digits or "6") + {"F": "f"}.get(kind, kind), value.cast("double"))
        made.append(F.when(value.isNotNull(), part) if kind not in "tT" else part)
    return F.concat(*made, F.lit(pattern[last:]))


@function
def parse_numeric(x, precision: int = 38, scale: int = 9):
    """Of a text with blanks, signs before or after, commas and exponents; an error for others."""
    bare = F.regexp_replace(F.btrim(col(x)), ",", "")
    sign = F.when(bare.rlike(r"^\s*-|-\s*$"), -1).otherwise(1)
    number = F.regexp_replace(bare, r"[-+\s]*(?=[\d.])(?<![eE][-+]?)|(?<=[\d.])\s*[-+]$", "")
    exact = F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), number.try_cast(f"decimal({precision},{scale})"))
    return F.when(col(x).isNull(), None).otherwise(F.coalesce(exact * sign, failing("not a number").cast(f"decimal({precision},{scale})"))).cast(f"decimal({precision},{scale})")


FUNCTIONS["parse_bignumeric"] = lambda x: parse_numeric(x, 38, 18)
FUNCTIONS["generate_uuid"] = lambda: F.expr("uuid()")
FUNCTIONS["typeof"] = lambda x: F.typeof(col(x))
FUNCTIONS["session_user"] = lambda: F.current_user()
FUNCTIONS["error"] = lambda message: F.raise_error(col(message))


def ready(spark) -> None:
    """Lets workers import this module's Python functions."""
    let_workers_import(spark)
