"""Per-document prose metrics as column expressions: words, sentences, and how evenly long the sentences are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sentence rule: what ends a sentence, what may stand between its end and the blank, what begins one.
ENDS, CLOSERS, OPENERS = ".!?", "\"'”’*_.)", "\"'‘“`$*[(-"

#: ASCII words with inner hyphens, not inside a longer Unicode word; atomic, so that a word is taken whole or not at all.
WORD = r"(?<![\p{L}\p{Nd}_])(?>[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?)(?![\p{L}\p{Nd}_])"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"


#: Stands after what looks like a sentence's end and isn't one; no text has this code point, which is no character.
GOES_ON = "\ufdd1"
#: An ellipsis, whatever quotes, brackets and blanks follow it, and "$ !", before white space: the sentence goes on.
_BLANK = r"[\s\x85\p{Z}]"
_NO_ENDS = (rf"((?:\.\.|…)[ \"'”’)\]}}]*)(?={_BLANK})", rf"(\$\s*!)(?={_BLANK})")
BREAK = rf"(?<={_class(ENDS)}{_class(CLOSERS)}{{0,2}}){_BLANK}+(?=[\p{{L}}\p{{Nd}}]|{_class(OPENERS)})"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts of over two bytes, stripped. A sentence ends with one of ENDS and up to two CLOSERS before white space."""
    for pattern in _NO_ENDS:
        text = F.regexp_replace(text, pattern, "$1" + GOES_ON)
    parts = F.transform(F.split(text, BREAK, -1), lambda s: F.regexp_replace(F.replace(s, F.lit(GOES_ON), F.lit("")), rf"^{_BLANK}+|{_BLANK}+$", ""))
    return F.filter(parts, lambda s: F.octet_length(s) > 2)


def prose_metrics(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, words, sentences, mean_sentence_length, sentence_length_std, burstiness_cv, colons_semicolons, em_dashes).

    Sentences without a word don't count in the mean, the deviation (n - 1) or their quotient, the coefficient of
    variation. A null text has no words and no sentences.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    # explode(array(...)) splits a text once
    split = df.select(key, content.alias("__text"), F.explode(F.array(sentences(content))).alias("__sentences"))
    lengths = F.filter(F.transform("__sentences", lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 0)
    counted = split.select(key, "__text", F.size("__sentences").alias("sentences"), F.explode(F.array(lengths)).alias("__n"))
    n, total = F.size("__n"), F.aggregate("__n", F.lit(0), lambda s, x: s + x)
    squares = F.aggregate("__n", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    mean = F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))
    variance = F.when(n > 1, (squares - total.cast("double") * total / n) / (n - 1)).otherwise(0.0)
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return counted.select(
        key,
        F.regexp_count("__text", F.lit(WORD)).cast("long").alias("words"),
        F.col("sentences").cast("long").alias("sentences"),
        F.round(mean, 6).alias("mean_sentence_length"),
        F.round(deviation, 6).alias("sentence_length_std"),
        F.round(F.coalesce(F.try_divide(deviation, mean), F.lit(0.0)), 6).alias("burstiness_cv"),
        F.regexp_count("__text", F.lit("[:;]")).cast("long").alias("colons_semicolons"),
        F.regexp_count("__text", F.lit("—")).cast("long").alias("em_dashes"),
    )
