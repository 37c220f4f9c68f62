"""String similarities without a built-in form, in Arrow batches; everything around them stays in the JVM."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks; the order of the two matters. Null or empty: 0."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Lower case without accents and ligatures."""
    ligatures = str.maketrans({"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "ð": "d", "þ": "th", "ł": "l"})

    def fold(x):
        if x is not None and x.isascii():
            return x.lower()
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.lower().translate(ligatures)) if not unicodedata.combining(c))

    return names.map(fold)


#: Words of titles that do not count.
TITLE_STOP_WORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "on", "at", "for", "is", "with", "by", "as")


def plain(text, separators=r"[._\-]+"):
    """Folded to lower case letters, digits and single spaces. What `separators` matches parts words."""
    out = F.regexp_replace(folded(text), separators, " ") if separators else folded(text)
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]+", " "), r"\s+", " "))


def _overlap(a, b):
    from shelfwise.operators.graph import jaccard

    return F.coalesce(jaccard(a, b), F.lit(0.0))


def name_similarity(a, b):
    """Three fifths of the sequence's ratio and two fifths of the words' overlap, of plain names; 0 if one has none."""
    x, y = plain(a, None), plain(b, None)
    words = lambda t: F.array_distinct(F.split(t, " "))
    return F.when((x == "") | (y == ""), 0.0).otherwise(0.6 * sequence_ratio(x, y) + 0.4 * _overlap(words(x), words(y)))


def title_similarity(a, b):
    """Half the sequence's ratio, 0.35 of the words' overlap without stop words and 0.15 if one holds the other, of plain
    titles; 0 if one has none."""
    x, y = plain(a), plain(b)
    words = lambda t: F.filter(F.array_distinct(F.split(t, " ")), lambda w: ~w.isin("", *TITLE_STOP_WORDS))
    score = 0.5 * sequence_ratio(x, y) + 0.35 * _overlap(words(x), words(y)) + F.when(x.contains(y) | y.contains(x), 0.15).otherwise(0.0)
    return F.when((x == "") | (y == ""), 0.0).otherwise(score)
