"""Arrow UDFs for the matching-blocks similarity ratio, which Spark lacks (UDF-3).

Each UDF works on the distinct non-null values of an Arrow batch only; callers pass
null for rows that an exact test has already settled, so few rows are scored.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscan.functions import vocab as V


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _per_distinct(values: pd.Series, fn) -> pd.Series:
    known = {v: fn(v) for v in values.dropna().unique()}
    return values.map(known, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two text columns; null when either is null."""
    seen: dict = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts cannot exceed: twice their common letters, as a multiset, by their lengths."""
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    letters = F.array_distinct(F.split(a, ""))
    common = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(2.0 * common / (F.length(a) + F.length(b)))


def length_bound(a: Column, b: Column) -> Column:
    """A cheaper, higher bound of the ratio, by lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def with_similarity(rows: DataFrame, a: str, b: str, least: float = 0.0, name: str = "ratio") -> DataFrame:
    """``rows`` with the ratio of two text columns in ``name`` (UDF-3).

    Distinct pairs that the bounds leave are scored once and joined back, so a pair that fills a third of the
    table is scored once too. Null where a text is null or the ratio is below ``least``. Other columns stay as
    they are, repeated rows as well; ``a``, ``b`` and ``name`` must be unambiguous names.
    """
    both = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL")
    if least > 0:
        x, y = F.col("_a"), F.col("_b")
        both = both.filter((length_bound(x, y) >= least) & (ratio_bound(x, y) >= least))
    scored = both.distinct().select("_a", "_b", similarity(F.col("_a"), F.col("_b")).alias(name)).filter(F.col(name) >= least)
    same = (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))
    return rows.join(scored, same, "left").drop("_a", "_b")


class FixedWords:
    """A fixed list of words, each indexed once, that texts are compared with.

    A text's similarity with a word is bounded from above by their lengths and by their common letters, which
    settles most words before any blocks are matched. ``extra`` cuts texts to that many letters beyond a word.
    """

    def __init__(self, words, extra: int | None = None):
        self.words, self.extra = list(words), extra
        self.matchers = [SequenceMatcher(None, "", word) for word in self.words]

    def _bounds(self, text: str, least: float):
        """(upper bound, place) of the words that can reach ``least``."""
        for place, matcher in enumerate(self.matchers):
            matcher.set_seq1(text if self.extra is None else text[: len(matcher.b) + self.extra])
            if matcher.real_quick_ratio() >= least:
                bound = matcher.quick_ratio()
                if bound >= least:
                    yield bound, place

    def closest(self, text: str, least: float) -> int | None:
        """Place of the most similar word (the first of equals) if it reaches ``least``.

        Words are matched in the order of their bounds, as long as a bound can still beat the best match.
        """
        best = (-least, len(self.words))
        for bound, place in sorted(self._bounds(text, least), key=lambda x: (-x[0], x[1])):
            if -bound > best[0]:
                break
            best = min(best, (-self.matchers[place].ratio(), place))
        return best[1] if best[1] < len(self.words) else None

    def has(self, text: str, least: float) -> bool:
        """Whether any word reaches ``least``."""
        return any(self.matchers[place].ratio() >= least for _, place in self._bounds(text, least))


def compact_form(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789")


VARIANTS = [(c, compact_form(v)) for c, vs in V.CANONICAL_LABELS.items() for v in vs]
LONG_VARIANTS = [(c, v) for c, v in VARIANTS if len(v) >= V.LABEL_FUZZY_LENGTH]

#: Texts whose answer a worker remembers from batch to batch.
REMEMBERED = 1 << 16
LABEL_WORDS = FixedWords((v for _, v in LONG_VARIANTS), extra=2)
COUNTRY_WORDS = FixedWords(V.COUNTRIES)
STATUTORY_WORDS = FixedWords(target for target, _ in V.STATUTORY_TARGETS)
HEADER_WORDS = FixedWords(V.NAME_HEADER_WORDS)


@lru_cache(REMEMBERED)
def closest_label(compact: str) -> str | None:
    """Concept of the long label variant that the beginning of the text resembles most, if any does."""
    place = LABEL_WORDS.closest(compact, V.LABEL_FUZZY_RATIO)
    return None if place is None else LONG_VARIANTS[place][0]


@F.pandas_udf(T.StringType())
def fuzzy_label(compact: pd.Series) -> pd.Series:
    return _per_distinct(compact, closest_label).astype(object)


@lru_cache(REMEMBERED)
def closest_country(value: str) -> str | None:
    """The most similar known country, if it begins alike and is hardly shorter than the value."""
    place = COUNTRY_WORDS.closest(value, V.COUNTRY_RATIO) if len(value) > 3 else None
    if place is None:
        return None
    country = COUNTRY_WORDS.words[place]
    return country if country.startswith(value[:3]) and len(country) >= len(value) - 2 else None


@F.pandas_udf(T.StringType())
def fuzzy_country(value: pd.Series) -> pd.Series:
    return _per_distinct(value, closest_country).astype(object)


@lru_cache(REMEMBERED)
def statutory_like(word: str) -> bool:
    """The (damaged) word resembles a statutory target word."""
    return STATUTORY_WORDS.has(word, V.CORRUPTED_MIN_RATIO)


@F.pandas_udf(T.IntegerType())
def first_statutory_word(words: pd.Series) -> pd.Series:
    """Position (0-based) of the first word of an array that resembles a target, else null."""
    position = lambda ws: next((i for i, w in enumerate(ws) if statutory_like(w)), None)
    return pd.Series([None if ws is None else position(ws) for ws in words], dtype="Int32")


@lru_cache(REMEMBERED)
def header_like(token: str) -> bool:
    """The token equals a header word or, from five letters on, resembles one."""
    return token in V.NAME_HEADER_WORDS or (len(token) >= 5 and HEADER_WORDS.has(token, V.NAME_HEADER_RATIO))


@F.pandas_udf(T.BooleanType())
def any_header_word(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else any(map(header_like, ts)) for ts in tokens], dtype="boolean")
