"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a boolean expression that rejects a document. On a bounded sample each rule's cost (seconds) and
selectivity (share of rejected rows) are measured; rules are ordered by rejection per cost and evaluated in
that order inside one CASE, so a document that one rule rejects never reaches the dearer ones. The order
changes the work only: the verdict is the same for every order.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick, staged, text_place

#: Rows that costs and selectivities are measured on.
SAMPLE_ROWS = 2000

#: White space that ends words, as a character class of regular expressions and as characters.
BLANK, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Thresholds of the rules.
LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES, MOST_SHOUTED, WORD_LENGTHS = 50, 0.5, 0.1, 0.5, 0.5, (1.5, 20)


def words(text: Column) -> Column:
    """The words of a text."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, BLANK)).otherwise(F.array().cast("array<string>"))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more, for the text's words."""
    width = 3

    def windows(x):
        return F.transform(F.slice(x, 1, F.greatest(F.size(x) - (width - 1), F.lit(0))), lambda a, i: F.xxhash64(a, F.get(x, i + 1), F.get(x, i + 2)))

    def repeated(h):
        """Sorted places of the windows whose hash a neighbour in hash order shares."""
        ordered = F.sort_array(F.transform(h, lambda a, i: F.struct(a.alias("h"), i.alias("i"))))
        near = lambda s, j: F.get(s, j)["h"]
        same = _let(ordered, lambda s: F.filter(s, lambda a, j: near(s, j - 1).eqNullSafe(a["h"]) | near(s, j + 1).eqNullSafe(a["h"])))
        return F.sort_array(F.transform(same, lambda a: a["i"]))

    def covered(at):
        steps = F.transform(at, lambda a, j: F.least(F.coalesce(F.get(at, j + 1) - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, a: total + a)

    return _let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(repeated(h), covered)))


def shouted(text: Column) -> Column:
    """Whether capitals are more than their share of the ASCII letters."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    small = F.length(text) - F.length(F.translate(text, "abcdefghijklmnopqrstuvwxyz", ""))
    return capitals > (capitals + small) * MOST_SHOUTED


def rules(text: str = "text", counts: dict[str, str] | None = None) -> dict[str, Column]:
    """The rejecting rules over a text column; ``counts`` names columns that already hold a measure."""
    t, have = F.coalesce(F.col(text), F.lit("")), counts or {}
    n = F.col(have["n_words"]) if "n_words" in have else F.size(words(t))
    measure = {
        "word_chars": lambda: word_chars(t), "n_symbols": lambda: n_symbols(t), "n_dup_lines": lambda: n_dup_lines(t),
        "n_repeat_words": lambda: n_repeat_words_of(t),
    }
    of = {k: F.col(have[k]) if k in have else make() for k, make in measure.items()}
    n_lines = F.size(F.split(t, "\n"))
    return {
        "few_words": n < LEAST_WORDS,
        "repeated_words": of["n_repeat_words"] * 100 > n * int(100 * MOST_REPEATED),
        "symbols": of["n_symbols"] > n * MOST_SYMBOLS,
        "repeated_lines": of["n_dup_lines"] > n_lines * MOST_DUP_LINES,
        "shouting": shouted(t),
        "word_length": ~of["word_chars"].between(n * WORD_LENGTHS[0], n * WORD_LENGTHS[1]) & (n > 0),
    }


def n_repeat_words_of(text: Column) -> Column:
    return _let(words(text), n_repeat_words)


def ordered_rules(docs: DataFrame, found: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, best rejection per cost first, by a sample of ``sample_rows`` rows of ``docs``."""
    sample = staged(docs.limit(sample_rows))
    total = max(sample.count(), 1)
    score = {}
    for name, rule in found.items():
        began = time.perf_counter()
        rejected = sample.where(rule).count()
        score[name] = (rejected / total) / max(time.perf_counter() - began, 1e-6)
    return sorted(found, key=lambda name: (-score[name], name))


def verdict(found: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule, in ``order``, that rejects the row, else null; later rules are not evaluated."""
    out = None
    for name in order:
        out = F.when(found[name], name) if out is None else out.when(found[name], name)
    return out


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``docs`` with a text, and rejected_by string (null: the document is kept).

    Null and empty texts have no words and are rejected. Ties and repeated rows are judged row by row; an empty
    table gives no rows. The text is the column of exactly that name, else one that differs in case; other columns
    pass through, clashing names included.
    """
    order = ordered_rules(pick(docs, text="string"), rules("text"), sample_rows)
    # columns by position: their names may clash
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    judged = flat.withColumn("rejected_by", verdict(rules(f"c{text_place(docs.columns)}"), order))
    return judged.toDF(*docs.columns, "rejected_by")


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the measures n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, base_failed, kept.

    One row per row of ``docs`` (doc_id, text). Null and empty texts have no words, so base_failed holds.
    """
    rows = pick(docs, doc_id="long", text="string")
    counts = {c: c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    t = F.coalesce("text", F.lit(""))
    measured = rows.select("doc_id", "text", words(t).alias("w")).select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    found = rules("text", counts)
    order = ordered_rules(rows.select("text"), rules("text"), sample_rows)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measured.select("doc_id", *counts, failed.alias("base_failed"), (~failed & verdict(found, order).isNull()).alias("kept"))
