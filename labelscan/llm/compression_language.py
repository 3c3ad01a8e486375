"""Language of a text by compression: the language whose dictionary makes the text smallest.

For each language that labelled texts name, a bounded, hash-chosen sample of their pieces is joined into a raw
content dictionary of zstandard. A text is cut into pieces, each piece is compressed once with every language's
dictionary, and the sizes are added up over all pieces of the text, so that a long text leans on the dictionary
as much as a short one. The smallest sum names the language; a margin below ``MARGIN`` of it is too narrow to
rely on, and the row is marked as not accepted.

The sample is the only thing fitted: ``DICTIONARY`` bytes a language (less if there are very many languages).
It is chosen by a hash of doc_id and text below a bound that follows from the language's count, so about as many
pieces as are needed move, whatever share of the rows a language has; equal rows are one before they reach the
driver. Every text is then read once, by an Arrow task, without a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick

#: Bytes of a language's dictionary, of all dictionaries together, and of a sampled piece.
DICTIONARY, ALL_DICTIONARIES, SAMPLE_PIECE = 64 << 10, 32 << 20, 2_000
#: Pieces sampled for each piece that a dictionary has room for: short pieces and copies take less room.
SPARE = 4
#: Characters that are compressed at once, and zstandard's level.
PIECE, LEVEL = 4_000, 6
#: Least share of the smallest size by which the next one must be larger.
MARGIN = 0.01
#: The answer for texts without letters.
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
_HASHES = 1 << 32


def _uniform(*columns: str) -> Column:
    """A hash in [0, 2**32)."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(_HASHES - 1))


def learn(train: DataFrame, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary for each language of ``train`` (doc_id, text, lang) with a text that has letters.

    Two small results reach the driver: one count a language, and about ``SPARE`` times the pieces that the
    dictionaries hold. Rows with a null text or lang take no part; copies of a piece count once.
    """
    rows = pick(train, doc_id="long", text="string", lang="string").where("text is not null and lang is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    size = min(dictionary, ALL_DICTIONARIES // len(counts))
    room = max(1, size // SAMPLE_PIECE)
    few = room * SPARE
    # rows of rare languages are all taken; the others by a bound on the hash
    bounds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(_HASHES, _HASHES * few // n + 1))])
    # a long text gives a piece from anywhere in it
    length = F.length("text")
    start = F.when(length > SAMPLE_PIECE, F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), length - SAMPLE_PIECE)).otherwise(0) + 1
    chosen = rows.withColumn("h", _uniform("doc_id", "text")).where(F.col("h") < bounds[F.col("lang")])
    pieces = chosen.select("lang", "h", F.substr("text", start.cast("int"), F.lit(SAMPLE_PIECE)).alias("piece"))
    own: dict[str, list[str]] = {}
    for r in sorted(pieces.distinct().collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        own.setdefault(r["lang"], []).append(r["piece"].lower())
    out = {}
    for lang, texts in own.items():
        if texts := [t for t in dict.fromkeys(texts) if LETTER.search(t)]:
            out[lang] = "\n".join(texts).encode()[:size]
    return dict(sorted(out.items()))


class Classifier:
    """Compresses texts with every language's dictionary; frames carry no header but their blocks."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(level, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.languages = list(dictionaries)
        self.compressors = [
            z.ZstdCompressor(dict_data=z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress for x in dictionaries.values()
        ]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, margin, score): the margin is how much larger the next size is, as a share of the smallest."""
        if not self.languages or not text or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        text = text.lower()
        sizes = [0] * len(self.languages)
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE].encode()
            for k, compress in enumerate(self.compressors):
                sizes[k] += len(compress(piece))
        least = min(sizes)
        best = sizes.index(least)  # of equal sizes the first language by name
        others = sizes[:best] + sizes[best + 1 :]
        if not others:
            return self.languages[best], 1.0, 1.0
        following = min(others)
        return self.languages[best], (following - least) / least, 1 - least / following


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and the columns of ``keep``): lang_pred, score, margin, accepted.

    ``score`` is 1 - smallest / next size, between 0 and 1 (1 if only one language was learned); ``accepted``
    is false where the margin is narrower than asked, and for ``und``. A null text, an empty one, one without
    letters, and every text when no language was learned are ``und`` with score 0. Repeated rows and equal or
    null doc_ids are judged one by one; of equally small sizes the first language by name wins; other columns,
    also with clashing names, are ignored; texts of any length are read whole, piece by piece; an empty table
    gives an empty table.
    """
    rows = pick(docs, doc_id="long", text="string", **{c: docs.schema[c].dataType.simpleString() for c in keep})

    def run(batches):
        judge = Classifier(dictionaries)
        for batch in batches:
            found = [judge(x.as_py()) for x in batch.column("text")]
            langs, margins, scores = ([x[k] for x in found] for k in range(3))
            columns = {c: batch.column(c) for c in ("doc_id", *keep)} | {
                "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "margin": pa.array(margins, pa.float64()),
                "accepted": pa.array([a != UNKNOWN and b >= margin for a, b, _ in found], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id long{kept}, lang_pred string, score double, margin double, accepted boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document takes no part in learning: the CRC of its decimal doc_id leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, accepted per document; learned from those not held out.

    A document with a null doc_id is not held out. Cases as in ``learn`` and ``classify``.
    """
    train = pick(docs, doc_id="long", text="string", lang="string").where(~held_out())
    found = classify(docs, learn(train))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")
