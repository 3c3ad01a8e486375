"""From raw documents to token ids: each stage works on the table that the stage before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.llm.bottom_k import near_duplicates
from labelscan.llm.bpe_chunks import encode_decode
from labelscan.llm.common import pick, staged, table
from labelscan.llm.domain_mixing import mix
from labelscan.llm.pii_tagger import redact
from labelscan.llm.quality_cascade import quality
from labelscan.llm.queries import tokenizer_path

#: The columns of documents.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}

#: Target shares of the tokens; documents of poor quality are gone by then.
TARGETS = {"good": 0.97, "toxic": 0.03}

#: Similarity in percent from which documents are near duplicates, and the size of their sketches.
PERCENT, K = 80, 48


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts are among them."""
    return quality(pick(docs, **COLUMNS)).where("rejected_by is null").drop("rejected_by")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id stays (all rows of that doc_id)."""
    rows = pick(docs, **COLUMNS)
    gone = near_duplicates(rows, PERCENT, k=K).where(~F.col("kept")).select("doc_id").distinct()
    return rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; all rows stay."""
    return redact(pick(docs, **COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row comes as often as its rate says: not at all, once, or repeated."""
    mixed = mix(docs, table(spark, sf_dir, "labels"), TARGETS, keep={k: v for k, v in COLUMNS.items() if k not in ("doc_id", "text")})
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text that they decode to."""
    return encode_decode(docs, tokenizer_path(), more=("ids",))


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_dedup), ("personal data", personal_data), ("mixing", mixing), ("tokens", tokens),
]

#: Trained models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
