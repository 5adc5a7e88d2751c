"""A corpus pipeline of five stages, each of which calls one operator of ``sievelake.llm``.

Each stage takes all that the one before it kept. The first four return the columns of ``documents``; the last
returns the encoded corpus. In every stage null, empty and blank texts are the empty text, ids are integers that may
repeat or be null, other columns may have any names, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import bpe, exact_dedup, mixing, near_dedup, quality
from sievelake.llm.common import discard, made, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from the labels of these documents. Repeated rows stay or go
    together. A score of exactly one half stays; without labels all do."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(quality.sample(docs, labels)))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the longest, then the one of the smallest id; one without an id only
    where no other is as long. Of all empty texts one stays. Rows of one id with different texts are documents of their own."""
    return exact_dedup.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates (five-word shingles, similarity 0.8): the one of the smallest
    id, then of the smallest text. Documents without words and rows without an id have no links and stay."""
    return near_dedup.keep(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of each source by its target weight; documents may be cut or repeated. A null source is a source of its
    own; documents without words are not taken; rows of one id are documents of their own."""
    return mixing.texts(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to it: a row for each row, none for other columns."""
    return bpe.encoded(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again. Once it is written, the
    tables before it are deleted."""
    before = made(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        discard(spark, before, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the keyed permutations of the mix have no SQL form. A test holds ``run`` against plain versions of
#: all five stages on a small table.
ORACLE_SQL = None
