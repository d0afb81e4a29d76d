"""From raw documents to token sequences: quality filter, exact and near-duplicate removal, source mix, encoding.

All stages but the last return the columns that they were given, whatever their names; an empty table gives an empty
one. Rows that repeat, and rows without identifier, are rows of their own until a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode, tokenizer_path
from tessera.llm.common import staged, table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.jaccard_join import near_dedup
from tessera.llm.mixing import mix
from tessera.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is judged by the bias alone; without labels of both classes all documents stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier stays.

    A null text equals an empty one. A row without identifier stays only where no equal text has one, and then one of
    them; of rows that repeat text and identifier one stays.
    """
    return exact_dedup(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest identifier stays.

    Texts without words, and rows without identifier, stay.
    """
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as their source's target takes them, a copy a row.

    Documents without words are taken 0 times; a null source is a source.
    """
    return mix(docs, whole=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding of each row: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text has no tokens."""
    return encode(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixture), ("encode", tokens)]

#: Learned weights and token merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
