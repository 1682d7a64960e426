"""A corpus made ready for training: known languages, good quality, one of each near-copy, packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the rows they keep with the columns of docs;
the last returns the pieces of the packed sequences. Null and empty texts are rejected by the first
stage; an empty table passes as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outlast.llm import langid, neardup, packing, quality
from outlast.llm.queries import table, word_tokenizer
from outlast.llm.settings import configure
from outlast.session import cut_lineage


#: Words of a shingle in the near-dedup stage, whose measure is the share of common shingles, 0.8 or more.
SHINGLE_WORDS = 5


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the byte network rejects go."""
    configure(spark)
    return langid.keep_known_language(docs, langid.fit_languages(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go."""
    configure(spark)
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 with shingles of SHINGLE_WORDS words: one document of each group of near-copies stays."""
    configure(spark)
    return neardup.keep_one_of_each(docs, words=SHINGLE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left, packed into sequences of at most 4096 tokens."""
    configure(spark)
    return packing.pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each),
    ("packing", packed),
]

#: The trained stages have no SQL counterpart; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
