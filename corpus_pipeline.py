"""From raw documents to token ids: STAGES in order, each written and read again.

Every stage takes any table with the columns of documents, and more, whatever
their names, and passes all columns on: null and empty texts stay unless a
stage says otherwise, rows without an id are never lost for it, equal rows are
judged alike and an empty table gives an empty one. A stage deletes what earlier
stages have staged in its thread: their results must be written by then.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.byte_bpe import byte_bpe
from larkspur.llm.decontaminate import without_contaminated
from larkspur.llm.ngram_jaccard import one_of_each
from larkspur.llm.quality import of_quality
from larkspur.llm.unit_dedup import cut_repeats
from larkspur.session import Scope, staged

_left = threading.local()  # scopes of the stages that this thread has called, by their place in STAGES


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [f.__name__ for _, f in STAGES].index(function.__name__)
        scopes = getattr(_left, "scopes", [])
        for earlier, scope in scopes:
            if earlier < place:
                scope.drop(spark, keep=docs)
        with Scope() as own:
            out = function(spark, docs, sf_dir)
        _left.scopes = [*((k, s) for k, s in scopes if k >= place), (place, own)]
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row by its own text; null and empty texts have a score, too."""
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word shingles with a ratio of 0.8: that of the smallest id. Texts without words and rows without an id stay; rows that share an id are one document."""
    return one_of_each(docs, size=5, num=8, den=10)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and runs of 50 words are cut out but for their earliest occurrence; n_chars follows. No row goes, a null text stays null."""
    return cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item, each row by its own text; null and empty texts stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what they decode to; a null or empty text has no tokens."""
    import public_tokenizers

    coded = byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The classifier and the alignment have no SQL form; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), name)
    return docs
