"""Corpus statistics: postings and lengths of the full-text index, and the vocabulary of the vectors.

The two term spaces differ: postings hold folded terms of any script with stop
words, the vocabulary holds expanded ASCII tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import index_terms, tokenize
from larkspur.functions.vectors import smoothed_idf


HEADING_TIMES = 3
ROWS = 2_000  # chunks that one step counts


def _whole(chunks: DataFrame) -> F.Column:
    return F.concat_ws(" ", "heading", "content")


def term_frequency(rows: DataFrame, tokens: F.Column, key: str) -> DataFrame:
    """(key, term, n, tf): share of each term among the tokens of a row. Rows without tokens have none."""
    each = rows.select(key, tokens.alias("tokens")).where(F.size("tokens") > 0)
    each = each.select(key, F.size("tokens").alias("total"), F.explode("tokens").alias("term"))
    # The tokens of a row stand together, so the partial count already is the count: one row for each term is shuffled.
    counts = each.groupBy(key, "term", "total").agg(F.count("*").alias("n"))
    return counts.select(key, "term", "n", (F.col("n") / F.col("total")).alias("tf"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) over heading and content."""
    terms = chunks.select("chunk_id", F.explode(index_terms(_whole(chunks))).alias("term"))
    return terms.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def terms(chunks: DataFrame) -> DataFrame:
    """(term): the distinct terms of the full-text index."""
    return chunks.select(F.explode(F.array_distinct(index_terms(_whole(chunks)))).alias("term")).distinct()


def words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, words) of tokenized() alone."""
    return chunks.select("chunk_id", index_terms(_whole(chunks)).alias("words"))


def tokens(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens) of tokenized() alone."""
    return chunks.select("chunk_id", boosted_tokens().alias("tokens"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_tokens) with stop words."""
    return chunks.select("chunk_id", F.size(index_terms(_whole(chunks))).cast("long").alias("n_tokens"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(term, df): chunks that hold the token."""
    terms = chunks.select(F.explode(F.array_distinct(tokenize(F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit("")))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def with_idf(frequencies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df), with the number of all chunks, those without tokens included."""
    total = chunks.agg(F.count("*").alias("n"))  # one row
    return frequencies.crossJoin(F.broadcast(total)).select("term", "df", smoothed_idf("n", "df").alias("idf"))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    return with_idf(document_frequency(chunks), chunks)


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, words, tokens) of each chunk: the terms of the full-text index, and the expanded tokens with those of the heading three times, as vectors weigh them."""
    return chunks.select("chunk_id", index_terms(_whole(chunks)).alias("words"), boosted_tokens().alias("tokens"))


def boosted_tokens() -> F.Column:
    """Tokens of a chunk with those of its heading three times."""
    heading = tokenize(F.coalesce("heading", F.lit("")))
    return F.concat(*[heading] * HEADING_TIMES, tokenize(F.coalesce("content", F.lit(""))))


def postings_of(tokens: DataFrame, with_lengths: bool = False) -> DataFrame:
    """postings() of tokenized chunks, with the number of all words of the chunk (n_tokens) if asked for, which needs no join here."""
    rest = [F.size("words").cast("long").alias("n_tokens")] if with_lengths else []
    rows = tokens.select("chunk_id", *rest, F.explode("words").alias("term"))
    return rows.groupBy("term", "chunk_id", *(["n_tokens"] if with_lengths else [])).agg(F.count("*").alias("tf"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            part = batch.slice(low, ROWS)
            words, chunks = part.column(1), part.column(0)
            sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = words.flatten().dictionary_encode()
            codes, distinct = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
            key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(distinct)) + codes, return_counts=True)
            at = key // max(1, len(distinct))
            cells = [distinct.take(pa.array(key % max(1, len(distinct)))).cast(pa.string()), chunks.take(pa.array(at)), pa.array(n, pa.int64()), pa.array(sizes[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["term", "chunk_id", "tf", "n_tokens"])


def postings_in_place(tokens: DataFrame) -> DataFrame:
    """postings_of() with n_tokens, counted by the task that reads a chunk: a chunk stands in one row, so nothing is shuffled."""
    return tokens.select("chunk_id", "words").mapInArrow(_counted, "term string, chunk_id long, tf long, n_tokens long")


def frequencies_of(tokens: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) of tokenized chunks: each token's share."""
    return term_frequency(tokens, F.col("tokens"), "chunk_id").select("chunk_id", "term", "tf")


def frequency_of(tokens: DataFrame) -> DataFrame:
    """document_frequency() of tokenized chunks."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
