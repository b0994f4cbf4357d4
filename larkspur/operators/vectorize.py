"""Hashed TF-IDF vectors as sparse rows, and cosine ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import hashed_dim, tokenize
from larkspur.functions.vectors import smoothed_idf
from larkspur.operators.forward import search_tokens, token_vectors
from larkspur.operators.lexical import top
from larkspur.operators.statistics import boosted_tokens, term_frequency
from larkspur.session import few, staged

DIMS = 1024
MIN_COSINE = 0.01
VOCAB_ROWS = 1_000_000  # terms that may be broadcast
ASKED_ROWS = 1_000_000  # cells of query vectors that may be broadcast


def hashed(frequencies: DataFrame, vocab: DataFrame, default: DataFrame, key: str, dims: int = DIMS) -> DataFrame:
    """(key, dim, w): signed sums of tf * idf by dimension, of unit length. default(idf_default) is one row.

    frequencies are best dealt by key: then nothing else is shuffled if the
    vocabulary is small enough to be broadcast. A larger one is joined by term,
    where Spark splits the terms that most rows have.
    """
    if dims <= 0:
        return frequencies.select(key, F.lit(0).alias("dim"), F.lit(0.0).alias("w")).limit(0)
    # Terms are hashed once each in the vocabulary; only unknown ones where they stand.
    dim, sign = hashed_dim("term", dims)
    terms = vocab.select("term", "idf", dim.alias("known_dim"), sign.alias("known_sign"))
    known = frequencies.join(few(terms, VOCAB_ROWS), "term", "left").crossJoin(F.broadcast(default))
    weight = F.coalesce("known_sign", sign) * F.col("tf") * F.coalesce("idf", "idf_default")
    cells = known.select(key, F.coalesce("known_dim", dim).alias("dim"), weight.alias("w"))
    sums = cells.groupBy(key, "dim").agg(F.sum("w").alias("w"))
    whole = sums.groupBy(key).agg(F.collect_list(F.struct("dim", "w")).alias("cells"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # at most dims cells
    unit = F.transform("cells", lambda x: F.struct(x["dim"].alias("dim"), F.when(F.col("norm") > 0, x["w"] / F.col("norm")).otherwise(x["w"]).alias("w")))
    return whole.select(key, F.inline(unit))


def chunk_vectors(chunks: DataFrame, vocab: DataFrame, dims: int = DIMS) -> DataFrame:
    """(chunk_id, dim, w). Chunks without tokens have no rows. Texts are dealt by chunk, and all sums follow that."""
    default = chunks.agg(smoothed_idf(F.count("*"), F.lit(0)).alias("idf_default"))
    dealt = chunks.select("chunk_id", "heading", "content").repartition("chunk_id")
    return hashed(term_frequency(dealt, boosted_tokens(), "chunk_id"), vocab, default, "chunk_id", dims)


def vector_search_tokens(queries: DataFrame, vocab: DataFrame, tokens: DataFrame, k: int, dims: int = DIMS, chunks: int | None = None) -> DataFrame:
    """vector_search() over tokens(chunk_id, tokens) of chunks, whose vectors are made where they are scored. vocab(term, df, idf) is that of these chunks; `chunks` is their number for unknown terms, by default of those with tokens."""
    sizes = tokens.agg(F.count("*").alias("all"), F.count_if(F.size("tokens") > 0).alias("filled")).first()
    asked = query_vectors(queries, vocab.select("term", "idf"), tokens, dims, sizes["filled"] if chunks is None else chunks)
    asked = staged(asked, "asked")
    found = search_tokens(asked, tokens, vocab.select("term", "df"), sizes["all"], k, dims, MIN_COSINE)
    if found is None:
        vectors = staged(token_vectors(tokens, vocab.select("term", "df"), sizes["all"], dims), "vectors")
        found = vector_search(queries, vocab, vectors, k, dims, sizes["filled"] if chunks is None else chunks)
    return found


def query_vectors(queries: DataFrame, vocab: DataFrame, vectors: DataFrame, dims: int = DIMS, chunks: int | None = None) -> DataFrame:
    """(query_id, dim, w); unknown terms get the idf of a corpus ten chunks larger. With `chunks`, their number is known and not counted."""
    if chunks is None:
        default = vectors.select("chunk_id").distinct().agg(smoothed_idf(F.count("*") + 10, F.lit(0)).alias("idf_default"))
    else:
        default = queries.sparkSession.range(1).select(smoothed_idf(F.lit(chunks + 10), F.lit(0)).alias("idf_default"))
    asked = term_frequency(queries, tokenize("query"), "query_id")
    vocab = staged(vocab.join(few(asked.select("term").distinct(), ASKED_ROWS), "term", "left_semi"), "asked_terms")
    return hashed(asked, vocab, default, "query_id", dims)


def vector_search(queries: DataFrame, vocab: DataFrame, vectors: DataFrame, k: int, dims: int = DIMS, chunks: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, from MIN_COSINE on: a join on the few dimensions of a query.

    What the join leaves is summed where it stands before it is dealt by chunk.
    Vectors stored by `part`, runs of 64 dimensions, are read for the parts that
    the queries have.
    """
    asked = staged(query_vectors(queries, vocab, vectors, dims, chunks).withColumnRenamed("w", "qw"), "asked")
    if "part" in vectors.columns:
        parts = [r[0] for r in asked.select(F.floor(F.col("dim") / 64).cast("int")).distinct().collect()]  # dims / 64 at most
        vectors = vectors.where(F.col("part").isin(parts)).drop("part")
    rows = vectors.join(few(asked, ASKED_ROWS), "dim")
    scored = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("score"))
    return top(scored.where(F.col("score") >= MIN_COSINE), k)
