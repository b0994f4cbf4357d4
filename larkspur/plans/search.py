"""Hybrid search over the tables of an index: lexical and vector ranks, fused."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.chunker import chunk
from larkspur.operators.dense import dense_search
from larkspur.operators.fusion import fuse
from larkspur.operators.forward import search_words, token_vectors
from larkspur.operators.lexical import lexical_search, stored_search
from larkspur.operators.maintain import chunk_id
from larkspur.operators.statistics import frequency_of, postings_of, tokenized, with_idf
from larkspur.operators.vectorize import DIMS, MIN_COSINE, vector_search, vector_search_tokens
from larkspur.schemas import QUERIES
from larkspur.session import staged
from larkspur.sources.provider import Embed, embed_rows

OVERFETCH = 4
DEFAULT_LIMIT, MAX_LIMIT = 5, 20
CACHE_ENTRIES = 256
FEW_QUERIES = 20  # whose results are looked up among the chunks by their ids


def clamp(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MAX_LIMIT)


@dataclass
class Index:
    """documents, chunks and what is derived from them. Batches of queries read tokens(chunk_id, words, tokens); postings and vectors are made when they are first asked for."""

    documents: DataFrame
    chunks: DataFrame
    tokens: DataFrame
    lengths: DataFrame
    vocab: DataFrame
    make_postings: Callable[[], DataFrame]
    make_vectors: Callable[[], DataFrame]
    facts: tuple[int, int] | None = None  # of a stored index: the numbers of chunks and of their tokens,
    make_terms: Callable[[], DataFrame] | None = None  # the dictionary (term, n, range, seq), which a search of few phrases asks for,
    ranged: Callable[[dict[int, list[int]]], DataFrame] | None = None  # and the postings of some of its ranges

    @staticmethod
    def build(documents: DataFrame, chunks: DataFrame, dims: int = DIMS) -> Index:
        """Statistics are a pure function of the chunks; each table is stored once and read from then on."""
        chunks = staged(chunks, "chunks")
        tokens = staged(tokenized(chunks), "tokens")
        vocab = staged(with_idf(frequency_of(tokens), chunks), "vocab")
        # Sorted by term, so that look-ups of few terms skip row groups.
        terms = lambda: staged(postings_of(tokens).repartitionByRange("term").sortWithinPartitions("term"), "postings")
        vectors = lambda: staged(token_vectors(tokens, vocab, chunks.count(), dims), "vectors")
        return Index(documents, chunks, tokens, tokens.select("chunk_id", F.size("words").cast("long").alias("n_tokens")), vocab, terms, vectors)

    @cached_property
    def postings(self) -> DataFrame:
        return self.make_postings()

    @cached_property
    def terms(self) -> DataFrame:
        return self.make_terms()

    @cached_property
    def vectors(self) -> DataFrame:
        return self.make_vectors()


def build_from_files(files: DataFrame, fence_aware: bool = False, dims: int = DIMS) -> Index:
    """An index of files(doc_id, path, body)."""
    rows = chunk(files, fence_aware=fence_aware)
    chunks = rows.select(chunk_id().alias("chunk_id"), "doc_id", "chunk_idx", "heading", "content")
    return Index.build(files.select("doc_id", "path"), chunks, dims)


def search_batch(index: Index, queries: DataFrame, limit: int = DEFAULT_LIMIT, dims: int = DIMS, embedded: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, path, heading, content, score, label) for queries(query_id, query), one plan for all of them.

    With embedded(chunk_id, vector) and query_vectors(query_id, vector) of an
    external model those take the place of the hashed vectors. Queries that are
    null, empty or of stop words only find nothing.
    """
    k = limit * OVERFETCH
    queries = queries.where("query is not null")
    lexical = stored_search(queries, lambda: index.terms, index.ranged, index.facts, k) if index.ranged else None
    few = lexical is not None
    if lexical is None:
        lexical = search_words(queries, index.tokens, k)
    if lexical is None:
        lexical = lexical_search(queries, index.postings, index.lengths, k)
    if embedded is not None and query_vectors is not None:
        vector = dense_search(query_vectors, embedded, k, MIN_COSINE)
    elif few and _small(queries, FEW_QUERIES):
        vector = vector_search(queries, index.vocab, index.vectors, k, dims, index.facts[0])
    else:
        vector = vector_search_tokens(queries, index.vocab, index.tokens, k, dims, index.facts[0] if index.facts else None)
    # Texts are joined to the few rows that are left.
    best = fuse(lexical, vector, limit)
    chunks = index.chunks.select("chunk_id", "doc_id", "heading", "content")
    if _small(queries, FEW_QUERIES):
        rows = best.collect()  # limit rows for each of few queries
        best = best.sparkSession.createDataFrame(rows, best.schema)
        chunks = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in rows]))
    return chunks.join(F.broadcast(best) if _small(queries) else best, "chunk_id").join(index.documents.select("doc_id", "path"), "doc_id").select("query_id", "rank", "chunk_id", "path", "heading", "content", "score", "label")


def _small(queries: DataFrame, most: int = 10_000) -> bool:
    """Whether a batch is small enough for its results, MAX_LIMIT rows a query, to be broadcast."""
    return queries.limit(most + 1).count() <= most


class Searcher:
    """Single queries, with the latest results kept by snapshot, query and limit. With embedded and connect the vectors are those of a model."""

    def __init__(self, index: Index, snapshot: str = "", dims: int = DIMS, embedded: DataFrame | None = None, connect: Callable[[], Embed] | None = None):
        self.index, self.snapshot, self.dims, self.embedded, self.connect = index, snapshot, dims, embedded, connect
        self._kept: OrderedDict[tuple, list] = OrderedDict()

    def search(self, query: str, limit: int = DEFAULT_LIMIT) -> list:
        key = (self.snapshot, query, limit)
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        frame = self.index.chunks.sparkSession.createDataFrame([(0, query)], QUERIES)
        asked = embed_rows(frame, F.col("query"), self.connect).select("query_id", "vector") if self.connect and self.embedded is not None else None
        rows = search_batch(self.index, frame, limit, self.dims, self.embedded if asked is not None else None, asked).orderBy("rank").collect()
        self._kept[key] = rows
        if len(self._kept) > CACHE_ENTRIES:
            self._kept.popitem(last=False)
        return rows

    def clear(self) -> None:
        self._kept.clear()
