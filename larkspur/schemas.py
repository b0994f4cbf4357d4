"""Schemas of the corpus tables."""

from __future__ import annotations

SCHEMA_VERSION = 3

FILE = "path string, body string"
DOCUMENTS = "doc_id long, path string, title string, ingested_at timestamp"
CHUNKS = "chunk_id long, doc_id long, chunk_idx int, heading string, content string"
POSTINGS = "term string, chunk_id long, tf long"
VOCAB = "term string, df long, idf double"
CHUNK_VEC = "chunk_id long, dim int, w double"
EMBEDDED = "chunk_id long, digest string, vector array<float>"
QUERIES = "query_id long, query string"
RESULT = "query_id long, rank int, chunk_id long, path string, heading string, content string, score double, label string"
