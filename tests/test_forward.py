"""Searches over the words of chunks where they stand, against the plans over tables."""

import numpy as np
import pytest

from larkspur.operators import forward, statistics
from larkspur.operators.lexical import lexical_search, match
from larkspur.operators.vectorize import chunk_vectors, vector_search, vector_search_tokens
from larkspur.plans.search import build_from_files, search_batch
from larkspur.plans.store import Store
from larkspur.session import staged

QUERIES = ["w000 w001", "w150 w151 w152 w003", "w04", "w01 w02", "w005 w005 w190", "oom zzz w007", "zzz", "", None, "the"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    words = np.array([f"w{i:03d}" for i in range(200)] + [f"w{i:03d}x" for i in range(50)] + ["oomkilled", "élève", "x" * 3000])
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum())) + f" only{i}" for i in range(400)]
    texts[300:330] = texts[:30]  # ties
    texts += ["", "the of", None]
    rows = [((i // 3) * 2**20 + i % 3, "Oom fix" if i % 9 == 0 else "", t) for i, t in enumerate(texts)]
    chunks = staged(spark.createDataFrame(rows, "chunk_id long, heading string, content string").repartition(3), "chunks")
    return chunks, staged(statistics.tokenized(chunks), "tokens"), spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def _rows(df):
    return sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_scores_of_words(spark, corpus, monkeypatch):
    chunks, tokens, queries = corpus
    tables = staged(statistics.postings(chunks), "postings"), staged(statistics.chunk_lengths(chunks), "lengths")
    monkeypatch.setattr(forward, "CELLS", 70)  # seven chunks at a time
    every, found = forward.match_words(queries, tokens), forward.search_words(queries, tokens, 5)
    assert _rows(every) == _rows(match(queries, *tables)) != []
    assert _rows(found) == _rows(lexical_search(queries, *tables, 5)) != []
    assert "Exchange" not in every._jdf.queryExecution().toString()  # neither postings nor their parts are shuffled
    assert forward.search_words(queries.where("query is null"), tokens, 5).collect() == []
    monkeypatch.setattr(forward, "ASKED", 3)
    assert forward.search_words(queries, tokens, 5) is None


@pytest.mark.parametrize("head", [1_000_000, 40, 1])
def test_vectors_of_tokens(spark, corpus, head, monkeypatch):
    chunks, tokens, queries = corpus
    vocab = staged(statistics.vocabulary(chunks), "vocab")
    vectors = staged(chunk_vectors(chunks, vocab, 64), "vectors")
    assert _rows(forward.token_vectors(tokens, vocab, chunks.count(), 64, head)) == _rows(vectors)
    monkeypatch.setattr(forward.search_tokens, "__defaults__", (head,))
    found = vector_search_tokens(queries, vocab, tokens, 5, 64)
    assert _rows(found) == _rows(vector_search(queries, vocab, vectors, 5, 64)) != []


def test_prefixes_need_no_postings(spark, corpus):
    chunks, _, _ = corpus
    assert _rows(statistics.terms(chunks)) == _rows(statistics.postings(chunks).select("term").distinct())


def test_batches_make_no_postings_or_vectors(spark, tmp_path):
    """A batch reads tokens: it neither makes the postings and vectors of an index, nor the stored vectors of a version."""
    files = [(i, f"a/{i:02d}.md", f"# Doc {i}\n## en\n" + " ".join(f"word{(i * j) % 17}" for j in range(12))) for i in range(40)]
    files = staged(spark.createDataFrame(files, "doc_id long, path string, body string"), "files")
    queries = spark.createDataFrame([(i, f"word{i % 17} doc{i} " + " ".join(f"q{i}x{j}" for j in range(80))) for i in range(30)], "query_id long, query string")
    index = build_from_files(files)
    found = _rows(search_batch(index, queries).select("query_id", "rank", "path", "score"))
    assert found and not {"postings", "vectors"} & set(index.__dict__)
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files.select("path", "body"))
    assert _rows(search_batch(store.index(), queries).select("query_id", "rank", "score")) == sorted((tuple(x for x in r if not isinstance(x, str)) for r in found), key=repr)
    assert not store.log.exists(f"{store.root}/vectors") and "tokens" in store.record()["segments"][0]["tables"]
