"""Providers, dense search, streaming, the command line and the driver's contract."""

import json

import numpy as np
import pytest

import __spark_entry__ as entry
from larkspur import cli
from larkspur.functions.vectors import bytes_to_floats, floats_to_bytes, from_bytes
from larkspur.operators.dense import DenseIndex, dense_search
from larkspur.operators.maintain import number_rows
from larkspur.plans.store import Store
from larkspur.sources.provider import embed_missing, http_embedder
from larkspur.streaming.ingest import follow
from larkspur.tools import Tools


def test_provider_embeds_only_what_changed(spark):
    chunks = spark.createDataFrame([(1, "a", "x"), (2, "b", ""), (3, "c", "z")], "chunk_id long, heading string, content string")

    def connect():
        return lambda texts: [None if t.startswith("c") else [float(len(t)), 0.0, 4.0] for t in texts]

    none = spark.createDataFrame([], "chunk_id long, digest string, vector array<float>")
    first = embed_missing(chunks, none, connect).collect()
    assert {r["chunk_id"]: r["vector"] is None for r in first} == {1: False, 2: False, 3: True}
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in first if r["vector"])
    known = spark.createDataFrame(first, none.schema)
    again = embed_missing(chunks, known, lambda: lambda texts: [[9.0, 9.0, 9.0] for _ in texts]).collect()
    changed = {r["chunk_id"] for r in again if abs(r["vector"][0] - 3**-0.5) < 1e-6}
    assert changed == {3}


def test_equal_texts_are_embedded_once(spark):
    sent = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(k, "h", f"text {k % 3}") for k in range(60)], "chunk_id long, heading string, content string").repartition(5)

    def connect():
        def embed(texts):
            sent.add(len(texts))
            return [[float(t[-1]), 1.0] for t in texts]

        return embed

    none = spark.createDataFrame([], "chunk_id long, digest string, vector array<float>")
    rows = embed_missing(chunks, none, connect).collect()
    assert len(rows) == 60 and all(abs(r["vector"][0] / r["vector"][1] - r["chunk_id"] % 3) < 1e-6 for r in rows) and sent.value == 3
    more = chunks.unionByName(spark.createDataFrame([(99, "h", "text 1"), (100, "h", "text 9")], chunks.schema))
    again = embed_missing(more, spark.createDataFrame(rows, none.schema), connect).collect()
    assert len(again) == 62 and sent.value == 4


def test_failed_batches_are_tried_again_in_halves(monkeypatch):
    calls = []

    class Answer:
        def __init__(self, texts):
            self.raw = json.dumps({"embeddings": [[float(len(t))] for t in texts]})

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, *_):
            return self.raw

    def urlopen(request, timeout):
        texts = json.loads(request.data)["input"]
        calls.append(len(texts))
        if "bad" in texts or len(calls) == 1:
            raise OSError("down")
        return Answer(texts)

    monkeypatch.setattr("urllib.request.urlopen", urlopen)
    embed = http_embedder("http://localhost/x", "m", tries=2, wait=0)()
    assert embed(["a", "bb"]) == [[1.0], [2.0]] and calls == [2, 2]
    assert embed(["a", "bad", "ccc", "dd"]) == [[1.0], None, [3.0], [2.0]]


def test_dense_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0])]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in (3, 50)], "query_id long, vector array<double>")
    got = dense_search(queries, table, 4).collect()
    for q in (3, 50):
        want = np.argsort(-(x @ x[q]))[:4].tolist()
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert dense_search(queries.limit(0), table, 4).collect() == []


def test_number_rows(spark):
    names = [f"n{k:03d}" for k in range(50)]
    rows = number_rows(spark.createDataFrame([(n,) for n in reversed(names)], "path string"), "path", "id", 7).collect()
    assert {r["path"]: r["id"] for r in rows} == {n: 8 + k for k, n in enumerate(names)}


def test_stream_follows_a_folder(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\nalpha words")
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: follow(spark, str(docs), store, f"file://{tmp_path}/state").awaitTermination(120)
    run()
    assert store.table("chunks").count() == 1
    (docs / "b.md").write_text("# B\nbeta\n## C\ngamma")
    run()
    assert sorted(r["heading"] for r in store.table("chunks").collect()) == ["A", "B", "C"]


def test_json_lines(spark, tmp_path):
    tools = Tools(spark, Store(spark, f"file://{tmp_path}/store"))
    ask = lambda method, **params: cli.answer(tools, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    assert ask("ping")["result"] == {}
    assert len(ask("tools/list")["result"]["tools"]) == 5
    assert ask("nothing")["error"]["code"] == -32601
    assert cli.answer(tools, "{")["error"]["code"] == -32700
    assert cli.answer(tools, '{"method": "notifications/initialized"}') is None
    assert ask("tools/call", name="search_knowledge", arguments={"query": ""})["error"]["code"] == -32602
    ask("tools/call", name="write_knowledge", arguments={"path": "a.md", "heading": "H", "content": "some words"})
    assert "some words" in ask("tools/call", name="search_knowledge", arguments={"query": "some words"})["result"]["content"][0]["text"]
    assert ask("tools/call", name="delete_knowledge", arguments={"path": "zz"})["error"]["code"] == -32603


def test_contract(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found)
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"query_id", "rank", "chunk_id", "path", "heading", "content", "score", "label"}


@pytest.mark.parametrize("name", ["sections", "bm25_topk", "vector_topk", "upsert_documents", "preview", "dense_clusters", "vector_bytes", "store_pages"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from larkspur.registry import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    mine, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(str, mine[cols].itertuples(index=False))) == sorted(map(str, theirs[cols].itertuples(index=False)))


def test_vector_bytes(spark):
    rows = [(0, [1.0, 2.5]), (1, None), (2, []), (3, [None, 1.0]), (4, [3.0]), (5, [float("nan")]), (6, [1.0] * 700)]
    table = spark.createDataFrame(rows, "id int, v array<double>").repartition(2)
    got = {r["id"]: r for r in table.select("id", floats_to_bytes("v").alias("raw"), bytes_to_floats(floats_to_bytes("v")).alias("back")).collect()}
    for k, v in rows:
        want = None if not v or None in v else np.array(v, "<f4").tobytes()
        assert got[k]["raw"] == want and from_bytes(want) == (None if want is None else got[k]["back"]) or k == 5
    raw = spark.createDataFrame([(b"",), (None,), (b"abc",), (np.array([1.0], "<f4").tobytes(),), (b"12345",)], "raw binary")
    assert [r[0] for r in raw.coalesce(1).select(bytes_to_floats("raw")).collect()] == [None, None, None, [1.0], None]


@pytest.mark.parametrize("pivots", [1, 9, 256])
def test_dense_clusters_match_brute_force(spark, tmp_path, pivots):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 12)) * 3
    x = np.concatenate([c + rng.standard_normal((70, 12)) * 0.2 for c in centers] + [rng.standard_normal((30, 12))])
    x[5] = x[6] = x[7]  # ties
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([*((k, v.tolist()) for k, v in enumerate(x)), (900, None), (901, [1.0])], "chunk_id long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([*((k, x[k].tolist()) for k in (3, 6, 80, 200, 430)), (-1, None), (-2, [1.0])], "query_id long, vector array<double>")
    index = DenseIndex(spark, f"file://{tmp_path}/dense").build(table, pivots)
    rows = lambda found: sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect()))
    for k, least in ((4, -2.0), (100, 0.5), (1000, -2.0)):
        assert rows(index.search(queries, k, least)) == rows(dense_search(queries.where("query_id >= 0"), table, k, least))
    assert index.search(queries, 4).count() and (pivots == 1 or index.compared < 0.6 * 5 * index.stored)
    assert index.search(queries.limit(0), 3).collect() == []
    assert DenseIndex(spark, f"file://{tmp_path}/none").build(table.limit(0)).search(queries, 3).collect() == []
