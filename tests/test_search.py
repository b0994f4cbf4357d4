"""Lexical scores against an independent full-text engine, fusion, and the life of a store."""

import datetime as dt
import sqlite3

import pytest

from larkspur.operators.fusion import fuse
from larkspur.operators.lexical import match
from larkspur.operators.statistics import chunk_lengths, postings
from larkspur.plans.search import Index, Searcher, build_from_files, search_batch
from larkspur.plans.store import Store
from larkspur.sources.markdown import read_local_markdown, read_markdown
from larkspur.tools import ToolError, Tools

ROWS = [
    (1, "Oom fix", "pod pods killed élève by oomkilled"),
    (2, "Sync", "retry the pod"),
    (3, "Net", "cilium the the"),
    (4, "X", "nothing here at all"),
    (5, "Y", "other words entirely"),
]


def scores(spark, rows, query):
    chunks = spark.createDataFrame(rows, "chunk_id long, heading string, content string")
    found = match(spark.createDataFrame([(1, query)], "query_id long, query string"), postings(chunks), chunk_lengths(chunks))
    return {(r["mode"], r["chunk_id"]): r["score"] for r in found.collect()}


def test_scores_of_known_corpus(spark):
    assert scores(spark, ROWS, "pod") == {(m, k): pytest.approx(v, abs=1e-8) for m in ("all", "any") for k, v in ((1, 0.39584969), (2, 0.36645491))}
    twice = scores(spark, ROWS, "pod pod")
    assert twice["all", 1] == pytest.approx(0.79169938, abs=1e-8)
    assert scores(spark, ROWS, "eleve")["all", 1] == pytest.approx(0.88209746, abs=1e-8)
    assert scores(spark, ROWS, "the") == {}
    clamp = [(k, "a", "pod " * k) for k in (1, 2, 3, 4)]
    assert [scores(spark, clamp, "pod")["all", k] for k in (1, 2, 3, 4)] == pytest.approx([1.2125984e-06, 1.4325581e-06, 1.5247525e-06, 1.5754476e-06], abs=1e-10)


def test_scores_match_sqlite(spark):
    rows = [(k, f"part {k % 7}", " ".join(f"w{(k * j) % 23}" for j in range(1, 4 + k % 11))) for k in range(1, 60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(heading, content, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, heading, content) VALUES (?, ?, ?)", rows)
    for query in ("w1", "w2 part", "w11 w3 w4"):
        mine = scores(spark, rows, query)
        for mode, word in (("all", " AND "), ("any", " OR ")):
            theirs = dict(db.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (word.join(f"{t}*" for t in query.split()),)).fetchall())
            assert {k: v for (m, k), v in mine.items() if m == mode} == pytest.approx(theirs, abs=1e-9)


def test_fusion(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id long, rank int")
    got = {r["chunk_id"]: (r["rank"], r["score"], r["label"]) for r in fuse(rank([(1, 7, 1), (1, 8, 2)]), rank([(1, 9, 1), (1, 7, 1)]), 5).collect()}
    assert got[7] == (1, pytest.approx(0.073770, abs=1e-6), "strong match")
    assert got[9] == (3, pytest.approx(0.008197, abs=1e-6), "weak match")


FILES = {
    "runbooks/deploy.md": "# Deployment\nHow to deploy.\n\n## OOM Fix\nPods are killed by oom; raise the memory limit.\n\n## Sync Retry\nRetry the sync.\n",
    "runbooks/net.md": "# Networking\neBPF networking for kubernetes with cilium.\n\n## Installation\nhelm install cilium\n",
    "tools/drain.md": "# Drain node\n```bash\nkubectl drain node\n```\n",
}


@pytest.fixture
def docs(tmp_path):
    for path, text in FILES.items():
        (tmp_path / "docs" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / path).write_text(text)
    return tmp_path / "docs"


def test_sources_agree(spark, docs):
    (docs / "with space.md").write_text("# S\nx")
    (docs / "skip.txt").write_text("no")
    read = lambda f: {(r["path"], r["body"]) for r in f(spark, str(docs)).collect()}
    assert read(read_markdown) == read(read_local_markdown) == {*FILES.items(), ("with space.md", "# S\nx")}


def test_search(spark):
    files = spark.createDataFrame([(k, p, b) for k, (p, b) in enumerate(sorted(FILES.items()))], "doc_id long, path string, body string")
    index = build_from_files(files)
    queries = spark.createDataFrame([(1, "oom fix pod memory"), (2, "ebpf networking kubernetes"), (3, "the of"), (4, None), (5, ""), (6, "OOMKilled"), (7, "kube cilium")], "query_id long, query string")
    rows = search_batch(index, queries).orderBy("query_id", "rank").collect()
    best = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert best[1]["heading"] == "OOM Fix" and best[2]["path"] == "runbooks/net.md"
    assert set(best) == {1, 2, 6, 7}
    searcher = Searcher(index)
    first = searcher.search("oom", 1)
    assert len(first) == 1 and searcher.search("oom", 1) is first


def test_store_life(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.list().collect() == []
    store.ingest(read_local_markdown(spark, str(docs)), dt.datetime(2024, 1, 1))
    ids = {r["path"]: r["doc_id"] for r in store.table("documents").collect()}
    assert len(ids) == 3 and store.table("chunks").count() == 6
    assert [r["path"] for r in store.list("runbooks/").collect()] == ["runbooks/deploy.md", "runbooks/net.md"]

    (docs / "tools" / "drain.md").unlink()
    (docs / "a.md").write_text("# New\n\n## Part\nx")
    store.ingest(read_local_markdown(spark, str(docs)))
    again = {r["path"]: r["doc_id"] for r in store.table("documents").collect()}
    assert set(again) == {"a.md", "runbooks/deploy.md", "runbooks/net.md"}
    assert all(again[p] == ids[p] for p in again if p in ids) and again["a.md"] not in ids.values()

    version = store.version()
    assert store.ingest(spark.createDataFrame([], "path string, body string")) == version
    store.write_chunk("a.md", "Part", "changed")
    store.write_chunk("a.md", "More", "added text")
    store.write_chunk("b.md", "First", "solo")
    rows = {(r["heading"], r["content"]) for r in store.table("chunks").collect()}
    assert {("Part", "changed"), ("More", "added text"), ("First", "solo")} <= rows
    assert any(r["heading"] == "More" for r in store.searcher().search("added text"))
    assert store.delete("a.md") == 3
    assert not store.searcher().search("changed")
    with pytest.raises(KeyError):
        store.delete("a.md")


def tables(store_or_index, names):
    read = store_or_index.table if isinstance(store_or_index, Store) else lambda n: getattr(store_or_index, n)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    return {n: sorted(map(rounded, read(n).select(sorted(read(n).columns)).collect())) for n in names}


def test_snapshots_equal_a_whole_build(spark, docs, tmp_path):
    names = ("postings", "lengths", "vocab", "vectors")
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(read_markdown(spark, str(docs)))
    steps = [
        lambda: store.write_chunk("runbooks/net.md", "More", "helm cilium twice"),
        lambda: store.update(spark.createDataFrame([("runbooks/deploy.md", "# Deployment\nother words"), ("x.md", "# X\ny"), ("tools/drain.md", "")], "path string, body string")),
        lambda: store.delete("runbooks/net.md"),
        lambda: store.ingest(read_markdown(spark, str(docs))),
    ]
    for step in steps:
        step()
        assert tables(store, names) == tables(Index.build(store.table("documents"), store.table("chunks")), names)
    assert {r["path"] for r in store.table("documents").collect()} == set(FILES)
    version = store.version()
    assert store.vacuum(1) == version - 1 and store.version() == version and store.table("chunks").count() == 6
    store.close()
    assert store.searcher().search("oom", 1)


def test_store_with_a_model(spark, docs, tmp_path):
    def connect(size=3):
        return lambda texts: [[float("cilium" in t.lower()), float("node" in t.lower()), *[0.1] * (size - 2)] for t in texts]

    store = Store(spark, f"file://{tmp_path}/store", connect=connect)
    store.ingest(read_markdown(spark, str(docs)))
    assert store.table("embedded").count() == store.table("chunks").count() == 6
    rows = store.searcher().search("zzz node", 3)
    assert rows[0]["path"] == "tools/drain.md"
    other = Store(spark, f"file://{tmp_path}/store", connect=lambda: connect(5))
    with pytest.warns(UserWarning, match="5: all chunks"):
        other.write_chunk("a.md", "H", "words")
    assert {len(r["vector"]) for r in other.table("embedded").collect()} == {5}


def test_tools(spark, docs, tmp_path):
    tools = Tools(spark, Store(spark, f"file://{tmp_path}/store"), str(docs))
    assert "empty" in tools.list_knowledge()
    assert "Nothing found" in tools.search_knowledge("x")
    tools.sync()
    assert "kubectl drain node" in tools.get_tool("drain node")
    assert "OOM Fix" in tools.search_knowledge("oom fix", 3)
    tools.write_knowledge("runbooks/deploy", "Sync Retry", "Do it twice.")
    assert "Do it twice." in (docs / "runbooks/deploy.md").read_text()
    assert "twice" in tools.search_knowledge("twice")
    tools.write_knowledge("new/pod-crash", "Cause", "unknown")
    assert (docs / "new/pod-crash.md").read_text() == "# pod crash\n\n## Cause\n\nunknown\n"
    assert "(2 sections removed)" in tools.delete_knowledge("new/pod-crash.md")
    with pytest.raises(ToolError):
        tools.write_knowledge("../../etc/x", "h", "c")
    with pytest.raises(ToolError):
        tools.search_knowledge("")
