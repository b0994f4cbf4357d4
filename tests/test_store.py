"""Segments, versions of several writers, merging, term ranges, pages of the list, and a folder that is followed."""

import threading

import pytest

from larkspur.operators import lexical
from larkspur.plans import store as stores
from larkspur.plans.log import CommitLog, Taken
from larkspur.plans.search import Index, search_batch
from larkspur.plans.store import Store
from larkspur.sources.markdown import read_markdown
from larkspur.streaming.ingest import Manifest, catch_up, follow

TABLES = ("postings", "lengths", "vocab", "vectors")


def files(spark, n, words=60):
    rows = [(f"d{k % 7}/f{k:03d}.md", f"# File {k}\n" + "\n## Part\n".join(" ".join(f"w{(k * 31 + j * j * 7 + s) % 977}" for j in range(words)) for s in range(3))) for k in range(n)]
    return spark.createDataFrame(rows, "path string, body string")


def content(of, names):
    read = of.table if isinstance(of, Store) else lambda n: getattr(of, n)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    return {n: sorted(map(rounded, read(n).select(sorted(read(n).columns)).collect())) for n in names}


def test_a_record_is_made_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.latest() is None and log.numbers() == []
    log.append({"version": 1, "by": "a"})
    with pytest.raises(Taken):
        log.append({"version": 1, "by": "b"})
    log.append({"version": 2, "by": "b"})
    assert log.read(1)["by"] == "a" and log.latest()["by"] == "b" and log.numbers() == [1, 2]
    assert sorted(f.name for f in (tmp_path / "log").iterdir() if not f.name.endswith(".crc")) == ["00000001.json", "00000002.json"]


def test_an_edit_writes_its_document_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 400, 200))
    base = store.record()["segments"][0]["bytes"]
    store.write_chunk("d0/f000.md", "Part", "w1 w2 and new words")
    first, edit = store.record()["segments"]
    assert first["bytes"] == base and edit["bytes"] < base / 10
    version = store.version()
    assert store.update(files(spark, 400, 200).limit(3).where("path <> 'd0/f000.md'")) == version  # nothing is new


def test_no_update_is_lost(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    Store(spark, root).ingest(files(spark, 5))
    failed = []

    def write(who):
        try:
            own = Store(spark, root)
            for k in range(2):
                own.write_chunk(f"{who}.md", f"H{k}", f"text {k} of {who}")
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in ("one", "two")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = Store(spark, root)
    found = {(r["path"], tuple(r["headings"])) for r in store.list().collect() if "/" not in r["path"]}
    assert not failed and found == {("one.md", ("H0", "H1")), ("two.md", ("H0", "H1"))}
    assert store.table("documents").select("doc_id").distinct().count() == 7
    assert content(store, TABLES) == content(Index.build(store.table("documents"), store.table("chunks")), TABLES)


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "TIER_BYTES", 1 << 30)
    monkeypatch.setattr(stores, "FAN", 3)
    monkeypatch.setattr(stores, "RANGE_ROWS", 100)
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 12))
    store.write_chunk("d0/f000.md", "Part", "w1 other words")
    store.delete("d1/f001.md")
    assert len(store.record()["segments"]) == 1 and store.record()["segments"][0]["dead_chunks"] == 0
    store.write_chunk("d1/f001.md", "Back", "again here")
    store.update(spark.createDataFrame([("d2/f002.md", "# Two\nshort"), ("d0/f000.md", "")], "path string, body string"))
    assert content(store, TABLES) == content(Index.build(store.table("documents"), store.table("chunks")), TABLES)
    record = store.record()
    assert record["chunks"] == store.table("chunks").count() and record["tokens"] == store.table("lengths").agg({"n_tokens": "sum"}).first()[0]
    terms = {r["term"]: r["n"] for r in store.table("terms").collect()}
    assert terms == {r["term"]: r["count"] for r in store.table("postings").groupBy("term").count().collect()}


def test_only_the_later_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FAN", 2)
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 30))
    monkeypatch.setattr(stores, "TIER_BYTES", store.record()["segments"][0]["bytes"] // 2)
    store.write_chunk("d0/f000.md", "Part", "w1 other words")
    store.delete("d1/f001.md")
    first, merged = store.record()["segments"]
    assert first["seq"] == 1 and merged["dead_chunks"] == 2
    assert content(store, TABLES) == content(Index.build(store.table("documents"), store.table("chunks")), TABLES)


@pytest.mark.parametrize("edited", [False, True])
def test_a_search_reads_the_ranges_of_its_terms(spark, tmp_path, monkeypatch, capsys, edited):
    monkeypatch.setattr(stores, "RANGE_ROWS", 300)
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 40))
    if edited:
        store.write_chunk("d0/f000.md", "Part", "w1 w2 fresh words")
        store.delete("d1/f001.md")
    index = store.index()
    asked = [(1, "w12 w43"), (2, "w1"), (3, "w977 nothing"), (4, "fresh"), (5, "the of"), (6, None), (7, "w9 w90 w900 zzz"), (8, "part"), (9, "file 3")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    rows = lambda found: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in found.collect())
    usable = queries.where("query is not null")
    got = lexical.stored_search(usable, index.terms, index.ranged, index.facts, 7)
    assert rows(got) == rows(lexical.lexical_search(usable, index.postings, index.lengths, 7)) != []
    whole = search_batch(Index.build(store.table("documents"), store.table("chunks")), queries).select("query_id", "rank", "chunk_id", "score")
    assert rows(search_batch(index, queries).select("query_id", "rank", "chunk_id", "score")) == rows(whole)

    ranges = [r[0] for r in spark.read.parquet(f"file://{tmp_path}/store/segments/{store.record()['segments'][0]['id']}/postings").select("range").distinct().collect()]
    assert len(ranges) > 5
    capsys.readouterr()
    index.ranged({1: ranges[:1]}).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "range#" in plan.split("PartitionFilters")[1].split("\n")[0]
    monkeypatch.setattr(lexical, "FEW_PHRASES", 0)
    assert lexical.stored_search(usable, index.terms, index.ranged, index.facts, 7) is None


def test_pages_of_the_list(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 12))
    seen, after = [], ""
    while page := store.page("d", after, 5).collect():
        seen += [(r["path"], tuple(r["headings"])) for r in page]
        after = page[-1]["path"]
    assert seen == sorted((r["path"], tuple(r["headings"])) for r in store.list().collect()) and len(seen) == 12
    assert [r["path"] for r in store.page("d1/", "", 5).collect()] == ["d1/f001.md", "d1/f008.md"]


def test_a_folder_is_followed(spark, tmp_path):
    docs, store = tmp_path / "docs", Store(spark, f"file://{tmp_path}/store")
    (docs / "tools").mkdir(parents=True)
    for name in ("tools/a.md", "b.md", "with space.md"):
        (docs / name).write_text(f"# {name}\nwords of {name}")
    store.ingest(read_markdown(spark, str(docs)))
    version, manifest = store.version(), Manifest(spark, f"file://{tmp_path}/manifest")
    paths = lambda: sorted(r["path"] for r in store.table("documents").collect())
    assert catch_up(spark, str(docs), store, manifest) == {"read": 3, "changed": 3, "gone": 0}
    assert store.version() == version and paths() == ["b.md", "tools/a.md", "with space.md"]  # each path once, as it was ingested
    assert catch_up(spark, str(docs), store, manifest) == {"read": 0, "changed": 0, "gone": 0}

    (docs / "b.md").unlink()
    (docs / "tools/a.md").write_text("# A\nother words, and more of them")
    (docs / "c.md").write_text("# C\nnew")
    run = lambda: follow(spark, str(docs), store, f"file://{tmp_path}/state").awaitTermination(120)
    assert catch_up(spark, str(docs), store, manifest) == {"read": 2, "changed": 2, "gone": 1}
    assert paths() == ["c.md", "tools/a.md", "with space.md"]
    version = store.version()
    run()
    assert store.version() == version
    (docs / "c.md").unlink()
    run()
    assert paths() == ["tools/a.md", "with space.md"]
    for f in ("tools/a.md", "with space.md"):
        (docs / f).unlink()
    run()
    assert len(paths()) == 2  # an empty listing removes nothing


def test_pages_and_edits_wait_for_no_postings(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 12))
    store.page("d", "", 5).collect()
    store.write_chunk("d0/f000.md", "Part", "w1 other words")
    store.delete("d1/f001.md")
    made = lambda: {f.name for s in (tmp_path / "store/segments").iterdir() for f in s.iterdir()}
    assert made() == {"documents", "chunks", "dead_documents", "dead_chunks", "gone"}
    # Counts are right although they are made after the edits, and what was made stays.
    assert content(store, TABLES) == content(Index.build(store.table("documents"), store.table("chunks")), TABLES)
    assert {"tokens", "lengths", "postings", "vocab"} < made()
    record = store.record()
    assert record["tokens"] == store.table("lengths").agg({"n_tokens": "sum"}).first()[0]
    terms = {r["term"]: r["n"] for r in store.table("terms").collect()}
    assert terms == {r["term"]: r["count"] for r in store.table("postings").groupBy("term").count().collect()}


@pytest.mark.parametrize("searched", [(), (1,), (1, 2, 3)])
def test_merged_segments_that_were_searched_or_not(spark, tmp_path, monkeypatch, searched):
    monkeypatch.setattr(stores, "FAN", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(files(spark, 30))
    monkeypatch.setattr(stores, "TIER_BYTES", store.record()["segments"][0]["bytes"] // 4)  # the first one is of a higher tier
    for n, edit in enumerate([lambda: store.write_chunk("d0/f000.md", "Part", "w1 other words"), lambda: store.write_chunk("d0/f000.md", "Part", "w2 third words"), lambda: store.delete("d1/f001.md")], 1):
        if n in searched:
            store.index()
        edit()
    first, merged = store.record()["segments"]
    assert first["seq"] == 1 and merged["dead_chunks"] and merged["seq"] == 4
    assert content(store, TABLES) == content(Index.build(store.table("documents"), store.table("chunks")), TABLES)
    terms = {r["term"]: r["n"] for r in store.table("terms").collect()}
    assert terms == {r["term"]: r["count"] for r in store.table("postings").groupBy("term").count().collect()}


def test_batches_and_counts_need_no_ranges(spark, tmp_path):
    """A batch of many phrases and the counts of terms wait for no ranges of postings, and an ingest leaves no staged texts."""
    from larkspur import session

    store = Store(spark, f"file://{tmp_path}/store")
    before = set(session._made.get(spark.sparkContext.applicationId, []))
    store.ingest(files(spark, 12))
    store.update(spark.createDataFrame([("d2/f002.md", "# Two\nshort"), ("d0/f000.md", "")], "path string, body string"))
    assert set(session._made.get(spark.sparkContext.applicationId, [])) == before
    queries = spark.createDataFrame([(k, " ".join(f"w{(k * 40 + j) % 977} q{k}x{j}" for j in range(60))) for k in range(30)], "query_id long, query string")
    found = search_batch(store.index(), queries)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())
    assert rows(found) == rows(search_batch(Index.build(store.table("documents"), store.table("chunks")), queries)) != []
    counted = lambda: sorted(map(tuple, store.table("occurrences").select("term", "chunks", "times").collect()))
    by_words = counted()
    assert not {"postings", "terms"} & {f.name for s in (tmp_path / "store/segments").iterdir() for f in s.iterdir()}
    held = store.table("postings").groupBy("term").agg({"chunk_id": "count", "tf": "sum"}).select("term", "count(chunk_id)", "sum(tf)")
    assert by_words == sorted(map(tuple, held.collect())) == counted() != []


def test_paths_that_come_twice(spark, tmp_path):
    """Of files of one path the greatest body counts, also where it has no chunk, and texts of other files are not shuffled for it."""
    rows = [("a.md", "first"), ("a.md", "second"), ("b.md", " before"), ("b.md", "---\nx\n---\n"), ("c.md", None), ("c.md", "# C\nx"), ("d.md", ""), ("e.md", "same"), ("e.md", "same"), (None, "no")]
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(spark.createDataFrame(rows, "path string, body string").repartition(3))
    held = lambda: sorted(map(tuple, store.table("chunks").join(store.table("documents"), "doc_id").select("path", "heading", "content").collect()))
    assert held() == [("a.md", "", "second"), ("c.md", "C", "x"), ("e.md", "", "same")]
    store.update(spark.createDataFrame([("a.md", "x"), ("a.md", ""), ("c.md", None), ("f.md", "new")], "path string, body string"))
    assert held() == [("a.md", "", "x"), ("e.md", "", "same"), ("f.md", "", "new")]


def test_only_changed_files_are_written_and_opened(spark, tmp_path, monkeypatch):
    """A folder is brought up to a table without touching what is the same, and a pass opens only what it names."""
    from larkspur.sources import markdown
    from larkspur.streaming import ingest

    root, store = f"file://{tmp_path}/docs", Store(spark, f"file://{tmp_path}/store")
    manifest = Manifest(spark, f"file://{tmp_path}/manifest")
    table = lambda rows: spark.createDataFrame(rows, "path string, body string")
    markdown.write_markdown(table([("a b%41+.md", "# A\nä"), ("x/b.md", "# B\nx"), ("x/c.md", "# C\nx"), ("x/_d.md", "hidden"), ("e.md", "")]), root)
    times = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "docs").rglob("*.md")}
    first = times()
    found = sorted((r["path"], r["size"]) for r in markdown.listed(spark, root).collect())
    monkeypatch.setattr(markdown, "_known", lambda root: False)
    by_spark = {(r["path"], r["size"], r["modified"]) for r in markdown.listed(spark, root).collect() if r["size"]}
    monkeypatch.undo()
    assert found == [("a b%41+.md", 6), ("e.md", 0), ("x/b.md", 5), ("x/c.md", 5)]
    assert {(r["path"], r["size"], r["modified"]) for r in markdown.listed(spark, root).collect() if r["size"]} == by_spark
    assert catch_up(spark, root, store, manifest) == {"read": 4, "changed": 4, "gone": 0}
    markdown.write_markdown(table([("a b%41+.md", "# A\nä"), ("x/b.md", "# B\ny")]), root, replace=True)
    second = times()
    assert set(second) == {"a b%41+.md", "b.md", "_d.md"} and second["a b%41+.md"] == first["a b%41+.md"] and second["b.md"] != first["b.md"]
    seen, whole = [], markdown.contents
    monkeypatch.setattr(ingest, "contents", lambda paths, root, bodies=True: seen.append(sorted(r["path"] for r in paths.collect())) or whole(paths, root, bodies))
    assert catch_up(spark, root, store, manifest) == {"read": 1, "changed": 1, "gone": 2} and seen == [["x/b.md"]] * 2
    held = store.table("chunks").join(store.table("documents"), "doc_id").select("path", "heading", "content").collect()
    assert sorted(map(tuple, held)) == [("a b%41+.md", "A", "ä"), ("x/b.md", "B", "y")]
