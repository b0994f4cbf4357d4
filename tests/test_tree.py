"""The data source for markdown trees."""

import pytest

from larkspur.sources import tree as source
from larkspur.sources.markdown import read_local_markdown, read_markdown
from larkspur.sources.tree import MarkdownReader, MarkdownTree


@pytest.fixture()
def tree(tmp_path):
    for path, body in {"a.md": "# A", "_hidden.md": "# H", ".dot.md": "x", "empty.md": "", "b/c/d.md": "é ü", "b/.git/e.md": "e", "b/c/notes.txt": "no", "b/sp ace+%41.md": "s", "hot/0.md": "0"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    for k in range(40):
        (tmp_path / "hot" / f"f{k}.md").write_text(f"# F{k}")
    (tmp_path / "bad.md").write_bytes(b"a\xffb\r\nc")
    return tmp_path


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_all_files_of_a_tree(spark, tree, parts):
    spark.dataSource.register(MarkdownTree)
    mine = spark.read.format("markdown").option("parts", parts).load(f"file://{tree}")
    assert mine.schema.simpleString() == "struct<path:string,body:string>"
    rows = _rows(mine)
    assert rows == _rows(read_local_markdown(spark, str(tree)))
    assert ("bad.md", "a�b\r\nc") in rows and ("empty.md", "") in rows and ("b/sp ace+%41.md", "s") in rows
    # What Spark's own listing shows has the same names.
    assert {r[0] for r in _rows(read_markdown(spark, f"file://{tree}"))} <= {r[0] for r in rows}


def test_a_folder_is_read_by_several_tasks(tree):
    shares = MarkdownReader({"path": str(tree), "parts": "3"}).partitions()
    hot = [s for s in shares if s.folder.endswith("/hot")]
    assert len(hot) > 1 and len({(s.folder, s.share) for s in shares}) == len(shares)


def test_a_file_that_is_gone_when_it_is_read(tree, monkeypatch):
    monkeypatch.setattr(source, "_listing", lambda files, folder, deep: files.get_file_info([f"{folder}/gone.md", f"{folder}/a.md"]))
    share = source.Share(str(tree), True, 0, 1)
    with pytest.raises(OSError, match="read gone.md"):
        list(MarkdownReader({"path": str(tree)}).read(share))
    batches = list(MarkdownReader({"path": str(tree), "errors": "skip"}).read(share))
    assert [b.to_pydict() for b in batches] == [{"path": ["a.md"], "body": ["# A"]}]


def test_folders_and_links(spark, tree):
    spark.dataSource.register(MarkdownTree)
    (tree / "folder.md").mkdir()
    (tree / "dangling.md").symlink_to(tree / "nowhere.md")
    assert len(_rows(spark.read.format("markdown").load(str(tree)))) == 49
    with pytest.raises(Exception, match="no folder"):
        spark.read.format("markdown").load(str(tree / "nothing")).collect()
