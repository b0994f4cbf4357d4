"""Markdown sections, size limits, front matter and editing."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import chunker, editing, maintain


def chunks(spark, md, **options):
    rows = chunker.chunk(spark.createDataFrame([(1, md)], "doc_id long, body string"), **options).orderBy("chunk_idx").collect()
    return [(r["heading"], r["content"]) for r in rows]


@pytest.mark.parametrize(
    "md, wanted",
    [
        ("", []),
        (None, []),
        ("# A\nline", [("A", "line")]),
        ("plain\ntext", [("", "plain\ntext")]),
        ("# A\nx\n## B\ny\n## C\nz", [("A", "x"), ("B", "y"), ("C", "z")]),
        ("## B\n## C\nz", [("B", ""), ("C", "z")]),
        ("# T\nx\n## S\ny\n### one\n1\n### two\n2", [("T", "x"), ("S", "y"), ("S / one", "1"), ("S / two", "2")]),
        ("### lone\nx", [("lone", "x")]),
        ("## S\n# T\n### sub\nx", [("S", ""), ("T", ""), ("sub", "x")]),
        ("# A\n#### deep\n#x", [("A", "#### deep\n#x")]),
        ("---\nk: v\n---\n# A\nx", [("A", "x")]),
        ("---title\n# A\nx", [("", "---title"), ("A", "x")]),
        ("---\nopen\n# A", [("", "---\nopen"), ("A", "")]),
        ("# A\r\nx\r\n", [("A", "x")]),
        ("# A\n```\n# comment\n```", [("A", "```"), ("comment", "```")]),
        ("##  B  \n###   c", [("B", ""), ("B /   c", "")]),
    ],
)
def test_sections(spark, md, wanted):
    assert chunks(spark, md) == wanted


def test_fences_can_be_respected(spark):
    assert chunks(spark, "# A\n```\n# comment\n```\n## B\ny", fence_aware=True) == [("A", "```\n# comment\n```"), ("B", "y")]


def test_large_sections_are_packed_by_bytes(spark):
    md = "## S\n" + "\n\n".join(c * n for c, n in zip("abcd", (500, 1900, 50, 3000), strict=True))
    parts = chunks(spark, md)
    assert [len(c) for _, c in parts] == [500, 1952, 3000]
    assert [h for h, _ in parts] == ["S", "S (2)", "S (3)"]
    wide = chunks(spark, "# W\n" + "é" * 900 + "\n\n" + "é" * 200)
    assert [h for h, _ in wide] == ["W", "W (2)"]
    assert len(chunks(spark, "# L\n" + "x" * 70000)) == 1


def edited(spark, md, heading, content):
    return spark.range(1).select(editing.replace_section(F.lit(md), F.lit(heading), F.lit(content)).alias("x")).first()["x"]


def test_replace_section(spark):
    md = "# T\n\n## A\n\nold\n### sub\nkept\n## B\n\nb\n"
    assert edited(spark, md, "A", " new\nlines ") == "# T\n\n## A\n\nnew\nlines\n\n### sub\nkept\n## B\n\nb\n"
    assert edited(spark, md, "C", "c") == md.rstrip("\n") + "\n\n## C\n\nc\n"
    assert edited(spark, "## A  \nx", "A", "y") == "## A\n\ny\n"


def test_first_code_block(spark):
    block = lambda md: spark.range(1).select(editing.first_code_block(F.lit(md)).alias("x")).first()["x"]
    assert block("a\n```bash\n x \ny\n```\n```\nz\n```") == "x \ny"
    assert block("a\n```\nopen") == "open"
    assert block("no code") == "no code"
    assert block("a\n```\n```") == "a\n```\n```"


def test_new_document(spark):
    made = spark.range(1).select(editing.new_document(F.lit("x/pod-oom.md"), F.lit("Fix"), F.lit(" do it ")).alias("x")).first()["x"]
    assert made == "# pod oom\n\n## Fix\n\ndo it\n"


def test_marks_in_the_text_stay(spark):
    text = "# A\nx\u0001y\u0002z\u0002e\u0002h\n```\n# not a heading\n\u0002# nor this\n```\nend"
    rows = lambda fence: spark.range(1).select(F.explode(chunker.sections(F.lit(text), fence)).alias("s")).select("s.*").collect()
    whole = rows(True)
    assert [(r["heading"], r["content"]) for r in whole] == [("A", text[4:])]
    assert [r["heading"] for r in rows(False)] == ["A", "not a heading"] and rows(False)[0]["content"] == "x\u0001y\u0002z\u0002e\u0002h\n```"


def test_chunk_ids_do_not_collide(spark):
    ids = lambda doc, idx: spark.createDataFrame([(doc, idx)], "doc_id long, chunk_idx int").select(maintain.chunk_id().alias("x")).first()["x"]
    assert ids(3, 5) == (3 << 20) + 5 and ids(2**43 - 1, 2**20 - 1) == 2**63 - 1 and ids(None, 1) is None
    for doc, idx in ((2**44, 0), (-1, 0), (1, 2**20)):
        with pytest.raises(Exception, match="no chunk id"):
            ids(doc, idx)
