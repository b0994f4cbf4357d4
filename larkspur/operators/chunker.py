"""Markdown to sections: one narrow expression for each document, no shuffle.

Headings of level 1 and 2 cut a document into groups and level 3 cuts a group,
so the heading above a level-3 section is that of its own group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import col, trim_space

MAX_BYTES = 2000
_MARK = "\u0002"  # begins what stands for a mark of the text (and e) or hides a heading (and h)


def strip_frontmatter(c: Column | str) -> Column:
    """Without a leading block between lines of three dashes; an unclosed block stays."""
    text = F.regexp_replace(col(c), r"^[ \t\r\n]+", "")
    rest = F.substring(text, F.lit(4), F.length(text))
    close = F.locate("\n---", rest)
    after = F.regexp_replace(F.substring(rest, close + 4, F.length(rest)), r"^[\r\n]+", "")
    return F.when(text.rlike("^---[\n\r]") & (close > 0), after).otherwise(text)


def _cut(c: Column, level: str) -> Column:
    return F.split(c, rf"(?dm)^(?={level} )")


def _outside_fences(c: Column) -> Column:
    """Headings inside fenced code are hidden behind a mark, to be shown again by _shown."""
    parts = F.split(F.replace(c, F.lit(_MARK), F.lit(_MARK + "e")), r"(?dm)^(?=```)")
    # Part 0 is before any fence; odd parts begin with an opening fence and are code.
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"(?dm)^(#{1,3} )", f"{_MARK}h$1")).otherwise(p)), "")


def _shown(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_MARK + "h"), F.lit("")), F.lit(_MARK + "e"), F.lit(_MARK))


def _first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def _body(c: Column) -> Column:
    at = F.locate("\n", c)
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(F.lit(""))


def sections(c: Column | str, fence_aware: bool = False) -> Column:
    """Sections of a markdown text before any size limit: array<struct<heading, content>>."""
    text = F.regexp_replace(F.regexp_replace(col(c), "\r\n", "\n"), r"\r\z", "")
    text = strip_frontmatter(text)
    groups = _cut(_outside_fences(text) if fence_aware else text, "#{1,2}")
    plain = _shown if fence_aware else lambda x: x

    def group(g: Column) -> Column:
        top = F.when(g.startswith("## "), trim_space(F.substring(_first_line(g), F.lit(4), F.length(g)))).otherwise(F.lit(""))

        def section(s: Column, i: Column) -> Column:
            own = F.regexp_replace(_first_line(s), "^#{1,3} ", "")
            under = F.when(s.startswith("### ") & (top != ""), F.concat(top, F.lit(" / "), own)).otherwise(own)
            headed = s.rlike("^#{1,3} ")
            content = F.when(headed, _body(s)).otherwise(s)
            return F.struct(plain(F.when(headed, trim_space(under)).otherwise(F.lit(""))).alias("heading"), trim_space(plain(content)).alias("content"))

        return F.transform(_cut(g, "###"), section)

    return F.filter(F.flatten(F.transform(groups, group)), lambda s: (s["heading"] != "") | (s["content"] != ""))


def split_large(section: Column, limit: int = MAX_BYTES) -> Column:
    """Parts of a section: paragraphs packed up to `limit` bytes; a longer paragraph stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("held"))

    def step(state: Column, p: Column) -> Column:
        full = (state["held"] != "") & (F.octet_length(state["held"]) + F.octet_length(p) > limit)
        parts = F.when(full, F.concat(state["parts"], F.array(trim_space(state["held"])))).otherwise(state["parts"])
        held = F.when(full | (state["held"] == ""), p).otherwise(F.concat(state["held"], F.lit("\n\n"), p))
        return F.struct(parts.alias("parts"), held.alias("held"))

    last = lambda s: F.when(s["held"] != "", F.concat(s["parts"], F.array(trim_space(s["held"])))).otherwise(s["parts"])
    packed = F.aggregate(F.split(section["content"], "\n\n"), empty, step, last)
    heading = lambda i: F.when((section["heading"] == "") | (i == 0), section["heading"]).otherwise(F.concat(section["heading"], F.lit(" ("), (i + 1).cast("string"), F.lit(")")))
    parts = F.transform(packed, lambda p, i: F.struct(heading(i).alias("heading"), p.alias("content")))
    return F.when(F.octet_length(section["content"]) > limit, parts).otherwise(F.array(section))


def chunks_of(c: Column | str, fence_aware: bool = False, limit: int = MAX_BYTES) -> Column:
    return F.flatten(F.transform(sections(c, fence_aware), lambda s: split_large(s, limit)))


def chunk(docs: DataFrame, body: str = "body", fence_aware: bool = False, every: bool = False) -> DataFrame:
    """A row for each chunk: the other columns of docs, chunk_idx, heading, content. Null and empty bodies have none, or one row of nulls with `every`."""
    rest = [c for c in docs.columns if c != body]
    each = F.posexplode_outer if every else F.posexplode
    return docs.select(*rest, each(chunks_of(body, fence_aware)).alias("chunk_idx", "chunk")).select(*rest, "chunk_idx", "chunk.heading", "chunk.content")
