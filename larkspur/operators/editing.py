"""Editing of markdown sections, and code blocks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import col, is_heading, trim_space


def replace_section(md: Column | str, heading: Column | str, content: Column | str) -> Column:
    """md with the body of its first line `## heading` replaced, up to the next heading of any level; appended if there is none."""
    md, target = col(md), F.concat(F.lit("## "), col(heading))
    body = trim_space(content)
    state = F.struct(F.split(md, "\n").alias("lines"), target.alias("target"), body.alias("body"), md.alias("md"))

    def edit(s: Column) -> Column:
        lines = s["lines"]
        start = F.array_position(F.transform(lines, lambda x: F.rtrim(x)), s["target"])
        later = F.transform(lines, lambda x, i: (i >= start) & is_heading(x))
        stop = F.array_position(later, F.lit(True))
        tail = F.when(stop > 0, F.slice(lines, F.greatest(stop, F.lit(1)).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
        new = F.concat(F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0)).cast("int")), F.array(s["target"], F.lit("")), F.split(s["body"], "\n"), F.array(F.lit("")), tail)
        appended = F.concat(F.regexp_replace(s["md"], "\n+$", ""), F.lit("\n\n"), s["target"], F.lit("\n\n"), s["body"], F.lit("\n"))
        return F.when(start > 0, F.array_join(new, "\n")).otherwise(appended)

    return F.get(F.transform(F.array(state), edit), 0)


def new_document(path: Column | str, heading: Column | str, content: Column | str) -> Column:
    """The text of a new file: a title from its name and one section."""
    stem = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.md$", "")
    return F.concat(F.lit("# "), F.translate(stem, "-", " "), F.lit("\n\n## "), col(heading), F.lit("\n\n"), trim_space(content), F.lit("\n"))


def first_code_block(c: Column | str) -> Column:
    """The trimmed content of the first fenced block, to the end if it is not closed; the text itself without one."""
    c = col(c)

    def cut(lines: Column) -> Column:
        fences = F.transform(lines, lambda x: x.startswith("```"))
        first = F.array_position(fences, F.lit(True)).cast("int")
        rest = F.slice(lines, first + 1, F.size(lines))
        close = F.array_position(F.transform(rest, lambda x: x.startswith("```")), F.lit(True)).cast("int")
        inner = F.when(close > 0, F.slice(rest, F.lit(1), F.greatest(close - 1, F.lit(0)))).otherwise(rest)
        return F.when((first > 0) & (F.size(inner) > 0), trim_space(F.array_join(inner, "\n")))

    return F.coalesce(F.get(F.transform(F.array(F.split(c, "\n")), cut), 0), c)
