"""The five tools of a knowledge base as Python functions that return text."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import PREVIEW_BYTES
from larkspur.operators.editing import first_code_block, new_document, replace_section
from larkspur.plans.search import clamp
from larkspur.plans.store import Store
from larkspur.sources.markdown import read_markdown

TOOL_PREFIX = "tools/"
TOOL_CANDIDATES = 10
LIST_ROWS = 200  # documents of a page of the list


class ToolError(ValueError):
    """A missing or unusable argument."""


def inside(root: str, path: str) -> str:
    """The absolute path of a relative one that stays below root."""
    top = os.path.abspath(root)
    full = os.path.abspath(os.path.join(top, path))
    if full != top and not full.startswith(top + os.sep):
        raise ToolError(f"path {path!r} is outside of the documents folder")
    return full


def cut_preview(text: str, limit: int = PREVIEW_BYTES) -> str:
    raw = text.encode()
    if len(raw) <= limit:
        return text
    head = raw[:limit].decode(errors="ignore")
    at = head.rfind(" ")
    if at >= 0 and len(head[:at].encode()) > limit - 60:
        head = head[:at]
    return head + "\n[... cut; a narrower search shows the whole section]"


class Tools:
    """Tools over a store. With docs_path the markdown files there are the truth; without it the store is."""

    def __init__(self, spark: SparkSession, store: Store, docs_path: str | None = None):
        self.spark, self.store, self.docs_path = spark, store, docs_path

    def _one(self, expression: F.Column) -> str:
        """The value of an expression of literals, so that editing has one definition."""
        return self.spark.range(1).select(expression.alias("x")).first()["x"]

    def _found(self, query: str, limit: int) -> list:
        try:
            return self.store.searcher().search(query, limit)
        except LookupError:
            return []

    def sync(self) -> int:
        return self.store.ingest(read_markdown(self.spark, self.docs_path))

    def search_knowledge(self, query: str, limit: int | None = None) -> str:
        if not query:
            raise ToolError("query is required")
        rows = self._found(query, clamp(limit))
        if not rows:
            return f"Nothing found for {query!r}. list_knowledge shows what there is; broader terms may help."
        out = [f"Results for {query!r}:\n"]
        for r in rows:
            name = f"{r['path']} / {r['heading']}" if r["heading"] else r["path"]
            out.append(f"{r['rank']}. {name} ({r['label']})\n\n{cut_preview(r['content'])}\n")
        return "\n".join(out)

    def list_knowledge(self, prefix: str = "", after: str = "") -> str:
        """A page of the documents below a prefix, by path; a last line says where the next one begins."""
        rows = self.store.page(prefix, after, LIST_ROWS).collect()
        if not rows:
            return f"No documents begin with {prefix!r}; an empty prefix lists all." if prefix or after else "The knowledge base is empty; write_knowledge adds to it."
        out = [f"{len(rows)} documents, {sum(len(r['headings']) for r in rows)} sections\n"]
        for r in rows:
            out += [r["path"], *(f"  - {h}" for h in r["headings"] if h)]
        if len(rows) == LIST_ROWS:
            out.append(f"... more come after {rows[-1]['path']!r}")
        return "\n".join(out) + "\n"

    def write_knowledge(self, path: str, heading: str, content: str) -> str:
        if not (path and heading and content):
            raise ToolError("path, heading and content are required")
        if self.docs_path is None:
            self.store.write_chunk(path, heading, content)
            return f"Saved: {path} / {heading}"
        path = path if path.endswith(".md") else path + ".md"
        full = inside(self.docs_path, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if os.path.exists(full):
            with open(full, encoding="utf-8", newline="") as f:
                text = self._one(replace_section(F.lit(f.read()), F.lit(heading), F.lit(content)))
        else:
            text = self._one(new_document(F.lit(path), F.lit(heading), F.lit(content)))
        with open(full, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        self.sync()
        return f"Saved: {path} / {heading}"

    def delete_knowledge(self, path: str) -> str:
        if not path:
            raise ToolError("path is required")
        if self.docs_path is not None:
            path = path if path.endswith(".md") else path + ".md"
            full = inside(self.docs_path, path)
            if os.path.exists(full):
                os.remove(full)
        return f"Deleted: {path} ({self.store.delete(path)} sections removed)"

    def get_tool(self, name: str, within: bool = False) -> str:
        """The code of the best of ten results that is below tools/; `within` looks further than ten."""
        if not name:
            raise ToolError("name is required")
        rows = [r for r in self._found(name, 200 if within else TOOL_CANDIDATES) if r["path"].startswith(TOOL_PREFIX)]
        if not rows:
            return f"No tool found for {name!r}; tools are code blocks in files below {TOOL_PREFIX}."
        best = rows[0]
        code = self._one(first_code_block(F.lit(best["content"])))
        body = best["content"] if code == best["content"] else f"```\n{code}\n```"
        return f"{best['path']} ({best['heading']}):\n\n{body}"
