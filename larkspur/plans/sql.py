"""The column functions and the chunker as functions and table functions of SQL.

The body of a SQL function is the text of the same column expression that the
DataFrame functions are, so a statement that calls it has the same plan, on the
JVM, and nothing is written twice. A table function over a column stands in
`LATERAL`, which Spark turns into a plain Generate: no join, no shuffle.

    register(spark)
    spark.sql("SELECT path, c.* FROM files, LATERAL chunks_of(body) c")
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import fnv1a32, fold, index_terms, preview, score_label, tokenize, tokenize_raw, trim_space
from larkspur.functions.vectors import cosine, normalize
from larkspur.operators.chunker import chunks_of, sections, strip_frontmatter
from larkspur.operators.editing import first_code_block, new_document, replace_section

#: name: (parameters, result, expression of columns of the parameters' names)
SCALAR: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "tokens_of": ("text STRING", "ARRAY<STRING>", tokenize),
    "raw_tokens_of": ("text STRING", "ARRAY<STRING>", tokenize_raw),
    "index_terms_of": ("text STRING", "ARRAY<STRING>", index_terms),
    "folded": ("text STRING", "STRING", fold),
    "trimmed": ("text STRING", "STRING", trim_space),
    "fnv1a": ("text STRING", "BIGINT", fnv1a32),
    "preview_of": ("text STRING", "STRING", preview),
    "without_frontmatter": ("text STRING", "STRING", strip_frontmatter),
    "code_block_of": ("text STRING", "STRING", first_code_block),
    "section_replaced": ("md STRING, title STRING, content STRING", "STRING", replace_section),
    "new_document": ("path STRING, title STRING, content STRING", "STRING", new_document),
    "label_of": ("score DOUBLE", "STRING", score_label),
    "unit_vector": ("vector ARRAY<FLOAT>", "ARRAY<DOUBLE>", normalize),
    "cosine_of": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", cosine),
}
_SECTION = "heading STRING, content STRING", "c.heading, c.content"
#: name: (parameters, the index column, the other columns, how an element gives them, expression: an array)
TABLE: dict[str, tuple[str, str, str, str, Callable[..., Column]]] = {
    "chunks_of": ("body STRING", "chunk_idx", *_SECTION, chunks_of),
    "fenced_chunks_of": ("body STRING", "chunk_idx", *_SECTION, lambda body: chunks_of(body, True)),
    "sections_of": ("body STRING", "idx", *_SECTION, sections),
    "words_of": ("text STRING", "place", "word STRING", "c", tokenize),
    "terms_of": ("text STRING", "place", "term STRING", "c", index_terms),
}
_PARTS = re.compile(
    r"""('(?:[^'\\]|\\.|'')*')          # a literal string
    |(?<![\w`])(and|or|in|not|[-+*/%&|^<>=!~]+)\(  # an operator
    |(?<![\w.`])(\d+\.\d+(?:E-?\d+)?)(?![\w.])  # a double, which would be a decimal""",
    re.DOTALL | re.VERBOSE,
)


def sql_text(c: Column) -> str:
    """A column as SQL that parses to the same expression: operators are called by name, which SQL takes in back quotes, and numbers with a point are doubles; strings stay as they are."""
    return _PARTS.sub(lambda m: m[1] or (f"`{m[2]}`(" if m[2] else f"{m[3]}D"), c._jc.toString())


def _body(parameters: str, expression: Callable[..., Column]) -> str:
    return sql_text(expression(*[F.col(p.split()[0]) for p in parameters.split(",")]))


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session, in place of temporary functions of the same names; returns their names. Nulls and empty texts give what the column functions give; a table function has no row for them."""
    for name, (parameters, result, expression) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {_body(parameters, expression)}")
    for name, (parameters, index, columns, values, expression) in TABLE.items():
        rows = f"SELECT posexplode({_body(parameters, expression)}) AS (pos, c)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({index} INT, {columns}) RETURN SELECT pos, {values} FROM ({rows})")
    return [*SCALAR, *TABLE]
