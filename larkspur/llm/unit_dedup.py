"""Substring dedup by global digests of normalised units.

Units are lines (or paragraphs), and runs of `passage` words, which find the
passages that start or end inside a line. Each unit is normalised and hashed to
128 bits, digests are grouped over all documents, the earliest (doc_id,
position) of each is kept and all other occurrences are cut out, with their
original offsets retained. Earliest occurrences come from partial aggregation,
so a unit that a third of all documents share costs one row a task.

There is a run of words at every word, too many to shuffle them all. Every run
has an anchor, the least hashed ten words inside it, and equal runs have equal
anchors; about one word in twenty is an anchor. Only anchors that occur again
go on, runs of one context (all words that the runs of an anchor cover) are
decided together, and runs are hashed one by one only for the earliest
occurrence of each context of an anchor that has several.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import BROADCAST_ROWS, lean, mix, prefix_hash, quoted, span_hash, staged, text_chunks, word_hashes, words_of
from larkspur.llm.suffix_dedup import anchors, shared_ids
from larkspur.session import few, restaged, scoped

MIN_WORDS = 1  # of a line or paragraph; units without words are never cut
PASSAGE = 50  # words of a run
SEED = 10  # words of an anchor
BREAKS = {"line": "\n", "paragraph": "\n\n"}
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_OTHER = np.uint64(0xA0761D6478BD642F)  # for the second half of a digest


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _firsts(doc: np.ndarray, *digests: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its document with these digests; entries are in order."""
    order = np.lexsort((np.arange(len(doc)), *digests, doc))
    same = np.ones(len(doc), bool)
    for x in (doc, *digests):
        same[1:] &= x[order][1:] == x[order][:-1]
    same[:1] = False
    out = np.empty(len(doc), bool)
    out[order] = ~same
    return out


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of document and start, with those that touch made one. Ends rise with starts."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], end[np.append(first[1:], len(doc)) - 1] if len(doc) else end


def _table(batch: pa.RecordBatch, doc: np.ndarray, names: list[str], digests: list[np.ndarray | None], ints: list[np.ndarray]) -> pa.RecordBatch:
    """Digests (null for None), id and copy of each document, and places in it."""
    at = pa.array(doc)
    cells = [pa.nulls(len(doc), pa.int64()) if x is None else _long(x) for x in digests]
    return pa.RecordBatch.from_arrays([*cells, batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x.astype(np.int32)) for x in ints]], names=names)


def _runs(passage: int):
    """Anchors of all runs: their hash, the digest of the context, and the first and last run, in words.

    A context that its document has before needs no comparison with others: its words go, as a row without a hash.
    """
    names = ["seed", "c1", "c2", "_id", "_copy", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in text_chunks(batch, "text"):
                start, end, bounds = words_of(data, offsets)
                words = word_hashes(data, start, end)
                doc, _, lo, hi, seed, context = anchors(words, bounds, min(SEED, passage), passage)
                other = span_hash(prefix_hash(mix(words ^ _OTHER)), lo, hi + passage)
                lo, hi = lo - bounds[doc], hi - bounds[doc]
                new = _firsts(doc, seed, context, other)
                yield _table(batch, doc[new] + i, names, [seed[new], context[new], other[new]], [lo[new], hi[new]])
                again, lo, end = _joined(doc[~new], lo[~new], hi[~new] + passage)
                yield _table(batch, again + i, names, [None] * 3, [lo, end - passage])

    return run


def _each_run(passage: int):
    """The digest of each run from lo to hi of each entry of `list`; runs that their document has before are rows without a digest, `end` past the last of them."""
    names = ["d1", "d2", "_id", "_copy", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, "text"):
                start, end, bounds = words_of(data, offsets)
                words = word_hashes(data, start, end)
                one, two = prefix_hash(words), prefix_hash(mix(words ^ _OTHER))
                lists = batch.column(3).slice(i, j - i)
                size = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                lo, hi = np.asarray(flat.field("lo")), np.asarray(flat.field("hi"))
                n = hi - lo + 1
                doc = np.repeat(np.repeat(np.arange(j - i), size), n)
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first = bounds[doc] + at
                order = np.lexsort((at, doc))
                doc, at, first = doc[order], at[order], first[order]
                digest = [span_hash(x, first, first + passage) for x in (one, two)]
                new = _firsts(doc, *digest)
                yield _table(batch, doc[new] + i, names, [x[new] for x in digest], [at[new], at[new] + passage])
                again, start, end = _joined(doc[~new], at[~new], at[~new] + passage)
                yield _table(batch, again + i, names, [None] * 2, [start, end])

    return run


def later_runs(rows: DataFrame, passage: int) -> DataFrame:
    """(_id, _copy, start, end): words of runs of rows (_id, _copy, text) that occur earlier; equal rows are one document."""
    found = staged(rows.mapInArrow(_runs(passage), "seed long, c1 long, c2 long, _id long, _copy long, lo int, hi int"), "runs")
    seeds = found.where("seed is not null").groupBy("seed").agg(F.count("*").alias("n"), F.min("c1").alias("least"), F.max("c1").alias("most")).where("n > 1")
    seeds = staged(seeds.selectExpr("seed", "least <> most as differ"), "seeds")  # apart from the join, so that Spark can split a hot seed there
    twice = staged(found.join(seeds, "seed"), "twice")
    key = ["seed", "c1", "c2"]
    rank = F.struct("_id", "_copy", "lo", "hi")
    contexts = staged(twice.groupBy(*key).agg(F.count("*").alias("n"), F.min(rank).alias("first"), F.first("differ").alias("differ")), "contexts")
    whole = twice.join(contexts.where("n > 1").select(*key, "first"), key).where(~rank.eqNullSafe(F.col("first")))
    span = ["_id", "_copy", F.col("lo").alias("start"), (F.col("hi") + passage).alias("end")]
    whole = whole.select(*span).unionByName(found.where("seed is null").select(*span))

    lists = contexts.where("differ").select("first.*").groupBy(F.col("_id").alias("id"), F.col("_copy").alias("copy")).agg(F.collect_list(F.struct("lo", "hi")).alias("list"))
    lists = staged(lists, "lists")
    texts = rows.dropDuplicates(["_id", "_copy"]) if shared_ids(rows, "_id") else rows
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_copy") == F.col("copy"))
    texts = texts.join(few(lists.select("id", "copy"), BROADCAST_ROWS), same, "left_semi")
    joined = texts.join(lists, same).select("_id", "_copy", "text", "list")
    runs = staged(joined.mapInArrow(_each_run(passage), "d1 long, d2 long, _id long, _copy long, start int, end int"), "each")
    rank = F.struct("_id", "_copy", "start")
    first = staged(runs.where("d1 is not null").groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").drop("n"), "first")
    each = runs.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first"))).unionByName(runs.where("d1 is null"), allowMissingColumns=True)
    return whole.unionByName(each.select("_id", "_copy", "start", "end"))


def later_units(rows: DataFrame, sep: str, min_words: int) -> DataFrame:
    """(_id, _copy, pos): lines or paragraphs of rows (_id, _copy, text) that occur earlier; equal rows are one document."""
    units = rows.select("_id", "_copy", F.posexplode(F.split("text", sep, -1)).alias("pos", "unit"))
    norm = F.trim(F.regexp_replace(F.lower("unit"), r"[\x20\x09-\x0D]+", " "))
    units = units.select("_id", "_copy", "pos", norm.alias("norm")).where((F.col("norm") != "") & (F.size(F.split("norm", " ")) >= min_words))
    units = staged(units.select("_id", "_copy", "pos", F.xxhash64("norm").alias("d1"), F.xxhash64(F.lit(1), "norm").alias("d2")), "units")
    rank = F.struct("_id", "_copy", "pos")
    first = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("d1", "d2", "first")
    first = staged(first, "first")  # apart from the join, so that Spark can split a hot digest there
    return units.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first"))).select("_id", "_copy", "pos")


def cut_text(text: str, sep: str, units: set[int], runs: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """What stays of a text, and the spans that go: whole units, or words of others with the blanks after them. A unit without words left goes too."""
    gone: list[bool] = []
    if runs:
        edges = [0] * (max(e for _, e in runs) + 1)
        for a, b in runs:
            edges[a] += 1
            edges[b] -= 1
        depth = 0
        for x in edges:
            depth += x
            gone.append(depth > 0)
    stay, spans, at, word = [], [], 0, 0
    for k, unit in enumerate(text.split(sep)):
        tokens = _TOKEN.findall(unit) if runs else []
        own = [*gone[word : word + len(tokens)], *[False] * (len(tokens) - max(0, len(gone) - word))][: len(tokens)]
        word += len(tokens)
        if k in units or own and all(own):
            spans.append((at, at + len(unit)))
        elif any(own):
            place = at + len(unit) - sum(map(len, tokens))
            rest = [unit[: place - at]]
            for n, (token, out) in enumerate(zip(tokens, own, strict=True)):
                if not out:
                    rest.append(token)
                elif n and own[n - 1]:
                    spans[-1] = (spans[-1][0], place + len(token.rstrip()))
                else:
                    spans.append((place, place + len(token.rstrip())))
                place += len(token)
            stay.append("".join(rest))
        else:
            stay.append(unit)
        at += len(unit) + len(sep)
    return sep.join(stay), spans


def _cut(sep: str):
    """row, text, units that go and runs that go -> row, what stays, number of units, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, units, runs = batch.columns
            kept, spans, sizes = [], [], []
            for text, gone, words in zip(texts.to_pylist(), units.to_pylist(), runs.to_pylist(), strict=True):
                sizes.append(text.count(sep) + 1 if text else 0)
                stay, out = cut_text(text, sep, set(gone or ()), [(x["start"], x["end"]) for x in words or ()]) if gone or words else (text, [])
                kept.append(stay)
                spans.append([{"start": a, "end": b} for a, b in out])
            yield pa.RecordBatch.from_arrays([rows, pa.array(kept, pa.string()), pa.array(sizes, pa.int32()), pa.array(spans, _SPAN)], names=["row", "text", "n_units", "removed"])

    return run


@scoped
def _decided(docs: DataFrame, unit: str, min_words: int, passage: int, id_col: str, text_col: str) -> DataFrame:
    """(row, text, n_units, removed), a row for each row of docs, which `row` holds whole, so that no column of it clashes."""
    lean(docs.sparkSession)
    sep = BREAKS[unit]
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).cast("long").alias("_id"), F.xxhash64(text).alias("_copy"), text.alias("text"))
    narrow = rows.select("_id", "_copy", "text")
    cuts = later_units(narrow, sep, min_words).select("_id", "_copy", "pos", F.lit(None).cast("struct<start:int,end:int>").alias("run"))
    if passage:
        cuts = cuts.unionByName(later_runs(narrow, passage).select("_id", "_copy", F.lit(None).cast("int").alias("pos"), F.struct("start", "end").alias("run")))
    cuts = restaged(cuts, "later")
    cuts = cuts.groupBy(F.col("_id").alias("id"), F.col("_copy").alias("copy")).agg(F.collect_set("pos").alias("units"), F.collect_list("run").alias("runs"))
    joined = rows.join(cuts, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_copy") == F.col("copy")), "left").select("row", "text", "units", "runs")
    added = T._parse_datatype_string("text string, n_units int, removed array<struct<start:int,end:int>>")
    return joined.mapInArrow(_cut(sep), T.StructType([rows.schema["row"], *added.fields]))


def cut_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns and rows, the text cut; see unit_dedup. No name of a column clashes."""
    out = _decided(docs, unit, min_words, passage, id_col, text_col)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def unit_dedup(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the earliest occurrence, by (doc_id, position), of each unit and of each run of `passage` words.

    Units are lines or paragraphs of at least `min_words` words, compared in
    lower case with single blanks; words of runs are `[^\\x20\\x09-\\x0D]+` with
    A-Z in lower case. passage=0 leaves runs out. All is judged on the input,
    not on what is left.

    Returns (doc_id, text, n_units, removed): what stays, and the removed spans
    as [start, end) code points of the original text, whole units or words of
    one; one row for each row of docs. The separator goes with a removed unit,
    the blanks after it with a removed word. Null texts stay null and empty
    texts empty, with no units. Null ids rank first. Rows that agree in id and
    text count as one document and are treated alike; rows of one id rank by a
    hash of their text. No rows, no result. Other columns are ignored, whatever
    their names.
    """
    docs = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return _decided(docs, unit, min_words, passage, "doc_id", "text").select("row.doc_id", "text", "n_units", "removed")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, and runs of 50 words, over all of documents; removed lists start-end offsets."""
    out = unit_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.col("n_units").cast("long").alias("n_units"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
OP6_SQL = f"""
WITH u AS (
  SELECT doc_id, pos, units[pos + 1] AS unit,
         coalesce(list_sum(list_transform(units[1:pos], lambda x: length(x) + 1)), 0)::BIGINT AS off,
         trim(regexp_replace(lower(units[pos + 1]), '{_BLANK}+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, units, unnest(range(0, len(units))) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS units FROM documents WHERE text IS NOT NULL))),
l AS (SELECT doc_id, pos, unit, off, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS again FROM u),
t AS (SELECT doc_id, pos, k, toks[k] AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS i
      FROM (SELECT doc_id, pos, toks, unnest(range(1, len(toks) + 1)) AS k
            FROM (SELECT doc_id, pos, regexp_extract_all(unit, '{_WORD}+{_BLANK}*') AS toks FROM u))),
w AS (SELECT *, translate(regexp_replace(tok, '{_BLANK}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM t),
r AS (SELECT doc_id, pos, k, tok, i, md5(string_agg(word, ' ') OVER f) AS digest, count(*) OVER f = {PASSAGE} AS whole FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {PASSAGE - 1} FOLLOWING)),
q AS (SELECT *, whole AND row_number() OVER (PARTITION BY whole, digest ORDER BY doc_id, i) > 1 AS later FROM r),
c AS (SELECT *, count(*) FILTER (later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {PASSAGE - 1} PRECEDING AND CURRENT ROW) > 0 AS cut FROM q),
a AS (SELECT doc_id, pos, bool_and(cut) AS every, string_agg(tok, '' ORDER BY k) FILTER (NOT cut) AS rest FROM c GROUP BY doc_id, pos),
x AS (SELECT l.*, again OR coalesce(every, false) AS gone, regexp_extract(unit, '^{_BLANK}*') AS lead, rest FROM l LEFT JOIN a USING (doc_id, pos)),
p AS (SELECT c.*, length(regexp_replace(tok, '{_BLANK}+$', '')) AS size, off + length(lead)
        + coalesce(sum(length(tok)) OVER (PARTITION BY c.doc_id, c.pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
        k - row_number() OVER (PARTITION BY c.doc_id, c.pos, cut ORDER BY k) AS island
      FROM c JOIN x ON c.doc_id = x.doc_id AND c.pos = x.pos WHERE NOT gone),
s AS (SELECT doc_id, off AS b, off + length(unit) AS e FROM x WHERE gone
      UNION ALL SELECT doc_id, min(place), max(place + size) FROM p WHERE cut GROUP BY doc_id, pos, island),
m AS (SELECT doc_id, count(*) AS n_removed, string_agg(b::BIGINT || '-' || e::BIGINT, ',' ORDER BY b) AS removed FROM s GROUP BY doc_id),
z AS (SELECT doc_id, count(*) AS n_units, string_agg(lead || coalesce(rest, ''), chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(z.text, '') END AS text,
       CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_units END::BIGINT AS n_units,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
