"""Vectors as product-quantised codes by Lloyd rounds over partition-local cover trees.

Every block of rows of a task gets one cover tree for each part of the vectors,
built once and stored: points in tree order with cumulative sums, so that the
sum of any subtree is a difference of two rows. In a round, a whole subtree goes
to an entry if the triangle inequality shows that no point of it can be nearer
to another (or as near); only nodes left ambiguous descend, down to points that
are compared exactly, in whole numbers. A round sends one row for each part,
entry and component from a task, summed by Spark before the driver sees them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import lean, staged
from larkspur.session import few

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 4096  # vectors that share a tree
LARGEST = 1 << 15  # components beyond are taken as this, so that squared distances fit 64 bits
LABEL_ROWS = 1_000_000  # sums by label that may be broadcast
_NODE = ("center", "start", "end", "child", "children")


def cover_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree of whole-number points, by levels: `order` of points, and for each node its center (a place in that order), its run of points [start, end), radius, first child and number of children.

    A child's points lie within half the node's radius of its center, and centers
    of one node lie further apart than that. The first point of a node is its
    center. A node of radius 0, of equal points, is a leaf.
    """

    def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(1))

    n = len(x)
    order, own = np.arange(n), np.zeros(n, np.int64)
    start, end = np.zeros(1, np.int64), np.full(1, n)
    radius = np.array([lengths(x, x[:1]).max()])
    levels, base = [], 0
    while True:
        below = base + len(start)
        inner = radius > 0
        own_of = np.repeat(np.arange(len(start)), end - start)
        place = np.concatenate([np.arange(a, b) for a, b in zip(start[inner], end[inner], strict=True)]) if inner.any() else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(start))[inner], (end - start)[inner])
        child, made = np.full(len(place), -1), 0
        points = x[order[place]]
        left = np.arange(len(place))
        while len(left):
            first = np.flatnonzero(np.diff(own[left], prepend=-1))
            which = np.cumsum(np.diff(own[left], prepend=-1) != 0) - 1
            near = lengths(points[left], points[left[first]][which]) <= radius[own[left]] / 2
            child[left[near]] = made + which[near]
            made += len(first)
            left = left[~near]
        moved = np.lexsort((child, own))
        order[place] = order[place[moved]]
        own, child = own[moved], child[moved]
        cut = np.flatnonzero((np.diff(child, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
        children = np.bincount(own[cut], minlength=len(start)) if len(cut) else np.zeros(len(start), np.int64)
        levels.append((start, start, end, below + np.cumsum(children) - children, children, radius))
        if not len(cut):
            break
        base = below
        start, end = place[cut], place[np.append(cut[1:], len(place)) - 1] + 1
        span = end - start
        where = np.repeat(start - np.cumsum(span) + span, span) + np.arange(span.sum())
        radius = np.maximum.reduceat(lengths(x[order[where]], np.repeat(x[order[start]], span, 0)), np.cumsum(span) - span)
    whole = [np.concatenate(c) for c in zip(*levels, strict=True)]
    return dict(zip(_NODE, (c.astype(np.int32) for c in whole), strict=False)) | {"radius": whole[5], "order": order.astype(np.int32)}


def descend(tree: dict[str, np.ndarray], x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes, entry of all points of each, nodes looked at): nodes that cover the tree, each wholly nearest to one entry of book; ties go to the lower index. x is in tree order."""
    front, nodes, entries, seen = np.zeros(1, np.int64), [], [], 0
    while len(front):
        seen += len(front)
        square = ((x[tree["center"][front]][:, None, :] - book[None]) ** 2).sum(2)
        best = square.argmin(1)
        away = np.sqrt(square)
        rows = np.arange(len(front))
        first = away[rows, best]
        away[rows, best] = np.inf
        radius = tree["radius"][front]
        sure = (radius == 0) | ((first + 2 * radius) * (1 + 1e-9) + 1e-6 < away.min(1))
        nodes.append(front[sure])
        entries.append(best[sure])
        open_ = front[~sure]
        count = tree["children"][open_]
        front = np.repeat(tree["child"][open_] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.concatenate(nodes), np.concatenate(entries), seen


def _blocks(parts: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.asarray(table.column(2).combine_chunks().flatten(), np.int64).reshape(len(table), -1)
            trees = [cover_tree(p) | {"points": p} for p in np.split(x, parts, 1)]
            for t in trees:
                t["points"] = t["points"][t["order"]].astype(np.int32)
            one = lambda a: pa.array([a.to_pylist()], pa.list_(a.type))
            cells = [one(table.column(0).combine_chunks()), one(table.column(1).combine_chunks())]
            names = ["ids", "labels"]
            for key in ("points", "order", "radius", *_NODE):
                cells.append(pa.array([[np.ascontiguousarray(t[key]).tobytes() for t in trees]], pa.list_(pa.binary())))
                names.append(key)
            return pa.RecordBatch.from_arrays(cells, names=names)

        size = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                take = batch.slice(at, rows - size)
                held.append(take)
                size, at = size + len(take), at + len(take)
                if size == rows:
                    yield made()
                    held, size = [], 0
        if size:
            yield made()

    return run


def _trees(batch: pa.RecordBatch, row: int, width: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    cell = {key: batch.column(batch.schema.get_field_index(key))[row].as_py() for key in ("points", "order", "radius", *_NODE)}
    for p in range(len(cell["points"])):
        tree = {key: np.frombuffer(cell[key][p], np.float64 if key == "radius" else np.int32) for key in cell}
        yield tree, tree["points"].reshape(-1, width).astype(np.int64)


def _sums(books: list[np.ndarray]):
    parts, (entries, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for p, (tree, x) in enumerate(_trees(batch, row, width)):
                    nodes, entry, _ = descend(tree, x, books[p])
                    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(x, 0)])
                    start, end = tree["start"][nodes], tree["end"][nodes]
                    np.add.at(n[p], entry, (end - start).astype(np.int64))
                    np.add.at(total[p], entry, running[end] - running[start])
        p, e = (a.ravel() for a in np.indices((parts, entries)))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n.ravel()), *[pa.array(total[:, :, k].ravel()) for k in range(width)]], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    return run


def _codes(books: list[np.ndarray]):
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, labels = batch.column(0)[row].values, batch.column(1)[row].values
                code, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for p, (tree, x) in enumerate(_trees(batch, row, width)):
                    nodes, entry, _ = descend(tree, x, books[p])
                    by = np.argsort(tree["start"][nodes], kind="stable")
                    each = np.repeat(entry[by], (tree["end"] - tree["start"])[nodes[by]])
                    code[tree["order"], p] = each
                    error[tree["order"]] += ((x - books[p][each]) ** 2).sum(1)
                text = code.tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): each vector as one byte for each part, in hex.

    Rows whose vector is null, empty or holds a null or non-finite component are
    left out, and so are those of another length than the vector of the least
    id; that length must be a multiple of `parts`. Components become whole
    numbers floor(scale * x); beyond LARGEST in size they are taken as LARGEST.
    The first codebooks are the parts of the vectors of the least distinct ids
    (of rows that share an id the least vector); with fewer ids than entries
    there are fewer entries, and without any id no row has a code. Equal
    distances go to the lower entry, equal rows have equal codes, each row keeps
    its own, and rows without an id have one, too. An empty table gives an empty
    one; other columns are ignored.
    """
    spark = vectors.sparkSession
    lean(spark)
    kind = vectors.schema[label_col].dataType
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # NaN is greater than any number for Spark.
    kept = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    schema = f"vec_id long, label {kind.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    least = kept.where("vec_id is not null").orderBy("vec_id", "v").select(F.size("v").alias("d")).first()
    if least is None:
        return spark.createDataFrame([], schema)
    if least["d"] % parts:
        raise ValueError(f"vectors of {least['d']} components have no {parts} equal parts")
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x, F.lit(-float(LARGEST))), F.lit(float(LARGEST))) * scale))
    kept = kept.where(F.size("v") == least["d"]).select("vec_id", "label", whole.alias("v"))
    first = [r["vec_id"] for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    seeds = kept.where(F.col("vec_id").isin(first)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    books = np.split(np.array([r["v"] for r in seeds], np.int64), parts, 1)
    names = ["points", "order", "radius", *_NODE]
    blocks = staged(kept.mapInArrow(_blocks(parts, block_rows), "ids array<bigint>, labels array<string>, " + ", ".join(f"{n} array<binary>" for n in names)), "trees")
    width = books[0].shape[1]
    cells = [f"s{k}" for k in range(width)]
    for _ in range(rounds):
        partial = blocks.mapInArrow(_sums(books), "part int, entry int, n long, " + ", ".join(f"{c} long" for c in cells))
        books = [b.copy() for b in books]
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cells]).where("n > 0").collect():  # parts * entries rows
            books[r["part"]][r["entry"]] = [r[c] // r["n"] for c in cells]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = staged(blocks.mapInArrow(_codes(books), "vec_id long, label string, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(few(sums, LABEL_ROWS), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.col("label").cast(kind).alias("label"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _sql() -> str:
    distance = "list_sum(list_transform(range(1, len(a.x) + 1), lambda j: (a.x[j] - b.x[j]) * (a.x[j] - b.x[j])))::BIGINT"
    near = "SELECT a.p, a.i, any_value(a.x) AS x, min({{'d': {d}, 'e': b.e}}) AS best FROM parts a JOIN {b} b ON a.p = b.p GROUP BY a.p, a.i"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(d=distance, b=f'b{r}')})")
        steps.append(f"m{r} AS (SELECT p, best.e AS e, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM n{r}, range(1, (SELECT any_value(len(x)) FROM parts) + 1) t(j) GROUP BY p, best.e, j)")
        steps.append(f"u{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{r} GROUP BY p, e)")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u ON b.p = u.p AND b.e = u.e)")
    steps.append(f"last AS MATERIALIZED ({near.format(d=distance, b=f'b{ROUNDS}')})")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT i, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, x FROM parts WHERE i <= {ENTRIES}),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
codes AS (SELECT i, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY i)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (i), digest
"""


OP12_SQL = _sql()
