"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with a cosine of c or more are at a squared distance of 2 - 2c or
less. The vectors are rotated and split into blocks of few dimensions; of such
a pair at least one block is within that block's share of the budget, in
proportion to its dimensions. Each block is a range join of its own: its first
coordinate is cut into slabs as wide as the block's radius, so partners are in
the same or the next slab. Candidates of all blocks are verified exactly on
the whole vectors in double precision; a pair that several blocks find counts
in the first of them.

Equal vectors are joined before. Slabs are cut into chunks of bounded size, and
TILE chunks of a slab against TILE others are a task, so that a chunk is sent to
a TILE-th of the tasks that pairs of chunks would be. A task compares its chunks
two by two and returns counts of links and stars (member, smallest member),
never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import staged
from larkspur.llm.graph import components

BLOCKS = 4
CHUNK = 8192  # vectors of a chunk
TILE = 8  # chunks of a side of a task; a task holds both sides
STRIP = 256  # rows of a chunk that are compared at once
SLICE = 1 << 16  # candidate pairs that are verified at once
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cuts(dims: int) -> np.ndarray:
    """Bounds of the blocks."""
    return np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that no square overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def block_distances(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat((x - y) ** 2, at[:-1], axis=1)


def _place(cosine: float):
    """A row for each vector, block and slab side: slab `home` of the vector, or the slab below, to which it comes as a guest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, column = batch.column(0), batch.column(1)
            sizes = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten())
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = units(flat[starts[rows][:, None] + np.arange(d)[None, :]]) @ rotation(int(d))
                at = cuts(int(d))
                for b in range(len(at) - 1):
                    radius = np.sqrt((2 - 2 * cosine) * (at[b + 1] - at[b]) / d + SLACK)
                    slab = np.floor(x[:, at[b]] / radius).astype(np.int32)
                    ids = rep.take(pa.array(rows))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(slab)], names=["rep", "dims", "block", "slab"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One row for a chunk: its ids, copies and vectors as bytes, the vectors in the precision that they came in."""
    first = table.slice(0, 1).drop_columns(["vector"]).to_pylist()[0]
    cell = lambda a, t=None: np.ascontiguousarray(a, t).tobytes()
    x = np.asarray(table.column("vector").combine_chunks().flatten())
    return pa.table({
        "dims": pa.array([first["dims"]], pa.int32()), "block": pa.array([first["block"]], pa.int32()), "slab": pa.array([first["slab"]], pa.int32()), "chunk": pa.array([first["chunk"]], pa.int32()),
        "ids": pa.array([cell(table.column("rep").to_numpy(), np.int64)], pa.binary()), "copies": pa.array([cell(table.column("copies").to_numpy(), np.int64)], pa.binary()), "vectors": pa.array([cell(x)], pa.binary()),
    })


def _compare(cosine: float, wide: bool):
    def run(table: pa.Table) -> pa.Table:
        """The chunks of one side with those of the other, or of one tile among themselves."""
        at = {name: table.column(name) for name in table.column_names}
        # The cells stay where they are; a chunk's arrays are views of them.
        rows = [{n: at[n][i].as_py() for n in ("dims", "block", "side", "chunk")} | {n: at[n][i].as_buffer() for n in ("ids", "copies", "vectors")} for i in range(len(table))]
        rows.sort(key=lambda r: r["chunk"])
        one, two = ([r for r in rows if r["side"] == side] for side in (0, 1))
        same = at["s1"][0].as_py() == at["s2"][0].as_py() and at["c1"][0].as_py() == at["c2"][0].as_py()
        pairs = [(a, b) for i, a in enumerate(one) for b in one[i:]] if same else [(a, b) for a in one for b in two]
        kind = np.float64 if wide else np.float32
        none = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("star", pa.int64())]).empty_table()
        return pa.concat_tables([none, *(_chunks(a, b, cosine, kind) for a, b in pairs)])

    return run


def _chunks(one: dict, two: dict, cosine: float, kind: type) -> pa.Table:
    d, b = one["dims"], one["block"]
    at = cuts(d)
    budget = (2 - 2 * cosine) * np.diff(at) / d + SLACK
    sides = []
    for v in (one, two):
        ids, copies = np.frombuffer(v["ids"], np.int64), np.frombuffer(v["copies"], np.int64)
        u = units(np.frombuffer(v["vectors"], kind).reshape(len(ids), d))
        sides.append((ids, copies, u, u @ rotation(d)))
    (ids1, n1, u1, r1), (ids2, n2, u2, r2) = sides
    same = one is two
    p1, p2 = r1[:, at[b] : at[b + 1]].astype(np.float32), r2[:, at[b] : at[b + 1]].astype(np.float32)
    q1, q2 = (p1 * p1).sum(1), (p2 * p2).sum(1)
    links1, links2 = np.zeros(len(ids1), np.int64), np.zeros(len(ids2), np.int64)
    parent = np.arange(len(ids1) + len(ids2))
    for s in range(0, len(ids1), STRIP):
        near = q1[s : s + STRIP, None] + q2[None, :] - 2 * (p1[s : s + STRIP] @ p2.T) <= np.float32(budget[b] + 1e-4)
        i, j = np.nonzero(near)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), SLICE):
            a, c = i[k : k + SLICE], j[k : k + SLICE]
            within = block_distances(r1[a], r2[c], at) <= budget
            own = within[:, b] & ~within[:, :b].any(1)
            a, c = a[own], c[own]
            linked = (u1[a] * u2[c]).sum(1) >= cosine
            a, c = a[linked], c[linked]
            links1 += np.bincount(a, n2[c], len(ids1)).astype(np.int64)
            links2 += np.bincount(c, n1[a], len(ids2)).astype(np.int64)
            _join(parent, a, c + len(ids1))
    ids = np.concatenate([ids1, ids2])
    root = parent[parent]
    while (root != root[root]).any():
        root = root[root]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    star = least[root]
    links = np.concatenate([links1, links2])
    out = np.flatnonzero((links > 0) | (star != ids))
    return pa.table({"rep": pa.array(ids[out]), "links": pa.array(links[out]), "star": pa.array(star[out])})


def _join(parent: np.ndarray, a: np.ndarray, c: np.ndarray) -> None:
    """Union of pairs in a forest of least positions, all at once until it is stable."""
    while len(a):
        ra, rc = parent[a], parent[c]
        while True:
            up_a, up_c = parent[ra], parent[rc]
            if (up_a == ra).all() and (up_c == rc).all():
                break
            ra, rc = up_a, up_c
        apart = ra != rc
        if not apart.any():
            return
        a, c, ra, rc = a[apart], c[apart], ra[apart], rc[apart]
        np.minimum.at(parent, np.maximum(ra, rc), np.minimum(ra, rc))


def _dealt(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """A row of a chunk for each task (s1, c1, s2, c2) of two tiles that it takes part in, on side 0 or 1."""
    slab = ["dims", "block", "slab"]
    # A tile goes to a task with each tile of its own slab, of the next one, and of the one before.
    for shift, name in ((0, "here"), (1, "above"), (-1, "below")):
        packed = packed.join(counts.select("dims", "block", (F.col("slab") - shift).alias("slab"), F.ceil(F.col("chunks") / TILE).cast("int").alias(name)), slab, "left")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda s1, c1, s2, c2, side: F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"), side.cast("int").alias("side"))
    s, c = F.col("slab"), F.floor(F.col("chunk") / TILE).cast("int")
    tasks = F.concat(
        F.transform(upto("here"), lambda x: task(s, F.least(c, x), s, F.greatest(c, x), c > x)),
        F.transform(upto("above"), lambda x: task(s, c, s + 1, x, F.lit(0))),
        F.transform(upto("below"), lambda x: task(s - 1, x, s, c, F.lit(1))),
    )
    sent = ["dims", "block", "chunk", "ids", "copies", "vectors"]
    return packed.select(*sent, F.explode(tasks).alias("t")).select(*sent, "t.*")


def embedding_links(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Links are pairs of rows with a cosine of at least `cosine` in double
    precision; component_id is the smallest id reachable by links and kept
    tells whether it is the row's own. Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Repeated rows link with each other; a null id has a null
    component, counts as a link of others and joins them, but is never the
    smallest. No rows, no result. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    wide = not isinstance(getattr(rows.schema["vector"].dataType, "elementType", None), T.FloatType)
    kind = "double" if wide else "float"
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size("vector") > 0) & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = staged(rows.withColumn("key", F.when(usable, F.transform("vector", lambda x: x + F.lit(0).cast(kind)))).drop("vector"), "vectors")
    sets = rows.where("key is not null").groupBy(F.col("key").alias("vector")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # A vector that only rows without an id have gets a stand-in, which never becomes a component.
    sets = staged(sets.select("vector", F.col("rep").isNotNull().alias("named"), F.coalesce("rep", -F.lit(1) - F.abs(F.xxhash64("vector"))).alias("rep"), "copies"), "distinct")

    placed = sets.select("rep", "vector").mapInArrow(_place(cosine), "rep long, dims int, block int, slab int")
    placed = staged(placed, "placed")
    slab = ["dims", "block", "slab"]
    # At most 2 / radius slabs a block and BLOCKS blocks for each length of vectors.
    counts = F.broadcast(staged(placed.groupBy(*slab).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "slabs"))
    chunked = placed.join(counts, slab).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    packed = chunked.join(sets, "rep").groupBy(*slab, "chunk").applyInArrow(_pack, "dims int, block int, slab int, chunk int, ids binary, copies binary, vectors binary")
    packed = staged(packed, "chunks")

    dealt = _dealt(packed, counts)
    found = dealt.groupBy("dims", "block", "s1", "c1", "s2", "c2").applyInArrow(_compare(cosine, wide), "rep long, links long, star long")
    found = staged(found, "found")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("star <> rep").select(F.col("star").alias("a"), F.col("rep").alias("b")))
    sets = sets.join(links, "rep", "left").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    if not sets.where("not named").isEmpty():
        sets = staged(sets.withColumn("component", F.coalesce("component", "rep")), "sets")
        least = sets.where("named").groupBy("component").agg(F.min("rep").alias("least"))
        sets = sets.join(least, "component", "left").withColumn("component", F.col("least"))
    sets = sets.select(F.col("vector").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", F.when(F.col("named"), F.col("rep"))).alias("component"))
    out = rows.join(sets, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Cosine 0.9 over all of embeddings."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept
FROM c LEFT JOIN k ON k.a = c.id
"""


def with_near_copies(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) and a near copy of every third vector, with an id that is larger by 10**9: each component is changed by a tenth of itself at most, by a rule."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = F.transform("embedding", lambda x, i: x * (1.0 + 0.1 * (F.pmod(F.col("vec_id") * 31 + (i + 1) * 17, F.lit(13)) - 6) / 6))
    return rows.unionByName(rows.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), moved.alias("embedding")))


def near_embeddings(spark, sf_dir: str) -> DataFrame:
    """Cosine 0.9 over all of embeddings and near copies of a third of them, so that there are links."""
    return embedding_links(with_near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


NEAR_SQL = OP9_SQL.replace("FROM embeddings", "FROM near").replace(
    "WITH RECURSIVE v AS",
    """WITH RECURSIVE near AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000000, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * (1 + 0.1::DOUBLE * ((vec_id * 31 + i * 17) % 13 - 6) / 6)) FROM embeddings WHERE vec_id % 3 = 0),
v AS""",
    1,
)
