"""Dense vectors: cosine of a query set against all rows in blocks, or against stored clusters that the triangle inequality cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.lexical import top
from larkspur.session import staged

QUERY_BLOCK = 512


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _best(ids: list[int], block: np.ndarray, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a partition for each query: what is shuffled does not grow with a partition."""
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            sims = np.round(block @ _matrix(batch.column(1)).T, 9)
            for q in range(len(ids)):
                who, s = np.concatenate([held[q][0], rows]), np.concatenate([held[q][1], sims[q]])
                keep = np.lexsort((who, -s))[:k]
                keep = keep[s[keep] >= least]
                held[q] = who[keep], s[keep]
        n = [len(h[0]) for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]))], names=["query_id", "chunk_id", "score"])

    return run


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(query_id, chunk_id, score, rank) by dot product of unit vectors.

    queries(query_id, vector) are taken in blocks of QUERY_BLOCK, vectors
    (chunk_id, vector) are read once for each block. Vectors that are null or of
    another length than the query's score nothing.
    """
    usable = queries.where("query_id is not null and vector is not null and size(vector) > 0")
    lengths = [r[0] for r in usable.select(F.size("vector")).distinct().collect()]
    found = None
    for d in lengths:
        own = usable.where(F.size("vector") == d)
        blocks = -(-own.count() // QUERY_BLOCK)
        rows = vectors.where(F.size("vector") == d).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
        for b in range(blocks):
            part = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("vector").cast("array<double>")).collect()
            if part:
                out = rows.mapInArrow(_best([r[0] for r in part], np.array([r[1] for r in part], np.float64), k, least), "query_id long, chunk_id long, score double")
                found = out if found is None else found.unionByName(out)
    if found is None:
        return top(queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double"), k)
    return top(found, k)


PIVOTS = 256
_SLACK = 1e-7  # of angles and scores, for rounding


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ pivots.T
                at = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), at], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle), pa.array(at, pa.int32())], names=["chunk_id", "vector", "angle", "cluster"])

    return run


def _best_of_clusters(block: np.ndarray, asked: dict[int, np.ndarray], ids: list[int], k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a batch of each query among the clusters that it asks for."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, vectors, cluster = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for c in np.unique(cluster):
                own = np.flatnonzero(cluster == c)
                sims = np.round(block[asked[int(c)]] @ vectors[own].T, 9)
                for q, s in zip(asked[int(c)], sims, strict=True):
                    keep = np.lexsort((rows[own], -s))[:k]
                    keep = keep[s[keep] >= least]
                    out.append((np.full(len(keep), ids[q], np.int64), rows[own[keep]], s[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "chunk_id", "score"])

    return run


class DenseIndex:
    """Unit vectors stored by cluster, each around a pivot with the largest angle of its vectors to it.

    A vector is no nearer to a query than the angle of the pivot less that
    largest one. So a query first reads the clusters nearest to it, until they
    have k vectors, and then those only whose bound reaches its k-th score; all
    others are partitions that the scan leaves out. The result is that of
    dense_search(), ties included. `compared` and `stored` say how much of the
    last search was read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.compared, self.stored = spark, path.rstrip("/"), 0, 0

    def build(self, vectors: DataFrame, pivots: int = PIVOTS) -> DenseIndex:
        """Store vectors(chunk_id, vector): unit vectors of one length; null ones and those of other lengths than the first pivot are left out. Pivots are the vectors of least hashed id, `pivots` of them."""
        usable = vectors.where("vector is not null and size(vector) > 0").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
        first = [r["vector"] for r in usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).collect()]
        first = np.array([v for v in first if len(v) == len(first[0])], np.float64)
        rows = usable.where(F.size("vector") == (len(first[0]) if len(first) else -1))
        near = rows.mapInArrow(_nearest(first), "chunk_id long, vector array<double>, angle double, cluster int")
        near.repartition("cluster", F.pmod("chunk_id", F.lit(16))).write.partitionBy("cluster").mode("overwrite").parquet(f"{self.path}/vectors")
        pivot = self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(first)], "cluster int, pivot array<double>")
        sizes = self._vectors().groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        sizes.join(F.broadcast(pivot), "cluster").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clusters")
        return self

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema("chunk_id long, vector array<double>, angle double, cluster int").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, least: float = -2.0) -> DataFrame:
        """(query_id, chunk_id, score, rank) for queries(query_id, vector), in blocks of QUERY_BLOCK; queries that are null or of another length find nothing."""
        clusters = self.spark.read.parquet(f"{self.path}/clusters").orderBy("cluster").collect()  # a row for each pivot
        none = top(self.spark.createDataFrame([], "query_id long, chunk_id long, score double"), k)
        if not clusters:
            return none
        number, n, radius = (np.array([r[c] for r in clusters]) for c in ("cluster", "n", "radius"))
        pivots = np.array([r["pivot"] for r in clusters], np.float64)
        self.compared, self.stored, found = 0, int(n.sum()), None
        usable = queries.where((F.size("vector") == pivots.shape[1]) & F.col("query_id").isNotNull())
        blocks = -(-usable.count() // QUERY_BLOCK)
        for b in range(blocks):
            part = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("vector").cast("array<double>")).collect()
            if part:
                out = self._block([r[0] for r in part], np.array([r[1] for r in part], np.float64), k, least, number, n, radius, pivots)
                found = out if found is None else found.unionByName(out)
        return none if found is None else found

    def _block(self, ids: list[int], block: np.ndarray, k: int, least: float, number: np.ndarray, n: np.ndarray, radius: np.ndarray, pivots: np.ndarray) -> DataFrame:
        angle = np.arccos(np.clip(block @ pivots.T, -1, 1))
        bound = np.cos(np.maximum(0, angle - radius - _SLACK)) + _SLACK
        order = np.argsort(angle, 1)
        before = np.cumsum(n[order], 1) - n[order]
        near = np.zeros_like(bound, bool)
        np.put_along_axis(near, order, before < k, 1)

        def scan(asked: np.ndarray) -> DataFrame:
            self.compared += int((asked * n).sum())
            wanted = {int(number[c]): np.flatnonzero(asked[:, c]) for c in np.flatnonzero(asked.any(0))}
            rows = self._vectors().where(F.col("cluster").isin(list(wanted))).select("chunk_id", "vector", "cluster")
            return top(rows.mapInArrow(_best_of_clusters(block, wanted, ids, k, least), "query_id long, chunk_id long, score double"), k).drop("rank")

        first = staged(scan(near), "near")
        place = {q: i for i, q in enumerate(ids)}
        reach = np.full(len(ids), least)
        for r in first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect():  # a row for each query of the block
            if r["n"] >= k:
                reach[place[r["query_id"]]] = max(least, r["score"])
        more = (bound >= reach[:, None]) & ~near
        return top(first.unionByName(scan(more)), k) if more.any() else top(first, k)
