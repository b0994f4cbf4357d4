"""Maintenance of the corpus tables as joins: upsert, prune, delete, list. Every function returns new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BITS = 20  # chunks of one document: ids are doc_id * 2**20 + chunk_idx, so they stay when a document is read again


def chunk_id(doc_id: str = "doc_id", chunk_idx: str = "chunk_idx") -> F.Column:
    """The id of a chunk; an error where doc_id is not below 2**43 or chunk_idx not below 2**20, as ids would collide."""
    doc, idx = F.col(doc_id).cast("long"), F.col(chunk_idx).cast("long")
    whole = doc.between(0, (1 << 63 - CHUNK_BITS) - 1) & idx.between(0, (1 << CHUNK_BITS) - 1)
    why = F.concat(F.lit("no chunk id for document "), doc.cast("string"), F.lit(", chunk "), idx.cast("string"))
    return F.when(doc.isNull() | idx.isNull() | whole, F.shiftleft(doc, CHUNK_BITS) + idx).otherwise(F.raise_error(why).cast("long"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in place of old ones with the same key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(new.columns))


def prune(old: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Only rows whose key is present; everything if nothing is present, as a failed walk must not empty the corpus."""
    return old if present.isEmpty() else old.join(present.select(key).distinct(), key, "left_semi")


def missing(old: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return old.join(present.select(key).distinct(), key, "left_anti")


def digests(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, d0, d1): the number of a document's chunks, and what two documents have in common only if their chunks are the same."""
    cell = ["chunk_idx", "heading", "content"]
    return chunks.groupBy(key).agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), *cell)).alias(f"d{k}") for k in (0, 1)])


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id): documents whose chunks are not the same in both, by number, headings and contents; of one table only too."""
    return differing(digests(old), digests(new))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """changed() of two tables of digests()."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "n", "d0", "d1")]
    return both.where(~(same[0] & same[1] & same[2] & same[3])).select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"))


def cascade_delete(documents: DataFrame, chunks: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents of these paths."""
    gone = documents.join(paths.select("path").distinct(), "path", "left_semi").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def next_chunk_idx(chunks: DataFrame) -> DataFrame:
    """(doc_id, next_idx) of each document with chunks."""
    return chunks.groupBy("doc_id").agg((F.max("chunk_idx") + 1).alias("next_idx"))


def list_documents(documents: DataFrame, chunks: DataFrame, prefix: str = "") -> DataFrame:
    """(path, title, headings, ingested_at) by literal path prefix; headings in order, a null heading's chunk is left out."""
    own = documents.where(F.col("path").startswith(prefix)) if prefix else documents
    rows = own.join(chunks.where("heading is not null").select("doc_id", "chunk_idx", "heading"), "doc_id")
    grouped = rows.groupBy("doc_id", "path", "title", "ingested_at").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "heading"))).alias("at"))
    return grouped.select("path", "title", F.transform("at", lambda x: x["heading"]).alias("headings"), "ingested_at")


def number_rows(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers from start + 1 on in the order of a unique column, without a single-task sort.

    df must be a stored table: it is read twice and has to be the same both times.
    """
    from pyspark.sql import Window

    from larkspur.session import staged

    ranged = staged(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min(order).alias("least")).orderBy("least").collect()  # a row for each partition
    before, rows = start, []
    for r in sizes:
        rows.append((r["_part"], before))
        before += r["n"]
    if not rows:
        return df.withColumn(name, F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    place = Window.partitionBy("_part").orderBy(order)
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(place) + F.col("_before")).drop("_part", "_before")
