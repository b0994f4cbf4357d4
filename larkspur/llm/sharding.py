"""Sharding by extendible hashing.

A directory of hash-prefix buckets: one bucket holds all rows, and only buckets
over the byte limit split on one more bit. All depths of a directory are summed
in one pass over narrow rows; only if some bucket is still too large at the
deepest level of the pass do its rows go on to the next levels.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import quoted, staged

ID_BITS, TEXT_BITS, ROW_BITS = 34, 14, 14  # of the hash: of the id, then of the text, then of the row; a second hash is all of the row
BITS = ID_BITS + TEXT_BITS + ROW_BITS


def _leading(value: F.Column, bits: int) -> F.Column:
    """The leading bits, 48 at most, of the MD5 of a value, as a long; null hashes like an empty string."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), 48 - bits)


def hash_bits(key: F.Column, text: F.Column) -> F.Column:
    """Hash bits of a row: its id tells most rows apart, its text those of one id, and the row's own number equal ones."""
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    return F.shiftleft(_leading(key, ID_BITS), TEXT_BITS + ROW_BITS) + F.shiftleft(_leading(text, TEXT_BITS), ROW_BITS) + row


def _directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows(hash, more, n_bytes, ...), a stored table, with shard_depth, shard_prefix, shard_part, shard_bytes and shard_rows.

    `hash` decides to a depth of BITS; what is too large even there, rows of one
    id and text, is split on by `more`.
    """
    rest = [F.col(quoted(c)) for c in rows.columns if c not in ("hash", "more")]
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, live = None, rows.withColumn("within", F.lit(0).cast("long"))
    for second in (False, True):
        base, depth = 0, 16 if second else min(BITS, math.ceil(math.log2(max(1, total / limit))) + 4)
        while True:
            fine = live.groupBy("within", F.shiftright("hash", BITS - depth).alias("fine")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
            fine = staged(fine, "fine").withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(depth))))
            fine = fine.withColumn("prefix", F.expr(f"shiftright(fine, {depth} - depth)"))
            levels = fine.groupBy("within", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
            fits = levels.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
            leaf = fine.select("within", "fine", "depth", "prefix").join(fits, ["within", "depth", "prefix"]).groupBy("within", "fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
            leaf = staged(leaf, "directory")
            live = live.withColumn("fine", F.shiftright("hash", BITS - depth))
            place = [F.col("leaf.depth"), F.col("leaf.prefix"), F.lit(0).cast("long")]
            if second:
                place = [F.col("leaf.depth") + BITS, F.col("within"), F.col("leaf.prefix")]
            out = live.join(leaf, ["within", "fine"]).select(*rest, *[c.alias(n) for c, n in zip(place, ("shard_depth", "shard_prefix", "shard_part"), strict=True)], "leaf.shard_bytes", "leaf.shard_rows")
            done = out if done is None else done.unionByName(out)
            live = live.join(leaf, ["within", "fine"], "left_anti").drop("fine")
            if depth == BITS or live.isEmpty():
                break
            live = staged(live, "rows")
            base, depth = depth + 1, min(BITS, depth + 8)
        if live.isEmpty():
            return done
        live = staged(live.select(*[quoted(c) for c in live.columns if c not in ("hash", "more", "within")], F.col("more").alias("hash"), F.lit(0).cast("long").alias("more"), F.col("hash").alias("within")), "beyond")
    return done


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> list[F.Column]:
    key, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")
    return [key.alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(key, text).alias("hash"), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(1)), 64 - BITS).alias("more")]


def extendible_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard_depth, shard_prefix, shard_part, shard_bytes, shard_rows), one row for each row of docs.

    A shard is the hash prefix `shard_prefix` of `shard_depth` bits, beyond BITS
    of them the whole hash and `shard_part` of the row's; every shard
    is within `limit` bytes of text unless it is a single row that is larger.
    Rows that share an id, a null one too, split by their text, and equal rows,
    however many, by their number. Null and empty texts have no bytes. Other columns are
    ignored, whatever their names. No rows, no shards.
    """
    return _directory(staged(docs.select(*_narrow(docs, id_col, text_col)), "rows"), limit)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs under path/shard=<depth>-<prefix>-<part>/, one folder a shard, and return the shards as (shard, bytes, rows).

    The files hold one column `row` with all columns of docs, so that none
    clashes with the name of the folder: read(...).select("row.*"). The table is
    staged once, as equal rows are told apart by their number in it.
    """
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *_narrow(docs, id_col, text_col)[1:])
    placed = _directory(staged(rows, "rows"), limit)
    shard = F.format_string("%d-%x-%x", "shard_depth", "shard_prefix", "shard_part").alias("shard")
    placed.select("row", shard).repartition("shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
    return placed.select(shard, F.col("shard_bytes").alias("bytes"), F.col("shard_rows").alias("rows")).distinct()


LIMIT = 1 << 20


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text over all of documents."""
    return extendible_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), LIMIT).drop("shard_part")


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT >> {48 - ID_BITS}) << {TEXT_BITS + ROW_BITS})
         + ((('0x' || substr(md5(coalesce(text, '')), 1, 12))::BIGINT >> {48 - TEXT_BITS}) << {ROW_BITS}) AS h
  FROM documents),
l AS (
  SELECT k.depth, h >> ({BITS} - k.depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows
  FROM d, (SELECT unnest(range(0, {BITS - ROW_BITS} + 1))::INTEGER AS depth) k GROUP BY ALL),
f AS (SELECT * FROM l WHERE shard_bytes <= {LIMIT} OR shard_rows = 1),
m AS (SELECT h, min(depth) AS depth FROM (SELECT DISTINCT h FROM d) x JOIN f ON f.prefix = x.h >> ({BITS} - f.depth) GROUP BY h)
SELECT d.doc_id, d.n_bytes, m.depth AS shard_depth, f.prefix AS shard_prefix, f.shard_bytes, f.shard_rows
FROM d JOIN m ON d.h = m.h JOIN f ON f.depth = m.depth AND f.prefix = d.h >> ({BITS} - m.depth)
"""
