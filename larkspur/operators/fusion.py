"""Weighted reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import score_label
from larkspur.operators.lexical import top

RRF_K = 60
LEXICAL_WEIGHT, VECTOR_WEIGHT = 4.0, 0.5


def fuse(lexical: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank, label): the sum of weight / (60 + rank) over both lists."""
    parts = [x.select("query_id", "chunk_id", (F.lit(w) / (F.col("rank") + RRF_K)).alias("part")) for x, w in ((lexical, LEXICAL_WEIGHT), (vector, VECTOR_WEIGHT))]
    summed = parts[0].unionByName(parts[1]).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("exact"))
    ranked = top(summed.withColumn("score", F.round("exact", 9)), k)
    return ranked.withColumn("label", score_label("exact")).drop("exact")
