"""Tasks of the embedding join hold tiles of chunks, so that a chunk is sent to few of them."""

import numpy as np
import pytest

pytest.importorskip("larkspur.llm")
from pyspark.sql import functions as F  # noqa: E402

from larkspur.llm import embedding_dedup  # noqa: E402


def test_op9_chunks_are_sent_by_tiles(spark):
    packed = spark.range(16).select(F.lit(2).alias("dims"), F.lit(0).alias("block"), F.lit(3).alias("slab"), F.col("id").cast("int").alias("chunk"), *[F.lit(b"").alias(c) for c in ("ids", "copies", "vectors")])
    counts = spark.createDataFrame([(2, 0, 3, 16)], "dims int, block int, slab int, chunks int")
    # Two tiles of eight chunks: each is compared with itself and with the other one.
    assert embedding_dedup._dealt(packed, counts).count() == 16 * 2


@pytest.mark.parametrize("tile", [1, 3])
def test_op9_links_of_many_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 8)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((240, 8))
    x[120:] = x[:120] + 0.05 * rng.standard_normal((120, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_links(table).collect()}
    assert [got[i] for i in range(240)] == links.tolist() and links.sum() > 0
