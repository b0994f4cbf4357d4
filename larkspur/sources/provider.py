"""Vectors of an external embedding model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import staged

Embed = Callable[[list[str]], list]


def embed_rows(rows: DataFrame, text: F.Column, connect: Callable[[], Embed]) -> DataFrame:
    """rows with `vector array<float>` of unit length. connect() is called once for each task and gives a function from texts to vectors.

    A text for which the model fails has a null vector, so that it is tried again later.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = connect()
        for texts in batches:
            out = []
            for v in embed(texts.fillna("").tolist()):
                v = None if v is None else np.asarray(v, np.float32)
                size = 0 if v is None else float(np.sqrt((v.astype(float) ** 2).sum()))
                out.append(None if v is None or not len(v) else (v / size if size else v).tolist())
            yield pd.Series(out)

    return rows.withColumn("vector", run(text))


def embed_missing(chunks: DataFrame, known: DataFrame, connect: Callable[[], Embed]) -> DataFrame:
    """(chunk_id, digest, vector): vectors of known(chunk_id, digest, vector) for texts that any chunk of it has, and new ones for the rest, each distinct text once."""
    text = F.when(F.coalesce("content", F.lit("")) == "", F.col("heading")).otherwise(F.concat_ws("\n", "heading", "content"))
    rows = staged(chunks.select("chunk_id", text.alias("text")).withColumn("digest", F.sha2("text", 256)), "texts")
    have = known.where("vector is not null").groupBy("digest").agg(F.max_by("vector", "chunk_id").alias("vector"))
    todo = rows.join(have, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    # Stored, so that a text is sent once however often the result is read.
    new = staged(embed_rows(staged(todo, "todo"), F.col("text"), connect).select("digest", "vector"), "embedded")
    return rows.select("chunk_id", "digest").join(have.unionByName(new), "digest", "left").select("chunk_id", "digest", "vector")


def http_embedder(url: str, model: str, timeout: float = 60.0, tries: int = 3, wait: float = 0.5) -> Callable[[], Embed]:
    """A connect function for a server that takes {"model", "input"} and answers {"embeddings": [...]}.

    A request that fails is sent again, after twice as long each time; a batch
    that keeps failing is sent in halves, so that one text fails alone. Each
    task has one request under way, so tasks at a time bound the server's load.
    """

    def connect() -> Embed:
        import json
        import time
        import urllib.request

        def ask(texts: list[str]) -> list | None:
            body = json.dumps({"model": model, "input": texts}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            for k in range(tries):
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        found = json.load(answer)["embeddings"]
                    if len(found) == len(texts):
                        return found
                except (OSError, ValueError, KeyError):
                    pass
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
            return None

        def embed(texts: list[str]) -> list:
            found = ask(texts) if texts else []
            if found is not None:
                return found
            half = len(texts) // 2
            return [*embed(texts[:half]), *embed(texts[half:])] if half else [None]

        return embed

    return connect
