"""BM25 over prefix phrases, all terms first and any term as the fallback, for batches of queries."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokenize, tokenize_raw
from larkspur.session import few, staged

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
PHRASE_ROWS = 1_000_000  # narrow rows of a batch of queries that may be broadcast
FEW_PHRASES = 2_000  # phrases of a batch of queries that are looked up in a stored dictionary
FEW_PREFIXES = 64  # phrases that are conditions of the dictionary's scan
FEW_TERMS = 50_000  # terms of these phrases that the driver takes
Dealt = Callable[[DataFrame], DataFrame]


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, mode, phrase, times): prefixes that all (mode all) or any (mode any) must stand; a repeated token counts each time."""
    two = F.array(F.struct(F.lit("all").alias("mode"), tokenize_raw("query").alias("tokens")), F.struct(F.lit("any").alias("mode"), tokenize("query").alias("tokens")))
    rows = queries.select("query_id", F.inline(two)).select("query_id", "mode", F.explode("tokens").alias("phrase"))
    return rows.groupBy("query_id", "mode", "phrase").agg(F.count("*").alias("times"))


def expand(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase, term): the terms that begin with each phrase; wanted is broadcast if the caller or its size says so.

    An equality join on the prefixes of a term, as long as phrases are, so the
    work is in proportion to the term dictionary and never a nested loop.
    """
    lengths = wanted.agg(F.collect_set(F.length("phrase")).alias("lengths"))  # a set of a few numbers
    prefixes = terms.select("term").crossJoin(F.broadcast(lengths))
    prefixes = prefixes.select("term", F.explode(F.filter("lengths", lambda n: n <= F.length("term"))).alias("n")).select("term", F.expr("substring(term, 1, n)").alias("phrase"))
    return prefixes.join(wanted, "phrase").select("phrase", "term")


def phrase_scores(own: DataFrame, postings: DataFrame, lengths: DataFrame, dealt: Dealt) -> tuple[DataFrame, DataFrame]:
    """(phrase, chunk_id, part), the BM25 part of one instance of each phrase, and (phrase, n), the chunks that hold it.

    Only postings of terms that some phrase needs leave the scan, dealt by
    chunk, so that sums by chunk need no other shuffle.
    """
    terms = staged(expand(dealt(own.select("phrase").distinct()), postings.select("term").distinct()), "terms")
    hits = postings.join(few(terms, PHRASE_ROWS), "term").select("phrase", "chunk_id", "tf").repartition("chunk_id").groupBy("phrase", "chunk_id").agg(F.sum("tf").cast("double").alias("f"))
    found = staged(hits.groupBy("phrase").agg(F.count("*").alias("n")), "found")
    whole = lengths.agg(F.count("*").alias("rows"), F.avg("n_tokens").alias("mean"))  # one row
    idf = F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = found.crossJoin(F.broadcast(whole)).select("phrase", F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)).alias("idf"), "mean")
    near = K1 * ((1 - B) + B * F.col("n_tokens") / F.col("mean"))
    rows = hits.join(dealt(weights), "phrase").join(lengths, "chunk_id")
    return rows.select("phrase", "chunk_id", (F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + near)).alias("part")), found


def wanted_phrases(queries: DataFrame) -> tuple[DataFrame, Dealt]:
    """(query_id, phrase, all, any): how often each mode asks for a phrase; the phrases of mode any include those of mode all.

    And what a table of at most as many rows is joined as: broadcast if these
    are counted and few enough, else as it is.
    """
    times = lambda mode: F.sum(F.when(F.col("mode") == mode, F.col("times")).otherwise(0)).alias(mode)
    own = staged(phrases(queries).groupBy("query_id", "phrase").agg(times("all"), times("any")), "phrases")
    return own, F.broadcast if own.count() <= PHRASE_ROWS else lambda table: table


def _summed(own: DataFrame, parts: DataFrame, mode: str, dealt: Dealt) -> DataFrame:
    """(query_id, chunk_id, score, held) over the phrases that a mode asks for; parts are dealt by chunk and stay so."""
    rows = parts.join(dealt(own.where(f"`{mode}` > 0")), "phrase")
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("part") * F.col(mode)), 10).alias("score"), F.count("*").alias("held"))


def match(queries: DataFrame, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, mode, chunk_id, score) of all chunks that hold all, or any, phrases of a query."""
    own, dealt = wanted_phrases(queries)
    parts, _ = phrase_scores(own, postings, lengths, dealt)
    asked = own.groupBy("query_id").agg(F.count_if(F.col("all") > 0).alias("asked"))
    either = _summed(own, parts, "any", dealt).select("query_id", F.lit("any").alias("mode"), "chunk_id", "score")
    every = _summed(own, parts, "all", dealt).join(dealt(asked), "query_id").where("held = asked")
    return either.unionByName(every.select("query_id", F.lit("all").alias("mode"), "chunk_id", "score"))


def top(ranked: DataFrame, k: int) -> DataFrame:
    """The first k of each query with their rank; ties by chunk_id. A task keeps k rows of each query before anything is shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): all-term matches where a query has any, else any-term matches.

    Chunks with all terms are looked for among those that hold the query's
    rarest one. Any-term scores, which most chunks of a corpus have, are made
    only for queries that no chunk answers whole.
    """
    own, dealt = wanted_phrases(queries)
    parts, found = phrase_scores(own, postings, lengths, dealt)
    parts = staged(parts, "parts")
    every = own.where("`all` > 0").join(found, "phrase", "left").groupBy("query_id")
    rarest = every.agg(F.count("*").alias("asked"), F.count("n").alias("known"), F.min(F.struct("n", "phrase"))["phrase"].alias("phrase")).where("known = asked")
    likely = parts.join(dealt(rarest.select("query_id", "phrase")), "phrase").select("query_id", "chunk_id")
    likely = likely.join(dealt(own.where("`all` > 0")), "query_id").join(parts, ["phrase", "chunk_id"])
    whole = likely.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("part") * F.col("all")), 10).alias("score"), F.count("*").alias("held"))
    whole = whole.join(dealt(rarest.select("query_id", "asked")), "query_id").where("held = asked").select("query_id", "chunk_id", "score")
    whole = staged(top(whole, k), "whole")

    left = own.join(dealt(whole.select("query_id").distinct()), "query_id", "left_anti")
    either = _summed(left, parts.repartition("chunk_id"), "any", dealt).select("query_id", "chunk_id", "score")
    return whole.unionByName(top(either, k))


def look_up(wanted: list[str], terms: DataFrame) -> DataFrame:
    """Rows of a dictionary with the `phrase` that their term begins with; a term of several phrases stands for each."""
    if len(wanted) <= FEW_PREFIXES:
        shortest = [p for p in wanted if not any(p != q and p.startswith(q) for q in wanted)]
        within = F.lit(False)
        for p in shortest:
            within = within | F.col("term").startswith(p)
        terms = terms.where(within)
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for p in wanted})])
    rows = terms.withColumn("_n", F.explode(F.filter(lengths, lambda n: n <= F.length("term")))).withColumn("phrase", F.expr("substring(term, 1, _n)")).drop("_n")
    phrase = terms.sparkSession.createDataFrame([(p,) for p in wanted], "phrase string")
    return rows.join(F.broadcast(phrase), "phrase", "left_semi")


def stored_search(queries: DataFrame, terms: DataFrame | Callable[[], DataFrame], ranged: Callable[[dict[int, list[int]]], DataFrame], facts: tuple[int, int], k: int) -> DataFrame | None:
    """lexical_search() on a stored index, for few phrases; None where there are too many, for which whole tables are the better plan.

    terms(term, n, range, seq) is the dictionary by segment, or what gives it if it is needed, ranged(ranges by
    seq) gives (term, chunk_id, tf, n_tokens) of these ranges only, and facts are
    the numbers of chunks and of their tokens. Nothing is counted anew but the
    chunks of phrases that several terms begin with.
    """
    spark = queries.sparkSession
    times = lambda mode: F.sum(F.when(F.col("mode") == mode, F.col("times")).otherwise(0)).alias(mode)
    own = phrases(queries).groupBy("query_id", "phrase").agg(times("all"), times("any")).limit(FEW_PHRASES + 1).collect()
    if len(own) > FEW_PHRASES:
        return None
    none = top(spark.createDataFrame([], "query_id long, chunk_id long, score double"), k)
    wanted = sorted({r["phrase"] for r in own})
    if not wanted:
        return none
    known = look_up(wanted, terms() if callable(terms) else terms).select("phrase", "term", "n", "range", "seq").limit(FEW_TERMS + 1).collect()
    if len(known) > FEW_TERMS:
        return None
    n: dict[tuple[str, str], int] = defaultdict(int)
    for r in known:
        n[r["phrase"], r["term"]] += r["n"]
    ranges: dict[int, set[int]] = defaultdict(set)
    for r in known:
        if r["range"] is not None and n[r["phrase"], r["term"]] > 0:
            ranges[r["seq"]].add(r["range"])
    chunks: dict[str, list[int]] = defaultdict(list)
    for (p, _), c in n.items():
        if c > 0:
            chunks[p].append(c)
    pairs = spark.createDataFrame([(p, t) for (p, t), c in n.items() if c > 0], "phrase string, term string")
    hits = ranged({seq: sorted(found) for seq, found in ranges.items()}).join(F.broadcast(pairs), "term")
    several = [p for p in wanted if len(chunks[p]) > 1]
    if several:
        hits = hits.groupBy("phrase", "chunk_id", "n_tokens").agg(F.sum("tf").alias("tf"))
    hits = staged(hits.select("phrase", "chunk_id", "n_tokens", F.col("tf").cast("double").alias("f")), "hits")
    seen = {p: sum(chunks[p]) for p in wanted}
    if several:
        seen |= {r["phrase"]: r["n"] for r in hits.where(F.col("phrase").isin(several)).groupBy("phrase").agg(F.count("*").alias("n")).collect()}

    def idf(count: int) -> float:
        value = math.log((facts[0] - count + 0.5) / (count + 0.5))
        return value if value > 0 else LEAST_IDF

    asked: dict[int, int] = defaultdict(int)
    for r in own:
        asked[r["query_id"]] += r["all"] > 0
    weights = spark.createDataFrame([(r["query_id"], r["phrase"], r["all"], r["any"], idf(seen[r["phrase"]]), asked[r["query_id"]]) for r in own if seen[r["phrase"]]], "query_id long, phrase string, `all` long, `any` long, idf double, asked long")
    near = K1 * ((1 - B) + B * F.col("n_tokens") / (facts[1] / max(1, facts[0]) or 1.0))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + near)
    rows = hits.join(F.broadcast(weights), "phrase").withColumn("part", part)
    sums = rows.groupBy("query_id", "chunk_id").agg(*[F.round(F.sum(F.col("part") * F.col(m)), 10).alias(m) for m in ("all", "any")], F.count_if(F.col("all") > 0).alias("held"), F.count_if(F.col("any") > 0).alias("some"), F.max("asked").alias("asked"))
    whole = (F.col("held") == F.col("asked")) & (F.col("asked") > 0)
    found = sums.where(whole | (F.col("some") > 0)).select("query_id", "chunk_id", whole.alias("whole"), F.when(whole, F.col("all")).otherwise(F.col("any")).alias("score"))
    # Chunks with all terms come first, and where there are any the others go.
    order = Window.partitionBy("query_id").orderBy(F.desc("whole"), F.desc("score"), "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.withColumn("first", F.max("whole").over(Window.partitionBy("query_id")))
    return best.where(F.col("whole") == F.col("first")).select("query_id", "chunk_id", "score", "rank")
