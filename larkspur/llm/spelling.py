"""Groups of spelling variants: words one insertion, deletion or replacement apart, by a dictionary of trie-node pairs.

Every distinct prefix of a word is a node of a trie, every distinct suffix one of
a trie of the reversed words, and nodes are numbered in the order of the words.
The numbers come from scans of ranges of sorted words; what two ranges share at
their border is one short row a range. A word that skips position i is the pair
(node of the prefix before i, node of the suffix after i), one with a gap at i
the pair around that gap. Words that meet in a pair of skips differ by one
replacement, a skip that meets a gap is one deletion; as nodes are exact, so are
neighbours. No pair of words is ever written: a pair of nodes has at most one
word with a gap and one skip for each letter, and it sends each of its words the
number of the others and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import CHUNK_BYTES, lean, quoted, staged

LEAST_LENGTH = 5
LEAST_COUNT = 3
TYPO_EVERY = 97
RANGE_CHARS = 2_000_000  # characters of words that one scan numbers
FLUSH_WORDS = 200_000  # words that a task counts before it sends them on

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
SKIP, REPEATED_SKIP, GAP = 0, 1, 2


def runs_of(text: str) -> Iterator[list[str]]:
    """The letter runs of a text in lower case, piece by piece, cut where no run stands."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            cut = _GAP.search(text, end)
            end = cut.start() if cut else len(text)
        yield _RUN.findall(text[at:end])
        at = end


def _counts(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found in runs_of(raw.as_buffer().to_pybytes().translate(_LOWER).decode()):
                    for word, n in Counter(found).items():
                        if len(word) < least:
                            continue
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        counts[word] += n
                    if len(counts) >= FLUSH_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                        counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): letter runs of at least `least` code points and `count` occurrences.

    One in `every` (document, run) pairs, chosen by a checksum, loses a letter
    first; an id that is null counts as an empty one.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("string").alias("doc_id"), F.col(quoted(text_col)).cast("string").cast("binary").alias("text"))
    counts = rows.mapInArrow(_counts(least, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _scan(table: pa.Table) -> pa.Table:
    """Sorted words of a range with their place and the numbers of their prefixes: new nodes of a word follow the numbers of all before it."""
    table = table.take(pa.compute.sort_indices(table.column("key").cast(pa.binary())))
    before, nodes, base, flat, sizes = "", [0], 0, [], []
    for word in table.column("key").to_pylist():
        same = shared(before, word)
        nodes = [*nodes[: same + 1], *range(base + same + 1, base + len(word) + 1)]
        base += len(word) + 1
        flat.append(np.array(nodes, np.int64))
        sizes.append(len(nodes))
        before = word
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(flat)))
    return table.append_column("place", pa.array(np.arange(len(table)), pa.int64())).append_column("nodes", out)


def trie_nodes(words: DataFrame, key: str, name: str, ranges: int) -> DataFrame:
    """words with `place`, the number of the row in the order of the distinct strings `key`, and `name`, the numbers of the trie nodes of its prefixes, from the empty one on."""
    spark = words.sparkSession
    ranged = words.withColumn("key", F.col(key)).repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    local = staged(ranged.groupBy("part").applyInArrow(_scan, f"{kinds}, place long, nodes array<long>"), "nodes")
    ends = local.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("nodes")).alias("numbers"), F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("nodes", "key").alias("nodes"))
    rows, carry, base, start, before = [], [], 0, 0, None
    for r in ends.orderBy("first").toLocalIterator():  # one row a range
        # What the range shares with the last word before it keeps the numbers that it has there.
        carry = [] if before is None else carry[: shared(before, r["first"]) + 1]
        rows.append((r["part"], start, base, carry))
        carry = [carry[x] if x < len(carry) else x + base for x in r["nodes"]]
        before, base, start = r["last"], base + r["numbers"], start + r["n"]
    moves = spark.createDataFrame(rows, "part int, _start long, _base long, _carry array<long>")
    whole = F.transform("nodes", lambda x: F.when(x < F.size("_carry"), F.get("_carry", x.cast("int"))).otherwise(x + F.col("_base")))
    out = local.join(F.broadcast(moves), "part").withColumn("place", F.col("place") + F.col("_start")).withColumn(name, whole)
    return out.drop("part", "key", "nodes", "_start", "_base", "_carry")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, s, rank, n, kind) of every skip and every gap of (word, n, rank, prefixes, suffixes)."""
    for batch in batches:
        if not len(batch):
            continue
        words = batch.column(0).to_pylist()
        n, rank = (batch.column(k).to_numpy() for k in (1, 2))
        sizes = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum(sizes) - sizes
        repeated = np.concatenate([[False], letters[1:] == letters[:-1]])
        repeated[first] = False
        # Prefix i stands beside the suffix that begins at i; both have one more place than letters.
        prefix, suffix = (batch.column(k).flatten().to_numpy() for k in (3, 4))
        start = first + np.arange(len(words))
        place = np.arange(len(prefix))
        suffix = suffix[np.repeat(2 * start + sizes, sizes + 1) - place]
        keep = np.ones(len(prefix), bool)
        keep[start + sizes] = False
        skips = prefix[keep], np.concatenate([suffix[1:], suffix[:1]])[keep]
        p, s = np.concatenate([skips[0], prefix]), np.concatenate([skips[1], suffix])
        kind = np.concatenate([repeated.astype(np.int8), np.full(len(prefix), GAP, np.int8)])
        each = lambda x: np.concatenate([np.repeat(x, sizes), np.repeat(x, sizes + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, s, each(rank), each(n), kind)], names=["p", "s", "rank", "n", "kind"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, near, n, least) from rows that come sorted by pair, n downwards and rank: how many words each meets there, and the n and rank of the best."""
    held: list[np.ndarray] | None = None

    def found(p, s, rank, n, kind):
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        keep = size[group] > 1
        rank, n, kind, group = rank[keep], n[keep], kind[keep], group[keep]
        _, group = np.unique(group, return_inverse=True)
        groups = int(group.max()) + 1 if len(group) else 0

        def firsts(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Number of such rows of each group, and its first and second; they stand in order."""
            at = np.flatnonzero(mask)
            count = np.bincount(group[at], minlength=groups)
            begin = np.cumsum(count) - count
            pick = lambda k: np.where(count > k, at[np.minimum(begin + k, max(0, len(at) - 1))] if len(at) else -1, -1)
            return count, pick(0), pick(1)

        skip = kind != GAP
        skips, top, second = firsts(skip)
        fresh, top_fresh, _ = firsts(kind == SKIP)
        gaps, gap, _ = firsts(kind == GAP)
        rows = np.arange(len(rank))
        other = np.where(skip, np.where(top[group] == rows, second[group], top[group]), top_fresh[group])
        near = np.where(skip, skips[group] - 1 + np.where(kind == SKIP, gaps[group], 0), fresh[group])
        more = np.where(kind == SKIP, gap[group], -1)
        # The better of the other skips and of the gap: more occurrences, then the smaller rank.
        better = (more >= 0) & ((other < 0) | (n[more] > n[other]) | ((n[more] == n[other]) & (rank[more] < rank[other])))
        best = np.where(better, more, other)
        use = near > 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (rank[use], near[use].astype(np.int64), n[best[use]], rank[best[use]])], names=["rank", "near", "n", "least"])

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        # The last pair may go on in the next batch.
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield found(*(c[:cut] for c in cols))
    if held is not None and len(held[0]):
        yield found(*held)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, rank, near, best_n, best): how many words of words(word, n) are one edit away, and the n and rank of the most frequent, ties to the smaller word; null without any."""
    lean(words.sparkSession)
    ranges = int((words.agg(F.sum(F.length("word"))).first()[0] or 0) // RANGE_CHARS) + 1
    forward = trie_nodes(words, "word", "prefixes", ranges).withColumnRenamed("place", "rank")
    forward = staged(forward.withColumn("back", F.reverse("word")), "forward")
    both = trie_nodes(forward, "back", "suffixes", ranges)
    pairs = both.select("word", "n", "rank", "prefixes", "suffixes").mapInArrow(_pairs, "p long, s long, rank long, n long, kind byte")
    dealt = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "rank")
    met = dealt.mapInArrow(_meet, "rank long, near long, n long, least long")
    best = met.groupBy("rank").agg(F.sum("near").alias("near"), F.max(F.struct("n", (-F.col("least")).alias("r"))).alias("b"))
    best = best.select("rank", "near", F.col("b.n").alias("best_n"), (-F.col("b.r")).alias("best"))
    return forward.select("word", "n", "rank").join(best, "rank", "left")


def last_of(steps: DataFrame) -> DataFrame:
    """(rank, to) with `to` the end of the chain that steps(rank, to) begins; a rank has one step at most and no chain is a ring. Each round doubles the steps taken."""
    steps = staged(steps.select("rank", "to"), "steps")
    while True:
        then = steps.select(F.col("rank").alias("to"), F.col("to").alias("beyond"))
        moved = staged(steps.join(then, "to", "left").select("rank", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "steps")
        if moved.where("moved").isEmpty():
            return moved.select("rank", "to")
        steps = moved.select("rank", "to")


def spelling_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n), distinct strings.

    A word's form is its most frequent near word (of equally frequent ones the
    first in code-point order) if that is at least twice as frequent, and its
    root the end of the chain of forms. Null words are left out; words of any
    length take part, also empty ones; no words give no rows.
    """
    near = staged(neighbours(staged(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")), "near")
    formed = near.where(F.col("best_n") >= 2 * F.col("n"))
    roots = last_of(formed.select("rank", F.col("best").alias("to")))
    name = lambda rank, word: near.select(F.col("rank").alias(rank), F.col("word").alias(word))
    ends = formed.select("rank", F.col("best").alias("form_rank"), F.col("best_n").alias("form_n")).join(roots.withColumnRenamed("to", "root_rank"), "rank")
    ends = ends.join(name("form_rank", "form"), "form_rank").join(name("root_rank", "root"), "root_rank").select("rank", "form", "root", "form_n")
    out = near.join(ends, "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling groups of the words of all documents."""
    return spelling_groups(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP13_SQL = f"""
WITH RECURSIVE
table_256 AS MATERIALIZED (SELECT list(x ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS x FROM range(256) t(i))),
runs AS MATERIALIZED (
  SELECT doc, word, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS word FROM documents)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY doc, word),
hashed AS (
  SELECT word, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc || ':' || word, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
    lambda h, b: xor(h >> 8, tab[xor(h, b) % 256 + 1]), 4294967295::BIGINT)) AS h FROM runs, table_256),
typed AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
skips AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM words, range(1, length(word) + 1) t(i)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION SELECT s.word, w.word FROM skips s JOIN words w ON s.a || s.b = w.word
  UNION SELECT w.word, s.word FROM skips s JOIN words w ON s.a || s.b = w.word),
ranked AS (SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, encode(other)) AS k FROM near JOIN words w ON w.word = other),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1),
chain AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT forms.word, form, chain.at AS root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.next IS NULL
"""
