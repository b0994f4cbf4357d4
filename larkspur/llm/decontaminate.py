"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Pass one counts, over all documents, in how many each n-gram of the test items
stands. Of each item the n-grams up to twice its median count are its rare
seeds (at least half of them). Pass two joins documents to items on all n-grams.
The words around a rare seed are aligned; those around common n-grams only are
aligned if they hold enough of the item's words for the score to reach the
threshold, a bound that loses nothing. So the counts decide what is checked
first, never what is found. The score is the local alignment's over that of a
full copy, so edited and paraphrased copies score by what they keep. Items are
taken in blocks of bounded size, so what is broadcast does not grow with the
benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import lean, shingles, staged, text_bytes, text_chunks, without_rows, word_hashes, words_of

GRAM = 4  # words of a seed
BLOCK_BYTES = 8 << 20  # text of the items of one block
SLAB_HITS = 1 << 20  # n-grams of documents times the items that have them, looked at together
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5

#: Bytes between words here: all of ASCII but letters and digits.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends and bounds by document."""
    start, end, bounds = words_of(data, offsets, SEPARATOR)
    return word_hashes(data, start, end), start, end, bounds


@dataclass
class Items:
    """A block of test items: ids, word hashes, and their n-grams in order of hash."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    owner: np.ndarray
    filter: np.ndarray
    size: int

    @staticmethod
    def of(ids: list[int], texts: list[str | None], size: int) -> list[Items]:
        """Items by the length of their n-grams: `size`, or all words of an item that has fewer."""
        hashes, _, _, bounds = tokens(*text_bytes(texts))
        words = np.split(hashes, bounds[1:-1])
        lengths = np.minimum(np.diff(bounds), size)
        out = []
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n).tolist()
            part = [words[k] for k in own]
            grams, cuts = shingles(np.concatenate(part), np.concatenate([[0], np.cumsum([len(w) for w in part])]), n)
            out.append(Items([ids[k] for k in own], part, *_ordered(grams, np.repeat(np.arange(len(own)), np.diff(cuts))), n))
        return out

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions of n-grams that the items have."""
        at = np.flatnonzero(self.filter[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0]
        found = np.searchsorted(self.grams, grams[at])
        return at[self.grams[np.minimum(found, len(self.grams) - 1)] == grams[at]]


def _ordered(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[first], owner[first]
    table = np.zeros(1 << 22, bool)
    table[(grams >> np.uint64(42)).astype(np.int64)] = True
    return grams, owner, table


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of word sequences a and b: its score, and the ends in a and b (exclusive)."""
    ramp = np.arange(len(b) + 1) * -GAP
    row, best = np.zeros(len(b) + 1), (0.0, 0, 0)
    for i in range(len(a)):
        new = np.maximum(0, row + GAP)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == a[i], MATCH, MISMATCH))
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps in a: the best of all cells to the left, less their distance
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), i + 1, j)
    return best


def aligned_span(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Score over a full copy's, and the words of the passage that the alignment covers."""
    score, i, j = align(item, passage)
    if not score:
        return 0.0, 0, 0
    _, _, back = align(item[:i][::-1], passage[:j][::-1])
    return score / (MATCH * len(item)), j - back, j


def most_matches(words: np.ndarray, counts: np.ndarray, passage: np.ndarray) -> int:
    """Words of an item, given as distinct hashes in order and their counts, that a passage holds in any order: no alignment matches more."""
    at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
    held = np.bincount(at[words[at] == passage], minlength=len(words))
    return int(np.minimum(held, counts).sum())


def _counts(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.grams), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "text"):
                hashes, _, _, bounds = tokens(data, offsets)
                grams, cuts = shingles(hashes, bounds, items.size)
                at = items.hits(grams)
                doc = np.searchsorted(cuts, at, side="right")
                pairs = np.unique(np.stack([doc.astype(np.uint64), grams[at]]), axis=1)
                which, n = np.unique(pairs[1], return_counts=True)
                np.add.at(total, np.searchsorted(items.grams, which), n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "docs"])

    return run


def rare_grams(items: Items, seen: np.ndarray) -> np.ndarray:
    """Of each item the n-grams that no more documents have than twice its median one; seen: documents of each entry of items.grams."""
    order = np.lexsort((seen, items.owner))
    bounds = np.searchsorted(items.owner[order], np.arange(len(items.ids) + 1))
    low, high = (bounds[:-1] + bounds[1:] - 1) // 2, (bounds[:-1] + bounds[1:]) // 2
    median = (seen[order][low] + seen[order][high]) / 2
    return seen <= 2 * median[items.owner]


def _passages(items: Items, rare: np.ndarray, threshold: float):
    size = items.size
    lengths = np.array([len(w) for w in items.words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows, which, scores, starts, ends = [], [], [], [], []
            for i, _, data, offsets in text_chunks(batch, "text"):
                hashes, start, end, bounds = tokens(data, offsets)
                grams, cuts = shingles(hashes, bounds, size)
                hits = items.hits(grams)
                if not len(hits):
                    continue
                of = np.searchsorted(cuts, hits, side="right") - 1
                first, last = np.searchsorted(items.grams, grams[hits]), np.searchsorted(items.grams, grams[hits], side="right")
                # Whole documents at a time, so that n-grams of many items take no more memory.
                before = np.cumsum(last - first) - (last - first)
                slab = before[np.searchsorted(of, of)] // SLAB_HITS
                for part in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(slab)) + 1):
                    at, doc, n = hits[part], of[part], (last - first)[part]
                    word = bounds[doc] + at - cuts[doc]
                    # Every item that has the n-gram, in order of document, item and place.
                    doc, word = np.repeat(doc, n), np.repeat(word, n)
                    entry = np.repeat(first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    own, sure = items.owner[entry], rare[entry]
                    order = np.lexsort((word, own, doc))
                    doc, word, own, sure = doc[order], word[order], own[order], sure[order]
                    reach = lengths[own]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (word[1:] - word[:-1] > 2 * reach[1:])
                    groups = np.flatnonzero(new)
                    best: dict[tuple[int, int], tuple] = {}
                    for g, h, seeded in zip(groups, [*groups[1:], len(doc)], np.logical_or.reduceat(sure, groups), strict=True):
                        d, x = int(doc[g]), int(own[g])
                        left = max(int(bounds[d]), int(word[g]) - 2 * int(reach[g]))
                        right = min(int(bounds[d + 1]), int(word[h - 1]) + size + 2 * int(reach[g]))
                        if not seeded:
                            if x not in bags:
                                bags[x] = np.unique(items.words[x], return_counts=True)
                            if MATCH * most_matches(*bags[x], hashes[left:right]) / (MATCH * lengths[x]) < threshold:
                                continue
                        score, a, b = aligned_span(items.words[x], hashes[left:right])
                        if score >= threshold and score > best.get((d, x), (0,))[0]:
                            best[d, x] = (score, int(start[left + a] - offsets[d]), int(end[left + b - 1] - offsets[d]))
                    for (d, x), (score, a, b) in best.items():
                        rows.append(i + d)
                        which.append(items.ids[x])
                        scores.append(round(score, 6))
                        starts.append(a)
                        ends.append(b)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(which, pa.int64()), pa.array(scores, pa.float64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "copy", "item_id", "score", "start", "end"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, size: int, threshold: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    spark = docs.sparkSession
    lean(spark)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("text")).where("item_id is not null and text is not null")
    blocks = int((tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    schema, found = "doc_id long, copy long, item_id long, score double, start int, end int", None
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        for items in Items.of([r[0] for r in rows], [r[1] for r in rows], size):
            seen = np.zeros(len(items.grams), np.int64)
            counted = docs.mapInArrow(_counts(items), "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas()  # n-grams of one block
            seen[counted["gram"]] = counted["docs"]
            seen = seen[np.searchsorted(items.grams, items.grams)]
            part = docs.mapInArrow(_passages(items, rare_grams(items, seen), threshold), schema)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else staged(found, "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = GRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Passages of docs that copy test items: (doc_id, item_id, score, start, end).

    One row for each document and item that share a run of `size` words and
    align around it with `threshold` of a full copy's score or more, however
    many documents have that run, with the bytes of the best passage (the
    earliest of equal ones). Of an item of fewer words the run is the whole
    item. Words are runs of letters and digits, A-Z in lower case. Null or
    empty texts, items without words and items without an id match nothing;
    repeated items give repeated rows, and so do repeated documents; a null
    doc_id stays null. Other columns are ignored. An empty benchmark or no
    documents give no rows.
    """
    return _found(docs, benchmark, size, threshold, id_col, text_col, item_col).drop("copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that copy no test item, with all columns; each row is judged by its own text, with an id or without."""
    return without_rows(docs, _found(docs, benchmark, size, threshold, "doc_id", "text", "item_id"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All of documents against all of benchmark."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
