"""Suffix-array dedup of long repeated byte strings.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else. Sorting every suffix of a corpus is not needed for that: every string of
`length` bytes has one anchor, the least hashed seed (rightmost on ties) of the
seeds inside it, and equal strings have their anchors at the same offset. So
only the suffixes at anchors, about one in 150 bytes, are grouped by the seed
that they start with and sorted.

Contexts (all bytes that the strings of an anchor cover) that are equal by two
hashes, 128 bits, stand once. Groups of different ones are sorted in tasks of
bounded size by deep-shallow sorting: multikey quicksort on 8-byte keys to a
shallow depth, then a blind trie for the suffixes that still agree. The tree of
common prefixes and the order of the reversed left contexts give, for each
anchor, the starts whose `length` bytes occur elsewhere. A group that is too
large for a task is split first, by what strings of a narrow range of starts
have in common, into groups that are sorted in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_ROWS, CHUNK_BYTES, lean, mix, prefix_hash, span_hash, staged, text_chunks
from larkspur.session import few

GROUP_LIMIT = 2000  # contexts of one group that a task sorts; larger groups are split
TASK_BYTES = 8 << 20  # bytes of contexts in one task
SHALLOW = 32  # depth, beyond the common seed, that multikey quicksort sorts to


# ---------------------------------------------------------------- sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """Order by insertion into a blind trie: a node keeps a depth and the branching bytes only, one comparison places a string."""
    root: list | int = [members[0]]  # leaves are lists of equal strings, inner nodes are (depth, {byte: node})
    for k in members[1:]:
        s = strings[k]
        node = root
        while isinstance(node, tuple):
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(k)
            continue
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < depth:
            parent, c = node, s[node[0]]
            node = node[1][c]
        mine = s[depth] if depth < len(s) else -1
        if isinstance(node, tuple) and node[0] == depth:
            node[1][mine] = [k]
            continue
        theirs = other[depth] if depth < len(other) else -1
        branch = (depth, {mine: [k], theirs: node})
        if parent is None:
            root = branch
        else:
            parent[1][c] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], known: int = 0) -> list[int]:
    """Indices in byte order; all strings agree on their first `known` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), known)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out += part
        elif depth >= known + SHALLOW:
            out += blind_trie_order(strings, part)
        else:
            keys = [(strings[k][depth : depth + 8], len(strings[k]) > depth + 8) for k in part]
            pivot = keys[len(keys) // 2]
            less = [k for k, x in zip(part, keys, strict=True) if x < pivot]
            same = [k for k, x in zip(part, keys, strict=True) if x == pivot]
            more = [k for k, x in zip(part, keys, strict=True) if x > pivot]
            if more:
                stack.append((more, depth))
            stack.append((same, depth + 8 if pivot[1] else known + SHALLOW))
            if less:
                stack.append((less, depth))
    return out


def repeated_starts(lefts: list[bytes], rights: list[bytes], seed: int, length: int) -> list[tuple[int, int, int]]:
    """(member, least offset, largest offset) before the anchor of starts whose `length` bytes another member has too.

    lefts are the bytes before the anchor in reverse, rights the bytes from it on.
    """
    if len(lefts) == 2:
        r, left = common_prefix(*rights), common_prefix(*lefts)
        return [(0, length - r, left), (1, length - r, left)] if left >= length - r else []
    order = deep_shallow_order(rights, seed)
    back = deep_shallow_order(lefts)
    rank = np.empty(len(back), np.int64)
    rank[back] = np.arange(len(back))
    left_lcp = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(back[:-1], back[1:], strict=True)])
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    members, out = np.array(order), []
    if (left_lcp[1:].max(initial=0)) < length - max(lcp, default=0):
        return out

    def node(first: int, last: int, depth: int) -> None:
        """Members first..last of the order agree on `depth` bytes."""
        ranks = rank[members[first : last + 1]]
        by = np.argsort(ranks)
        near = np.minimum.reduceat(left_lcp, ranks[by][:-1] + 1) if len(by) > 1 else np.zeros(0, int)
        near[-1] = left_lcp[ranks[by][-2] + 1 : ranks[by][-1] + 1].min()
        best = np.maximum(np.append(near, 0), np.append(0, near))
        who = members[first : last + 1][by]
        hit = best >= length - depth
        out.extend((int(m), length - depth, int(b)) for m, b in zip(who[hit], best[hit], strict=True))

    stack: list[tuple[int, int]] = []  # (depth, first) of open nodes
    for k, depth in enumerate([*lcp, 0]):
        first = k
        while stack and stack[-1][0] > depth:
            was, first = stack.pop()
            if was >= seed:
                node(first, k, was)
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
    return out


# ---------------------------------------------------------------- tasks


def anchors(data: np.ndarray, offsets: np.ndarray, seed: int, length: int) -> tuple[np.ndarray, ...]:
    """document, anchor, first and last start of each run of starts with one anchor; hashes of the seed and of the whole context."""
    empty = np.zeros(0, np.int64)
    w, n = length - seed + 1, len(data)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - seed + 1)
    h = span_hash(prefix, at, at + seed)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    rows = -(-len(v) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(v)] = v
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[w - 1 : w + n - length])
    anchor = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if not len(start):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    cut = np.flatnonzero((np.diff(anchor[start]) != 0) | (np.diff(start) != 1)) + 1
    lo, hi = start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])]
    a = anchor[lo]
    whole = mix(span_hash(prefix, lo, hi + length) + np.uint64(0x9E3779B97F4A7C15) * (a - lo).astype(np.uint64))
    return doc[lo], a, lo, hi, h[a], whole


def mixed_grams(data: np.ndarray) -> np.ndarray:
    """A mixed value of the eight bytes from each place on, 0 near the end: a second hash of them fails for other texts than that of the bytes."""
    out = np.zeros(len(data), np.uint64)
    if len(data) >= 8:
        n = len(data) - 7
        for k in range(8):
            out[:n] |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        out[:n] = mix(out[:n])
        out[n:] = 0
    return out


def _anchors(seed: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, _, data, offsets in text_chunks(batch, "text", CHUNK_BYTES // 2):
                d, a, lo, hi, key, whole = anchors(data, offsets, seed, length)
                other = span_hash(prefix_hash(mixed_grams(data)), lo, hi + max(1, length - 7))
                begin = offsets[d]
                take = pa.array(d + i)
                hashes = [pa.array(x.view(np.int64)) for x in (key, whole, other)]
                ints = [pa.array((x - begin).astype(np.int32)) for x in (lo, a, hi)]
                yield pa.RecordBatch.from_arrays([*hashes, ids.take(take), *ints], names=["seed", "context", "other", "doc_id", "lo", "at", "hi"])

    return run


def _sort(seed: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("seed", "doc_id", "lo", "at", "hi", "bytes")}
        key = np.array(cols["seed"], np.int64)
        order = np.argsort(key, kind="stable")
        ids, starts, ends = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            part = part.tolist()
            off = [cols["at"][k] - cols["lo"][k] for k in part]
            text = [bytes(cols["bytes"][k]) for k in part]
            for m, least, most in repeated_starts([t[:o][::-1] for t, o in zip(text, off, strict=True)], [t[o:] for t, o in zip(text, off, strict=True)], seed, length):
                k = part[m]
                first, last = max(cols["lo"][k], cols["at"][k] - most), min(cols["hi"][k], cols["at"][k] - least)
                if first <= last:
                    ids.append(cols["doc_id"][k])
                    starts.append(first)
                    ends.append(last + length)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())})

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each row and cut them out."""
    names = ["doc_id", "n_bytes", "spans", "kept"]
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        ids, found = batch.column(0), batch.column(2)
        for i, j, data, offsets in text_chunks(batch, "text", 8 << 20):
            kept, merged, sizes = [], [], []
            for k in range(i, j):
                raw = data[offsets[k - i] : offsets[k - i + 1]].tobytes()
                spans: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in (found[k].as_py() or [])):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append([*s])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                merged.append([{"start": a, "end": b} for a, b in spans])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(merged, spans_type), pa.array(kept, pa.binary())], names=names)


def _split(big: DataFrame, length: int, widest: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Groups too large for a task, in parts that fit: (spans that are decided, contexts of the parts).

    Of a range of starts, the core is what all its strings have in common and
    the hull what they cover together. Strings can only be equal within one
    core, so (range, core) is a group of its own, of contexts cut to the range.
    A hull that occurs twice has only repeated starts: these are decided, and
    one of them goes on for the sake of the others. What is still too large is
    cut into narrower ranges; a range of one start is always decided.
    """
    rows = staged(big, "large")
    who = ["seed", "doc_id", "lo"]
    same = " and ".join(f"{c} = _{c}" for c in who)
    live = rows.select(*who, F.lit(0).alias("o1"), F.lit(widest).alias("o2"))
    done = parts = None
    while True:
        x = rows.join(live.select(*[F.col(c).alias(f"_{c}") for c in who], "o1", "o2"), F.expr(same)).drop(*[f"_{c}" for c in who])
        width = F.greatest(F.lit(1), F.ceil((F.col("o2") - F.col("o1") + 1) / 7).cast("int"))
        x = x.withColumn("width", width)
        off = F.col("at") - F.col("lo")  # of the anchor inside the context

        def piece(o):
            p, q = F.greatest(o, F.col("at") - F.col("hi")), F.least(o + F.col("width") - 1, F.col("o2"), F.col("at") - F.col("lo"))
            end = F.least(o + F.col("width") - 1, F.col("o2"))
            cut = lambda a, b: F.md5(F.col("bytes").substr(a, b))
            whole = (o >= F.col("at") - F.col("hi")) & (end <= F.col("at") - F.col("lo"))
            return F.struct(
                o.alias("o1"), end.alias("o2"), (p <= q).alias("own"),
                cut(off - o + 1, F.lit(length) - (end - o)).alias("core"),
                F.when(whole, cut(off - end + 1, F.lit(length) + (end - o))).alias("hull"),
            )

        x = x.select(*who, "at", "hi", F.explode(F.transform(F.sequence("o1", "o2", "width"), piece)).alias("x")).select(*who, "at", "hi", "x.*").where("own")
        x = staged(x, "ranges")
        core = ["seed", "o1", "o2", "core"]
        cores = x.groupBy(*core).agg(F.count("*").alias("cores")).where("cores > 1")
        hulls = x.where("hull is not null").groupBy(*core[:3], "hull").agg(F.count("*").alias("hulls")).where("hulls > 1")
        x = staged(x.join(cores, core).join(hulls, [*core[:3], "hull"], "left"), "decided")
        found = x.where("hulls > 1").select("doc_id", F.greatest("lo", F.col("at") - F.col("o2")).alias("start"), (F.least("hi", F.col("at") - F.col("o1")) + length).alias("end"))
        done = found if done is None else done.unionByName(found)

        live = x.where("hulls is null and o2 > o1").select(*who, *core[1:])
        one = x.where("hulls > 1 and o2 > o1").groupBy(*core, "hull").agg(F.min(F.struct("doc_id", "lo")).alias("one"))
        one = one.join(live.select(*core).distinct(), core, "left_semi").select("seed", "one.*", *core[1:])
        live = staged(live.unionByName(one), "live")
        sizes = live.groupBy(*core).agg(F.count("*").alias("n"))
        fit = live.join(sizes.where(f"n between 2 and {limit}").select(*core), core)
        fit = fit.select(*[F.col(c).alias(f"_{c}") for c in who], *core[1:])
        first, last = F.greatest("lo", F.col("at") - F.col("o2")), F.least("hi", F.col("at") - F.col("o1"))
        bytes_ = F.col("bytes").substr(first - F.col("lo") + 1, last - first + length)
        part = rows.join(fit, F.expr(same)).select(F.xxhash64(*core).alias("seed"), "doc_id", first.alias("lo"), "at", last.alias("hi"), bytes_.alias("bytes"))
        parts = part if parts is None else parts.unionByName(part)
        live = staged(live.join(sizes.where(f"n > {limit}").select(*core), core).select(*who, "o1", "o2"), "beyond")
        if live.isEmpty():
            return done, parts


def suffix_dedup(docs: DataFrame, length: int = 400, seed: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut out every byte that lies in a string of `length` bytes which also starts elsewhere.

    Texts are UTF-8 bytes, matches never cross documents, overlapping
    occurrences count. Returns (doc_id, n_bytes, spans, kept): the maximal
    removed runs as original byte offsets and the bytes that stay, one row for
    each row of docs. Null and empty texts give no spans and no bytes. Every
    row is a document of its own: repeated rows are occurrences of each other,
    and where ids are null or shared, rows are numbered in a stored table. Other
    columns are ignored.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The number stays the same whenever a task is run again, as the table is stored.
    keyed = staged(docs.withColumn("row", F.monotonically_increasing_id()), "rows") if shared_ids(docs) else docs.withColumn("row", F.col("doc_id"))
    docs = keyed.select(F.col("row").alias("doc_id"), "text")
    found = docs.mapInArrow(_anchors(seed, length), "seed long, context long, other long, doc_id long, lo int, at int, hi int")
    found = staged(found, "anchors")
    ends = [f(c).alias(f.__name__ + c) for c in ("context", "other") for f in (F.min, F.max)]
    keys = found.groupBy("seed").agg(F.count("*").alias("n"), *ends).where("n > 1")
    keys = staged(keys.selectExpr("seed", "mincontext <> maxcontext or minother <> maxother as differ"), "seeds")  # apart from the join, so that Spark can split a hot seed there
    twice = staged(found.join(keys, "seed"), "twice")
    same = ["seed", "context", "other"]
    apart = twice.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo", "at", "hi")).alias("first"), F.first("differ").alias("differ"))
    apart = staged(apart, "contexts")
    # A hot context is never one task: it is joined where it stands, or split as a skewed key of a merge join.
    whole = twice.join(few(apart.where("n > 1").select(*same), BROADCAST_ROWS), same).selectExpr("doc_id", "lo as start", f"hi + {length} as end")

    lists = apart.where("differ").select("seed", "first.*").groupBy("doc_id").agg(F.collect_list(F.struct("seed", "lo", "at", "hi")).alias("list"))
    joined = docs.join(lists, "doc_id").select("doc_id", F.col("text").cast("binary").alias("raw"), "list")
    cut = F.transform("list", lambda x: F.struct(x["seed"].alias("seed"), x["lo"].alias("lo"), x["at"].alias("at"), x["hi"].alias("hi"), F.substring(F.col("raw"), x["lo"] + 1, x["hi"] - x["lo"] + length).alias("bytes")))
    contexts = staged(joined.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*"), "bytes")

    groups = staged(contexts.groupBy("seed").agg(F.count("*").alias("group")).where("group > 1"), "groups")
    contexts = contexts.join(groups, "seed")
    inside, spans = contexts.where(f"group <= {GROUP_LIMIT}").drop("group"), whole
    if not groups.where(f"group > {GROUP_LIMIT}").isEmpty():
        decided, parts = _split(contexts.where(f"group > {GROUP_LIMIT}").drop("group"), length, length - seed, GROUP_LIMIT)
        inside, spans = inside.unionByName(staged(parts, "parts")), spans.unionByName(decided)
    total = inside.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bins = max(8, int(total // TASK_BYTES) + 1)
    inside = inside.withColumn("task", F.pmod(F.xxhash64("seed"), F.lit(bins)))
    spans = spans.unionByName(inside.groupBy("task").applyInArrow(_sort(seed, length), "doc_id long, start int, end int"))
    spans = spans.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = keyed.join(spans, "row", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_keep, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def shared_ids(docs: DataFrame, column: str = "doc_id") -> bool:
    total, nulls, ids = docs.agg(F.count("*"), F.count_if(F.col(column).isNull()), F.count_distinct(column)).first()
    return total != ids or nulls > 0


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes over all of documents; after the digests what stays, as valid UTF-8."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
