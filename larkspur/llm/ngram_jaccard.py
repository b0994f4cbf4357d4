"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. For each size
class this order is cut into fragments, so many that a set fills more of them
than the largest symmetric difference that a pair at the threshold can have; so
such a pair agrees on at least one filled fragment, and documents that agree on
a filled fragment meet in its bucket. There the parities of their n-grams in some bins, about a bit for each
n-gram, bound the symmetric difference from below; pairs within the bound are
candidates, and their components are clusters. In each cluster the overlap of
pairs is counted fragment by fragment and summed per pair, and the exact ratio
decides.

Groups stay bounded: equal n-gram sets are one class from the start, and large
buckets and clusters are cut into blocks, each a task that also gets the
group's leader. What is linked to the leader is in one component already; only
the rest goes on and meets all other blocks. A task returns stars (smallest
member, member) of what it has linked, never all pairs. Links between different
components are all tested.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import keep_rows_of, lean, mix, shingle_sets, staged, text_chunks
from larkspur.llm.graph import components
from larkspur.session import few, restaged, scoped

CLASS_RATIO = 1.5  # sizes of one class, largest to smallest
BLOCK_DOCS = 512  # documents of a block
BLOCK_BYTES = 4 << 20  # text bytes of a block
BUCKET_DOCS = 2048  # documents of a block of a bucket
BUCKET_ROWS = 50_000  # rows of sizes and parities, about 300 bytes each, that may be broadcast
LEAST_BITS = 256  # of the parities of a document
FRAGMENT_COLUMNS = 4096  # n-grams of a fragment of the overlap count


def size_classes(largest: int) -> list[int]:
    """Lower ends of the size classes up to `largest`."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS_RATIO)))
    return ends


@functools.cache
def fragments_of(tag: int, num: int, den: int) -> tuple[int, int]:
    """(most, fragments) of a size class: the largest symmetric difference of a pair whose smaller set is in it, and so many fragments that a set of the class fills more than `most` of them, by two and a half standard deviations."""
    low = class_start(tag)
    upper = max(low + 1, int(low * CLASS_RATIO)) - 1
    most = upper * (den - num) // num
    m = most + 1
    while m < 64 * upper:
        empty = (1 - 1 / m) ** low
        if m * (1 - empty) - 2.5 * math.sqrt(m * empty * (1 - empty)) > most:
            break
        m += 1 + m // 16
    return most, m


def class_start(tag: int) -> int:
    """The lower end of a class."""
    end = 1
    for _ in range(tag):
        end = max(end + 1, int(end * CLASS_RATIO))
    return end


def fragment_keys(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the filled fragments of one sorted n-gram set: equal keys mean equal fragments of one size class.

    Of a pair at the threshold at most `most` fragments differ, so it agrees on a
    filled one if either set fills more than that. A set that does not has the
    keys of its single n-grams as well, of which there are more than `most`, and
    so a pair of two such sets meets there. Empty fragments have no keys.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64)
    ends = size_classes(n)
    tag_of = lambda size: int(np.searchsorted(ends, size, side="right")) - 1
    mixed, high, out = mix(grams), grams >> np.uint64(32), []
    for tag in range(tag_of(max(1, -(-num * n // den))), tag_of(n) + 1):
        most, m = fragments_of(tag, num, den)
        if not most:
            continue  # only equal sets reach the threshold, and those are one class already
        salt = np.uint64(0xD1B54A32D192ED03 * (tag + 1) % (1 << 64))
        cut = np.searchsorted((high * np.uint64(m)) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
        filled = np.flatnonzero(cut[1:] > cut[:-1])
        out.append(mix(np.add.reduceat(mixed, cut[:-1][filled]) + np.uint64(0x9E3779B97F4A7C15) * filled.astype(np.uint64) + salt))
        if len(filled) <= most:
            out.append(mix(mixed ^ salt))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parities(grams: np.ndarray) -> bytes:
    """The parity of the number of n-grams in each of 2**k bins, two bins for each n-gram at most."""
    bits = LEAST_BITS
    while bits < len(grams):
        bits *= 2
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def folded(bits: int, size: int, to: int) -> int:
    """Parities of 8 * size bins as those of 8 * to bins: the upper half adds to the lower."""
    while size > to:
        size //= 2
        bits = (bits >> 8 * size) ^ (bits & ((1 << 8 * size) - 1))
    return bits


def close_pairs(left: list[tuple[int, bytes]], right: list[tuple[int, bytes]], num: int, den: int) -> np.ndarray:
    """Pairs of (size, parities) whose symmetric difference may be that of a pair at the threshold."""
    size = min(len(b) for _, b in (*left, *right))
    sides = []
    for side in (left, right):
        whole = b"".join(b if len(b) == size else folded(int.from_bytes(b, "little"), len(b), size).to_bytes(size, "little") for _, b in side)
        sides.append(np.frombuffer(whole, np.uint64).reshape(len(side), size // 8))
    sizes = np.array([n for n, _ in right])
    near = np.zeros((len(left), len(right)), bool)
    for k in range(len(left)):
        near[k] = np.bitwise_count(sides[0][k] ^ sides[1]).sum(1, dtype=np.int64) * (num + den) <= (den - num) * (left[k][0] + sizes)
    return near


def _links(rows: list, ids: np.ndarray, side: np.ndarray, lead: np.ndarray, linked) -> list[tuple[int, int, int]]:
    """(group, root, member) of what linked(left, right) links in each group of a task: of all its rows, or of those of side 0 with those of side 1. A root is the leader or else the smallest member."""
    edges = []
    for group, part in rows:
        left, right = part[side[part] == 0], part[side[part] == 1]
        if not len(left):
            continue
        if len(right):
            near = np.zeros((len(part), len(part)), bool)
            at = np.concatenate([left, right])
            near[: len(left), len(left) :] = linked(left, right)
            near |= near.T
        else:
            at, near = part, np.array(linked(part, part))
        near &= ids[at][:, None] != ids[at][None, :]
        found = stars(ids[at], near)
        first = int(ids[part[lead[part] == 1][0]]) if lead[part].any() else None
        root = next((least for member, least in found if member == first), first)
        edges += [(group, first, root)] if root != first else []
        edges += [(group, first if least == root else least, member) for member, least in found if member != first]
    return edges


def _task(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each group of a task in order, all ids, all sides, and which rows are leaders."""
    group, ids, side, lead = (table.column(c).to_numpy() for c in ("group", "rep", "side", "lead"))
    order = np.lexsort((ids, side, group))
    parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
    return [(int(group[p[0]]), p) for p in parts if len(p)], ids, side, lead


def _edges(found: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table({name: pa.array([e[k] for e in found], pa.int64()) for k, name in enumerate(("group", "a", "b"))})


def _meet(num: int, den: int):
    """Stars of the close pairs of buckets."""

    def run(table: pa.Table) -> pa.Table:
        rows, ids, side, lead = _task(table)
        own = list(zip(table.column("n").to_pylist(), table.column("bits").to_pylist(), strict=True))
        edges: list[tuple[int, int, int]] = []
        more = []
        for group, part in rows:
            if len(part) == 2 and not lead[part].any():
                (n, a), (m, b) = own[part[0]], own[part[1]]
                size = min(len(a), len(b))
                apart = (folded(int.from_bytes(a, "little"), len(a), size) ^ folded(int.from_bytes(b, "little"), len(b), size)).bit_count()
                x, y = sorted((int(ids[part[0]]), int(ids[part[1]])))
                if x != y and apart * (num + den) <= (den - num) * (n + m):
                    edges.append((group, x, y))
            else:
                more.append((group, part))
        pick = lambda at: [own[k] for k in at]
        return _edges(edges + _links(more, ids, side, lead, lambda left, right: close_pairs(pick(left), pick(right), num, den)))

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of each pair, counted fragment by fragment of the global order and summed."""
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    seen, times = np.unique(np.concatenate([np.unique(np.concatenate(side)) if side else np.zeros(0, np.uint64) for side in (left, right)]), return_counts=True)
    shared = seen[times > 1]
    for f in range(0, len(shared), FRAGMENT_COLUMNS):
        part = shared[f : f + FRAGMENT_COLUMNS]
        sides = []
        for side in (left, right):
            inside = np.zeros((len(side), len(part)), dtype=np.float32)
            for k, grams in enumerate(side):
                own = grams[np.searchsorted(grams, part[0]) : np.searchsorted(grams, part[-1], side="right")]
                at = np.searchsorted(part, own)
                inside[k, at[part[at] == own]] = 1
            sides.append(inside)
        total += sides[0] @ sides[1].T
    return total


def stars(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member) of the components of a symmetric matrix, without singles."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    ids, linked = ids[order], linked[np.ix_(order, order)]
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(ids[k]), int(ids[x])) for k, x in enumerate(label) if k != x]


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    common = overlaps(left, right).astype(np.int64)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return (common > 0) & (den * common >= num * (sizes - common))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in text_chunks(batch, "text"):
                n, d1, d2, bits = [], [], [], []
                for grams in shingle_sets(data, offsets, size):
                    n.append(len(grams))
                    bits.append(parities(grams))
                    m = mix(grams)
                    d1.append(int(m.sum(dtype=np.uint64)))
                    d2.append(int(mix(m + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)))
                signed = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), *signed, pa.array(bits, pa.binary())], names=["doc_id", "n", "d1", "d2", "bits"])

    return run


def _keys(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch, "text"):
                keys = [fragment_keys(grams, num, den) for grams in shingle_sets(data, offsets, size)]
                each = np.array([len(k) for k in keys])
                flat = np.concatenate(keys).view(np.int64) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids[i:j], each).astype(np.int64))], names=["key", "rep"])

    return run


def _verify(size: int, num: int, den: int):
    """Stars of the pairs of clusters that reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        rows, ids, side, lead = _task(table)
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).to_batches():
            for _, _, data, offsets in text_chunks(batch, "text"):
                sets += shingle_sets(data, offsets, size)
        pick = lambda at: [sets[k] for k in at]
        return _edges(_links(rows, ids, side, lead, lambda left, right: linked_pairs(pick(left), pick(right), num, den)))

    return run


def in_groups(rows: DataFrame, carry: list[str], bins: int, most: int, run) -> tuple[DataFrame, DataFrame]:
    """Links (group, a, b) inside each group of rows(group, rep, weight, blocks, carry): of groups of one block, and of larger ones.

    The components of both are those of all linked pairs. Groups of one block
    are dealt to bins. A larger group is dealt to its blocks, and its leader,
    the row of most weight, goes to each of them: what is linked to the leader
    need not be compared with other blocks, but with those rows that no block
    has linked to it. Only these, in parts of `most` rows, meet each other and
    the blocks of the linked ones. So of a group of near copies each row goes to
    one task, and to more only if its group falls apart.
    """
    links = "group long, a long, b long"
    out = ["group", "rep", *carry]
    flags = [F.lit(0).alias("side"), F.lit(0).alias("lead")]
    single = rows.where("blocks = 1").select(*out, *flags, F.pmod(F.xxhash64("group"), F.lit(bins)).alias("task"))
    single = single.groupBy("task").applyInArrow(run, links)
    many = rows.where("blocks > 1")
    if many.isEmpty():
        return single, many.select("group", F.col("group").alias("a"), F.col("group").alias("b")).limit(0)
    many = staged(many.withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "many")
    leaders = many.groupBy("group").agg(F.max(F.struct("weight", "rep"))["rep"].alias("leader"), F.first("blocks").alias("count"))
    leaders = staged(leaders, "leaders")
    led = many.join(leaders, ["group"])
    guests = led.where("rep = leader").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    own = led.where("rep <> leader").select(*out, "home", F.lit(0).alias("side"), F.lit(0).alias("lead"))
    own = own.unionByName(guests.select(*out, F.col("to").alias("home"), F.lit(0).alias("side"), F.lit(1).alias("lead")))
    inside = staged(own.groupBy("group", "home").applyInArrow(run, links), "inside")

    done = inside.join(leaders.select("group", F.col("leader").alias("a")), ["group", "a"]).select("group", F.col("b").alias("rep"))
    done = staged(done.unionByName(leaders.select("group", F.col("leader").alias("rep"))).distinct(), "done")
    rest = staged(many.join(done, ["group", "rep"], "left_anti"), "rest")
    parts = rest.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    parts = staged(parts, "parts")
    if parts.isEmpty():
        return single, inside
    each = lambda table, n: table.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    rest = rest.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    task = lambda *ends: F.xxhash64("group", *ends).alias("task")
    low, high = F.least("part", "other"), F.greatest("part", "other")
    apart = each(rest, "parts").select(*out, (F.col("part") > low).cast("int").alias("side"), flags[1], task(F.lit(0), low, high))
    beside = each(rest, "blocks").select(*out, *flags, task(F.lit(1), F.col("part"), F.col("other")))
    linked = each(many.join(parts, "group").join(done, ["group", "rep"], "left_semi"), "parts").select(*out, F.lit(1).alias("side"), flags[1], task(F.lit(1), F.col("other"), F.col("home")))
    across = apart.unionByName(beside).unionByName(linked).groupBy("group", "task").applyInArrow(run, links)
    return single, inside.unionByName(across)


@scoped
def ngram_jaccard_join(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard ratio of num/den or more.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Returns (doc_id,
    n_shingles, component_id), one row for each row of docs.

    Null or empty texts, and texts without words, have no n-grams and are
    linked with nothing. Fewer words than `size` make one n-gram. Repeated rows
    give repeated result rows; rows that share an id count as one document. A
    row whose id is null has its own n-gram count and a null component. No rows,
    no result. Other columns are ignored, whatever their names.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = staged(docs.mapInArrow(_signatures(size), "doc_id long, n long, d1 long, d2 long, bits binary"), "marks")
    sets = marks.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    sets = staged(sets, "sets")

    reps = sets.select(F.col("rep").alias("doc_id")).distinct()
    keyed = staged(keep_rows_of(docs, reps, "doc_id").mapInArrow(_keys(size, num, den), "key long, rep long"), "keyed")
    # Counted apart from the join, so that Spark can split a hot key there.
    keys = staged(keyed.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1"), "keys")
    meet = keyed.join(keys, "key")
    meet = restaged(meet.select(F.col("key").alias("group"), "rep", "docs", F.ceil(F.col("docs") / BUCKET_DOCS).cast("int").alias("blocks")), "buckets", [marks, sets])
    # The documents that a document meets: of a group of near copies, the one that the others were made from has most.
    weights = staged(meet.groupBy("rep").agg(F.sum("docs").alias("weight")), "weights")
    own = keep_rows_of(marks, weights.select(F.col("rep").alias("doc_id")), "doc_id").groupBy(F.col("doc_id").alias("rep")).agg(F.max(F.struct("n", "bits")).alias("own"))
    own = staged(own.select("rep", "own.*").join(weights, "rep"), "own")
    meet = meet.drop("docs").join(few(own, BUCKET_ROWS), "rep")
    near, more = in_groups(meet, ["n", "bits"], _bins(meet, F.length("bits") + 40), BUCKET_DOCS, _meet(num, den))
    clusters = staged(components(near.unionByName(more).select("a", "b")), "clusters").select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    clusters = restaged(clusters.join(weights.withColumnRenamed("rep", "doc_id"), "doc_id"), "weighted", [marks, sets])

    small = clusters.limit(200_001).count() <= 200_000
    members = docs.where("text is not null").join(F.broadcast(clusters) if small else clusters, "doc_id")
    members = members.select(F.col("cluster").alias("group"), F.col("doc_id").alias("rep"), "weight", "text")
    members = staged(members if _unique(marks) else members.dropDuplicates(["rep"]), "members")
    sizes = staged(members.groupBy("group").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")), "sizes")
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    bins = _bins(members, F.octet_length("text"))
    members = members.join(sizes.select("group", blocks.alias("blocks")), "group")
    apart, joined = in_groups(members, ["text"], bins, BLOCK_DOCS, _verify(size, num, den))
    apart = staged(apart, "found").select(F.col("b").alias("rep"), F.col("a").alias("component"))
    linked = apart.unionByName(components(joined.select("a", "b")).where("id <> component").select(F.col("id").alias("rep"), "component"))
    linked = restaged(linked, "linked", [marks, sets])

    sets = sets.join(linked, "rep", "left").select(F.col("n").alias("sn"), F.col("d1").alias("s1"), F.col("d2").alias("s2"), F.coalesce("component", "rep").alias("component"))
    out = marks.join(sets, (F.col("n") == F.col("sn")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _bins(rows: DataFrame, size: F.Column) -> int:
    """Tasks for groups of one block: about BLOCK_BYTES or BUCKET_DOCS rows each."""
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    return max(8, (total or 0) // BLOCK_BYTES + 1, n // BUCKET_DOCS + 1)


def _unique(marks: DataFrame) -> bool:
    total, ids = marks.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return total == ids


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id is the smallest of their component, with all columns. Rows without an id stay, and rows that share an id are one document, which stays or goes as a whole."""
    id_col = options.get("id_col", "doc_id")
    groups = ngram_jaccard_join(docs, **options)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return keep_rows_of(docs, gone, id_col, "left_anti").select(docs.columns)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Shingles of three words, ratio 90/100, over all of documents."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
  ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.id = d.doc_id
"""
