"""A corpus as a log of small segments.

A change writes a segment: the documents it has put in place, their chunks, the
ids of the documents it replaces or removes, and the chunks these had. It then
claims the next version in the log, which lists the segments that count; where
another writer has been faster, the change is made again from that writer's
version, so no update is lost. Readers merge: rows of a segment whose document a
later segment names are dead, counts are sums of the segments' differences. So
an edit writes in proportion to its documents, whatever the size of the corpus.
Neighbouring segments of a size are merged once there are FAN of them.

What is derived from chunks, their words, postings and counts, follows from a
segment alone. It is made and stored with the segment when it is first asked
for, so pages, lists and edits of a corpus that nobody has searched do not wait
for it.

Postings lie in ranges of terms, with a dictionary that says which; a search
reads the ranges of its terms only. Hashed vectors weigh every term by the size
of the corpus, so they are made for a version when it is first searched.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import time
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.vectors import smoothed_idf
from larkspur.operators import maintain, statistics
from larkspur.operators.chunker import chunk
from larkspur.operators.forward import token_vectors
from larkspur.operators.vectorize import DIMS
from larkspur.plans.log import CommitLog, Taken
from larkspur.plans.search import Index, Searcher
from larkspur.schemas import CHUNKS, DOCUMENTS, EMBEDDED, SCHEMA_VERSION
from larkspur.session import Scope, few, release, staged
from larkspur.sources.provider import Embed, embed_missing

SCHEMAS = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "postings": "term string, chunk_id long, tf long, n_tokens long, range int",
    "terms": "term string, n long, range int",
    "lengths": "chunk_id long, n_tokens long",
    "tokens": "chunk_id long, words array<string>, tokens array<string>",
    "vocab": "term string, df long",
    "occurrences": "term string, chunks long, times long",
    "embedded": EMBEDDED,
    "dead_documents": "doc_id long",
    "dead_chunks": "doc_id long",
    "gone": f"{CHUNKS}, seq int",
}
DERIVED = ("tokens", "lengths", "postings", "terms", "vocab")  # follow from the chunks of a segment and those it has replaced
SUMMED = {"terms": "n", "vocab": "df"}  # tables that hold a segment's differences
CHANGED_ROWS = 1_000_000  # ids of changed documents that may be broadcast
RANGE_ROWS = 200_000  # postings of a term range
FAN = 4  # neighbouring segments of a tier that are merged
TIER_BYTES = 1 << 20  # of the lowest tier; each next one is FAN times as large
ATTEMPTS = 20
DENSE = {"compression": "zstd"}  # of the tables that have the words of the corpus


class Record(dict):
    """A version as the log has it; its number of tokens is counted when it is first asked for."""

    def __init__(self, found: dict, tokens: Callable[[dict], int]):
        super().__init__(found)
        self._tokens = tokens

    def __missing__(self, key: str) -> int:
        if key != "tokens":
            raise KeyError(key)
        self[key] = self._tokens(self)
        return self[key]


class Store:
    """Segments and their log below `root`, for any number of writers. With connect, of sources.provider, chunks have vectors of that model as well, and searches use them."""

    def __init__(self, spark: SparkSession, root: str, dims: int = DIMS, fence_aware: bool = False, connect: Callable[[], Embed] | None = None):
        self.spark, self.root, self.dims, self.fence_aware, self.connect = spark, root.rstrip("/"), dims, fence_aware, connect
        self.log = CommitLog(spark, f"{self.root}/log")
        self._searcher: Searcher | None = None
        self.record()

    # ------------------------------------------------------------- versions

    def record(self) -> dict | None:
        """The latest version: its number, its segments from old to new, and the number of chunks and of their tokens."""
        found = self.log.latest()
        if found and found["schema"] > SCHEMA_VERSION:
            raise ValueError(f"snapshot has schema {found['schema']}; this library reads up to {SCHEMA_VERSION}")
        for s in found["segments"] if found else []:  # derived tables that have been made since
            s["tables"] += [n for n in self.log.names(self._at(s["id"])) if n in DERIVED and n not in s["tables"]]
        return Record(found, self._tokens) if found else None

    def _tokens(self, record: dict) -> int:
        return self._merged("lengths", record).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]

    def version(self) -> int:
        """The latest version, 0 for none."""
        return max(self.log.numbers(), default=0)

    def _commit(self, make: Callable[[dict | None], dict | None]) -> int:
        """Add the segment that make(latest version) writes; again from the start if another writer takes the next number first. None changes nothing."""
        for attempt in range(ATTEMPTS):
            base = self.record()
            made = make(base)
            if made is None:
                return base["version"] if base else 0
            segment = made["segment"]
            version = base["version"] + 1 if base else 1
            record = {"version": version, "schema": SCHEMA_VERSION, "segments": [*(base["segments"] if base else []), segment | {"seq": version}]}
            record["chunks"] = (base["chunks"] if base else 0) + made["chunks"]
            try:
                self.log.append(record)
            except Taken:
                self.log.delete(self._at(segment["id"]))
                time.sleep(0.05 * attempt)
                continue
            self._searcher = None
            self._compact()
            return version
        raise TimeoutError(f"other writers were faster {ATTEMPTS} times")

    def _at(self, segment: str) -> str:
        return f"{self.root}/segments/{segment}"

    # -------------------------------------------------------------- reading

    def _read(self, name: str, segments: list[dict]) -> DataFrame | None:
        """Rows of the segments that have the table, with `seq`."""
        out = None
        for s in segments:
            if name in DERIVED:
                self._derive(s, name)
            elif name not in s["tables"]:
                continue
            rows = self._stored(s["id"], name).withColumn("seq", F.lit(s["seq"]))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _stored(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self._at(segment)}/{name}")

    def _has(self, s: dict, name: str) -> bool:
        """Whether a segment has the table; derived ones may have been made since the record was read."""
        return name in s["tables"] or name in DERIVED and self.log.exists(f"{self._at(s['id'])}/{name}")

    def _derive(self, s: dict, name: str) -> None:
        """Make a derived table of a segment where there is none yet. Others read it when it is whole; of two that make it one counts."""
        if self._has(s, name):
            return
        for n in {"tokens": (), "lengths": ("tokens",), "postings": ("tokens",), "terms": ("postings",), "vocab": ("tokens",)}[name]:
            self._derive(s, n)
        of = lambda n: self._stored(s["id"], n)
        by = ["range"] if name == "postings" else []
        if name == "tokens":
            rows = statistics.tokenized(of("chunks"))  # texts are tokenised once, here
        elif name == "lengths":
            rows = of("tokens").select("chunk_id", F.size("words").cast("long").alias("n_tokens"))
        elif name == "postings":
            n = of("tokens").agg(F.coalesce(F.sum(F.size(F.array_distinct("words"))), F.lit(0))).first()[0]
            rows = self._in_ranges(statistics.postings_in_place(of("tokens")), n).select("term", "chunk_id", "tf", "n_tokens", "range")
        elif name == "terms":
            rows = of("postings").groupBy("term", "range").agg(F.count("*").alias("n")).select("term", "n", "range")
            if "gone" in s["tables"]:
                gone = statistics.postings_in_place(statistics.words(of("gone"))).groupBy("term").agg((-F.count("*")).alias("n"))
                rows = rows.unionByName(gone.select("term", "n", F.lit(None).cast("int").alias("range")))
            rows = rows.repartitionByRange("term").sortWithinPartitions("term")  # so that a prefix skips row groups
        else:
            rows = statistics.frequency_of(of("tokens"))
            if "gone" in s["tables"]:
                gone = statistics.frequency_of(statistics.tokens(of("gone"))).select("term", (-F.col("df")).alias("df"))
                rows = rows.unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        at, draft = f"{self._at(s['id'])}/{name}", f"{self._at(s['id'])}/.{uuid.uuid4().hex}"
        rows.write.options(**DENSE).partitionBy(*by).parquet(draft)
        self.log.system(at).rename(self.log.path(draft), self.log.path(at))
        if self.log.exists(draft):  # another was faster
            self.log.delete(draft)

    def _in_ranges(self, postings: DataFrame, n: int) -> DataFrame:
        """n postings dealt by term, with the number of the `range`. Chunks are part of the order, so that a term of very many chunks has several ranges."""
        return postings.repartitionByRange(n // RANGE_ROWS + 1, "term", "chunk_id").sortWithinPartitions("term", "chunk_id").withColumn("range", F.spark_partition_id())

    def _live(self, rows: DataFrame, name: str, record: dict) -> DataFrame:
        """Without the rows of documents that a later segment names; `seq` stays."""
        kind = "dead_documents" if name == "documents" else "dead_chunks"
        dead = self._read(kind, record["segments"])
        if dead is None:
            return rows
        dead = dead.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("seq").alias("_seq"))
        own = F.col("doc_id") if name in ("documents", "chunks") else F.shiftright("chunk_id", maintain.CHUNK_BITS)
        small = sum(s[kind] for s in record["segments"]) <= CHANGED_ROWS
        return rows.join(F.broadcast(dead) if small else dead, (own == F.col("_doc")) & (F.col("seq") < F.col("_seq")), "left_anti")

    def _merged(self, name: str, record: dict, segments: list[dict] | None = None, only: F.Column | None = None) -> DataFrame:
        """A table as the record has it, of all or some segments; `only` is a condition on the stored rows."""
        rows = self._read(name, record["segments"] if segments is None else segments)
        if rows is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if only is not None:
            rows = rows.where(only)
        if name not in SUMMED:
            return self._live(rows, name, record).drop("seq")
        value = SUMMED[name]
        return rows.groupBy("term").agg(F.sum(value).alias(value)).where(f"{value} > 0")

    def table(self, name: str) -> DataFrame:
        """A table of the latest version: documents, chunks, postings, lengths, vocab, terms, occurrences (chunks and times of a term's postings), frequencies, vectors or embedded."""
        record = self.record()
        if name == "frequencies":
            return statistics.frequencies_of(self.table("tokens"))
        if record is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name == "vectors":
            return self._vectors(record).drop("part")
        if name == "occurrences":
            # Ranges of postings are for searches; where none has been made, chunks are counted where they stand.
            made = all(self._has(s, "postings") for s in record["segments"])
            rows = self._merged("postings", record) if made else statistics.postings_in_place(self._merged("tokens", record))
            return rows.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("times"))
        rows = self._merged(name, record)
        if name == "vocab":
            return rows.withColumn("idf", smoothed_idf(F.lit(record["chunks"]), "df"))
        return rows.select("term", "chunk_id", "tf") if name == "postings" else rows

    def _vectors(self, record: dict) -> DataFrame:
        """(chunk_id, dim, w, part) of a version, made when it is first asked for; part is a run of dimensions."""
        at = f"{self.root}/vectors/{record['version']:08d}"
        if not self.log.exists(at):
            draft = f"{self.root}/vectors/.{uuid.uuid4().hex}"
            vocab = staged(self._merged("vocab", record), "vocab")
            vectors = token_vectors(self._merged("tokens", record), vocab, record["chunks"], self.dims)
            vectors.withColumn("part", F.floor(F.col("dim") / 64).cast("int")).write.partitionBy("part").parquet(draft)
            self.log.system(at).rename(self.log.path(draft), self.log.path(at))
            if self.log.exists(draft):  # another reader was faster
                self.log.delete(draft)
        return self.spark.read.schema("chunk_id long, dim int, w double, part int").parquet(at)

    # -------------------------------------------------------------- writing

    def _segment(self, base: dict | None, documents: DataFrame, chunks: DataFrame, dead_documents: DataFrame | None, dead_chunks: DataFrame | None) -> dict:
        """Write a segment of these documents and chunks; the dead are (doc_id) whose older rows no longer count."""
        segment, tables, dead = uuid.uuid4().hex, [], {"dead_documents": 0, "dead_chunks": 0}

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.options(**DENSE).parquet(f"{self._at(segment)}/{name}")
            tables.append(name)
            return self._stored(segment, name)

        if base and self.connect:
            known, changed_model = self._known(base)
            if changed_model:  # all chunks are embedded again, so all are written again
                gone = self._merged("chunks", base)
                keep = gone.join(dead_chunks, "doc_id", "left_anti") if dead_chunks is not None else gone
                chunks, dead_chunks = chunks.unionByName(keep.select(chunks.columns)), gone.select("doc_id")
        for name, ids in (("dead_documents", dead_documents), ("dead_chunks", dead_chunks)):
            if base and ids is not None:
                dead[name] = put(ids.select("doc_id").distinct(), name).count()
        put(documents, "documents")
        chunks = put(chunks, "chunks")
        made = chunks.count()
        if base and dead["dead_chunks"]:
            ids = self._stored(segment, "dead_chunks")
            old = self._live(self._read("chunks", base["segments"]), "chunks", base)
            # The counts of these are taken off when counts are made, whatever has become of older segments by then.
            made -= put(old.join(F.broadcast(ids) if dead["dead_chunks"] <= CHANGED_ROWS else ids, "doc_id", "left_semi").select("chunk_id", "doc_id", "chunk_idx", "heading", "content", "seq"), "gone").count()
        if self.connect:
            put(embed_missing(chunks, known if base else self.spark.createDataFrame([], EMBEDDED), self.connect), "embedded")
        return {"chunks": made, "segment": {"id": segment, "tables": tables, "bytes": self.log.bytes(self._at(segment))} | dead}

    def _compact(self) -> None:
        """Merge the latest segments up to the lowest tier of which there are FAN among them; another writer's version in between leaves it for later."""
        base = self.record()
        tiers = [int(math.log(max(1.0, s["bytes"] / TIER_BYTES), FAN)) for s in base["segments"]]
        run = 0
        for tier in sorted(set(tiers)):
            run = next((k for k, t in enumerate(reversed(tiers)) if t > tier), len(tiers))
            if tiers[len(tiers) - run :].count(tier) >= FAN:
                break
        else:
            return
        run_of, rest = base["segments"][-run:], base["segments"][:-run]
        segment, tables = uuid.uuid4().hex, []

        def put(df: DataFrame, name: str, *by: str) -> None:
            df.write.options(**DENSE).partitionBy(*by).parquet(f"{self._at(segment)}/{name}")
            tables.append(name)

        before = rest[-1]["seq"] if rest else 0
        # Segments of older versions have not kept what they replaced, so what follows from it must be merged.
        kept = all("gone" in s["tables"] or not s["dead_chunks"] for s in run_of)
        for name in SCHEMAS:
            if name in DERIVED or not any(name in s["tables"] for s in run_of):
                continue
            if name.startswith("dead_"):
                if rest:  # nothing is older than the first segment
                    put(self._read(name, run_of).select("doc_id").distinct(), name)
            elif name == "gone":
                if rest and kept:  # chunks of the merged segments have gone with them
                    own = [self._stored(s["id"], "gone").where(F.col("seq") <= before) for s in run_of if "gone" in s["tables"]]
                    put(functools.reduce(DataFrame.unionByName, own), name)
            else:
                put(self._merged(name, base, run_of), name)
        # Derived tables are merged where all segments have them; otherwise they are made from the merged chunks when they are asked for.
        have = {name for name in DERIVED if all(self._has(s, name) for s in run_of)}
        if not kept:
            have |= {"postings", "terms", "vocab"}
        for name in ("tokens", "lengths", "vocab"):
            if name in have:
                rows = self._read(name, run_of)
                put(rows.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0") if name == "vocab" else self._merged(name, base, run_of), name)
        if {"postings", "terms"} <= have:
            postings = staged(self._merged("postings", base, run_of).drop("range"), "merged")
            put(self._in_ranges(postings, postings.count()), "postings", "range")
            own = self._stored(segment, "postings").groupBy("term", "range").agg(F.count("*").alias("n"))
            # What the merged segments add up to, less what the postings show, is owed to older segments.
            sums = self._read("terms", run_of).groupBy("term").agg(F.sum("n").alias("n")).unionByName(own.groupBy("term").agg((-F.sum("n")).alias("n")))
            owed = sums.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").select("term", "n", F.lit(None).cast("int").alias("range"))
            put(own.select("term", "n", "range").unionByName(owed).repartitionByRange("term").sortWithinPartitions("term"), "terms")
        dead = {k: sum(s[k] for s in run_of) if k in tables else 0 for k in ("dead_documents", "dead_chunks")}
        merged = {"id": segment, "tables": tables, "bytes": self.log.bytes(self._at(segment)), "seq": run_of[-1]["seq"]} | dead
        try:
            self.log.append(base | {"version": base["version"] + 1, "segments": [*rest, merged]})
        except Taken:
            self.log.delete(self._at(segment))

    def _known(self, base: dict) -> tuple[DataFrame, bool]:
        """Stored vectors of the model, and whether the model now gives vectors of another length: none of them count then, with a warning."""
        known = self._merged("embedded", base)
        probe = self.connect()(["probe"])[0]
        row = known.where("vector is not null").select(F.size("vector").alias("n")).first()
        if row and probe is not None and row["n"] != len(probe):
            warnings.warn(f"stored vectors have {row['n']} dimensions, the model gives {len(probe)}: all chunks are embedded again", stacklevel=3)
            return known.limit(0), True
        return known, row is None  # without any vector so far all chunks are due

    def _rows(self, files: DataFrame) -> DataFrame:
        """The chunks of files(path, body) by path, which are read once; a file without chunks has a row without chunk_idx. Of files of one path that with the greatest body counts."""
        files = files.select("path", "body").where("path is not null")
        cut = lambda f: staged(chunk(f, fence_aware=self.fence_aware, every=True), "rows", **DENSE)
        rows = cut(files)
        twice = rows.where("coalesce(chunk_idx, 0) = 0").groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
        twice = staged(twice, "twice")
        if not twice.isEmpty():
            twice = few(twice, CHANGED_ROWS)
            own = cut(files.join(twice, "path", "left_semi").groupBy("path").agg(F.max("body").alias("body")))
            rows = rows.join(twice, "path", "left_anti").unionByName(own)
        return rows

    def _numbered(self, rows: DataFrame, now: dt.datetime | None) -> DataFrame:
        """Documents of rows. Ids of known paths stay."""
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
        first = rows.where("chunk_idx = 0").select("path", F.when(F.col("heading") != "", F.col("heading")).otherwise(stem).alias("title"))
        known = self.table("documents").select("path", "doc_id")
        new = staged(first.join(known, "path", "left_anti"), "new")
        top = known.agg(F.max("doc_id")).first()[0] or 0
        ids = known.unionByName(maintain.number_rows(new, "path", "doc_id", top).select("path", "doc_id"))
        stamp = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return staged(first.join(ids, "path").select("doc_id", "path", "title", F.lit(stamp).alias("ingested_at")), "documents")

    def _fresh(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """Chunks of the documents ids(path, doc_id). Texts are shuffled only if these are too many to be broadcast."""
        fresh = rows.where("chunk_idx is not null").join(few(ids.select("path", "doc_id"), CHANGED_ROWS), "path")
        return fresh.select(maintain.chunk_id().alias("chunk_id"), "doc_id", "chunk_idx", "heading", "content")

    def _changed(self, old: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
        """(doc_id) of documents whose chunks differ in old and rows. Only digests are joined, not texts."""
        new = maintain.digests(rows.where("chunk_idx is not null"), "path").join(documents.select("path", "doc_id"), "path").drop("path")
        return staged(maintain.differing(maintain.digests(old), new), "changed")

    def ingest(self, files: DataFrame, now: dt.datetime | None = None) -> int:
        """Make the corpus hold exactly these files(path, body); returns the version.

        Ids of known paths stay. Files without chunks are left out and files
        that are gone are pruned, but without any file nothing changes. Chunks
        are written for the files that have changed.
        """
        with Scope() as own:
            rows = self._rows(files)
            if rows.where("chunk_idx is not null").isEmpty():
                return self.version()

            def make(base: dict | None) -> dict:
                documents = self._numbered(rows, now)
                if base is None:
                    return self._segment(None, documents, self._fresh(rows, documents), None, None)
                changed = self._changed(self._merged("chunks", base), rows, documents)
                due = documents.join(few(changed, CHANGED_ROWS), "doc_id", "left_semi")
                return self._segment(base, documents, self._fresh(rows, due), self._merged("documents", base), changed)

            version = self._commit(make)
            own.drop(self.spark)  # the segment has what counts
        return version

    def update(self, files: DataFrame, now: dt.datetime | None = None) -> int:
        """Put these files(path, body) in place of those of the same paths and keep all others; returns the version. A file without chunks is deleted. Chunks are written for files that have changed; where none has, nothing changes, not even the time."""
        with Scope() as staged_here:
            rows = self._rows(files)
            paths = rows.where("coalesce(chunk_idx, 0) = 0").select("path")

            def make(base: dict | None) -> dict | None:
                own = staged(self.table("documents").join(few(paths, CHANGED_ROWS), "path", "left_semi").select("doc_id", "path"), "own")
                documents = self._numbered(rows, now)
                old = self.table("chunks").join(few(own.select("doc_id"), CHANGED_ROWS), "doc_id", "left_semi")
                changed = self._changed(old, rows, documents)
                if changed.isEmpty():
                    return None
                due = documents.join(few(changed, CHANGED_ROWS), "doc_id", "left_semi")
                stamped = own.select("doc_id").unionByName(documents.select("doc_id"))
                return self._segment(base, documents, self._fresh(rows, due), stamped, changed)

            version = self._commit(make)
            staged_here.drop(self.spark)
        return version

    def remove(self, paths: DataFrame) -> int:
        """Remove the documents of paths(path); returns the version. Unknown paths change nothing."""
        paths = staged(paths.select("path").distinct(), "paths")

        def make(base: dict | None) -> dict | None:
            own = staged(self.table("documents").join(few(paths, CHANGED_ROWS), "path", "left_semi").select("doc_id"), "own")
            if base is None or own.isEmpty():
                return None
            none = lambda name: self.spark.createDataFrame([], SCHEMAS[name])
            return self._segment(base, none("documents"), none("chunks"), own, own)

        return self._commit(make)

    def write_chunk(self, path: str, heading: str, content: str, now: dt.datetime | None = None) -> int:
        """Replace the chunk of this path and non-empty heading, or append one; a new document has the heading as its title. Writes the one document."""

        def make(base: dict | None) -> dict:
            documents, chunks = self.table("documents"), self.table("chunks")
            own = documents.where(F.col("path") == path).first()
            doc = own["doc_id"] if own else (documents.agg(F.max("doc_id")).first()[0] or 0) + 1
            stamp = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            mine = chunks.where(F.col("doc_id") == doc)
            hit = mine.where(F.col("heading") == heading).agg(F.min("chunk_idx")).first()[0] if heading else None
            last = maintain.next_chunk_idx(mine).first() if hit is None else None
            at = hit if hit is not None else last["next_idx"] if last else 0
            row = self.spark.createDataFrame([(doc, at, heading, content)], "doc_id long, chunk_idx int, heading string, content string")
            whole = staged(maintain.upsert(mine, row.select(maintain.chunk_id().alias("chunk_id"), "*"), "chunk_id"), "whole")
            new = self.spark.createDataFrame([tuple(own) if own else (doc, path, heading, stamp)], DOCUMENTS)
            ids = row.select("doc_id")
            return self._segment(base, new, whole, ids, ids)

        return self._commit(make)

    def delete(self, path: str) -> int:
        """Remove a document; returns the number of its chunks. KeyError for an unknown path."""
        removed = 0

        def make(base: dict | None) -> dict:
            nonlocal removed
            own = self.table("documents").where(F.col("path") == path).select("doc_id").first()
            if own is None:
                raise KeyError(f"not found: {path}")
            ids = self.spark.createDataFrame([(own["doc_id"],)], "doc_id long")
            removed = self.table("chunks").where(F.col("doc_id") == own["doc_id"]).count()
            none = lambda name: self.spark.createDataFrame([], SCHEMAS[name])
            return self._segment(base, none("documents"), none("chunks"), ids, ids)

        self._commit(make)
        return removed

    # ------------------------------------------------------------ searching

    def list(self, prefix: str = "") -> DataFrame:
        return maintain.list_documents(self.table("documents"), self.table("chunks"), prefix).orderBy(F.desc("ingested_at"), "path")

    def page(self, prefix: str = "", after: str = "", size: int = 100) -> DataFrame:
        """The first `size` documents of the list by path that come after a path: the last path of a page begins the next one. Chunks are read for those only."""
        documents = self.table("documents").where(F.col("path").startswith(prefix) & (F.col("path") > after)).orderBy("path").limit(size)
        documents = staged(documents, "page")
        own = self.table("chunks").join(few(documents.select("doc_id"), CHANGED_ROWS), "doc_id", "left_semi")
        return maintain.list_documents(documents, own).orderBy("path")

    def index(self) -> Index:
        """The tables of the latest version, with what a search of few queries reads instead of whole tables."""
        record = self.record()
        if record is None or not record["chunks"]:
            raise LookupError("the corpus is empty")
        names = ("documents", "chunks", "tokens", "lengths")
        vocab = self._merged("vocab", record).withColumn("idf", smoothed_idf(F.lit(record["chunks"]), "df"))
        postings = lambda: self._merged("postings", record).select("term", "chunk_id", "tf")
        whole = Index(**{n: self._merged(n, record) for n in names}, vocab=vocab, make_postings=postings, make_vectors=lambda: self._vectors(record))
        whole.facts = (record["chunks"], record["tokens"])
        whole.make_terms = lambda: self._read("terms", record["segments"])
        whole.ranged = lambda wanted: self._ranged(record, wanted)
        return whole

    def _ranged(self, record: dict, wanted: dict[int, list[int]]) -> DataFrame:
        """Postings of the term ranges of each segment, by `seq`; the other ranges are not listed."""
        out = None
        for s in record["segments"]:
            if wanted.get(s["seq"]):
                rows = self._read("postings", [s]).where(F.col("range").isin(wanted[s["seq"]]))
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], SCHEMAS["postings"]) if out is None else self._live(out, "postings", record).drop("seq")

    def searcher(self) -> Searcher:
        """A searcher over the latest version; a new version has a new one, so no stale result is kept."""
        version = self.version()
        if self._searcher is None or self._searcher.snapshot != str(version):
            embedded = self.table("embedded") if self.connect else None
            self._searcher = Searcher(self.index(), str(version), self.dims, embedded, self.connect)
        return self._searcher

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the latest `keep` versions and what only they read; returns how many. Nobody may read those any more, nor write meanwhile."""
        numbers = self.log.numbers()
        old, stay = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
        live = {s["id"] for n in stay for s in self.log.read(n)["segments"]}
        for n in old:
            self.log.forget(n)
        files = self.log.system(self.root)
        for folder, used in (("segments", live), ("vectors", {f"{n:08d}" for n in stay})):
            for f in files.globStatus(self.log.path(f"{self.root}/{folder}/*")) or []:
                if f.getPath().getName() not in used:
                    files.delete(f.getPath(), True)
        return len(old)

    def close(self) -> None:
        """Forget results and delete the staged tables of this application."""
        self._searcher = None
        release(self.spark)
