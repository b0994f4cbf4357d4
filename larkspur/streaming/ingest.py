"""A corpus that follows a folder of markdown files: files that come, change or go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.plans.log import CommitLog, Taken
from larkspur.plans.store import Store
from larkspur.session import few, staged
from larkspur.sources.markdown import contents, listed

MANIFEST = "path string, modified timestamp, size long, digest string"


class Manifest:
    """What was last seen of a folder: (path, modified, size, digest), as numbered tables below `root`, one of which counts by the log beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, f"{root.rstrip('/')}/log")

    def table(self) -> DataFrame:
        record = self.log.latest()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{record['table']}") if record else self.spark.createDataFrame([], MANIFEST)

    def put(self, rows: DataFrame) -> None:
        """Replace the table; a follower of the same folder that has been faster wins, and the next pass sees what is left."""
        before, table = self.log.latest(), uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{table}")
        try:
            self.log.append({"version": before["version"] + 1 if before else 1, "table": table})
        except Taken:
            self.log.delete(f"{self.root}/{table}")
            return
        if before:
            self.log.delete(f"{self.root}/{before['table']}")


def catch_up(spark: SparkSession, root: str, store: Store, manifest: Manifest) -> dict[str, int]:
    """Bring the corpus up to the folder; returns how many files were read, had new contents and were gone.

    Only files whose time or size is not as it was last seen are opened, and
    only those with another digest are put in the corpus. A pass that is run
    again finds nothing to do. Where no file is listed at all, nothing is
    removed, as after a failed listing. Digests are taken first and bodies of
    changed files read after that, straight into the corpus; the digest of a
    file that has changed in between is not kept, so the next pass reads it.
    """
    now, old = staged(listed(spark, root), "listed"), manifest.table()
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("modified", "size")]
    both = now.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "left")
    looked = both.where(~(same[0] & same[1]) | F.col("o.path").isNull()).select("n.path", "n.modified", "n.size", F.col("o.digest").alias("before"))
    looked = staged(looked, "looked")
    digests = staged(contents(looked, root, bodies=False), "digests")
    new = staged(looked.join(digests, "path").where(~F.col("digest").eqNullSafe(F.col("before"))).select("path"), "changed")
    gone = old.join(now.select("path"), "path", "left_anti") if not now.isEmpty() else old.limit(0)
    counts = {"read": looked.count(), "changed": new.count(), "gone": gone.count()}
    if counts["changed"]:
        store.update(contents(new, root))
    if counts["gone"]:
        store.remove(gone.select("path"))
    if counts["read"] or counts["gone"]:
        stay = old.join(few(looked.select("path"), 1_000_000), "path", "left_anti").join(few(gone.select("path"), 1_000_000), "path", "left_anti")
        seen = looked.join(digests, "path", "left").select("path", "modified", "size", "digest")
        if counts["changed"]:
            still = listed(spark, root).withColumn("still", F.lit(True))
            seen = seen.join(still, ["path", "modified", "size"], "left").withColumn("digest", F.when(F.col("still"), F.col("digest"))).drop("still")
        manifest.put(staged(stay.unionByName(seen), "seen"))
    return counts


def follow(spark: SparkSession, root: str, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a folder: each tick of a stream is a pass of catch_up(), whose state is a manifest beside the checkpoint.

    A tick that is run again after a failure finds what is left to do. By
    default one tick; processingTime="30 seconds" goes on.
    """
    manifest = Manifest(spark, f"{checkpoint.rstrip('/')}/manifest")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    batch = lambda df, number: catch_up(spark, root, store, manifest)
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/ticks").trigger(**(trigger or {"availableNow": True})).start()
