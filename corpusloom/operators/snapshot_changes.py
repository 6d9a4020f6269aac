"""What changed between full snapshots of a table.

Method: a bucketed key-to-fingerprint index of each delivery. A delivery is indexed once (one scan, one
shuffle on the record key) and written bucketed by that key; probing the next delivery against the index of
the last one is then a join of equal buckets without any shuffle, after which the newer index takes the
place of the older. The index holds a 60-bit fingerprint instead of the hash; the hashes themselves are
fetched only for changed records (``with_values``). Late rows may come in an ``ingest`` of their own: they are merged with what the
delivery had, and its comparisons with both neighbours become due again.

Defined results: a row without table, id or snapshot number names no record and is ignored. Of several rows
of a record in one snapshot the latest delivered counts (ties: the larger fingerprint, absent lowest; null times lowest).
A record is ``changed`` only if both snapshots carry a hash. Empty input gives an empty result. Columns other
than those named are never read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, checkpoint, partitions, shared_dir

KEY = ["record_table", "record_id"]
CHANGES = "record_table string, record_id string, snapshot_no int, change_type string"


def clean_hash(value: Column) -> Column:
    """A hash without letter case, outer white space and a leading ``sha256:``; blank is null."""
    bare = F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_replace(bare, r"^sha256:\s*", "")
    return F.when(bare != "", bare)


def record_hash() -> Column:
    """The hash a snapshot row carries; sources have none."""
    return F.when(F.col("record_table") == "sources", F.lit(None)).otherwise(
        F.coalesce(clean_hash(F.col("chunk_hash")), clean_hash(F.col("content_sha256")))
    )


def fingerprint(value: Column) -> Column:
    """60 bits of a hash, whatever its spelling."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def _last() -> Column:
    """What of a record's rows in one delivery counts."""
    return F.max(F.struct("delivered_at", "hashed", "fp")).alias("last")


class SnapshotIndex:
    """Bucketed indexes of deliveries, and the changes between consecutive ones.

    ``ingest`` adds rows of deliveries, new or late; ``advance`` compares the oldest delivery whose comparison is due with the one
    before it and makes it the current one. ``pending`` lists what is due: deliveries never compared, and those which, or whose
    neighbour, got rows or came in between since. The changes that advance gives for a number replace those it gave before.

    The parts lie in ``folder`` (by default a new one in the shared folder); an index opened on a folder takes up its parts, with every
    comparison due unless ``current`` says up to which delivery they are done. ``close`` forgets the tables and deletes the parts.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, folder: str | None = None, current: int | None = None):
        self.spark = spark
        self.buckets = buckets or partitions(spark)
        self.folder = folder or f"{shared_dir(spark)}/snapshot-index-{uuid.uuid4().hex}"
        self.current: int | None = None
        self._parts: dict[int, list[str]] = {}
        self._done: dict[int, tuple] = {}
        for name, buckets in self._stored():
            self._attach(name, buckets)
        if current is not None:
            self._done = {no: self._state(no) for no in self._parts if no <= current}
            self.current = current

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _stored(self) -> list[tuple[str, int]]:
        files, path = self._path()
        names = sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
        return [(n, int(n.split("_")[2])) for n in names if n.startswith("snapshot_index_")]

    def _attach(self, name: str, buckets: int) -> None:
        self.spark.sql(
            f"create table if not exists {name} (record_table string, record_id string, delivered_at timestamp_ntz, hashed boolean, fp long, snapshot_no int) using parquet "
            f"partitioned by (snapshot_no) clustered by (record_table, record_id) sorted by (record_table, record_id) into {buckets} buckets location '{self.folder}/{name}'"
        )
        # One row per delivery: bounded by the number of deliveries, not of records.
        for (no,) in self.spark.table(name).select("snapshot_no").distinct().collect():
            self._parts.setdefault(no, []).append(name)

    def ingest(self, deliveries: DataFrame) -> None:
        """Index the rows given, of any deliveries: one scan, one write for all of them."""
        rows = deliveries.select(
            F.col("snapshot_no").cast("int").alias("snapshot_no"),
            *KEY,
            fingerprint(record_hash()).alias("fp"),
            record_hash().isNotNull().alias("hashed"),
            F.col("delivered_at").cast("timestamp_ntz").alias("delivered_at"),
        ).where("snapshot_no is not null and record_table is not null and record_id is not null")
        # Reduced first, so that repeated rows can't gather; then hashed by the key alone, so that a bucket of
        # every delivery lies in one task and one file.
        index = rows.groupBy("snapshot_no", *KEY).agg(_last()).select(*KEY, "last.*", "snapshot_no").repartition(self.buckets, *KEY)
        name = f"snapshot_index_{self.buckets}_{uuid.uuid4().hex}"
        (
            index.write.partitionBy("snapshot_no")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .format("parquet")
            .option("path", f"{self.folder}/{name}")
            .saveAsTable(name)
        )
        self._attach(name, self.buckets)

    def index(self, no: int) -> DataFrame:
        """(table, id, fp) of a delivery; one of several parts is reduced again."""
        parts = [self.spark.table(p).where(F.col("snapshot_no") == no) for p in self._parts[no]]
        rows = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(_last()).select(*KEY, "last.*")
        return rows.select(*KEY, F.when(F.col("hashed"), F.col("fp")).alias("fp"))

    def _state(self, no: int) -> tuple:
        before = max((n for n in self._parts if n < no), default=None)
        return before, tuple(self._parts.get(before, ())), tuple(self._parts[no])

    def pending(self) -> list[int]:
        return sorted(no for no in self._parts if self._done.get(no) != self._state(no))

    def advance(self) -> DataFrame | None:
        """Changes of the next pending delivery against the one before it; None for the first."""
        no = self.pending()[0]
        before = self._state(no)[0]
        self._done[no], self.current = self._state(no), no
        if before is None:
            return None
        old = self.index(before).withColumnRenamed("fp", "old_fp").withColumn("in_old", F.lit(True))
        new = self.index(no).withColumnRenamed("fp", "new_fp").withColumn("in_new", F.lit(True))
        kind = (
            F.when(F.col("in_old").isNull(), "added")
            .when(F.col("in_new").isNull(), "removed")
            .when(F.col("old_fp") != F.col("new_fp"), "changed")
        )
        return (
            old.join(new, KEY, "full_outer")
            .select(*KEY, F.lit(no).cast("int").alias("snapshot_no"), kind.alias("change_type"))
            .where("change_type is not null")
        )

    def close(self) -> None:
        """Drop the tables and delete their files; results not yet read are lost."""
        for name in {p for parts in self._parts.values() for p in parts}:
            self.spark.sql(f"drop table if exists {name}")
        files, path = self._path()
        files.delete(path, True)
        self._parts, self._done, self.current = {}, {}, None


def snapshot_changes(deliveries: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per record and later snapshot of two consecutive ones: added, removed or changed.

    The result is read from the index, whose parts stay in the shared folder as long as that does.
    """
    spark = deliveries.sparkSession
    index = SnapshotIndex(spark, buckets)
    index.ingest(deliveries)
    steps: list[DataFrame] = []
    while index.pending():
        if (step := index.advance()) is not None:
            steps.append(step)
    return reduce(DataFrame.unionByName, steps) if steps else spark.createDataFrame([], CHANGES)


def with_values(changes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Changed records with their old and new hash: one scan takes the values of both sides, for changes only.

    Up to a million changes are broadcast, so that nothing else of the table is moved; more are joined.
    """
    no = F.col("snapshot_no").cast("int")
    # One row per delivery.
    order = sorted(r[0] for r in deliveries.select(no).distinct().collect() if r[0] is not None)
    pairs = changes.sparkSession.createDataFrame(list(zip(order, order[1:])), "earlier int, snapshot_no int")
    changed = changes.where("change_type = 'changed'").join(F.broadcast(pairs), "snapshot_no")
    wanted = checkpoint(changed.select(*KEY, "snapshot_no", F.explode(F.array("earlier", "snapshot_no")).alias("_no")))
    value = record_hash()
    values = deliveries.select(*KEY, no.alias("_no"), "delivered_at", value.isNotNull().alias("hashed"), fingerprint(value).alias("fp"), value.alias("hash"))
    found = values.join(broadcast_if_small(wanted, 1_000_000), [*KEY, "_no"]).withColumn("_old", F.col("_no") < F.col("snapshot_no"))
    last = lambda side: F.max(F.when(side, F.struct("delivered_at", "hashed", "fp", "hash")))["hash"]
    return found.groupBy(*KEY, "snapshot_no").agg(last(F.col("_old")).alias("old_hash"), last(~F.col("_old")).alias("new_hash"))
