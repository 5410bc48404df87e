"""File changes as a stream of micro-batches: extracted, joined within the batch, and merged into a keyed table of buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import CodeGraph
from ..session import ensure_checkpoint_dir

TRIGGER = "300 milliseconds"  # changes of one path within it fall together
BUCKETS = 64  # of the keyed table; a batch rewrites those that it touches
STATE = ["fileId", "scannedAt", "snapshotVersion", "deleted"]


class BatchGraph(CodeGraph):
    """The graph of the files of one batch alone: nothing else is joined."""

    def __init__(self, batch: DataFrame):
        super().__init__(batch.sparkSession, "")
        self.batch = batch

    def raw(self, name: str) -> DataFrame:
        if name != "file_info":
            raise ValueError(f"a batch has no {name}")
        return self.batch

    def batch_edges(self, snapshot: str) -> DataFrame:
        """Edges from the batch's files to what their texts hold, under the batch's snapshot."""
        parts = [x.select("id", "repoRoot", "file") for x in (self.classes, self.errors, self.type_definitions, self.tests)]
        held = parts[0]
        for p in parts[1:]:
            held = held.unionByName(p)
        return self._in_file(held, "CONTAINS").unionByName(self._in_file(parts[0], "DECLARES")).withColumn("snapshotVersion", F.lit(snapshot))


def newest(batch: DataFrame) -> DataFrame:
    """The last delivery of each file in a batch; a delivery that says deleted is a tombstone."""
    rest = STATE[1:]
    return batch.groupBy("fileId").agg(F.max(F.struct(*rest)).alias("r")).select("fileId", *[f"r.{c}" for c in rest])


def _flagged(batch: DataFrame) -> DataFrame:
    return batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))


def _manifest(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """Bucket to the batch that wrote it last; BUCKETS rows at most."""
    return {} if number < 0 else {r["bucket"]: r["version"] for r in spark.read.parquet(f"{folder}/manifest/v{number}").collect()}


def _read(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame:
    out = spark.createDataFrame([], "fileId bigint, scannedAt timestamp, snapshotVersion string, deleted boolean")
    by_version: dict[int, list[int]] = {}
    for bucket, v in versions.items():
        by_version.setdefault(v, []).append(bucket)
    for v, some in sorted(by_version.items()):
        out = out.unionByName(spark.read.parquet(f"{folder}/v{v}").where(F.col("bucket").isin(some)).select(*STATE))
    return out


def merge_batch(folder: str, edges: bool = True):
    """A foreachBatch function that merges a batch into the table in ``folder`` and adds its edges.

    A batch writes the buckets that it touches under its number, and a manifest of where each bucket
    is; a batch that runs again after a failure writes the same again, from the same predecessor.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = _flagged(batch).persist()
        rows = newest(batch).withColumn("bucket", F.pmod(F.xxhash64("fileId"), F.lit(BUCKETS)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        versions = _manifest(spark, folder, number - 1)
        old = _read(spark, folder, {b: v for b, v in versions.items() if b in touched})
        merged = newest(old.unionByName(rows.select(*STATE))).withColumn("bucket", F.pmod(F.xxhash64("fileId"), F.lit(BUCKETS)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{number}")
        if edges:
            BatchGraph(batch.where("NOT deleted")).batch_edges(f"batch-{number}").write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")
        versions |= {b: number for b in touched}
        spark.createDataFrame(sorted(versions.items()), "bucket int, version int").write.mode("overwrite").parquet(f"{folder}/manifest/v{number}")
        batch.unpersist()

    return run


def current(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """fileId, scannedAt, snapshotVersion of the files that are there after a batch."""
    return _read(spark, folder, _manifest(spark, folder, number)).where("NOT deleted").select(*STATE[:3])


def _start(stream: DataFrame, folder: str, once: bool, edges: bool):
    writer = stream.writeStream.foreachBatch(merge_batch(folder, edges)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def watch(spark: SparkSession, source: str, folder: str, once: bool = False, edges: bool = True):
    """Starts the stream over Parquet files of file rows that arrive in ``source``."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream needs a folder
        stream = reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    else:
        stream = reader.parquet(source)
    extra = ["deleted"] if "deleted" in schema.names else []
    texts = ["repoRoot", "absPath", "content"] if edges else []  # no content is read where no edges are wanted
    return _start(stream.select("fileId", *texts, "scannedAt", "snapshotVersion", *extra), folder, once, edges)


def watch_repository(spark: SparkSession, root: str, folder: str, names: str = "*.{js,jsx,ts,tsx,py,java,cs}", once: bool = False, edges: bool = True):
    """Starts the stream over source files that are added below a repository's root, or written anew there under a new name; a changed file has a later time."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", names).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1024).load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    stream = raw.select(F.xxhash64(path).alias("fileId"), F.lit(root.rstrip("/")).alias("repoRoot"), path.alias("absPath"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("scannedAt"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("snapshotVersion"))
    return _start(stream, folder, once, edges)


def _replayed(spark: SparkSession, sf_dir: str, edges: bool) -> tuple[str, int]:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    q = watch(spark, f"{sf_dir}/file_info.parquet", folder, once=True, edges=edges)
    q.awaitTermination()
    # the offsets log also counts a last trigger without data
    return folder, max([p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0], default=0)


def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_info replayed as a stream: the newest delivery of each file after all batches."""
    folder, last = _replayed(spark, sf_dir, False)
    return current(spark, folder, last).withColumn("scannedAt", F.unix_micros("scannedAt"))


def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the batches of that stream add: from files to the classes, errors, types and tests in their texts."""
    folder, _ = _replayed(spark, sf_dir, True)
    return spark.read.parquet(f"{folder}/edges").select("fromId", "type", "toId").distinct()


STREAM_SQL = "SELECT fileId, epoch_us(max({'a': scannedAt, 'b': snapshotVersion}).a) AS scannedAt, max({'a': scannedAt, 'b': snapshotVersion}).b AS snapshotVersion FROM file_info GROUP BY 1"
EDGES_SQL = """SELECT DISTINCT f.id AS fromId, 'CONTAINS' AS type, n.id AS toId FROM fl f JOIN ents n ON n.repoRoot = f.repoRoot AND n.file = f.file WHERE n.type IN ('Class', 'ErrorMessage', 'TypeDefinition', 'Test')
UNION ALL SELECT DISTINCT f.id, 'DECLARES', n.id FROM fl f JOIN ents n ON n.repoRoot = f.repoRoot AND n.file = f.file WHERE n.type = 'Class'"""
