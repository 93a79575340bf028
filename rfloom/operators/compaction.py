"""Consolidating far too many small files, partition by partition.

A store is a folder with ``data/commit=ID/part=N`` (Parquet) and ``versions``:
one small table per version, which lists the (commit, part) folders that are
live in it. Files become visible only by a version, never by being written:

* ``append`` writes a folder of its own and takes the next version; if another
  writer took it, it builds on that one and tries the version after it.
* ``compact`` reads one version, rewrites only the partitions that hold too
  many small files (as listed, whatever their rows say) or a key more than
  once, by dynamic overwrite into a commit folder of its own, and publishes
  them in the next version. Commits of others that arrived meanwhile stay live
  beside the result; a partition that another compaction replaced meanwhile is
  a conflict: it is left alone and reported.
* ``read`` reads the files of one version; ``vacuum`` removes the folders that
  the last versions don't use.

A version is taken by renaming a folder, which fails if it exists: as atomic as
the file system's rename.

Cost of a compaction: the payload is shuffled by key with map-side combining,
and once more when the files are sized. What reaches the driver is one line
per partition and live commit.

Defined results: null ``sta_path``/``cell_idx`` are taken from the other names;
a row without any name, with null or empty ``weights`` or a broken ``shape``
holds no whole component and gives no row; repeated rows count once; of several
copies the last written stays (ties: larger file_id); empty input gives an
empty table; further columns of the input are ignored. ``n_files`` counts
distinct files of a compaction; a superseded file that is delivered again
after it counts again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from rfloom.tables import scratch

KEY = ["recording", "channel", "cell_idx", "component"]
#: Bytes of stored payload that a partition is meant for.
PARTITION_BYTES = 1 << 30
_VERSION = "part int, commit string, action string, layout string"


class CompactionConflict(RuntimeError):
    """Another writer committed the version this one was about to commit."""


@dataclass
class Report:
    version: int
    rewritten: list[int] = field(default_factory=list)
    conflicts: list[int] = field(default_factory=list)


def _segments(path: Column) -> Column:
    """(recording, channel, cell) of a path, whatever its folders, separators, case or padding."""
    plain = F.lower(F.regexp_replace(F.trim(path), r"[\\/]+", "/"))
    pattern = r"([^/]+)/([^/]+)/cell_?([0-9]+)(?:/[^/]*)?$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(plain, pattern, i)), F.lit(""))
    return F.struct(part(1).alias("recording"), part(2).alias("channel"), part(3).cast("int").alias("cell"))


def components(files: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """One row per component that a stored file holds whole.

    With ``channels``, recording and channel get the spelling used there.
    """
    named = files.select(
        "file_id", "written_at", "n_bytes", "cell_idx", "first_component", "shape", "weights",
        _segments(F.col("w_path")).alias("w"), _segments(F.col("sta_path")).alias("s"),
    )
    pixels = F.try_element_at("shape", F.lit(2))
    held, listed = F.floor(F.size("weights") / F.nullif(pixels, F.lit(0))).cast("int"), F.try_element_at("shape", F.lit(1))
    whole = F.when(held < listed, held).when(held >= listed, listed)  # null if either is
    rows = (
        named.withColumns({
            "recording": F.coalesce("w.recording", "s.recording"),
            "channel": F.coalesce("w.channel", "s.channel"),
            "cell_idx": F.coalesce("cell_idx", "w.cell", "s.cell"),
            "pixels": pixels,
            "whole": whole,
        })
        .where("recording is not null and cell_idx is not null and first_component is not null and pixels > 0 and whole > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
        .select(
            "recording", "channel", "cell_idx", (F.col("first_component") + F.col("i")).alias("component"), "file_id", "written_at", "n_bytes",
            F.slice("weights", F.col("i") * F.col("pixels") + 1, F.col("pixels")).alias("weights"),
        )
    )
    if channels is None:
        return rows
    spelled = channels.groupBy(F.lower("recording").alias("recording"), F.lower("channel").alias("channel")).agg(F.min(F.struct(F.col("recording").alias("r"), F.col("channel").alias("c"))).alias("as"))
    return rows.join(spelled, ["recording", "channel"], "left").select(
        F.coalesce("as.r", "recording").alias("recording"), F.coalesce("as.c", "channel").alias("channel"), *rows.columns[2:]
    )


def consolidate(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Each key once: the payload of the last version, and by how many distinct files it is held.

    Files are counted on narrow columns, by (key, file) first, so that one key
    held by very many files is spread; the payload is combined map-side.
    """
    held = F.col("n_files") if "n_files" in rows.columns else F.lit(1).cast("bigint")
    counted = rows.groupBy(*keys, "file_id").agg(F.max(held).alias("n_files")).groupBy(*keys).agg(F.sum("n_files").alias("n_files"))
    content = F.max_by(F.struct("file_id", "written_at", *payload), F.struct("written_at", "file_id", *payload))
    return rows.groupBy(*keys).agg(content.alias("content")).join(counted, keys).select(*keys, "n_files", "content.*")


class SmallFileStore:
    """A partitioned Parquet folder with versions. ``buckets`` bounds the number of partitions; an existing store keeps its own."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], bucket_by: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.bucket_by, self.buckets = spark, root.rstrip("/"), keys, bucket_by, buckets
        self.data = f"{self.root}/data"
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._context = self._fs.FileContext.getFileContext(self._path("").toUri(), spark._jsc.hadoopConfiguration())
        if self.version():
            self.buckets = int(self._layout().split(" ", 1)[0])

    # --- versions -------------------------------------------------------------------------------------

    def _path(self, inside: str):
        return self._fs.Path(f"{self.root}/{inside}" if inside else self.root)

    def version(self) -> int:
        """The last version; 0 for a store that has none."""
        folder = self._path("versions")
        if not self._context.util().exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._context.util().listStatus(folder)), default=0)

    def _entries(self, version: int) -> DataFrame:
        return self.spark.read.schema(_VERSION).json(f"{self.root}/versions/{version:08d}")

    def _layout(self) -> str:
        """'buckets schema-as-JSON', as the store was created."""
        return self._entries(self.version()).where("layout is not null").first()["layout"]

    def live(self, version: int) -> dict[int, frozenset[str]]:
        """Partition -> commits whose files it consists of."""
        found: dict[int, set[str]] = defaultdict(set)
        if version:
            for row in self._entries(version).where("part is not null").toLocalIterator():
                found[row["part"]].add(row["commit"])
        return {part: frozenset(commits) for part, commits in found.items()}

    def _take(self, version: int, live: dict[int, frozenset[str]], action: str, layout: str) -> None:
        """Publishes ``live`` as ``version``; CompactionConflict if it exists."""
        rows = [(part, commit, action, None) for part, commits in live.items() for commit in sorted(commits)] + [(None, None, action, layout)]
        pending = f"pending/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.json(f"{self.root}/{pending}")
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._context.mkdir(self._path("versions"), self._fs.permission.FsPermission.getDirDefault(), True)
            self._context.rename(self._path(pending), self._path(f"versions/{version:08d}"), none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or self.version() >= version:
                raise CompactionConflict(f"version {version} is taken") from error
            raise

    # --- writing and reading -----------------------------------------------------------------------------

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, commit: str) -> set[int]:
        """Writes partitions of a commit, replacing what an earlier attempt left in them; returns their numbers."""
        full = rows.withColumn("commit", F.lit(commit))
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit", "part").parquet(self.data)
        folder = self._path(f"data/commit={commit}")
        if not self._context.util().exists(folder):
            return set()
        names = (s.getPath().getName() for s in self._context.util().listStatus(folder))
        return {int(name.removeprefix("part=")) for name in names if name.startswith("part=")}

    def append(self, rows: DataFrame, before_publish=None) -> int:
        """Adds rows as they come; this is where small files arise."""
        commit, last = uuid.uuid4().hex, self.version()
        kept = rows.drop("part")
        parts = self._write(self._bucketed(kept), commit)
        if before_publish:
            before_publish()
        while True:
            layout = self._layout() if last else f"{self.buckets} {kept.schema.json()}"
            live = self.live(last)
            try:
                self._take(last + 1, {**live, **{part: live.get(part, frozenset()) | {commit} for part in parts}}, "append", layout)
                return last + 1
            except CompactionConflict:
                last = self.version()

    def _folders(self, live: dict[int, frozenset[str]]) -> list[str]:
        return [f"{self.data}/commit={commit}/part={part}" for part, commits in sorted(live.items()) for commit in sorted(commits)]

    def read(self, version: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """The rows of one version (the last one), of all partitions or some, with their ``part``."""
        version = self.version() if version is None else version
        schema = StructType.fromJson(json.loads(self._layout().split(" ", 1)[1])).add("commit", StringType()).add("part", IntegerType())
        folders = self._folders({p: c for p, c in self.live(version).items() if parts is None or p in parts})
        if not folders:
            return self.spark.createDataFrame([], schema).drop("commit")
        return self.spark.read.schema(schema).option("basePath", self.data).parquet(*folders).drop("commit")

    def snapshot(self, version: int | None = None, small_bytes: int = 64 << 20) -> DataFrame:
        """Per partition of a version: number of physical files, of small ones, and bytes (contents aren't read)."""
        folders = self._folders(self.live(self.version() if version is None else version))
        if not folders:
            return self.spark.createDataFrame([], "part int, n_files bigint, n_small bigint, bytes bigint")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folders)
        return (
            files.select(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int").alias("part"), "length")
            .groupBy("part")
            .agg(F.count("*").alias("n_files"), F.count_if(F.col("length") < small_bytes).alias("n_small"), F.sum("length").alias("bytes"))
        )

    def compact(self, payload: list[str], max_small_files: int = 1, small_bytes: int = 64 << 20, target_bytes: int = 128 << 20, before_publish=None) -> Report:
        """Rewrites the partitions with more than ``max_small_files`` files below ``small_bytes``, or with a key more than once.

        Every key stands once in a rewritten partition. ``before_publish`` is
        called between writing and publishing (tests inject writers there).
        """
        version = self.version()
        before, stored = self.live(version), self.read(version)
        listed = self.snapshot(version, small_bytes).withColumn("crowded", F.col("n_small") > max_small_files)
        repeated = stored.groupBy("part", *self.keys).count().where("count > 1").select("part").distinct().withColumn("repeated", F.lit(True))
        chosen = listed.join(repeated, "part", "left").where("crowded or repeated")
        victims = {r["part"]: max(1, -(-r["bytes"] // target_bytes)) for r in chosen.select("part", "bytes").collect()}
        if not victims:
            return Report(version)
        pieces = self.spark.createDataFrame(list(victims.items()), "part int, pieces bigint")
        rows = consolidate(self.read(version, set(victims)), [*self.keys, "part"], payload)
        sized = rows.join(F.broadcast(pieces), "part").withColumn("piece", F.pmod(F.xxhash64(*self.keys), F.col("pieces"))).repartition("part", "piece")
        commit = uuid.uuid4().hex
        written_parts = self._write(sized.select(*[c for c in stored.columns if c != "part"], "part"), commit)
        if before_publish:
            before_publish()
        while True:
            last = self.version()
            now = self.live(last)
            # what was read must still be there; what others added stays beside the result
            publish = sorted(part for part in written_parts if before[part] <= now.get(part, frozenset()))
            if not publish:
                return Report(last, [], sorted(victims))
            try:
                self._take(last + 1, {**now, **{part: (now[part] - before[part]) | {commit} for part in publish}}, "compact", self._layout())
                return Report(last + 1, publish, sorted(set(victims) - set(publish)))
            except CompactionConflict:
                continue

    def vacuum(self, keep_versions: int = 2) -> list[str]:
        """Removes the commit folders that older versions used and none of the last ``keep_versions`` does; returns their names.

        Folders that no version knows may belong to a writer at work and stay.
        """
        last = self.version()
        used = lambda versions: {(part, c) for v in versions for part, commits in self.live(v).items() for c in commits}
        first = max(1, last - keep_versions + 1)
        gone = sorted(used(range(1, first)) - used(range(first, last + 1)))
        for part, commit in gone:
            self._context.delete(self._path(f"data/commit={commit}/part={part}"), True)
        return [f"commit={commit}/part={part}" for part, commit in gone]


def compact_components(files: DataFrame, channels: DataFrame, buckets: int | None = None) -> DataFrame:
    """The reshaped_W files as one consolidated table, each component exactly once, with ``n_files`` that hold it.

    Without ``buckets`` their number follows from the stored bytes.
    """
    spark = files.sparkSession
    if buckets is None:
        total = files.agg(F.sum("n_bytes")).first()[0] or 0
        buckets = max(12, math.ceil(total / PARTITION_BYTES))
    store = SmallFileStore(spark, scratch(spark, "nmf"), KEY, ["recording", "channel", "cell_idx"], buckets)
    store.append(components(files, channels).withColumn("n_files", F.lit(1).cast("bigint")))
    store.compact(["n_bytes", "weights"])
    return store.read()
