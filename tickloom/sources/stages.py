"""Stage tables kept by content, and fingerprints."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: dict[str, str] = {}

# Names of the stages, so that nothing else under a root is ever listed or removed.
STAGES = (
    "bars", "market", "features", "labels", "labelled", "predictions", "contract", "sequence_inputs", "fold_sequences", "fold_rows", "trees",
    "steps", "model_scores", "model_results", "scored_members", "grid_members", "grid_models", "grid_held", "grid_scores", "grid_results", "run_records",
)


@cache
def code_key() -> str:
    """Key of the definitions, so that a changed operator never reads an older stage table.

    Read as package resources, which also works from a zip.
    """
    digest, found = hashlib.sha1(), 0
    for part in ("functions", "operators", "plans", "sources"):
        for file in sorted(resources.files(f"tickloom.{part}").iterdir(), key=lambda f: f.name):
            if file.name.endswith(".py"):
                digest.update(file.name.encode() + file.read_bytes())
                found += 1
    if not found:
        raise FileNotFoundError("the package's sources cannot be read, so stage tables cannot be keyed")
    return digest.hexdigest()


def shared_root(spark: SparkSession) -> str:
    """Folder for stage tables: the one that ``spark.checkpoint.dir`` names.

    Without it only a local master, whose driver is the one machine there is, gets a folder of
    its own; on a cluster every executor would write to its own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/tickloom"
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("name a shared folder: set spark.checkpoint.dir or pass a root for stage tables")
    if context.applicationId not in _local_root:
        _local_root[context.applicationId] = tempfile.mkdtemp(prefix="tickloom-")
    return _local_root[context.applicationId]


def payload_key(payload: dict) -> str:
    return hashlib.sha1(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()


def files_key(spark: SparkSession, paths: Sequence[str]) -> str:
    """Key of the files under ``paths`` from name, size and change time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "modificationTime", "length")
    row = files.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("x")
    ).first()
    return payload_key({"n": row["n"], "x": row["x"]})


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, index: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """One row that changes when any row of the chosen columns changes; order does not matter."""
    wanted = [c for c in (columns or df.columns) if c in df.columns] or df.columns[:3]
    wanted += [c for c in index if c in df.columns and c not in wanted]
    row = F.xxhash64(*wanted)
    # A second, salted hash: two equal rows cancel out in an xor but not in a sum.
    salted = F.pmod(F.xxhash64(F.lit(17), *wanted), F.lit(2147483647))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(salted).alias("s")
    ).select("n", F.sha1(F.concat_ws("|", "n", "x", "s").cast("binary")).alias("fingerprint"))


def fold_keys(members: DataFrame, encoder: str, params: dict) -> DataFrame:
    """sha1 per (ticker, fold) over the date ranges, row counts and parameters of the fold."""
    train, val = F.col("role") == "train", F.col("role") == "val"
    per_fold = members.groupBy("ticker", "fold").agg(
        F.min(F.when(train, F.col("date"))).alias("train_start"),
        F.max(F.when(train, F.col("date"))).alias("train_end"),
        F.min(F.when(val, F.col("date"))).alias("val_start"),
        F.max(F.when(val, F.col("date"))).alias("val_end"),
        F.count_if(train).alias("n_train"),
        F.count_if(val).alias("n_val"),
    )
    text = F.concat_ws(
        "|", F.lit(encoder), F.lit(json.dumps(params, sort_keys=True)), "ticker",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("train_start", "train_end", "val_start", "val_end")],
        "n_train", "n_val",
    )
    return per_fold.withColumn("fold_key", F.sha1(text.cast("binary")))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Renames a finished table to its place; of two drivers that made the same one, the first stays."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    files = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not exists(spark, path) and not files.rename(to_path(made), to_path(path)) and not exists(spark, path):
        raise OSError(f"cannot move {made} to {path}")


def _entries(spark: SparkSession, path: str) -> list:
    to_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = to_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(files.listStatus(to_path)) if files.exists(to_path) else []


class Stages:
    """Tables written once per content key and read back.

    A written table also cuts the lineage: losing an executor later repeats the
    work after it only, and its readers scan just the columns they need.  Of two writers of one
    key the first to rename its table wins and both read that.  Tables are kept until they are
    removed (``expired``, ``remove``) and everything they hold can be made again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_root(spark)

    def table(
        self, stage: str, payload: dict, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
    ) -> DataFrame:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        path = f"{self.root}/{stage}/{payload_key(payload)}"
        if not exists(self.spark, path):
            made = f"{self.root}/{stage}/making-{uuid.uuid4().hex}"
            build().write.partitionBy(*partition_by).parquet(made)
            publish(self.spark, made, path)
        return self.spark.read.parquet(path)

    def catalogue(self) -> DataFrame:
        """(stage, key, finished, changed, path) of all tables under the root; unfinished ones are those of writers at work
        or of writers that were lost.  One row per table, from the file system's listing."""
        rows = []
        for stage in _entries(self.spark, self.root):
            if not stage.isDirectory() or stage.getPath().getName() not in STAGES:
                continue
            for table in _entries(self.spark, stage.getPath().toString()):
                path = table.getPath().toString()
                finished = not table.getPath().getName().startswith("making-") and exists(self.spark, path)
                rows.append((stage.getPath().getName(), table.getPath().getName(), finished, table.getModificationTime() / 1000.0, path))
        listed = self.spark.createDataFrame(rows, "stage string, key string, finished boolean, changed double, path string")
        return listed.withColumn("changed", F.timestamp_seconds("changed"))

    def expired(self, days: float, keep: Sequence[str] = ()) -> DataFrame:
        """Tables that have not changed for ``days`` days and whose key is not among ``keep``."""
        old = F.col("changed") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(days * 86400.0))
        return self.catalogue().filter(old & ~F.col("key").isin(list(keep)))

    def remove(self, tables: DataFrame) -> int:
        """Deletes tables of the catalogue; how many there were.  A reader at work on one of them fails and builds it anew."""
        root, n = self.root.rstrip("/"), 0
        for row in tables.select("stage", "key").collect():  # one row per table
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{row['stage']}/{row['key']}")
            n += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return n
