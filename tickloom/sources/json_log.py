"""The run log as one JSON document ``{metadata, runs: [...]}``, read by many tasks.

A JSON string holds no raw line break, so every line of a document begins outside of strings and Spark may cut
the file at any of them.  The only state that goes from line to line is how many brackets are open: lines are
numbered by file block, each block's sum of brackets is carried to the blocks after it, and a record ends where a
line leaves the brackets as they were at the start of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.runlog import read_log

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLACE = ("file", "block")


def write_runs(records: DataFrame, path: str, metadata: DataFrame | None = None, order: str = "run_number") -> None:
    """One document, one run per line; a document is one file and so one task's work to write."""
    lines = records.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(order)).alias("k"), F.to_json(F.struct(*records.columns)).alias("text"))
    comma = F.when(F.lead("k").over(Window.orderBy("k")).isNotNull(), ",").otherwise("")
    runs = lines.select("part", "k", F.concat("text", comma).alias("text"))
    spark = records.sparkSession
    about = metadata.select(F.to_json(F.struct(*metadata.columns)).alias("m")) if metadata is not None else spark.range(1).select(F.lit("{}").alias("m"))
    head = about.limit(1).select(F.lit(0).alias("part"), F.lit(0).alias("k"), F.concat(F.lit('{"metadata": '), "m", F.lit(', "runs": [')).alias("text"))
    tail = spark.range(1).select(F.lit(2).alias("part"), F.lit(0).alias("k"), F.lit("]}").alias("text"))
    head.unionByName(runs).unionByName(tail).coalesce(1).sortWithinPartitions("part", "k").select("text").write.text(path)


def _carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the file up to the line, from sums per block."""
    rows = rows.withColumn("_v", value)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*_PLACE).agg(F.sum("_v").alias("_sum"))
    carry = sums.select(*_PLACE, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    upto = Window.partitionBy(*_PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carry, list(_PLACE)).withColumn(name, F.col("_carry") + F.sum("_v").over(upto)).drop("_v", "_carry")


def read_runs(spark: SparkSession, path: str, schema, field: str = "runs") -> DataFrame:
    """The runs of one or more documents, one row per run, in no order.

    The list has to begin at the end of a line, as writers that break lines leave it; a document without such a
    line is read by one task.  Runs that end on one line go together, so a task holds about one run at a time.
    An empty list gives no row.
    """
    kind = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).simpleString()
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", _STRING, "")
    opened = lambda marks: F.length(bare) - F.length(F.translate(bare, marks, ""))
    deep = _carried(lines, opened("{[") - opened("}]"), "depth")
    starts = deep.filter((F.col("depth") == 2) & F.col("value").rlike(rf'"{field}"\s*:\s*\[\s*$')).groupBy("file").agg(
        F.min(F.struct("block", "at")).alias("start"))
    if not starts.head(1):
        return read_log(spark, path, f"{field} array<{kind}>", field)
    inside = deep.join(starts, "file").filter(F.struct("block", "at") > F.col("start"))
    ends = inside.filter("depth < 2").groupBy("file").agg(F.min(F.struct("block", "at")).alias("stop"))
    inside = inside.join(ends, "file").filter(F.struct("block", "at") < F.col("stop")).drop("start", "stop")
    closed = F.col("depth") == 2
    # Lines up to the one that closes a run share its number.
    numbered = _carried(inside, closed.cast("long"), "run").withColumn("run", F.col("run") - closed.cast("long"))
    texts = numbered.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    joined = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["value"]), "\n"), r",\s*$", "")
    items = F.from_json(F.concat(F.lit("["), joined, F.lit("]")), f"array<{kind}>", {"mode": "FAILFAST"})
    return texts.select(F.explode(items).alias("r")).select("r.*")
