"""Tables and JSON records in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; without one, in a folder of this machine if all tasks run on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, by: list[str]) -> None:
    """A partitioned table; the partitions that df holds are replaced, and none other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, appended."""
    df.write.mode("append").json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of the schema; lines that are no such record are skipped."""
    fields = StructType([*StructType.fromDDL(schema), StructField("__corrupt", StringType())])
    read = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").json(path)
    return read.where("__corrupt is null").drop("__corrupt")


def erase(spark: SparkSession, path: str, mine: Column, schema: str) -> tuple[int, int]:
    """Removes records for which `mine` (of the schema's columns) is true from the JSON lines of a folder; (files, lines) that changed.

    Only files that hold such a line are written again, each by itself with its other lines in their order, and then take the
    place of the old one by a rename; a run that dies before that leaves the file as it was. Lines that are no such record stay.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__line"))
    parsed = F.from_json("value", StructType.fromDDL(schema))
    told = read.withColumn("__record", parsed).select("value", "__file", "__line", "__record.*").withColumn("__mine", F.coalesce(mine, F.lit(False)))
    hit = {r[0]: r[1] for r in told.where("__mine").groupBy("__file").agg(F.count("*")).collect()}  # names of files
    if not hit:
        return 0, 0
    fresh = folder(spark, "erased")
    files = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(hit))], "__file string, __number int")
    kept = told.where("not __mine").join(F.broadcast(files), "__file").select("__number", "__line", "value")
    kept.repartition(len(hit), "__number").sortWithinPartitions("__number", "__line").select("__number", "value").write.partitionBy("__number").text(fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    for i, name in enumerate(sorted(hit)):
        old, made = path_of(jvm.java.net.URI(name)), path_of(f"{fresh}/__number={i}")
        fs = old.getFileSystem(conf)
        parts = [x.getPath() for x in fs.listStatus(made)] if fs.exists(made) else []
        if parts:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), conf).rename(parts[0], old, over)
        else:
            fs.delete(old, False)
    return len(hit), sum(hit.values())


def key_code(key: Column) -> Column:
    """A key as a URI component."""
    out = F.url_encode(key)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
