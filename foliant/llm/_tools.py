"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: What separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes(range(65)) + LOWER.encode() + bytes(range(91, 256))


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lowered; bytes.split() then cuts at the same six spaces."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; without one named, a folder of this machine if all tasks run on it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write once, read many times: cuts lineage in a way that survives lost executors.

    The table lies in the shared folder and goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _held_bytes(value: Column, kind: DataType) -> Column:
    """About the bytes that a value holds besides its own eight, whatever it is made of."""
    none = F.lit(0).cast("long")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value).cast("long"), none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.aggregate(value, none, lambda n, x: n + 16 + _held_bytes(x, kind.elementType)), none)
    if isinstance(kind, MapType):
        return _held_bytes(F.map_keys(value), ArrayType(kind.keyType)) + _held_bytes(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((8 + _held_bytes(value[f.name], f.dataType) for f in kind), none)
    return none


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its fixed columns, and what strings, arrays, maps and structs hold at any depth."""
    return sum((_held_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16 + 8 * len(df.columns)).cast("long"))


def broadcast_if_small(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only after measuring; larger tables keep their shuffle join.

    df must be staged or cheap, since its bytes are summed here.
    """
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes else df
