"""Running values over a long order without a window over a hot key.

Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in many parts. Each part tells one short row a key: the
sums of its values and the value of its last row. Those rows, as many as parts and keys together, are scanned in order and
give every part what came before it; inside a part the order is its own. What is shuffled twice are the rows' narrow
columns, never one key into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources import store


def dealt(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with `__part`, the number of their range; written once, since ranges are sampled anew each time they are computed."""
    spark, path = rows.sparkSession, store.folder(rows.sparkSession, "dealt")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, key, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spark.read.schema(f"{ddl}, __part int").parquet(path)


def scan(rows: DataFrame, key: str, order: list[str], sums: list[str] = [], last: list[str] = [], parts: int | None = None) -> DataFrame:
    """rows with `before_<c>` for each c in sums (the sum of c over the rows before, 0 at first) and `last_<c>` for each c in `last`
    (its value in the row before, null at first), by key in the order, which must tell rows of a key apart.

    Null keys are a key of their own; null values add nothing.
    """
    base, at = dealt(rows, key, order, parts), F.struct(*order)
    held = [F.coalesce(F.sum(c), F.lit(0)).alias(f"__sum_{c}") for c in sums] + [F.max_by(F.struct(F.col(c)), at).alias(f"__end_{c}") for c in last]
    borders = base.groupBy(key, "__part").agg(*held)
    earlier = Window.partitionBy(key).orderBy("__part")  # a row a part that has the key
    upto = earlier.rowsBetween(Window.unboundedPreceding, -1)
    starts = borders.select(
        F.col(key).alias("__key"),
        F.col("__part").alias("__at"),
        *(F.coalesce(F.sum(f"__sum_{c}").over(upto), F.lit(0)).alias(f"__from_{c}") for c in sums),
        *(F.lag(f"__end_{c}").over(earlier).alias(f"__prior_{c}") for c in last),
    )
    joined = base.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")))
    inside = Window.partitionBy("__part", key).orderBy(*order)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(inside) == 1
    out = {f"before_{c}": F.col(f"__from_{c}") + F.coalesce(F.sum(c).over(above), F.lit(0)) for c in sums}
    out |= {f"last_{c}": F.when(first, F.col(f"__prior_{c}.{c}")).otherwise(F.lag(c).over(inside)) for c in last}
    return joined.select(*rows.columns, *(v.alias(n) for n, v in out.items()))
