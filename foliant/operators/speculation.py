"""Ordered folds in parallel, by speculation.

Some decisions depend on all that was decided before: whether a budget has room, who holds a job. Rows are dealt into ranges of their
order, and as many ranges as may run at once do, each from a guess of the state that it starts with. A range tells, for every key of the state that it
touched, the value that it started from and the one that it left. What a key should have started from is what the last range before it that touched
the key left; the ranges up to the first that started from anything else are right, since the first range is right by itself and each
is right once those before it are. The next round takes as many ranges from there on.

All ranges run once from nothing, which tells what they touch. The guess for the first range of a round is the state that the settled ranges left, so it is
right; for the ranges behind it, it is that state too, with what the ranges between added to numbers when they ran last. A round runs a fixed number of ranges and
lets the first settle once it touches nothing new, so the work does not grow with the square of the ranges even where every one changes what the next
one needs (a sequence by nature then); where states settle, a round settles many.

State lives in tables by range and key, so nothing but the numbers of ranges passes the driver, and a range holds its own rows and the keys that
they touched before or that are settled.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources import store

RANGE_ROWS = 200_000
_TOLD = ["__key", "__start", "__end"]


class State:
    """Values by key, null where nothing is known. Remembers what each key that was asked for began with."""

    def __init__(self, starts: dict[str, str]):
        self._starts, self.began, self._now = starts, {}, {}

    def __getitem__(self, key: str):
        if key not in self.began:
            self.began[key] = self._starts.get(key)
            self._now[key] = None if self.began[key] is None else json.loads(self.began[key])
        return self._now[key]

    def __setitem__(self, key: str, value) -> None:
        self[key]
        self._now[key] = value

    def left(self) -> list[tuple[str, str | None, str | None]]:
        return [(k, began, None if self._now[k] is None else json.dumps(self._now[k])) for k, began in self.began.items()]


def fold(rows: DataFrame, order: list[str], step: Callable[[State, dict], str], name: str = "decision", range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with step(state, row) for each, as if all were taken one after another.

    `order` must tell any two rows apart. A value of the state is what JSON can hold.
    """
    spark, columns = rows.sparkSession, rows.columns
    base, done = store.folder(spark, "ranges"), store.folder(spark, "folded")
    ranges = -(-rows.count() // range_rows)
    if not ranges:
        return rows.withColumn(name, F.lit(None).cast("string"))
    # the deal is written once: rounds must see the same ranges
    store.save(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), base, ["__range"])
    dealt = spark.read.schema(f"{_ddl(rows)}, __range int").parquet(base)
    starts = spark.createDataFrame([], "__range int, __key string, __value string")
    out_ddl = f"{_ddl(rows)}, `{name}` string, __key string, __start string, __end string, __range int"

    def run(held: pa.Table, began: pa.Table) -> pa.Table:
        place = held.column("__range")[0].as_py()
        held = held.select(columns).sort_by([(c, "ascending") for c in order])
        state = State(dict(zip(began.column("__key").to_pylist(), began.column("__value").to_pylist())))
        told = [step(state, dict(zip(columns, values))) for values in zip(*(c.to_pylist() for c in held.columns))]
        decided = held.append_column(name, pa.array(told, pa.string()))
        for c in _TOLD:
            decided = decided.append_column(c, pa.nulls(len(told), pa.string()))
        left = state.left()
        keys = {c: pa.nulls(len(left), t) for c, t in zip([*columns, name], [*held.schema.types, pa.string()])} | {c: pa.array([x[i] for x in left], pa.string()) for i, c in enumerate(_TOLD)}
        both = pa.concat_tables([decided, pa.table(keys).cast(decided.schema)])
        return both.append_column("__range", pa.array([place] * len(both), pa.int32()))

    def ran(todo: DataFrame, starts: DataFrame) -> None:
        store.save(todo.groupBy("__range").cogroup(starts.groupBy("__range")).applyInArrow(run, out_ddl), done, ["__range"])

    def kept(d: DataFrame, what: str) -> DataFrame:
        path = store.folder(spark, what)
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    ran(dealt, starts)
    settled, ahead, number = 0, max(2, spark.sparkContext.defaultParallelism), lambda c: F.expr(f"try_cast({c} AS bigint)")
    state = spark.createDataFrame([], "__key string, __end string")  # what the settled ranges left
    while settled < ranges:
        upto = min(ranges, settled + ahead)
        now = F.col("__range").between(settled, upto - 1)
        fresh = spark.read.schema(out_ddl).parquet(done).where("__key is not null").where(now).select("__range", "__key", "__start", "__end")
        both = fresh.unionByName(state.select(F.lit(-1).alias("__range"), "__key", F.lit(None).cast("string").alias("__start"), "__end"))
        before = Window.partitionBy("__key").orderBy("__range")  # a row a range of the round that touched the key
        left = F.first(F.when(F.col("__range") < 0, F.col("__end"))).over(before)
        due = F.lag("__end").over(before)
        added = F.sum(F.when(F.col("__range") >= 0, number("__end") - F.coalesce(number("__start"), F.lit(0)))).over(before.rowsBetween(Window.unboundedPreceding, -1))
        told = both.select("*", left.alias("__left"), due.alias("__due"), added.alias("__added")).where("__range >= 0")
        told = kept(told.withColumn("__guess", F.when(F.col("__added").isNotNull(), (F.coalesce(number("__left"), F.lit(0)) + F.col("__added")).cast("string")).otherwise(F.coalesce("__left", "__due"))), "told")
        wrong = sorted(r[0] for r in told.where(~F.col("__start").eqNullSafe(F.col("__due"))).select("__range").distinct().collect())
        right = wrong[0] if wrong else upto
        if right > settled:
            ends = told.where(F.col("__range") < right).groupBy("__key").agg(F.max_by("__end", "__range").alias("__end"))
            state, settled = kept(state.join(ends, "__key", "left_anti").unionByName(ends), "state"), right
        else:
            starts = kept(told.where(F.col("__range").isin(wrong)).select("__range", "__key", F.col("__guess").alias("__value")), "starts")
            ran(dealt.where(F.col("__range").isin(wrong)), starts)
    return spark.read.schema(out_ddl).parquet(done).where("__key is null").select(*columns, name)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
