"""Publishing results of finished jobs once, whatever is delivered twice or dies halfway.

A sink keeps several tables and a ledger of epochs. An epoch (the number of a micro-batch) writes its part of
every table into a folder of its own, and only the ledger entry that comes last, put in place by one rename, makes them
count. A batch that died before that is run again by Spark with the same rows and replaces what it left; a batch that died
after it finds its entry and does nothing. Readers take the epochs of the ledger and no others, so all tables of an
epoch become visible together. What earlier epochs hold is not published again: that is for messages that are delivered twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import cost

_LEDGER = "ledger"


@dataclass
class EpochSink:
    """Tables under `path`. `decide` makes an epoch's tables from its batch and from what earlier epochs hold.

    `schemas` names the tables. `step` is called after each write with what was done; tests let it raise.
    """

    path: str
    schemas: dict[str, str]
    decide: Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]]
    step: Callable[[str, int], None] = field(default=lambda done, epoch: None)

    def _fs(self, spark: SparkSession):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_LEDGER}")
        return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self, spark: SparkSession) -> int:
        """The last epoch that counts, -1 before the first. Epochs come in order, so all before it count too."""
        at, fs = self._fs(spark)
        if not fs.exists(at):
            return -1
        return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=-1)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table as far as its epochs count."""
        schema, last = self.schemas[name], self.last(spark)
        if last < 0:
            return spark.createDataFrame([], schema)
        read = spark.read.schema(f"{schema}, epoch long").option("ignoreMissingFiles", "true").parquet(f"{self.path}/{name}")
        return read.where(F.col("epoch") <= last).drop("epoch")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch <= self.last(spark):
            return
        # a batch is read by each table, so it is computed once
        batch.persist()
        try:
            tables = self.decide(batch, {t: self.table(spark, t) for t in self.schemas})
            for name in self.schemas:
                tables[name].write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")
                self.step(name, epoch)
        finally:
            batch.unpersist()
        self._enter(spark, epoch)
        self.step(_LEDGER, epoch)

    def _enter(self, spark: SparkSession, epoch: int) -> None:
        at, fs = self._fs(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(at)
        draft, entry = path(f"{self.path}/{_LEDGER}/.{epoch}"), path(f"{self.path}/{_LEDGER}/{epoch}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"epoch": epoch, "tables": sorted(self.schemas)}).encode()))
        out.close()
        if not fs.rename(draft, entry):
            raise RuntimeError(f"epoch {epoch} was entered by another writer")


# ---- results of jobs -----------------------------------------------------------------------

TABLES = {
    "results": "job long, message long, usr long, book string, status string",
    "settlements": "job long, status string, cents long",
    "entitlements": "usr long, book string, job long",
}


def publish_jobs(batch: DataFrame, held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A job's first outcome counts; later and repeated ones change nothing.

    batch: job, message, at, usr, book, sample, done, usd. A result settles its budget (finalized at its cents, rounded up; refunded for a
    failed job) and, unless it is a sample, entitles its user to the book, once.
    """
    at = F.struct("at", "message")
    rest = [c for c in batch.columns if c != "job"]
    fresh = batch.where("job is not null").join(held["results"].select("job"), "job", "left_anti")
    first = fresh.groupBy("job").agg(F.min_by(F.struct(*rest), at).alias("r")).select("job", "r.*")
    status = F.when(F.col("done"), "done").otherwise("error")
    titles = first.where("done and not sample").groupBy("usr", "book").agg(F.min_by("job", F.struct("at", "message")).alias("job"))
    return {
        "results": first.select("job", "message", "usr", "book", status.alias("status")),
        "settlements": first.select("job", F.when(F.col("done"), "finalized").otherwise("refunded").alias("status"), F.when(F.col("done"), cost.cents(F.col("usd"))).otherwise(0).cast("long").alias("cents")),
        "entitlements": titles.join(held["entitlements"].select("usr", "book"), ["usr", "book"], "left_anti").select("usr", "book", "job"),
    }


def job_sink(path: str, step: Callable[[str, int], None] | None = None) -> EpochSink:
    return EpochSink(path, TABLES, publish_jobs, step) if step else EpochSink(path, TABLES, publish_jobs)


def run(stream: DataFrame, sink: EpochSink, state: str) -> None:
    """All there is, from where the folder `state` says that the last run ended."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
