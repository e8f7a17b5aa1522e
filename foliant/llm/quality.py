"""Quality rules with host verdicts, in DataFrame operations only.

Every document is measured by itself. Rule failures are then counted by host (two-phase
aggregation, so a host with a third of all rows costs a counter per task), each host's
failure rate is shrunk towards the corpus by a beta prior fitted to the hosts, and hosts whose
shrunk rate is beyond the limit lose their documents.

Defined cases: a null or empty text has no words and fails; a null host gets no verdict, so
its documents are judged by their own rules; repeated rows are judged alike and each counts;
an empty table gives an empty table; columns of other names pass through `keep` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import _tools as tools


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    #: percent of words in 3-word windows that occur again
    max_repeat_percent: int = 50
    #: a host goes when its shrunk failure rate is above this
    max_host_rate: float = 0.8


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, from sorted windows.

    Equal windows are neighbours after the sort, so the cost is n log n without a shuffle.
    """
    n = F.size(w) - 2
    windows = F.sort_array(F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n), F.sequence(F.lit(0), n - 1)))

    def same(a: Column, b: Column) -> Column:
        return (a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"])

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"), (p + 3).alias("end")), lambda s: s["n"])

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))

    # transform over one element binds the sorted array, which is then computed once
    at = F.transform(F.array(windows), lambda s: F.array_sort(F.transform(repeated(s), lambda x: x["3"])))
    return F.when(n < 2, F.lit(0)).otherwise(covered(at[0]))


def measure(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add the five measures of the text column."""
    body, w = F.coalesce(F.col(text), F.lit("")), f"{prefix}__words"
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(tools.WORD))
    df = df.withColumns({w: tools.words(F.col(text)), f"{prefix}__lines": lines})
    return df.withColumns(
        {
            f"{prefix}n_words": F.size(w).cast("long"),
            f"{prefix}word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
            f"{prefix}n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            f"{prefix}n_dup_lines": (F.size(f"{prefix}__lines") - F.size(F.array_distinct(f"{prefix}__lines"))).cast("long"),
            f"{prefix}n_repeat_words": _repeat_words(F.col(w)).cast("long"),
        }
    ).drop(w, f"{prefix}__lines")


def host_verdicts(measured: DataFrame, host: str, failed: str, rules: Rules) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, rejected.

    The prior's mean and strength come from the hosts' raw rates by moments, which are three
    sums whatever the number of hosts.
    """
    hosts = tools.stage(measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    mean, var, inverse = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.var_pop(rate), F.avg(1 / F.col("n_docs"))).first()
    mean = 0.0 if mean is None else mean
    # between-host variance is what the binomial noise of the hosts' sizes leaves over
    spread = max((var or 0.0) - mean * (1 - mean) * (inverse or 0.0), 1e-6)
    strength = max(mean * (1 - mean) / spread - 1, 1e-3)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", F.col("shrunk_rate") > rules.max_host_rate)


def _base_failed(prefix: str, rules: Rules) -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < rules.min_words) | (100 * F.col(f"{prefix}n_repeat_words") > rules.max_repeat_percent * n)


def _judge(measured: DataFrame, host: str, prefix: str, rules: Rules) -> DataFrame:
    """Adds {prefix}kept; measured must be staged, since it is read twice."""
    verdicts = host_verdicts(measured, host, f"{prefix}base_failed", rules)
    bad = verdicts.where("host_rejected").select(F.col("host").alias(f"{prefix}__host"))
    bad = tools.broadcast_if_small(bad).withColumn(f"{prefix}__bad", F.lit(True))
    joined = measured.join(bad, F.col(host) == F.col(f"{prefix}__host"), "left")
    kept = ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}__bad").isNull()
    return joined.withColumn(f"{prefix}kept", kept).drop(f"{prefix}__host", f"{prefix}__bad")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict of every document: doc_id, host, the measures, base_failed, kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("__text"))
    measured = measure(slim, "__text").drop("__text").withColumn("base_failed", _base_failed("", rules))
    return _judge(tools.stage(measured), "host", "", rules).select("doc_id", "host", *MEASURES, "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with their own columns and no others."""
    p = "__quality_"
    measured = measure(docs, text, p).withColumn(f"{p}base_failed", _base_failed(p, rules))
    measured = measured.drop(*(f"{p}{m}" for m in MEASURES))
    return _judge(tools.stage(measured), host, p, rules).where(f"{p}kept").select(*docs.columns)
