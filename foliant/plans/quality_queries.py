"""Named queries over pairs of turns: a user's turn and the assistant's next stand for source
and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import quality
from foliant.plans.text_queries import query

PAIRS_SQL = "pairs AS (SELECT u.conv_id, u.turn, u.text AS s, a.text AS t FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"

#: Rows that trigger each guard rule, since conversations hold none.
PROBES = [
    (-1, 0, "Source text that is long enough to be judged at all, surely.", "The cat was there with that dog and they would have what this one had."),
    (-2, 0, "short", "⟦0⟧ left over"),
    (-3, 0, "short", "Sorry, I can't do that."),
    (-4, 0, "short", "日本語の文"),
    (-5, 0, "Source text that is long enough to be judged at all, surely.", "Egy másik mondat, amelyik már magyarul van és elég hosszú is."),
    (-6, 0, "x" * 200, "x" * 100),
    (-7, 0, "⟦0⟧ a", "a"),
    (-8, 0, "He met Klee and Melissa.", "Kleével, Melissával találkozott."),
]


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return u.join(a, ["conv_id", "turn"])


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).union(spark.createDataFrame(PROBES, "conv_id long, turn long, s string, t string"))


_PROBES_SQL = "probes(conv_id, turn, s, t) AS (VALUES " + ", ".join(f"({a}, {b}, '{s.replace(chr(39), chr(39) * 2)}', '{t.replace(chr(39), chr(39) * 2)}')" for a, b, s, t in PROBES) + ")"
PROBED_SQL = f"{PAIRS_SQL}, {_PROBES_SQL}, every AS (SELECT * FROM pairs UNION ALL SELECT * FROM probes)"


def _hits(code: str, text: str = "t") -> str:
    return f"len(list_distinct(regexp_extract_all(lower({text}), '\\b({'|'.join(fixed.STOPWORDS[code])})\\b')))"


_GUARD = f"""CASE WHEN regexp_matches(t, '[⟦⟧【】]') THEN 'residual' WHEN regexp_matches(trim(t), '(?i)\\b{fixed.REFUSAL.replace("'", "''")}\\b') THEN 'refusal' WHEN regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') THEN 'foreign'
WHEN length(trim(s)) >= 40 AND length(trim(t)) >= 40 AND {_hits("en")} >= 3 AND NOT regexp_matches(t, '{fixed.DISTINCTIVE["hu"]}') AND {_hits("hu")} < 3 THEN 'untranslated' END"""


@query(f"WITH {PROBED_SQL} SELECT conv_id, turn, {_GUARD} AS reason FROM every")
def untranslated_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(spark, sf_dir).select("conv_id", "turn", quality.guard(F.col("s"), F.col("t"), F.col("t")).alias("reason"))


@query(f"WITH {PROBED_SQL}, judged AS (SELECT conv_id, {_GUARD} AS reason FROM every) SELECT conv_id, count(*)::BIGINT AS n_blocks, count(reason)::BIGINT AS n_failed, coalesce(bool_or(reason = 'refusal'), false) AS refused, CASE WHEN coalesce(bool_or(reason = 'refusal'), false) THEN 'error:moderation_refusal' WHEN count(reason) > 0 THEN 'error:transient' ELSE 'done' END AS outcome FROM judged GROUP BY conv_id")
def guard_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = untranslated_guard(spark, sf_dir)
    refused = F.coalesce(F.bool_or(F.col("reason") == "refusal"), F.lit(False))
    jobs = judged.groupBy("conv_id").agg(F.count("*").alias("n_blocks"), F.count("reason").alias("n_failed"), refused.alias("refused"))
    return jobs.withColumn("outcome", quality.outcome(F.lit(None).cast("string"), F.lit(False), F.col("refused").cast("int"), F.col("n_failed")))


def _flags_sql(mode: str) -> str:
    least, most = quality.band(mode)
    ratio = "length(trim(t)) / length(trim(s))::DOUBLE"
    return f"""concat_ws(',', CASE WHEN length(s) - length(replace(s, '⟦', '')) <> length(t) - length(replace(t, '⟦', '')) THEN 'tokens' END, CASE WHEN length(trim(s)) >= 200 AND ({ratio} < {least}::DOUBLE OR {ratio} > {most}::DOUBLE) THEN 'omission' END,
    CASE WHEN (contains(s, 'Klee') AND NOT (contains(lower(t), 'kleex') OR contains(lower(t), 'kleéx'))) THEN 'glossary' END)"""


def _flags(mode: str) -> Column:
    least, most = map(F.lit, quality.band(mode))
    missing = F.col("s").contains("Klee") & ~T.mentions(F.col("t"), F.lit("Kleex"))
    return quality.flags(F.col("s"), F.col("t"), least, most, missing.cast("int"))


@query(f"WITH {PROBED_SQL} SELECT conv_id, turn, {_flags_sql('balanced')} AS balanced, {_flags_sql('fidelity')} AS fidelity FROM every")
def validate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(spark, sf_dir).select("conv_id", "turn", *(F.array_join(_flags(m), ",").alias(m) for m in ("balanced", "fidelity")))


@query(f"""WITH {PROBED_SQL}, flagged AS (SELECT conv_id, turn, {_flags_sql('balanced')} AS f FROM every), judged AS (SELECT f.*, l.quality, l.toxic, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 5 WHEN conv_id % 2 = 0 THEN 3 ELSE 2 END AS score FROM flagged f LEFT JOIN labels l ON l.doc_id = f.conv_id)
SELECT conv_id, turn, it.i AS iteration, CASE WHEN it.i >= 2 THEN 'accept' WHEN contains(f, 'omission') OR coalesce(toxic, 0) = 1 OR coalesce(score, 9) <= 2 THEN 'refine' WHEN coalesce(score, 9) = 3 OR contains(f, 'glossary') OR contains(f, 'tokens') THEN 'refine' ELSE 'accept' END AS action, it.i < 2 AND (contains(f, 'omission') OR coalesce(toxic, 0) = 1 OR coalesce(score, 9) <= 2) AS deep FROM judged, (VALUES (0), (1), (2)) it(i)""")
def route_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for the judge's verdict: toxic for a loss of accuracy, quality for the score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "conv_id")
    p = probed(spark, sf_dir).withColumn("f", _flags("balanced")).join(labels, "conv_id", "left")
    score = F.when(F.col("quality") == 1, 5).when(F.col("quality").isNotNull() & (F.col("conv_id") % 2 == 0), 3).when(F.col("quality").isNotNull(), 2)
    p = p.withColumn("iteration", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    routed = quality.route(F.col("f"), score, F.lit(False), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("iteration"), "balanced")
    return p.withColumn("r", routed).select("conv_id", "turn", "iteration", "r.action", "r.deep")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM conversations)
SELECT conv_id, count(*)::BIGINT AS n_blocks, sha256(string_agg('【' || i || '】' || chr(10) || body, chr(10) || chr(10) ORDER BY i)) AS payload_hash, sha256(string_agg(body, chr(10) ORDER BY i)) AS bodies_hash FROM t GROUP BY conv_id""")
def marker_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a marked payload, and the bodies split out of it again."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct("turn", T.collapse(F.col("text")).alias("body")).alias("x"))
    bodies = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["body"])
    p = c.groupBy("conv_id").agg(bodies.alias("b")).select("conv_id", T.block_payload(F.col("b")).alias("payload"))
    back = F.transform(T.split_blocks(F.col("payload")), lambda x: T.trim(x["body"]))
    return p.select("conv_id", F.size(back).cast("long").alias("n_blocks"), F.sha2("payload", 256).alias("payload_hash"), F.sha2(F.array_join(back, "\n"), 256).alias("bodies_hash"))


@query(f"""WITH {PAIRS_SQL}, a AS (SELECT conv_id, turn, unnest(string_split(s, chr(10))) AS o, generate_subscripts(string_split(s, chr(10)), 1) - 1 AS idx FROM pairs), b AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS idx FROM pairs)
SELECT conv_id, turn, idx::BIGINT AS idx, o AS original, coalesce(x, '') AS translated FROM a LEFT JOIN b USING (conv_id, turn, idx) WHERE trim(o) <> ''""")
def bilingual_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks side by side by position, in the row they came in; empty originals are dropped."""
    p = turn_pairs(spark, sf_dir)
    t = F.split("t", "\n")
    rows = p.select("conv_id", "turn", t.alias("ts"), F.posexplode(F.split("s", "\n")).alias("idx", "original"))
    return rows.where(F.trim("original") != "").select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), "original", F.coalesce(F.get("ts", F.col("idx")), F.lit("")).alias("translated"))
