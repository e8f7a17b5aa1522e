"""Named queries over the translation stage: the ladder of fallbacks, prompts, and the view of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.operators import ladder, prompts
from foliant.operators.translation import Provider
from foliant.plans.record_queries import CHAPTERS_SQL, chapters
from foliant.plans.text_queries import query
from foliant.sources import epub, store


def _kept(d: DataFrame) -> DataFrame:
    path = store.folder(d.sparkSession, "stage")
    d.write.option("compression", "zstd").parquet(path)  # texts, read a few times: small counts for more than fast
    return d.sparkSession.read.schema(d.schema).parquet(path)


# ---- the ladder ----------------------------------------------------------------------------


class Forgetful(Provider):
    """Writes every e as E; loses the first text mark of payloads of blocks, and the second of single blocks, by their lengths."""

    def translate(self, df: DataFrame, source: str, out: str) -> DataFrame:
        s = F.col(source)
        several, marked = s.contains(fixed.BLOCK_OPEN), s.contains(fixed.TOKEN_OPEN)
        lost = F.when(several & (F.length(s) % 3 == 0), F.replace(s, F.lit("⟦0⟧"), F.lit(""))).when(~several & marked & (F.length(s) % 2 == 0), F.replace(s, F.lit("⟦1⟧"), F.lit(""))).otherwise(s)
        return df.withColumn(out, F.replace(lost, F.lit("e"), F.lit("E")))


_ESCAPED = "replace(replace(replace(replace({}, 'e', 'E'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(rf"""WITH bare AS (SELECT page_id // 3 AS chunk, row_number() OVER (PARTITION BY page_id // 3 ORDER BY page_id) - 1 AS block_idx, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS h FROM pages),
 nodes AS (SELECT chunk, block_idx, list_filter(regexp_split_to_array(h, '<[^>]*>'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS raw FROM bare),
 texts AS (SELECT *, array_to_string(list_transform(raw, lambda x, i: '⟦' || (i - 1) || '⟧' || regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) AS t FROM nodes),
 whole AS (SELECT chunk, length(string_agg('【' || block_idx || '】' || chr(10) || t, chr(10) || chr(10) ORDER BY block_idx) FILTER (t <> '')) % 3 = 0 AS lost FROM texts GROUP BY chunk)
SELECT chunk, block_idx, CASE WHEN t = '' THEN 'none' WHEN NOT lost THEN 'chunk' WHEN length(t) % 2 = 0 AND len(raw) > 1 THEN 'segment' ELSE 'block' END AS rung, len(raw)::BIGINT AS n_texts,
 sha256(array_to_string(list_transform(raw, lambda x: regexp_extract(x, '^\s*') || {_ESCAPED.format(r"regexp_replace(x, '^\s+|\s+$', '', 'g')")} || regexp_extract(x, '\s*$')), chr(10))) AS texts_hash FROM texts JOIN whole USING (chunk)""")
def fallback_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages are the blocks of a chunk; a model that loses marks sends them down the rungs, and no text is lost."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.floor(F.col("page_id") / 3).alias("chunk"), F.struct("page_id", "html").alias("b"))
    chunks = p.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["html"]).alias("blocks"))
    told = ladder.translate(chunks, ["chunk"], "blocks", Forgetful(), _kept)
    return told.select("chunk", "block_idx", "rung", F.size("texts").cast("long").alias("n_texts"), F.sha2(F.array_join("texts", "\n"), 256).alias("texts_hash"))


# ---- prompts -------------------------------------------------------------------------------

_NL = "chr(10)"


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(role, '') = 'assistant' AS fluency, regexp_extract(coalesce(text, ''), '[A-Z][a-z]+', 0) AS term, length(coalesce(text, '')) AS n FROM conversations),
 p AS (SELECT *, CASE WHEN term <> '' AND n % 5 = 0 THEN '{prompts.GLOSSARY}"' || term || '", "x".' END AS lacking FROM c),
 l AS (SELECT *, list_filter([CASE WHEN n % 3 = 0 THEN '{prompts.OMISSION}' END, CASE WHEN turn % 2 = 1 THEN '{prompts.ACCURACY}' END, CASE WHEN fluency THEN '{prompts.FLUENCY}' END, lacking, CASE WHEN n % 4 = 0 THEN '{prompts.TOKENS}' END], lambda x: x IS NOT NULL) AS items,
  list_filter([CASE WHEN turn % 3 = 0 AND n > 0 THEN '{prompts.CONTEXT_HEAD}' || {_NL} || '\"\"\"' || right(text, 20) || '\"\"\"' END, CASE WHEN turn % 2 = 0 AND n > 0 THEN '{prompts.SOURCE_HEAD}' || {_NL} || '\"\"\"' || left(text, 20) || '\"\"\"' END], lambda x: x IS NOT NULL) AS parts FROM p)
SELECT conv_id, turn, CASE WHEN term = '' THEN '' ELSE '{prompts.TERMS_HEAD}' || {_NL} || '- "' || term || '"' || CASE WHEN n % 2 = 0 THEN ' -> "' || upper(term) || '"' ELSE ' {prompts.TERM_OPEN}' END END AS terms,
 CASE WHEN len(items) = 0 THEN '' ELSE '{prompts.PROBLEMS_HEAD}' || {_NL} || array_to_string(items, {_NL}) || {_NL} || {_NL} END AS problems,
 CASE WHEN len(parts) = 0 THEN text ELSE array_to_string(list_append(parts, '{prompts.TEXT_HEAD}' || {_NL} || text), {_NL} || {_NL}) END AS said FROM l""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as texts to translate, with a term, problems and contexts by their lengths and places."""
    text = F.coalesce("text", F.lit(""))
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("fluency"), F.regexp_extract(text, "[A-Z][a-z]+", 0).alias("term"), F.length(text).alias("n"))
    none = F.array().cast("array<struct<term: string, rendering: string>>")
    glossary = F.when(F.col("term") != "", F.array(F.struct("term", F.when(F.col("n") % 2 == 0, F.upper("term")).otherwise("").alias("rendering")))).otherwise(none)
    flags = F.array_compact(F.array(F.when(F.col("n") % 3 == 0, "omission"), F.when(F.col("n") % 4 == 0, "tokens")))
    missing = F.when((F.col("term") != "") & (F.col("n") % 5 == 0), F.array("term", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    problems = prompts.problems(flags, F.lit(None).cast("boolean"), F.col("turn") % 2 == 1, F.col("fluency"), missing)
    said = prompts.with_context(F.col("text"), F.when(F.col("turn") % 3 == 0, F.right("text", F.lit(20))), F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(20))))
    return c.select("conv_id", "turn", prompts.terms(glossary).alias("terms"), problems.alias("problems"), said.alias("said"))


# ---- results beside their originals --------------------------------------------------------


@query(f"""WITH {CHAPTERS_SQL} SELECT 'book-' || doc_id || '.epub' AS path, 'text/c' || pos || '.xhtml' AS href, '{fixed.CHAPTER_TITLE} ' || (pos + 1) AS title, sha256(CASE WHEN pos % 3 = 2 THEN '' ELSE body END) AS original_hash, sha256(upper(replace(body, 'ß', 'SS'))) AS translated_hash FROM chapters""")
def result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated chapters beside the originals of the same link; every third chapter has none."""
    c = chapters(spark, sf_dir).select("path", F.col("pos").alias("spine_pos"), F.substring("href", 3, 1000).alias("href"), "content")
    upper = F.concat(F.lit("<html><body>"), F.upper(F.substring("content", 13, 1 << 30)))
    done = c.withColumn("content", F.replace(upper, F.lit("</BODY></HTML>"), F.lit("</body></html>")))
    told = epub.result_view(done, c.where("spine_pos % 3 <> 2"))
    return told.select("path", "href", "title", F.sha2("original", 256).alias("original_hash"), F.sha2("translated", 256).alias("translated_hash"))
