"""Named queries over single functions: names, signatures, page texts, scopes, and the whole translation stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import cost, translation
from foliant.plans.record_queries import JOBS_SQL, jobs
from foliant.plans.stage_queries import _kept
from foliant.plans.text_queries import LINES, query
from foliant.sources import html


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- names and signatures ------------------------------------------------------------------

_KINDS = {"uuid": (fixed.UUID, True), "locale": (fixed.LOCALE, True), "language": (fixed.LANGUAGE, True), "hash": (fixed.SOURCE_HASH, True), "user_id": (fixed.USER_ID, False), "job_id": (fixed.JOB_ID, False)}


@query(rf"""WITH n AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN regexp_replace(md5(event_id::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\1-\2-\3-\4-') WHEN 1 THEN 'hu-HU' WHEN 2 THEN 'EN' || CASE WHEN user_id % 2 = 0 THEN '-Latn-' || user_id ELSE '' END
  WHEN 3 THEN upper(sha256(event_id::VARCHAR)) WHEN 4 THEN event_type || '@x:' || user_id WHEN 5 THEN event_type || ' ' || user_id WHEN 6 THEN event_type || '_' || repeat('y', user_id::INT) ELSE 'ab-' || event_id || chr(10) END AS name FROM events)
SELECT event_id, {", ".join(f"regexp_full_match(name, '{'(?i)' if either else ''}{p}') AS {k}" for k, (p, either) in _KINDS.items())} FROM n""")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the names that a service takes a text could be."""
    i, u, e = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type")
    name = (
        F.when(i % 8 == 0, F.regexp_replace(F.md5(i.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")).when(i % 8 == 1, "hu-HU")
        .when(i % 8 == 2, F.concat(F.lit("EN"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("-Latn-"), u)).otherwise(""))).when(i % 8 == 3, F.upper(F.sha2(i.cast("string"), 256)))
        .when(i % 8 == 4, F.concat(e, F.lit("@x:"), u)).when(i % 8 == 5, F.concat(e, F.lit(" "), u)).when(i % 8 == 6, F.concat(e, F.lit("_"), F.repeat(F.lit("y"), F.col("user_id").cast("int"))))
        .otherwise(F.concat(F.lit("ab-"), i.cast("string"), F.lit("\n")))
    )
    n = _read(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return n.select("event_id", *(T.is_named(F.col("name"), p, either).alias(k) for k, (p, either) in _KINDS.items()))


_KEY = b"a key of the tests"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""SELECT doc_id, replace(replace(rtrim(to_base64(unhex(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(text)))))), '='), '+', '-'), '/', '_') AS signature FROM documents""")
def signed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts signed with a key: HMAC-SHA256 in base64url."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.hmac_sha256(_KEY)(F.col("text")).alias("signature"))


@query(f"""WITH {JOBS_SQL}, e AS (SELECT DISTINCT usr, source_hash, target FROM j WHERE sample = 0 AND status = 'done' AND usr <> '')
SELECT job FROM j WHERE status = 'running' AND EXISTS (SELECT 1 FROM e WHERE e.usr = j.usr AND e.source_hash = j.source_hash AND e.target = j.target)""")
def entitled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose user already has the book in the language."""
    every = jobs(spark, sf_dir)
    has = every.where("sample = 0 AND status = 'done' AND user <> ''").select("user", "source_hash", "target")
    return every.where("status = 'running'").join(has, ["user", "source_hash", "target"], "left_semi").select("job")


@query("""SELECT u.conv_id, u.turn, a.text IS NOT NULL AS answered, length(coalesce(a.text, ''))::BIGINT AS answer_chars FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its target, empty where there is none."""
    c = _read(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    joined = c.where("role = 'user'").select("conv_id", "turn").join(answers, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.col("answer").isNotNull().alias("answered"), F.length(F.coalesce("answer", F.lit(""))).cast("long").alias("answer_chars"))


# ---- pages ---------------------------------------------------------------------------------

_INLINE = "|".join(fixed.INLINE_TAGS)
_BARE = rf"regexp_replace(regexp_replace({{}}, '(?i)</?(?:{_INLINE})(?:>|[^A-Za-z0-9>][^>]*>)', '', 'g'), '<[^>]+>', ' ', 'g')"
_DECODED = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_HEAD = r"regexp_extract(html, '(?is)^\s*((?:<\?xml.*?\?>\s*)?(?:<!doctype.*?>\s*)?)', 1)"


@query(rf"""WITH p AS (SELECT page_id, html, url || chr(7) || chr(10) || '  ' || html AS t FROM pages)
SELECT page_id, sha256({_COLLAPSED.format(_DECODED.format(_BARE.format('html')))}) AS plain_hash, nullif(left({_COLLAPSED.format("regexp_replace(t, '[' || chr(1) || '-' || chr(31) || chr(127) || ']', ' ', 'g')")}, 500), '') AS title,
 sha256(CASE WHEN page_id % 2 = 0 THEN html ELSE {_HEAD} || '<body>new</body>' END) AS back_hash FROM p""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of a page, a title that is cleaned and cut, and a new body behind the page's own prolog (or a body that has one)."""
    p = _read(spark, sf_dir, "pages")
    title = T.clean_title(F.concat("url", F.lit("\x07\n  "), "html"))
    body = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("<body>new</body>")
    return p.select("page_id", F.sha2(T.plain_text(F.col("html")), 256).alias("plain_hash"), title.alias("title"), F.sha2(html.reserialise(F.col("html"), body), 256).alias("back_hash"))


# ---- the translation stage -----------------------------------------------------------------


@query(f"""WITH {LINES}, w AS (SELECT doc_id, count(*) AS n, array_to_string(list('【' || idx || '】' || chr(10) || trim(line) ORDER BY idx) FILTER (idx % 3 = 1), chr(10) || chr(10)) AS s FROM lines GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 1 THEN sha256(s) END AS source_hash, CASE WHEN n > 1 THEN sha256(upper(replace(s, 'ß', 'SS'))) END AS draft_hash FROM w""")
def weak_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and draft narrowed to every third block; nothing where that would be all of them or none."""
    source = T.block_payload(F.split("text", "\n"))
    d = _read(spark, sf_dir, "documents").select("doc_id", source.alias("s")).withColumn("d", F.upper("s"))
    weak = lambda blocks: F.filter(F.transform(blocks, lambda x: x["index"]), lambda i: i % 3 == 1)
    d = cost.with_weak_scope(d, "s", "d", weak, "scope")
    return d.select("doc_id", F.sha2("scope.source", 256).alias("source_hash"), F.sha2("scope.draft", 256).alias("draft_hash"))


_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PAYLOAD = f"length({_TRIMMED.format('string_agg({}, chr(10) || chr(10) ORDER BY idx)')})"


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, idx, {_TRIMMED.format('line')} AS line, upper(replace({_TRIMMED.format('line')}, 'ß', 'SS')) AS up FROM lines),
 n AS (SELECT doc_id, {_PAYLOAD.format("'【' || idx || '】' || chr(10) || line")} AS s, {_PAYLOAD.format(f"'【' || idx || '】 {fixed.FAKE_PREFIX}' || chr(10) || up")} AS t, count(*) AS k FROM b GROUP BY doc_id),
 r1 AS (SELECT *, s >= {fixed.OMISSION_MIN_CHARS} AND (t / s::DOUBLE < 0.88 OR t / s::DOUBLE > 1.45) AS again FROM n),
 r2 AS (SELECT *, again AND (t + 2 * k) / s::DOUBLE BETWEEN 0.88 AND 1.45 AS settled FROM r1),
 m AS (SELECT doc_id, CASE WHEN NOT again THEN 0 WHEN settled THEN 1 ELSE 2 END AS rounds FROM r2)
SELECT doc_id, idx::BIGINT AS block_idx, rounds, sha256({_TRIMMED.format(f"'{fixed.FAKE_PREFIX}' || repeat('{fixed.FAKE_REFINE}', rounds) || chr(10) || up")}) AS target_hash FROM b JOIN m USING (doc_id) WHERE line <> ''""")
def translated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the whole stage with the offline provider: drafts, and refinement where a draft's length says that something is missing."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("blocks"))
    told = translation.translate(d, ["doc_id"], "blocks", translation.OfflineProvider(), save=_kept).where(T.trim(F.col("source")) != "")
    rounds = (F.length("target") - F.length(F.replace("target", F.lit(fixed.FAKE_REFINE), F.lit("")))) / len(fixed.FAKE_REFINE)
    return told.select("doc_id", "block_idx", rounds.cast("int").alias("rounds"), F.sha2("target", 256).alias("target_hash"))
