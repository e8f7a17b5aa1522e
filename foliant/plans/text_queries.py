"""Named queries over documents and pages, each with its SQL twin.

A book is a source, its spine the documents by id, a block a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import chunking, cost, glossary
from foliant.sources import html

BUDGET = 2000


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "source", "text")))


# ---- SQL parts -----------------------------------------------------------------------------

LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"


def _chunks_sql(budget: int) -> str:
    """Recursive CTE `chunks` with one row per chunk."""
    over = f"(c.held > 0 AND c.held + length(l.line) > {budget})"
    held = f"(CASE WHEN {over} THEN 0 ELSE c.held END + length(l.line))"
    number = f"(c.nxt + CASE WHEN {over} THEN 1 ELSE 0 END)"
    return f"""{LINES}, packed AS (
      SELECT doc_id, source, idx, line, 0::BIGINT AS ordinal, CASE WHEN length(line) >= {budget} THEN 1 ELSE 0 END::BIGINT AS nxt, CASE WHEN length(line) >= {budget} THEN 0 ELSE length(line) END::BIGINT AS held FROM lines WHERE idx = 0
      UNION ALL
      SELECT l.doc_id, l.source, l.idx, l.line, {number}, {number} + CASE WHEN {held} >= {budget} THEN 1 ELSE 0 END, CASE WHEN {held} >= {budget} THEN 0 ELSE {held} END
      FROM packed c JOIN lines l ON l.doc_id = c.doc_id AND l.idx = c.idx + 1),
    chunks AS (SELECT source, doc_id, ordinal, min(idx)::BIGINT AS first_block, count(*)::BIGINT AS n_blocks, sum(length(line))::BIGINT AS n_chars, string_agg(line, chr(10) ORDER BY idx) AS chunk_text FROM packed GROUP BY source, doc_id, ordinal)"""


COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
WORDS = r"len(regexp_extract_all({}, '\S+'))::BIGINT"


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


TIER_SQL = f"tiers(tier, cap) AS (VALUES {_values(fixed.TIERS)})"
PRICE_SQL = f"prices(prefix, p_in, p_cached, p_out) AS (VALUES {_values(fixed.PRICES)})"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- metering ------------------------------------------------------------------------------


@query(f"""WITH {LINES}, {TIER_SQL}, books AS (
  SELECT source, count(DISTINCT doc_id)::BIGINT AS spine_items, sum(length({COLLAPSED.format("nfc_normalize(line)")}))::BIGINT AS source_characters FROM lines GROUP BY source)
SELECT source, spine_items, source_characters, (CASE WHEN source_characters = 0 THEN 0 ELSE ceil(source_characters / 1000.0) END)::BIGINT AS required_credits,
  (SELECT min(tier) FROM tiers WHERE cap >= source_characters)::INT AS tier FROM books""")
def quote_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    blocks = F.split(T.nfc(F.col("text")), "\n")
    n = F.aggregate(F.transform(blocks, lambda x: F.length(T.collapse(x))), F.lit(0).cast("long"), lambda a, x: a + x)
    books = d.groupBy("source").agg(F.count("*").alias("spine_items"), F.sum(n).alias("source_characters"))
    return cost.quoted(books)


@query(f"""WITH {TIER_SQL}, books AS (SELECT source, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source), caps AS (SELECT tier, cap, lag(cap, 1, -1) OVER (ORDER BY cap) AS below FROM tiers)
SELECT tier::INT AS tier, count(*)::BIGINT AS n_books, sum(n_chars)::BIGINT AS n_chars FROM books LEFT JOIN caps ON n_chars > below AND n_chars <= cap GROUP BY tier""")
def tier_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _docs(spark, sf_dir, "source", "n_chars").groupBy("source").agg(F.sum("n_chars").alias("n_chars"))
    return books.groupBy(cost.tier(F.col("n_chars")).alias("tier")).agg(F.count("*").alias("n_books"), F.sum("n_chars").alias("n_chars"))


_MODEL_SQL = f"""m AS (SELECT p_partkey, coalesce((SELECT prefix FROM (SELECT prefix, row_number() OVER (ORDER BY prefix) - 1 AS k FROM prices) WHERE k = p_partkey % 9), CASE p_partkey % 9 WHEN 7 THEN lower(p_brand) ELSE '' END)
  || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '-preview' ELSE '-lite' END AS model FROM part)"""


@query(f"""WITH {PRICE_SQL}, {_MODEL_SQL}
SELECT p_partkey, model, coalesce(arg_max(prefix, length(prefix)), '{fixed.DEFAULT_MODEL}') AS profile FROM m LEFT JOIN prices ON starts_with(model, prefix) GROUP BY p_partkey, model""")
def model_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts name models: known ones, with endings that make them others or not, and unknown ones; the longest known prefix tells the price."""
    k, known = F.col("p_partkey") % 9, sorted(m for m, *_ in fixed.PRICES)
    name = F.when(k == 7, F.lower("p_brand")).otherwise("")
    for i, prefix in enumerate(known):
        name = F.when(k == i, prefix).otherwise(name)
    model = F.concat(name, F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "-preview").otherwise("-lite"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", model.alias("model"))
    return parts.select("p_partkey", "model", cost.price_profile(F.col("model")).alias("profile"))


# ---- chunks --------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_chunks_sql(BUDGET)} SELECT doc_id, ordinal, first_block, n_blocks, n_chars, sha256(chunk_text) AS chunk_hash FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_docs(spark, sf_dir), BUDGET).select("doc_id", "ordinal", "first_block", "n_blocks", "n_chars", F.sha2("chunk_text", 256).alias("chunk_hash"))


@query(f"WITH RECURSIVE {_chunks_sql(fixed.CHUNK_CHARS)} SELECT source, count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars, max(n_chars)::BIGINT AS max_chars FROM chunks GROUP BY source")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(_docs(spark, sf_dir))
    per_doc = c.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("m"))
    return per_doc.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_docs"), F.sum("s").alias("n_chars"), F.max("m").alias("max_chars"))


@query(f"WITH RECURSIVE {_chunks_sql(BUDGET)} SELECT doc_id, ordinal, lag(right({COLLAPSED.format('chunk_text')}, 600)) OVER (PARTITION BY source ORDER BY doc_id, ordinal) AS context FROM chunks")
def previous_chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.previous_context(chunking.chunks(_docs(spark, sf_dir), BUDGET)).select("doc_id", "ordinal", "context")


@query(f"""WITH RECURSIVE {_chunks_sql(BUDGET)}, firsts AS (SELECT source, arg_min(chunk_text, (doc_id, ordinal)) AS t, min((doc_id, ordinal)) AS at FROM chunks GROUP BY source)
SELECT c.doc_id, c.ordinal, CASE WHEN (c.doc_id, c.ordinal) = f.at THEN NULL ELSE right('{fixed.FAKE_PREFIX}' || upper(replace(f.t, 'ß', 'SS')), 600) END AS anchor FROM chunks c JOIN firsts f ON f.source = c.source""")
def style_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(_docs(spark, sf_dir), BUDGET)
    first = chunking.first_chunks(c).select("source", F.col("doc_id").alias("fd"), F.col("ordinal").alias("fo"), chunking.tail(cost.fake_translate(F.col("chunk_text"))).alias("t"))
    own = (F.col("doc_id") == F.col("fd")) & (F.col("ordinal") == F.col("fo"))
    return c.select("source", "doc_id", "ordinal").join(first, "source").select("doc_id", "ordinal", F.when(~own, F.col("t")).alias("anchor"))


@query(f"""WITH RECURSIVE {_chunks_sql(BUDGET)}, sized AS (SELECT source, doc_id, ordinal, {WORDS.format('chunk_text')} AS words FROM chunks),
chapters AS (SELECT source, doc_id, sum(words) AS w FROM sized GROUP BY source, doc_id),
best AS (SELECT source, arg_min(doc_id, (CASE WHEN w >= 250 THEN 0 WHEN w > 0 THEN 1 ELSE 4 END, doc_id)) AS doc_id FROM chapters GROUP BY source),
cum AS (SELECT s.*, sum(words) OVER (PARTITION BY s.source ORDER BY ordinal) AS upto FROM sized s JOIN best b ON b.source = s.source AND b.doc_id = s.doc_id)
SELECT source, doc_id, count(*)::BIGINT AS n_chunks, sum(words)::BIGINT AS words FROM cum WHERE upto <= 5000 OR ordinal = 0 GROUP BY source, doc_id""")
def first_content_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.content_chapters(chunking.chunks(_docs(spark, sf_dir), BUDGET))


@query(f"""WITH sized AS (SELECT doc_id, {WORDS.format('text')} AS words FROM documents), eligible AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM sized WHERE words >= 120)
SELECT doc_id, words FROM eligible WHERE n <= 12 OR pos IN (SELECT floor(i * n::DOUBLE / 12)::BIGINT FROM range(12) r(i))""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.word_count(F.col("text")).alias("words"))
    return chunking.spread(d, ["doc_id"], 12, F.col("words") >= fixed.EVAL_MIN_WORDS)


@query(f"""WITH RECURSIVE {_chunks_sql(BUDGET)} SELECT c.doc_id, c.ordinal FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id)""")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks still to do; labelled documents stand for the cache of done ones."""
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return chunking.chunks(_docs(spark, sf_dir).join(done, "doc_id", "left_anti"), BUDGET).select("doc_id", "ordinal")


# ---- terms ---------------------------------------------------------------------------------

# marked occurrences: RE2 has ASCII classes, and a word boundary before the term is \b itself
TERMS = f"""parts AS (SELECT source, doc_id, string_split(regexp_replace(text, '\\b{fixed.PROPER_NOUN.replace("'", "''")}\\b', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents),
hits AS (SELECT source, doc_id, i - 1 AS pos, split_part(p[i + 1], chr(2), 1) AS term, replace(p[i], chr(2), '') AS before FROM parts, range(1, len(p)) r(i)),
found AS (SELECT *, regexp_extract(before, '(\\s*)$', 1) AS gap, right(regexp_replace(before, '\\s+$', ''), 1) AS last FROM hits),
terms AS (SELECT source, term, count(*)::BIGINT AS n, sum(CASE WHEN last = '' OR contains(gap, chr(10)) OR contains('{fixed.SENTENCE_END}', last) THEN 0 ELSE 1 END)::BIGINT AS middle, min((doc_id, pos)) AS first FROM found GROUP BY source, term)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.counts(glossary.occurrences(_docs(spark, sf_dir), "source", "doc_id"), "source", "doc_id")


@query(f"WITH {TERMS} SELECT source, term, n, middle, n >= 2 AND middle / n < 0.15 AS opener FROM terms")
def glossary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("source", "term", "n", "middle", glossary.is_opener().alias("opener"))


TOP = f"""{TERMS}, flagged AS (SELECT *, n >= 2 AND middle / n < 0.15 AS opener FROM terms),
openers AS (SELECT source, list(term) AS o FROM flagged WHERE opener AND NOT contains(term, ' ') GROUP BY source),
kept AS (SELECT f.*, string_split(term, ' ') AS w, coalesce(o, []) AS o FROM flagged f LEFT JOIN openers USING (source) WHERE NOT opener AND (contains(term, ' ') OR n >= 2)),
named AS (SELECT source, n, first, array_to_string(w[least(coalesce(list_position(list_transform(w, lambda x: list_contains(o, x)), false), len(w)), len(w)):], ' ') AS name FROM kept),
best AS (SELECT source, name, max((n, -first[1], -first[2])) AS b FROM named WHERE regexp_matches(name, '^[A-Z]') GROUP BY source, name),
ranked AS (SELECT source, name, b[1]::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY b DESC)::BIGINT AS rank FROM best)"""
TOP = TOP.replace("first[1]", "struct_extract(first, 1)").replace("first[2]", "struct_extract(first, 2)").replace("b[1]", "struct_extract(b, 1)")


@query(f"WITH {TOP} SELECT source, name, n, rank FROM ranked WHERE rank <= 200")
def glossary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.top_terms(_terms(spark, sf_dir), "source")


@query(f"""WITH {TOP}, base AS (SELECT name AS term, '' AS rendering FROM ranked WHERE rank <= 200 GROUP BY name), bench AS (SELECT DISTINCT regexp_extract(text, '[A-Z][a-z]+', 0) AS term FROM benchmark), incoming AS (SELECT term, CASE WHEN length(term) > 4 THEN upper(term) ELSE '' END AS rendering FROM bench WHERE term <> '')
SELECT term, coalesce(nullif(i.rendering, ''), b.rendering, '') AS rendering FROM base b FULL JOIN incoming i USING (term)""")
def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = glossary_top(spark, sf_dir).select(F.col("name").alias("term")).distinct().withColumn("rendering", F.lit(""))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract("text", "[A-Z][a-z]+", 0).alias("term")).where("term <> ''").distinct()
    return glossary.merge(base, bench.withColumn("rendering", F.when(F.length("term") > 4, F.upper("term")).otherwise("")))


@query("""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS word FROM conversations), terms AS (SELECT DISTINCT left(word, length(word) - 1) AS term, left(word, length(word) - 1) AS rendering FROM words WHERE length(word) > 3),
pairs AS (SELECT u.conv_id, u.turn, u.text AS s, a.text AS t FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, count(*)::BIGINT AS missing, string_agg(term, ',' ORDER BY term) AS terms FROM pairs, terms WHERE contains(s, term) AND NOT (contains(lower(t), lower(rendering)) OR (regexp_replace(regexp_replace(lower(rendering), 'a$', 'á'), 'e$', 'é') <> lower(rendering) AND contains(lower(t), regexp_replace(regexp_replace(lower(rendering), 'a$', 'á'), 'e$', 'é')))) GROUP BY conv_id, turn""")
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a user's turn holds, whole or inside a longer word, and the answer lacks."""
    from foliant.plans.quality_queries import turn_pairs

    words = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("word")).where(F.length("word") > 3)
    terms = words.select(F.left("word", F.length("word") - 1).alias("term")).distinct().withColumn("rendering", F.col("term"))
    pairs = turn_pairs(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    missing = glossary.missing_terms(pairs, terms, "key", "s", "t")
    return missing.groupBy("key.conv_id", "key.turn").agg(F.count("*").alias("missing"), F.array_join(F.sort_array(F.collect_list("term")), ",").alias("terms"))


_EDGE = r"\b"


@query("SELECT doc_id, " + ", ".join(f"len(list_distinct(regexp_extract_all(lower(text), '{_EDGE}({'|'.join(w)}){_EDGE}')))::BIGINT AS {code}" for code, w in fixed.STOPWORDS.items()) + " FROM documents")
def language_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *(T.stopword_hits(F.col("text"), code).alias(code) for code in fixed.STOPWORDS))


# ---- translation ---------------------------------------------------------------------------


@query(f"SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS input_tokens, ceil(length('{fixed.FAKE_PREFIX}' || upper(t)) / 4.0)::BIGINT AS output_tokens, sha256('{fixed.FAKE_PREFIX}' || upper(t)) AS target_hash FROM (SELECT doc_id, replace(text, 'ß', 'SS') AS t, text FROM documents)")
def fake_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = cost.fake_translate(F.col("text"))
    d = _docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", T.tokens(F.length("text")).alias("input_tokens"), T.tokens(F.length(target)).alias("output_tokens"), F.sha2(target, 256).alias("target_hash"))


@query(f"""WITH {LINES}, numbered AS (SELECT doc_id, idx, trim(line) AS line, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
SELECT doc_id, count(*)::BIGINT AS n_blocks, sha256(string_agg('【' || idx || '】' || chr(10) || CASE WHEN idx % 3 = 1 AND n > 1 AND line <> '' THEN '+ ' || line ELSE line END, chr(10) || chr(10) ORDER BY idx)) AS spliced_hash FROM numbered GROUP BY doc_id""")
def weak_block_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block (from the second) is weak, refined on its own and spliced back."""
    draft = T.block_payload(F.split("text", "\n"))
    d = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", draft.alias("draft")).withColumn("blocks", T.split_blocks(F.col("draft")))
    weak = F.filter("blocks", lambda x: x["index"] % 3 == 1)
    refined = F.transform(weak, lambda x: F.struct(x["index"].alias("index"), F.when(T.trim(x["body"]) != "", F.concat(F.lit(fixed.FAKE_REFINE), T.trim(x["body"]))).otherwise("").alias("body")))
    d = d.withColumn("refined", refined)
    return d.select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.sha2(cost.splice(F.col("blocks"), F.col("refined")), 256).alias("spliced_hash"))


@query(f"""WITH {LINES}, swapped AS (SELECT doc_id, idx, CASE WHEN l.quality = 1 AND idx % 2 = 0 THEN upper(replace(line, 'ß', 'SS')) ELSE line END AS line FROM lines LEFT JOIN labels l USING (doc_id))
SELECT doc_id, count(*)::BIGINT AS n_blocks, sha256(string_agg(line, chr(10) ORDER BY idx)) AS text_hash FROM swapped GROUP BY doc_id""")
def restitch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even blocks of good documents have a translation; the others keep their own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    blocks = T.lines(_docs(spark, sf_dir, "doc_id", "text"))
    translated = blocks.join(labels, "doc_id", "left_semi").where("block_idx % 2 = 0").select("doc_id", "block_idx", F.upper("line").alias("translated"))
    stitched = blocks.join(translated, ["doc_id", "block_idx"], "left").select("doc_id", F.struct("block_idx", F.coalesce("translated", "line").alias("line")).alias("b"))
    whole = F.array_join(F.transform(F.sort_array("bs"), lambda x: x["line"]), "\n")
    return stitched.groupBy("doc_id").agg(F.collect_list("b").alias("bs")).select("doc_id", F.size("bs").cast("long").alias("n_blocks"), F.sha2(whole, 256).alias("text_hash"))


_USD = "(greatest(0, i - c) / 1e6::DOUBLE * p_in + c / 1e6::DOUBLE * p_cached + o / 1e6::DOUBLE * p_out)"


@query(f"""WITH RECURSIVE {_chunks_sql(BUDGET)}, {PRICE_SQL}, used AS (SELECT source, sum(ceil(n_chars / 4.0))::BIGINT AS i, sum(floor(n_chars / 40.0))::BIGINT AS c, sum(ceil(n_chars / 4.0 * 1.0))::BIGINT AS o FROM chunks GROUP BY source)
SELECT source, i AS input_tokens, c AS cached_tokens, o AS output_tokens, {_USD} AS usd FROM used, prices WHERE prefix = 'gemini-3.1-flash-lite'""")
def chunk_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(_docs(spark, sf_dir), BUDGET).select("source", T.tokens(F.col("n_chars")).alias("i"), F.floor(F.col("n_chars") / 40).alias("c"))
    used = c.groupBy("source").agg(F.sum("i").alias("input_tokens"), F.sum("c").alias("cached_tokens"), F.sum("i").alias("output_tokens"))
    return used.withColumn("usd", cost.usd("gemini-3.1-flash-lite", F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))


@query(f"""WITH RECURSIVE {_chunks_sql(BUDGET)}, {PRICE_SQL}, t AS (SELECT source, doc_id, ordinal, ceil(n_chars / 4.0)::BIGINT AS k FROM chunks),
run AS (SELECT *, row_number() OVER w AS seq, coalesce(sum(k) OVER (PARTITION BY source ORDER BY doc_id, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id, ordinal)),
priced AS (SELECT run.*, (before + k) / 1e6::DOUBLE * p_in + 0::DOUBLE * p_cached + (before + k) / 1e6::DOUBLE * p_out > 0.01::DOUBLE AS over FROM run, prices WHERE prefix = 'gemini-3.1-flash-lite')
SELECT source, count(*)::BIGINT AS n_chunks, (coalesce(min(CASE WHEN over THEN seq END), count(*) + 1) - 1)::BIGINT AS n_done, coalesce(bool_or(over), false) AS ceiling_hit FROM priced GROUP BY source""")
def cost_ceiling_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(_docs(spark, sf_dir), BUDGET).select("source", "doc_id", "ordinal", T.tokens(F.col("n_chars")).alias("k"))
    return cost.ceiling_cut(c, "source", ["doc_id", "ordinal"], "k", "gemini-3.1-flash-lite", 0.01)


# ---- pages ---------------------------------------------------------------------------------

_INLINE = "|".join(fixed.INLINE_TAGS)
_STRIPPED = rf"regexp_replace(regexp_replace({{}}, '(?i)</?(?:{_INLINE})(?:>|[^A-Za-z0-9>][^>]*>)', '', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"""WITH p AS (SELECT page_id, html, {WORDS.format(_STRIPPED.format('html'))} AS words, list_sum(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: {WORDS.format(_STRIPPED.format('x'))})) AS l FROM pages)
SELECT page_id, words, coalesce(l, 0)::BIGINT AS linked_words, words > 0 AND coalesce(l, 0) / nullif(words, 0)::DOUBLE >= 0.5 AS navigation FROM p""")
def page_link_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.word_count(F.col("html")).alias("words"), chunking.linked_words(F.col("html")).alias("linked_words"))
    return p.withColumn("navigation", (F.col("words") > 0) & (F.coalesce(F.try_divide("linked_words", "words"), F.lit(0.0)) >= fixed.NAVIGATION_RATIO))


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS h FROM pages),
nodes AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS n FROM bare)
SELECT page_id, len(n)::BIGINT AS n_nodes, sha256(array_to_string(list_transform(n, lambda x, i: '⟦' || (i - 1) || '⟧' || x), chr(10))) AS payload_hash FROM nodes""")
def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.text_segments(F.col("html")).alias("n"))
    return p.select("page_id", F.size("n").cast("long").alias("n_nodes"), F.sha2(T.segment_payload(F.transform("n", lambda x: x["core"])), 256).alias("payload_hash"))


@query()
def leaf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.leaf_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id", "html")


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<(?:h1|h2|title)\b[^>]*>(.*?)</(?:h1|h2|title)>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), ''), 'Chapter ' || page_id) AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", html.title(F.col("html"), F.concat(F.lit("Chapter "), F.col("page_id").cast("string"))).alias("title"))


# ---- library -------------------------------------------------------------------------------


@query("""WITH h AS (SELECT source, doc_id, sha256(text) AS source_hash, n_chars, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id DESC) AS rn, count(*) OVER (PARTITION BY source, sha256(text)) AS copies FROM documents)
SELECT source, source_hash, doc_id AS latest, copies::BIGINT AS copies, n_chars FROM h WHERE rn = 1""")
def library_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each owner and source hash, by two-phase aggregation."""
    d = _docs(spark, sf_dir, "source", "doc_id", "text", "n_chars").withColumn("source_hash", F.sha2("text", 256))
    return d.groupBy("source", "source_hash").agg(F.max("doc_id").alias("latest"), F.count("*").alias("copies"), F.max_by("n_chars", "doc_id").alias("n_chars"))


@query("""SELECT doc_id, replace(replace(rtrim(to_base64(encode('{"doc":' || doc_id || ',"source":"' || source || '"}')), '='), '+', '-'), '/', '_') AS header, source AS decoded FROM documents""")
def header_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as base64url JSON, and read back from it."""
    d = _docs(spark, sf_dir, "doc_id", "source").select("doc_id", T.base64url(F.to_json(F.struct(F.col("doc_id").alias("doc"), "source")).cast("binary")).alias("header"))
    return d.select("doc_id", "header", F.from_json(T.unbase64url(F.col("header")).cast("string"), "doc long, source string")["source"].alias("decoded"))
