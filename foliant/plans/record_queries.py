"""Named queries over archives, stored records, model replies and single moves, each with its SQL twin.

Where the tables hold no such cases, the same literal rows stand on both sides.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import display, fixed
from foliant.functions import text as T
from foliant.operators import ledger, replies
from foliant.plans.text_queries import query
from foliant.sources import epub, epub_source, store


def _sql(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "NULL" if v is None else str(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- archives ------------------------------------------------------------------------------

CHAPTER = 10  # lines


def _paths(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.concat(F.lit("book-"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("path"), "doc_id", "text")


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, title, chapters: a book a document, a chapter every ten lines; they are cut within the book's row, and only its text is shuffled."""
    escaped = _paths(_read(spark, sf_dir, "documents")).withColumn("text", T.escape_entities(F.col("text")))
    d = escaped.groupBy("path", "doc_id").agg(F.transform(F.collect_list("text"), lambda t: F.split(t, "\n")).alias("texts"))
    # an id that comes twice is one book, its lines side by side
    part = lambda k: F.sort_array(F.flatten(F.transform("texts", lambda t: F.transform(F.slice(t, k * CHAPTER + 1, CHAPTER), lambda x, i: F.struct(i.alias("i"), x.alias("line"))))))
    body = lambda k: F.array_join(F.transform(part(k), lambda x: F.concat(F.lit("<p>"), x["line"], F.lit("</p>"))), "")
    last = F.floor((F.array_max(F.transform("texts", F.size)) - 1) / CHAPTER).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.cast("long").alias("pos"), F.concat(F.lit("./text/c"), k.cast("string"), F.lit(".xhtml")).alias("href"), F.concat(F.lit("<html><body>"), body(k), F.lit("</body></html>")).alias("content")))
    return d.select("path", F.concat(F.lit("Title  "), F.col("doc_id").cast("string")).alias("title"), made.alias("chapters"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, title, pos, href, content."""
    return _volumes(spark, sf_dir).select("path", "title", F.explode("chapters").alias("c")).select("path", "title", "c.*")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.bound(_volumes(spark, sf_dir))


CHAPTERS_SQL = f"""chapters AS (SELECT doc_id, idx // {CHAPTER} AS pos, string_agg('<p>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY idx) AS body
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents) GROUP BY 1, 2)"""


@query(f"""WITH {CHAPTERS_SQL} SELECT 'book-' || doc_id || '.epub' AS path, 'Title ' || doc_id AS title, pos::BIGINT AS spine_pos, 'c' || pos AS item_id, 'OEBPS/text/c' || pos || '.xhtml' AS href, 'application/xhtml+xml' AS media_type,
 sha256('<html><body>' || body || '</body></html>') AS content_hash FROM chapters""")
def epub_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as archives and read back: title, references, manifest, links, contents."""
    spine = epub.spine(epub.books(_books(spark, sf_dir)))
    return spine.select("path", "title", "spine_pos", "item_id", "href", "media_type", F.sha2("content", 256).alias("content_hash"))


@query(f"""WITH {CHAPTERS_SQL}, b AS (SELECT 'book-' || doc_id || '.epub' AS path, 'Title ' || doc_id AS title, 'ok' AS status, pos::BIGINT AS spine_pos, 'c' || pos AS item_id, 'OEBPS/text/c' || pos || '.xhtml' AS href, sha256('<html><body>' || body || '</body></html>') AS content_hash FROM chapters)
SELECT * FROM b UNION ALL SELECT 'bad-' || doc_id || '.epub', NULL, 'not an archive', NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 100 = 0""")
def epub_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of books, some of them none, written and read as a data source."""
    epub_source.register(spark)
    path = store.folder(spark, "books")
    _books(spark, sf_dir).write.format("epub").mode("overwrite").save(path)
    i = F.col("doc_id").cast("string")
    bad = _read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.concat(F.lit("bad-"), i, F.lit(".epub")).alias("path"), F.encode(F.lit("no archive, but long enough to be one"), "utf-8").alias("archive"))
    bad.write.format("epub").mode("append").save(path)
    found = spark.read.format("epub").option("partitionBytes", 1 << 20).load(path)
    return found.select("path", "title", "status", "spine_pos", "item_id", "href", F.sha2("content", 256).alias("content_hash"))


NOTE = "machine translation & more"


@query(f"""WITH {CHAPTERS_SQL}, n AS (SELECT doc_id, count(*)::BIGINT AS n_chapters FROM chapters GROUP BY 1)
SELECT 'book-' || doc_id || '.epub' AS path, 'ok' AS status, n_chapters + 1 AS n_items, n_chapters + 1 AS n_spine, '<p>changed</p>' AS first_content, 1::BIGINT AS marks, true AS same_again FROM n""")
def epub_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with the first chapter replaced, the mark set and a colophon added, read back; and marked a second time."""
    changes = _paths(_read(spark, sf_dir, "documents")).select("path", F.lit("OEBPS/text/c0.xhtml").alias("href"), F.lit("<p>changed</p>").alias("content")).distinct()
    path = store.folder(spark, "delivered")
    epub.rebuilt(_books(spark, sf_dir), changes, NOTE).write.parquet(path)
    made = spark.read.schema("path string, archive binary").parquet(path)
    twice = epub.rebuilt(made.withColumn("once", F.col("archive")), None, NOTE, keep=["once"])
    both = epub.books(twice.select("path", F.col("once").alias("archive"), (F.col("once") == F.col("archive")).alias("same_again")), keep=["same_again"])
    first = F.filter("chapters", lambda c: c["href"] == "OEBPS/text/c0.xhtml")[0]["content"]
    marks = F.regexp_count("package", F.lit("trainedAlgorithmicMedia")).cast("long")
    return both.select("path", "status", F.size("items").cast("long").alias("n_items"), F.size("refs").cast("long").alias("n_spine"), first.alias("first_content"), marks.alias("marks"), "same_again")


_LIMITS = epub.Limits(entries=12, uncompressed=4000)
_CONTAINER = '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>'
_PACKAGE = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="c.xhtml" media-type="text/html"/></manifest><spine><itemref idref="c"/></spine></package>'


def _hostile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive a document; by its id some reach out of their folder, hold too many entries, lack a chapter, or are none."""
    for batch in batches:
        made = []
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            kind, out = doc % 8, io.BytesIO()
            more = {2: [("a/../../x", "1")], 3: [("/etc/x", "1")], 4: [("C:\\x", "1")], 5: [(f"f{i}", "") for i in range(12)]}.get(kind, [])
            package = _PACKAGE.replace("text/html", "text/css") if kind == 6 else _PACKAGE
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in [("META-INF/container.xml", _CONTAINER), ("p.opf", package), ("c.xhtml", text or ""), *more]:
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content.encode("utf-8", "surrogatepass"), zipfile.ZIP_DEFLATED)
            made.append(b"no archive, but long enough to be one" if kind == 7 else None if doc % 97 == 1 else out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([f"{d}.epub" for d in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "archive"])


@query(f"""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {len(_CONTAINER) + len(_PACKAGE)} - CASE WHEN doc_id % 8 = 6 THEN 1 ELSE 0 END AS size, doc_id % 8 AS kind FROM documents)
SELECT doc_id || '.epub' AS path, CASE WHEN kind = 7 THEN 'not an archive' WHEN doc_id % 97 = 1 THEN 'too large' WHEN kind = 5 THEN 'too many entries' WHEN kind IN (2, 3, 4) THEN 'unsafe path' WHEN size > {_LIMITS.uncompressed} THEN 'expands too far' WHEN kind = 6 THEN 'empty' ELSE 'ok' END AS status FROM d""")
def epub_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of documents, hostile ones among them, and why they are refused; sizes are summed from the directory alone."""
    files = _read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_hostile, "path string, archive binary")
    return epub.books(files, _LIMITS).select("path", "status")


# ---- inline tags and display ---------------------------------------------------------------

_INLINE = rf"(?i)</?(?:{'|'.join(fixed.INLINE_TAGS)})(?:[^A-Za-z0-9_>][^>]*)?>"


@query(f"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '{_INLINE}') AS tags, string_split_regex(html, '{_INLINE}') AS rest FROM pages)
SELECT page_id, len(tags)::BIGINT AS n_tags, sha256(rest[1] || coalesce(array_to_string(list_transform(range(1, len(rest)), lambda i: '⟦' || (i - 1) || '⟧' || rest[i + 1]), ''), '')) AS text_hash, sha256(html) AS back_hash,
 sha256(rest[1] || coalesce(array_to_string(list_transform(range(1, len(rest)), lambda i: CASE WHEN i = 1 THEN tags[1] ELSE '' END || rest[i + 1]), ''), '')) AS first_hash FROM p""")
def inline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline tags as marks, put back, and put back with only the first tag known."""
    p = _read(spark, sf_dir, "pages").select("page_id", T.protect(F.col("html")).alias("p")).select("page_id", "p.*")
    back = T.restore(F.col("text"), F.col("tags"))
    return p.select("page_id", F.size("tags").cast("long").alias("n_tags"), F.sha2("text", 256).alias("text_hash"), F.sha2(back, 256).alias("back_hash"), F.sha2(T.restore(F.col("text"), F.slice("tags", 1, 1)), 256).alias("first_hash"))


@query("""WITH v AS (SELECT event_id, floor(value * 8) / 8 AS usd, event_id * 7919 % 20000000 - 5 AS ms, (event_id % 400) / 16.0::DOUBLE AS speed FROM events),
 r AS (SELECT *, floor(ms / 1000.0 + 0.5)::BIGINT AS s, floor(floor(ms / 1000.0 + 0.5) / 60 + 0.5)::BIGINT AS m FROM v)
SELECT event_id, '$' || CASE WHEN usd >= 1 THEN printf('%.2f', usd) ELSE printf('%.3f', usd) END AS usd, CASE WHEN ms > 0 THEN CASE WHEN s < 60 THEN '~' || s || ' mp' WHEN m < 60 THEN '~' || m || ' perc' WHEN m % 60 > 0 THEN '~' || m // 60 || ' ó ' || m % 60 || ' p' ELSE '~' || m // 60 || ' óra' END END AS eta,
 CASE WHEN speed > 0 THEN CASE WHEN speed >= 10 THEN floor(speed + 0.5)::BIGINT::VARCHAR ELSE (floor(speed * 10 + 0.5) / 10)::DECIMAL(9, 1)::VARCHAR END || ' szakasz/perc' END AS speed FROM r""".replace("floor(value * 8) / 8", "floor(value * 4) / 4"))
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money, time left and speed as they are shown."""
    e, i = _read(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", display.usd_text(F.floor(F.col("value") * 4) / 4).alias("usd"), display.eta_text(i * 7919 % 20000000 - 5).alias("eta"), display.speed_text((i % 400) / F.lit(16.0)).alias("speed"))


# ---- replies of models ---------------------------------------------------------------------

#: What a model answers to an event: usage under either set of names, of the right type or not, or no JSON at all.
_REPLY_SQL = """r AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN '{"prompt_tokens": ' || user_id || ', "completion_tokens": ' || floor(value)::BIGINT || ', "prompt_tokens_details": {"cached_tokens": ' || user_id % 7 || '}}'
  WHEN 1 THEN '{"input_tokens": ' || user_id || ', "output_tokens": ' || floor(value)::BIGINT || ', "total_cached_tokens": ' || user_id % 5 || ', "weak_blocks": [' || event_id % 4 || ', 1.5, "3", -1, ' || user_id || ']}'
  WHEN 2 THEN '{"prompt_tokens": "' || user_id || '", "input_tokens": ' || user_id + 1 || ', "weak_blocks": ["a", -' || user_id || ']}'
  WHEN 3 THEN '{"weak_blocks": ' || user_id || ', "prompt_tokens_details": {"cached_tokens": "9"}, "total_cached_tokens": ' || user_id || '}'
  WHEN 4 THEN props ELSE event_type END AS reply FROM events)"""
_NUMBER = "CASE WHEN json_type(j, '{0}') IN ('UBIGINT', 'BIGINT') THEN json_extract(j, '{0}')::BIGINT END"


@query(f"""WITH {_REPLY_SQL}, p AS (SELECT event_id, CASE WHEN json_valid(reply) THEN reply::JSON END AS j FROM r),
 w AS (SELECT event_id, list_filter(CASE WHEN json_type(j, '$.weak_blocks') = 'ARRAY' THEN json_extract(j, '$.weak_blocks[*]') ELSE [] END, lambda x: json_type(x) = 'UBIGINT') AS ws FROM p)
SELECT event_id, coalesce({_NUMBER.format('$.prompt_tokens')}, {_NUMBER.format('$.input_tokens')}, 0)::BIGINT AS input, coalesce({_NUMBER.format('$.completion_tokens')}, {_NUMBER.format('$.output_tokens')}, 0)::BIGINT AS output,
 coalesce({_NUMBER.format('$.prompt_tokens_details.cached_tokens')}, {_NUMBER.format('$.total_cached_tokens')}, 0)::BIGINT AS cached, CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(ws, lambda x: x::VARCHAR), ',') END AS weak FROM p JOIN w USING (event_id)""")
def reply_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by either set of names, and weak blocks that are whole numbers."""
    i, u, v = F.col("event_id"), F.col("user_id"), F.floor("value")
    said = lambda form, *values: F.format_string(form, *values)
    reply = (
        F.when(i % 6 == 0, said('{"prompt_tokens": %d, "completion_tokens": %d, "prompt_tokens_details": {"cached_tokens": %d}}', u, v, u % 7))
        .when(i % 6 == 1, said('{"input_tokens": %d, "output_tokens": %d, "total_cached_tokens": %d, "weak_blocks": [%d, 1.5, "3", -1, %d]}', u, v, u % 5, i % 4, u))
        .when(i % 6 == 2, said('{"prompt_tokens": "%d", "input_tokens": %d, "weak_blocks": ["a", -%d]}', u, u + 1, u))
        .when(i % 6 == 3, said('{"weak_blocks": %d, "prompt_tokens_details": {"cached_tokens": "9"}, "total_cached_tokens": %d}', u, u))
        .when(i % 6 == 4, F.col("props"))
        .otherwise(F.col("event_type"))
    )
    r = _read(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    weak = replies.weak_blocks(F.when(F.try_parse_json("reply").isNotNull(), F.col("reply")))
    return r.select("event_id", replies.usage(F.col("reply")).alias("u"), F.when(F.size(weak) > 0, F.array_join(weak, ",")).alias("weak")).select("event_id", "u.*", "weak")


@query(r"""WITH c AS (SELECT conv_id * 100 + turn AS request, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) AS terms, lower(regexp_extract(text, '[a-z]+', 0)) AS said, length(text) % 4 AS kind FROM conversations WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[A-Z][a-z]+')) > 0),
 t AS (SELECT DISTINCT request, unnest(terms) AS term, said, kind FROM c)
SELECT DISTINCT request::BIGINT AS request, term, said || term AS rendering FROM t WHERE kind IN (0, 1) AND (kind = 0 OR length(term) % 2 = 0)""")
def glossary_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is asked for the names of a turn; it answers with spaces around, leaves some blank, adds one that nobody asked for, or answers no JSON."""
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)
    c = _read(spark, sf_dir, "conversations").where(F.size(names) > 0).select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), F.array_distinct(names).alias("terms"), F.lower(F.regexp_extract("text", "[a-z]+", 0)).alias("said"), (F.length("text") % 4).alias("kind"))
    blank = lambda t: F.when((F.col("kind") == 0) | (F.length(t) % 2 == 0), F.concat(F.lit("  "), F.col("said"), t, F.lit(" "))).otherwise(F.lit("  "))
    entries = F.array_append(F.transform("terms", lambda t: F.struct(t.alias("key"), blank(t).alias("value"))), F.struct(F.lit("Nobody asked").alias("key"), F.lit("x").alias("value")))
    reply = F.when(F.col("kind") == 3, F.concat(F.lit("junk "), F.col("said"))).when(F.col("kind") == 2, F.to_json(F.create_map(F.lit("Nobody asked"), F.lit("x")))).otherwise(F.to_json(F.map_from_entries(entries)))
    told = c.select("request", "terms", reply.alias("reply"))
    json = F.when(F.try_parse_json("reply").isNotNull(), F.col("reply"))
    return replies.accepted_renderings(told.withColumn("reply", json), "request", "terms", "reply").distinct()


# ---- moves ---------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 700 AS tx, o_custkey % 3 AS usr, CASE o_orderkey % 5 WHEN 0 THEN 'gift' WHEN 1 THEN 'credits.600' ELSE 'credits.250' END AS product FROM orders),
 f AS (SELECT tx, arg_min(usr, id) AS u, arg_min(product, id) AS pr, min(id) AS id FROM p WHERE product <> 'gift' GROUP BY tx),
 d AS (SELECT p.id, CASE WHEN product = 'gift' THEN 'unknown' WHEN p.id = f.id THEN 'applied' WHEN usr = u AND product = pr THEN 'repeated' ELSE 'rebound' END AS decision, product FROM p LEFT JOIN f USING (tx))
SELECT id, decision, CASE WHEN decision <> 'applied' THEN 0 WHEN product = 'credits.600' THEN 600 ELSE 250 END::BIGINT AS credits FROM d""")
def purchase_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction counts once; bound to another user or product it is refused."""
    k = F.col("o_orderkey")
    product = F.when(k % 5 == 0, "gift").when(k % 5 == 1, "credits.600").otherwise("credits.250")
    p = _read(spark, sf_dir, "orders").select(k.alias("id"), (k % 700).alias("tx"), (F.col("o_custkey") % 3).alias("usr"), product.alias("product"))
    return ledger.grant_purchases(p, "tx", "usr", "product", {"credits.250": 250, "credits.600": 600}, "id").select("id", "decision", "credits")


_CREDIT_SQL = """m AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, event_id, user_id AS usr, CASE event_type WHEN 'purchase' THEN 'grant' WHEN 'view' THEN 'finalize' WHEN 'error' THEN 'refund' ELSE 'reserve' END AS kind,
 'b' || event_id % 97 AS job, CASE WHEN event_id % 13 = 0 THEN 'q2' ELSE 'q1' END AS quote, CASE WHEN event_type = 'purchase' THEN 250 ELSE 60 + 10 * (event_id % 97 % 4) END::BIGINT AS credits FROM events)"""


@query(f"""WITH RECURSIVE {_CREDIT_SQL}, s AS (SELECT 0::BIGINT AS i, MAP {{}}::MAP(BIGINT, BIGINT) AS bal, MAP {{}}::MAP(VARCHAR, STRUCT(u BIGINT, q VARCHAR, c BIGINT, st VARCHAR)) AS jobs, NULL::BIGINT AS id, NULL::VARCHAR AS decision
 UNION ALL SELECT i, CASE decision WHEN 'granted' THEN map_concat(bal, MAP {{usr: own + credits}}) WHEN 'reserved' THEN map_concat(bal, MAP {{usr: own - credits}}) WHEN 'refunded' THEN map_concat(bal, MAP {{j.u: coalesce(bal[j.u], 0) + j.c}}) ELSE bal END,
  CASE WHEN decision = 'reserved' THEN map_concat(jobs, MAP {{job: {{'u': usr, 'q': quote, 'c': credits, 'st': 'reserve'}}}}) WHEN decision IN ('refunded', 'finalized') THEN map_concat(jobs, MAP {{job: {{'u': j.u, 'q': j.q, 'c': j.c, 'st': kind}}}}) ELSE jobs END, event_id, decision
 FROM (SELECT *, CASE WHEN kind = 'grant' THEN 'granted' WHEN kind = 'reserve' THEN CASE WHEN j IS NOT NULL AND (j.u <> usr OR j.q <> quote OR j.c <> credits) THEN 'mismatched' WHEN j IS NOT NULL AND j.st <> 'refund' THEN 'repeated' WHEN credits > own THEN 'short' ELSE 'reserved' END
   WHEN j IS NULL OR j.st <> 'reserve' THEN 'ignored' WHEN kind = 'refund' THEN 'refunded' ELSE 'finalized' END AS decision
  FROM (SELECT m.*, s.bal, s.jobs, s.jobs[m.job] AS j, coalesce(s.bal[m.usr], 0) AS own FROM s JOIN m ON m.i = s.i + 1)))
SELECT id AS event_id, decision FROM s WHERE i > 0""")
def credit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users grant, reserve and settle jobs that belong to whoever got them first."""
    i, e = F.col("event_id"), F.col("event_type")
    kind = F.when(e == "purchase", "grant").when(e == "view", "finalize").when(e == "error", "refund").otherwise("reserve")
    job = F.concat(F.lit("b"), (i % 97).cast("string"))
    credits = F.when(e == "purchase", 250).otherwise(60 + 10 * (i % 97 % 4)).cast("long")
    moves = _read(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("user"), kind.alias("kind"), job.alias("job"), F.when(i % 13 == 0, "q2").otherwise("q1").alias("quote"), credits.alias("credits"))
    return ledger.credit_moves(moves, ["ts", "event_id"]).select("event_id", "decision")


_DAY_CENTS, _MONTH_CENTS = 60_000, 270_000
_BUDGET_SQL = """m AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, event_id, CASE event_type WHEN 'view' THEN 'finalize' WHEN 'error' THEN 'refund' ELSE 'ask' END AS kind, user_id * 3 + event_id % 3 AS job,
 CASE WHEN event_type IN ('view', 'error') THEN floor(value * 8)::BIGINT WHEN event_id % 11 = 0 THEN 700 ELSE 500 * (1 + (user_id * 3 + event_id % 3) % 5) END::BIGINT AS cents, strftime(DATE '2024-01-01' + (5 * (day(ts) - 1))::INTEGER, '%Y-%m-%d') AS day FROM events)"""


@query(f"""WITH RECURSIVE {_BUDGET_SQL}, s AS (SELECT 0::BIGINT AS i, MAP {{}}::MAP(VARCHAR, BIGINT) AS used, MAP {{}}::MAP(BIGINT, STRUCT(d VARCHAR, c BIGINT, o BOOLEAN)) AS jobs, NULL::BIGINT AS id, NULL::VARCHAR AS decision
 UNION ALL SELECT i, CASE decision WHEN 'acquired' THEN map_concat(used, MAP {{day: ud + cents, substr(day, 1, 7): um + cents}})
   WHEN 'refunded' THEN map_concat(used, MAP {{j.d: used[j.d] - j.c, substr(j.d, 1, 7): used[substr(j.d, 1, 7)] - j.c}}) WHEN 'finalized' THEN map_concat(used, MAP {{j.d: used[j.d] + cents - j.c, substr(j.d, 1, 7): used[substr(j.d, 1, 7)] + cents - j.c}}) ELSE used END,
  CASE decision WHEN 'acquired' THEN map_concat(jobs, MAP {{job: {{'d': day, 'c': cents, 'o': true}}}}) WHEN 'finalized' THEN map_concat(jobs, MAP {{job: {{'d': j.d, 'c': j.c, 'o': false}}}}) WHEN 'refunded' THEN map_concat(jobs, MAP {{job: NULL::STRUCT(d VARCHAR, c BIGINT, o BOOLEAN)}}) ELSE jobs END, event_id, decision
 FROM (SELECT *, CASE WHEN kind = 'ask' THEN CASE WHEN j IS NOT NULL THEN CASE WHEN j.c = cents THEN 'held' ELSE 'refused' END WHEN ud + cents > {_DAY_CENTS} OR um + cents > {_MONTH_CENTS} THEN 'refused' ELSE 'acquired' END
   WHEN j IS NULL OR NOT j.o THEN 'ignored' WHEN kind = 'refund' THEN 'refunded' ELSE 'finalized' END AS decision
  FROM (SELECT m.*, s.used, s.jobs, s.jobs[m.job] AS j, coalesce(s.used[m.day], 0) AS ud, coalesce(s.used[substr(m.day, 1, 7)], 0) AS um FROM s JOIN m ON m.i = s.i + 1)))
SELECT id AS event_id, decision FROM s WHERE i > 0""")
def budget_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asking again changes nothing, refunds free the budget of the day asked for, and final costs replace estimates, across months."""
    i, e = F.col("event_id"), F.col("event_type")
    job = F.col("user_id") * 3 + i % 3
    cents = F.when(e.isin("view", "error"), F.floor(F.col("value") * 8)).when(i % 11 == 0, 700).otherwise(500 * (1 + job % 5)).cast("long")
    day = F.date_format(F.date_add(F.lit("2024-01-01"), 5 * (F.dayofmonth("ts") - 1)), "yyyy-MM-dd")
    kind = F.when(e == "view", "finalize").when(e == "error", "refund").otherwise("ask")
    moves = _read(spark, sf_dir, "events").select("ts", "event_id", kind.alias("kind"), job.alias("job"), cents.alias("cents"), day.alias("day"))
    return ledger.budget_moves(moves, ["ts", "event_id"], _DAY_CENTS, _MONTH_CENTS).select("event_id", "decision")


JOBS_SQL = """j AS (SELECT o_orderkey AS job, CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN '' ELSE 'u' || o_custkey % 40 END AS usr, 'h' || o_orderkey % 9 AS source_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'hu' ELSE 'de' END AS target,
 CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS sample, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'running' END AS status, CASE WHEN o_orderkey % 10 < 8 THEN 'r' || o_orderkey END AS result_key, o_orderdate AS finished_at FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    user = F.when(c % 11 == 0, None).when(c % 13 == 0, "").otherwise(F.concat(F.lit("u"), (c % 40).cast("string")))
    return _read(spark, sf_dir, "orders").select(
        k.alias("job"), user.alias("user"), F.concat(F.lit("h"), (k % 9).cast("string")).alias("source_hash"), F.when(k % 2 == 0, "hu").otherwise("de").alias("target"),
        F.when(k % 7 == 0, 1).otherwise(0).alias("sample"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"),
        F.when(k % 10 < 8, F.concat(F.lit("r"), k.cast("string"))).alias("result_key"), F.col("o_orderdate").alias("finished_at"),
    )


@query(f"WITH {JOBS_SQL} SELECT job, status FROM j WHERE usr = 'u7'")
def owned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.owned(jobs(spark, sf_dir), "user", "u7").select("job", "status")


@query(f"WITH {JOBS_SQL} SELECT usr AS owner, source_hash, target, job FROM j WHERE sample = 0 AND status = 'done' AND result_key IS NOT NULL AND usr <> '' QUALIFY row_number() OVER (PARTITION BY usr, source_hash, target ORDER BY finished_at DESC, job DESC) = 1")
def completed_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = jobs(spark, sf_dir).where("user <> ''")
    return ledger.completed_translations(own).select(F.col("user").alias("owner"), "source_hash", "target", "job")


# ---- stored records ------------------------------------------------------------------------


@query("""SELECT source AS owner, sha256(text) AS source_hash, max(doc_id) AS latest FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 17 <> 3 GROUP BY 1, 2""")
def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as JSON lines, some corrupt, read back without these, and found by owner and source
    hash; samples never count."""
    path = store.folder(spark, "library")
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("owner"), F.sha2("text", 256).alias("source_hash"), (F.col("doc_id") % 5 == 0).alias("sample"))
    line = F.to_json(F.struct("doc_id", "owner", "source_hash", "sample"))
    d.select(F.when(F.col("doc_id") % 17 == 3, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    found = store.records(spark, path, "doc_id long, owner string, source_hash string, sample boolean")
    return found.where("not sample").groupBy("owner", "source_hash").agg(F.max("doc_id").alias("latest"))


@query("""WITH k AS (SELECT doc_id, 'OEBPS/a b' || chr(39) || doc_id % 7 || '(é).xhtml#' || doc_id AS key, source AS job, n_chars FROM documents)
SELECT job, replace(replace(replace(key, ' ', '%20'), 'é', '%C3%A9'), '/', '%2F').replace('#', '%23') AS code, CASE WHEN job = 'src1' THEN n_chars + 1 ELSE n_chars END AS n FROM k""")
def chunk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by job and encoded key; saving one job again replaces its partition alone."""
    path = store.folder(spark, "cache")
    i = F.col("doc_id").cast("string")
    key = F.concat(F.lit("OEBPS/a b'"), (F.col("doc_id") % 7).cast("string"), F.lit("(é).xhtml#"), i)
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("job"), store.key_code(key).alias("code"), F.col("n_chars").alias("n"))
    store.save(d, path, ["job"])
    store.save(d.where("job = 'src1'").withColumn("n", F.col("n") + 1), path, ["job"])
    return spark.read.schema(d.select("code", "n", "job").schema).parquet(path).select("job", "code", "n")


@query("""SELECT event_id, event_type, substr(sha256(user_id::VARCHAR), 1, 16) AS subject FROM events WHERE user_id <> 7""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as JSON lines under pseudonyms, in two goes; one user's lines are erased from the files that hold them."""
    path, schema = store.folder(spark, "events"), "event_id long, event_type string, subject string"
    e = _read(spark, sf_dir, "events").select("event_id", "event_type", T.pseudonym(F.col("user_id")).alias("subject"))
    for half in (0, 1):
        store.append_records(e.where(F.col("event_id") % 2 == half), path)
    store.erase(spark, path, F.col("subject") == T.pseudonym(F.lit(7)), schema)
    return store.records(spark, path, schema)


@query("""WITH s AS (SELECT o_orderpriority AS config, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(sum(o_totalprice)) AS usd FROM orders GROUP BY 1)
SELECT 0::BIGINT AS row, '| config | jobs | done | usd |' AS line UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY config), '| ' || config || ' | ' || n || ' | ' || done || ' | ' || usd::BIGINT || ' |' FROM s""")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as lines of a Markdown table."""
    o = _read(spark, sf_dir, "orders")
    s = o.groupBy(F.col("o_orderpriority").alias("config")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"), F.round(F.sum("o_totalprice")).cast("long").alias("usd"))
    rows = F.sort_array(F.collect_list(F.struct("config", F.concat(F.lit("| "), F.concat_ws(" | ", "config", *(F.col(c).cast("string") for c in ("n", "done", "usd"))), F.lit(" |")).alias("line"))))
    head = F.array(F.lit("| config | jobs | done | usd |"), F.lit("|---|---|---|---|"))
    return s.agg(F.posexplode(F.concat(head, F.transform(rows, lambda r: r["line"]))).alias("row", "line")).select(F.col("row").cast("long").alias("row"), "line")
