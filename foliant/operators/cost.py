"""Prices, quotes, the offline translation provider and order-dependent cost cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import ordered_scan
from foliant.sources import store


def credits(chars: Column) -> Column:
    return F.when(chars == 0, 0).otherwise(F.ceil(chars / fixed.CHARS_PER_CREDIT)).cast("long")


def tier(chars: Column) -> Column:
    """The first tier whose cap holds the characters; null above the last."""
    out = F.when(chars <= fixed.TIERS[0][1], fixed.TIERS[0][0])
    for number, cap in fixed.TIERS[1:]:
        out = out.when(chars <= cap, number)
    return out.cast("int")


def quoted(books: DataFrame, chars: str = "source_characters") -> DataFrame:
    return books.withColumn("required_credits", credits(F.col(chars))).withColumn("tier", tier(F.col(chars)))


def price_profile(model: Column) -> Column:
    """The longest known prefix of a model's name, or the default."""
    out = None
    for prefix in sorted((p[0] for p in fixed.PRICES), key=len, reverse=True):
        out = F.when(model.startswith(prefix), prefix) if out is None else out.when(model.startswith(prefix), prefix)
    return out.otherwise(fixed.DEFAULT_MODEL)


def usd(model: str, inputs: Column, cached: Column, outputs: Column) -> Column:
    """Price of token totals (never a sum of prices of rows)."""
    known = [p for p in fixed.PRICES if model.startswith(p[0])]
    _, p_in, p_cached, p_out = max(known, key=lambda p: len(p[0])) if known else next(p for p in fixed.PRICES if p[0] == fixed.DEFAULT_MODEL)
    fresh = F.greatest(F.lit(0), inputs - cached)
    return fresh / F.lit(1e6) * F.lit(p_in) + cached / F.lit(1e6) * F.lit(p_cached) + outputs / F.lit(1e6) * F.lit(p_out)


def cents(usd_: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(usd_ * 100)).cast("long")


def ceiling_cut(chunks: DataFrame, book: str, order: list[str], tokens: str, model: str, ceiling: float) -> DataFrame:
    """book, n_chunks, n_done, ceiling_hit: work in order until the next chunk would pass the ceiling.

    order names a document and a place in it. Documents are summed first, so what is scanned in a book's order is one row
    a document; only the document in which the ceiling is passed is looked into.
    """
    doc, *place = order
    path = store.folder(chunks.sparkSession, "chunks")
    chunks.write.parquet(path)  # read twice
    chunks = chunks.sparkSession.read.schema(chunks.schema).parquet(path)
    price = lambda upto: usd(model, upto, F.lit(0), upto)
    sums = chunks.groupBy(book, doc).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("n"))
    scanned = ordered_scan.scan(sums, book, [doc], sums=["tokens", "n"])
    sums = scanned.select(book, doc, "tokens", "n", (F.col("before_tokens") + F.col("tokens")).alias("upto"), (F.col("before_n") + F.col("n")).alias("done"))
    over = F.when(price(F.col("upto")) > F.lit(ceiling), F.struct(F.col(doc), (F.col("upto") - F.col("tokens")).alias("before"), (F.col("done") - F.col("n")).alias("done")))
    books = sums.groupBy(book).agg(F.sum("n").alias("n_chunks"), F.min(over).alias("at"))
    crossing = books.where("at is not null").select(book, F.col(f"at.{doc}").alias(doc), "at.before", "at.done")
    inside = chunks.join(crossing, [book, doc]).withColumn("upto", F.col("before") + F.sum(tokens).over(Window.partitionBy(book, doc).orderBy(*place)))
    fitting = inside.groupBy(book).agg((F.max("done") + F.count(F.when(~(price(F.col("upto")) > F.lit(ceiling)), 1))).alias("n_fit"))
    return books.join(fitting, book, "left").select(book, "n_chunks", F.coalesce("n_fit", "n_chunks").cast("long").alias("n_done"), F.col("at").isNotNull().alias("ceiling_hit"))


def eta(done: Column, total: Column, mean_ms: Column, concurrency: Column) -> dict[str, Column]:
    """pct, eta_ms and chunks_per_min of a job."""
    left = F.greatest(F.lit(0), total - done)
    workers = F.greatest(F.lit(1), F.least(concurrency, left))
    known = mean_ms.isNotNull() & (left > 0) & (mean_ms > 0)
    return {
        "pct": F.when(total > 0, done / total * 100).otherwise(0.0),
        "eta_ms": F.when(known, mean_ms * left / workers),
        "chunks_per_min": F.when(known, F.lit(60000.0) / mean_ms * workers),
    }


# ---- the offline provider ------------------------------------------------------------------

_MARKED = f"[{fixed.TOKEN_OPEN}{fixed.TOKEN_CLOSE}{fixed.BLOCK_OPEN}{fixed.BLOCK_CLOSE}]"
_OPEN, _CLOSE, _SOLID = f"[{fixed.TOKEN_OPEN}{fixed.BLOCK_OPEN}]", f"[{fixed.TOKEN_CLOSE}{fixed.BLOCK_CLOSE}]", f"[^{T.WS[1:-1]}]"
#: A mark that touches other characters than white space, or is no number in a pair of brackets.
_INSIDE_WORD = f"{_OPEN}(?:(?<={_SOLID}.)|(?![0-9]+{_CLOSE}))|{_CLOSE}(?:(?={_SOLID})|(?<!{_OPEN}[0-9]{{1,9}}.))"


def fake_translate(text: Column, terms: dict[str, str] | None = None) -> Column:
    """Terms replaced, words without marks in upper case, every block prefixed."""
    for term, rendering in (terms or {}).items():
        if rendering:
            text = F.replace(text, F.lit(term), F.lit(rendering))
    # words and the space between them alternate, so each piece is upper-cased on its own; where every mark is whole and a
    # word by itself, as in most texts, all of the text is upper-cased at once
    parts = F.regexp_extract_all(text, F.lit(f"({T.WS}+|[^{T.WS[1:-1]}]+)"), 1)
    mixed = F.array_join(F.transform(parts, lambda w: F.when(w.rlike(_MARKED), w).otherwise(F.upper(w))), "")
    upper = F.when(text.rlike(_INSIDE_WORD), mixed).otherwise(F.upper(text))
    mark = f"({fixed.BLOCK_OPEN}\\d+{fixed.BLOCK_CLOSE})"
    return F.when(upper.rlike(mark), F.regexp_replace(upper, mark, f"$1 {fixed.FAKE_PREFIX}")).otherwise(F.concat(F.lit(fixed.FAKE_PREFIX), upper))


def fake_refine(draft: Column) -> Column:
    return F.replace(draft, F.lit(fixed.FAKE_PREFIX), F.lit(fixed.FAKE_PREFIX + fixed.FAKE_REFINE))


def join_blocks(blocks: Column) -> Column:
    """(index, body) back to a payload."""
    return F.array_join(F.transform(blocks, lambda x: F.concat(F.lit(fixed.BLOCK_OPEN), x["index"].cast("string"), F.lit(f"{fixed.BLOCK_CLOSE}\n"), T.trim(x["body"]))), "\n\n")


def splice(blocks: Column, refined: Column) -> Column:
    """The draft's blocks with non-empty refined bodies in their places, joined."""

    def body(x: Column) -> Column:
        return F.coalesce(F.nullif(T.trim(T.body_of(refined, x["index"])), F.lit("")), x["body"])

    return join_blocks(F.transform(blocks, lambda x: F.struct(x["index"].alias("index"), body(x).alias("body"))))


def _scope(s: Column, d: Column, weak: Column) -> Column:
    own, drafted = F.filter(s, lambda x: F.array_contains(weak, x["index"])), F.filter(d, lambda x: F.array_contains(weak, x["index"]))
    safe = (F.size(weak) > 0) & (F.size(s) > 0) & (F.size(d) == F.size(s)) & (F.size(own) > 0) & (F.size(own) == F.size(drafted)) & (F.size(own) < F.size(s))
    return F.when(safe, F.struct(join_blocks(own).alias("source"), join_blocks(drafted).alias("draft")))


def weak_scope(source: Column, draft: Column, weak: Column) -> Column:
    """Struct of source and draft narrowed to the weak blocks, null where that would be unsafe."""
    return _scope(T.split_blocks(source), T.split_blocks(draft), weak)


def with_weak_scope(df: DataFrame, source: str, draft: str, weak: Callable[[Column], Column], out: str) -> DataFrame:
    """df with the weak scope; weak(blocks of the source) tells the numbers of the weak ones.

    Payloads are split once, and what is weak is known before blocks are compared with it: an expression for it would be computed
    again for every block.
    """
    d = df.withColumn("__s", T.split_blocks(F.col(source))).withColumn("__d", T.split_blocks(F.col(draft)))
    d = d.withColumn("__weak", F.array_distinct(weak(F.col("__s"))))
    return d.withColumn(out, _scope(F.col("__s"), F.col("__d"), F.col("__weak"))).drop("__s", "__d", "__weak")
