"""Text functions as column expressions; Python only where Spark has no function."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions import fixed

#: JavaScript's white space, which Java's \s is only a part of.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\uFEFF\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: ASCII word boundaries before and after (Java's \b knows Unicode).
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Texts without characters beyond this are composed already.
_MAYBE_UNCOMPOSED = "[^\\u0000-\\u02FF]"


def trim(c: Column) -> Column:
    # not by an expression: that tries every place of the text for white space up to its end
    return F.trim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def utf16_length(c: Column) -> Column:
    """UTF-16 units; characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Composed form; only texts that may change are sent to Python."""
    may = c.rlike(_MAYBE_UNCOMPOSED)
    return F.coalesce(_nfc(F.when(may, c)), c)


def visible_chars(c: Column) -> Column:
    """Code points of a composed, collapsed text: what is metered."""
    return F.length(collapse(nfc(c))).cast("long")


#: An inline tag, opening or closing.
INLINE_TAG = rf"(?i)</?(?:{'|'.join(fixed.INLINE_TAGS)})(?![A-Za-z0-9_])[^>]*>"


def protect(html: Column) -> Column:
    """Struct of the text, its inline tags as ⟦i⟧, and of the tags."""
    tags = F.regexp_extract_all(html, F.lit(f"({INLINE_TAG})"), 1)
    rest = F.split(html, INLINE_TAG, -1)
    marked = F.transform(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), lambda x, i: F.concat(F.lit(fixed.TOKEN_OPEN), i.cast("string"), F.lit(fixed.TOKEN_CLOSE), x))
    return F.struct(F.concat(F.get(rest, F.lit(0)), F.array_join(marked, "")).alias("text"), tags.alias("tags"))


def restore(text: Column, tags: Column) -> Column:
    """Marks as their tags again; a mark without a tag vanishes."""
    head, hits = _split(text, f"{fixed.TOKEN_OPEN}\\s*(\\d+)\\s*{fixed.TOKEN_CLOSE}")
    return F.concat(head, F.array_join(F.transform(hits, lambda x: F.concat(F.coalesce(F.get(tags, x["index"]), F.lit("")), x["body"])), ""))


def strip_inline(c: Column) -> Column:
    return F.regexp_replace(c, INLINE_TAG, "")


def strip_tags(c: Column) -> Column:
    """Inline tags vanish, all others become a space."""
    return F.regexp_replace(strip_inline(c), "<[^>]+>", " ")


def decode_entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def escape_entities(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def plain_text(html: Column) -> Column:
    return collapse(decode_entities(strip_tags(html)))


def word_count(c: Column) -> Column:
    # few texts have tags, and most characters are ASCII: those are told at once
    bare = F.when(c.contains("<"), strip_tags(c)).otherwise(c)
    return F.regexp_count(bare, F.lit(f"[!-~]++[^{WS[1:-1]}]*+|[^{WS[1:-1]}]++")).cast("long")


def tokens(n_chars: Column) -> Column:
    return F.ceil(n_chars / fixed.CHARS_PER_TOKEN).cast("long")


def count_of(c: Column, mark: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))).cast("long")


def has_residual(c: Column) -> Column:
    return c.rlike(f"[{fixed.TOKEN_OPEN}{fixed.TOKEN_CLOSE}{fixed.BLOCK_OPEN}{fixed.BLOCK_CLOSE}]")


def mentions(text: Column, rendering: Column) -> Column:
    """Whether a rendering occurs, its last a or e perhaps lengthened."""
    t, r = F.lower(text), F.lower(rendering)
    longer = F.regexp_replace(F.regexp_replace(r, "a$", "á"), "e$", "é")
    return t.contains(r) | ((longer != r) & t.contains(longer))


def stopword_hits(c: Column, code: str) -> Column:
    """Distinct function words of the language in the text."""
    words = fixed.STOPWORDS.get(code)
    if not words:
        return F.lit(0).cast("long")
    # a boundary is where an ASCII word character meets something else
    edge = r"(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))"
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"{edge}({'|'.join(words)}){edge}"), 1))).cast("long")


# ---- marked payloads -----------------------------------------------------------------------


def segment_payload(parts: Column) -> Column:
    """Segments as ⟦i⟧text, a line each."""
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit(fixed.TOKEN_OPEN), i.cast("string"), F.lit(fixed.TOKEN_CLOSE), x)), "\n")


def block_payload(parts: Column) -> Column:
    """Blocks as 【i】 and the trimmed body on the next line, an empty line between."""
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit(fixed.BLOCK_OPEN), i.cast("string"), F.lit(f"{fixed.BLOCK_CLOSE}\n"), trim(x))), "\n\n")


def _split(payload: Column, pattern: str) -> tuple[Column, Column]:
    """The text before the first mark; an array of (index, body) in order."""
    parts = F.split(F.regexp_replace(payload, pattern, "\u0001$1\u0002"), "\u0001")
    hits = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.struct(F.substring_index(x, "\u0002", 1).try_cast("int").alias("index"), F.substring_index(x, "\u0002", -1).alias("body")))
    return parts[0], F.transform(hits, lambda x: F.struct(x["index"].alias("index"), x["body"].alias("body")))


def split_blocks(payload: Column) -> Column:
    """(index, body) of every block mark; what comes before the first is dropped."""
    return _split(payload, f"{fixed.BLOCK_OPEN}(\\d+){fixed.BLOCK_CLOSE}")[1]


def split_segments(payload: Column) -> Column:
    """(index, body) of every segment mark (spaces inside allowed); what comes before the first
    mark belongs to the first segment."""
    head, hits = _split(payload, f"{fixed.TOKEN_OPEN}\\s*(\\d+)\\s*{fixed.TOKEN_CLOSE}")
    return F.transform(hits, lambda x, i: F.struct(x["index"].alias("index"), F.when(i == 0, F.concat(head, x["body"])).otherwise(x["body"]).alias("body")))


def body_of(hits: Column, index: Column) -> Column:
    """Body of the last hit with the index, null without one."""
    return F.get(F.reverse(F.filter(hits, lambda x: x["index"] == index)), F.lit(0))["body"]


# ---- digests and codes ---------------------------------------------------------------------


def pseudonym(c: Column) -> Column:
    """16 hex digits that stand for a user."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def uuid_of(hex32: Column) -> Column:
    return F.concat_ws("-", *(F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(c), "\\s", ""), "+/=", "-_"))


def unbase64url(c: Column) -> Column:
    pad = F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4)))
    return F.unbase64(F.concat(F.translate(c, "-_", "+/"), pad))


def hmac_sha256(key: bytes):
    """A function of text columns: HMAC-SHA256 in base64url."""

    @F.pandas_udf("binary")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).digest())

    return lambda c: base64url(digest(c))


def is_named(c: Column, pattern: str, either_case: bool = True) -> Column:
    """Whether the whole of a text is such a name; false for null."""
    return F.coalesce(c.rlike(f"{'(?i)' if either_case else ''}\\A(?:{pattern})\\z"), F.lit(False))


def clean_title(c: Column) -> Column:
    """Control characters as spaces, collapsed, 500 characters at most; empty is null."""
    return F.nullif(F.substring(collapse(F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", " ")), 1, 500), F.lit(""))


def resolve_href(folder: Column, href: Column) -> Column:
    """Path in the archive of a link relative to a folder."""
    raw = F.when(folder != "", F.concat_ws("/", folder, href)).otherwise(href)
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(raw, "/"),
        empty,
        lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    return F.array_join(parts, "/")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of the text: all columns but it, block_idx and line."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("block_idx", "line"))
