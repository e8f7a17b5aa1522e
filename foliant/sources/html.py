"""XHTML and HTML bodies: leaf blocks by a small tree builder, text segments by expressions.

Rule for malformed markup: script, style and comments are dropped; a block tag that opens in its
own kind closes it; tags left open close with their parent; a leaf is a block without a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style"}


class _Tree(HTMLParser):
    """Elements as [tag, parts, holds a block]; parts are strings or elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ["", [], False]
        self.open, self.skipping, self.count = [self.root], 0, Counter()

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipping += 1
        if self.skipping:
            return
        if tag in fixed.BLOCK_TAGS and tag == self.open[-1][0]:
            self.close_last()
        if tag in _VOID:
            self.open[-1][1].append(self.get_starttag_text())
            return
        node = [tag, [self.get_starttag_text()], False]
        if tag in fixed.BLOCK_TAGS:
            for parent in reversed(self.open):
                if parent[2]:  # and so have all above
                    break
                parent[2] = True
        self.open[-1][1].append(node)
        self.open.append(node)
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if not self.skipping:
            self.open[-1][1].append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipping = max(0, self.skipping - 1)
            return
        if self.skipping or not self.count[tag]:
            return
        while True:
            node = self.close_last()
            node[1].append(f"</{node[0]}>")
            if node[0] == tag:
                return

    def close_last(self) -> list:
        node = self.open.pop()
        self.count[node[0]] -= 1
        return node

    def handle_data(self, data):
        if not self.skipping:
            self.open[-1][1].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def _written(node: list) -> str:
    """The parts of an element and of all below it, in order."""
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo.extend(reversed(part[1]))
    return "".join(out)


def _inner(node: list) -> str:
    """What lies between an element's tags."""
    return _written([node[0], node[1][1:]]).removesuffix(f"</{node[0]}>")


def _elements(node: list, stop: Callable[[list], bool] = lambda n: False) -> Iterator[list]:
    """Elements below the node in document order; nothing below those where stop holds."""
    todo = [x for x in reversed(node[1]) if isinstance(x, list)]
    while todo:
        now = todo.pop()
        yield now
        if not stop(now):
            todo.extend(x for x in reversed(now[1]) if isinstance(x, list))


def blocks_of(html: str) -> list[str]:
    """Inner HTML of the leaf blocks, in document order."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    body = next((n for n in _elements(tree.root) if n[0] == "body"), tree.root)
    leaf = lambda n: n[0] in fixed.BLOCK_TAGS and not n[2]
    return [_inner(n) for n in _elements(body, leaf) if leaf(n)]


def leaf_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, block_idx, inner_html, plain: one row per leaf block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(h or "") for h in batch.column(1).to_pylist()]
            rows = [i for i, b in enumerate(found) for _ in b]
            at = [j for b in found for j in range(len(b))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()), pa.array([x for b in found for x in b], pa.string())], [key, "block_idx", "inner_html"])

    kind = pages.schema[key].dataType.simpleString()
    blocks = pages.select(key, html).mapInArrow(run, f"{key} {kind}, block_idx long, inner_html string")
    return blocks.withColumn("plain", T.plain_text(F.col("inner_html")))


def text_segments(html: Column) -> Column:
    """Array of (leading, core, trailing) of the text nodes with a core."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    nodes = F.split(bare, "<[^>]*>")
    lead, trail = f"^{T.WS}*", f"{T.WS}*$"
    cut = F.transform(nodes, lambda x: F.struct(F.regexp_extract(x, lead, 0).alias("leading"), T.trim(x).alias("core"), F.regexp_extract(x, trail, 0).alias("trailing")))
    return F.filter(cut, lambda x: x["core"] != "")


def restore_segments(segments: Column, hits: Column) -> Column:
    """Text nodes with translated cores, escaped; null unless every segment has a translation."""
    bodies = F.transform(segments, lambda x, i: T.body_of(hits, i))
    texts = F.zip_with(segments, bodies, lambda s, b: F.concat(s["leading"], T.escape_entities(T.trim(b)), s["trailing"]))
    return F.when(F.forall(bodies, lambda b: b.isNotNull()), texts)


def body(html: Column) -> Column:
    """What is inside the body, or all of it without one."""
    inner = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)
    return F.when(html.rlike(r"(?is)<body\b[^>]*>.*</body\s*>"), inner).otherwise(html)


def title(html: Column, fallback: Column) -> Column:
    """Text of the first h1, h2 or title."""
    inner = F.regexp_extract(html, r"(?is)<(?:h1|h2|title)\b[^>]*>(.*?)</(?:h1|h2|title)>", 1)
    return F.coalesce(F.nullif(T.collapse(F.regexp_replace(inner, "<[^>]+>", "")), F.lit("")), fallback)


def reserialise(original: Column, body: Column) -> Column:
    """Prolog and doctype of the original put back before a body that lost them."""
    head = F.regexp_extract(original, r"(?is)^\s*((?:<\?xml.*?\?>\s*)?(?:<!doctype.*?>\s*)?)", 1)
    return F.when(body.rlike(r"(?is)^\s*<(\?xml|!doctype)"), body).otherwise(F.concat(head, body))
