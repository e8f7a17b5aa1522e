"""Line dedup by a log-template tree, in DataFrame operations only.

Tokens with digits become a wildcard. A line's leaf in the tree is its token count and its leading
tokens; in a leaf, lines that agree with its commonest line at most positions share that line's
template, the rest vote again, and so on until every line has a template. A round elects several
templates of a leaf at once, four times as many in each round up to `most_elected`, so a ballot has a bounded size and rounds are few. A
template is boilerplate when it recurs in at least `min_contexts` different documents that are no
copies, or with as many different lines before it and after it, and its lines are then dropped
everywhere. A document is a copy when templates that recur in `min_contexts` different documents
hold more than `max_shared` of its tokens; copies are no evidence and are left for near-duplicate
search, which keeps one. So the lines of a block of any length count, though they recur with the
same neighbours.

Only hashes are shuffled, but for the distinct lines of leaves that hold several; those of a hot leaf are
compared with its elected templates in a join whose large side Spark may split. A template in a
third of all documents is counted by (template, neighbour) before it is counted by template.

Defined cases: null texts stay null and have no lines; lines without a word are kept and are nobody's
neighbour; the only line of a document is no evidence (it has no neighbour); lines of fewer
than `min_words` words besides numbers are kept (rows of figures); repeated rows count as rows; an empty table gives an empty one;
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import _tools as tools


@dataclass(frozen=True)
class Tree:
    depth: int = 4  # leading tokens of a leaf
    min_words: int = 4  # shorter lines are never dropped
    min_generalised: int = 8  # shorter lines have no variable fields but digits
    min_agreement: float = 0.7  # share of equal positions that joins a template
    elected: int = 16  # templates of a leaf in the first round; results don't depend on it
    most_elected: int = 1024  # in any round
    min_contexts: int = 5  # different documents, or different neighbours on either side
    max_shared: float = 0.5  # share of recurring tokens beyond which a document is a copy


def _masked(line: Column) -> Column:
    """The line with single spaces and every token that holds a digit as a wildcard."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    spaced = F.regexp_replace(bare, tools.SPACES, " ")
    return F.when(bare.rlike(r"[0-9\x09\x0B-\x0D]|  "), F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(bare)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _exploded(docs: DataFrame, text: str, tree: Tree) -> DataFrame:
    """One row per line with words: doc, total (tokens of doc), pos, h (masked line), before, after, leaf, line, n_tokens."""
    d = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc"), F.filter(_lines(F.col(text)), lambda x: x.rlike(tools.WORD)).alias("lines"))
    d = d.withColumn("lines", F.transform("lines", _masked))
    joined = F.array_join("lines", " ")
    d = d.withColumn("total", F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)
    d = d.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("n", F.size("lines"))
    edge = F.array(F.when(F.col("n") > 1, F.col("doc")))
    before = F.concat(edge, F.slice("h", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))))
    after = F.concat(F.slice("h", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), edge)
    zipped = F.arrays_zip(F.col("h").alias("h"), before.alias("before"), after.alias("after"), F.col("lines").alias("line"))
    d = d.select("doc", "total", F.posexplode(zipped).alias("pos", "x")).select("doc", "total", "pos", F.col("x.h").alias("h"), F.col("x.before").alias("before"), F.col("x.after").alias("after"), F.col("x.line").alias("line"))
    n_tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    n_fields = (F.length("line") - F.length(F.replace("line", F.lit("<*>"), F.lit("")))) / 3
    d = d.withColumn("n_tokens", n_tokens).where(F.col("n_tokens") - n_fields >= tree.min_words)
    leaf = F.xxhash64("n_tokens", F.substring_index("line", " ", tree.depth))
    return d.withColumn("leaf", F.when(F.col("n_tokens") >= tree.min_generalised, leaf))


def _generalised(docs: DataFrame, lines: DataFrame, text: str, tree: Tree) -> DataFrame:
    """(h, template) of the lines that share a template with a different line."""
    several = lines.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    several = tools.stage(several.where((F.col("n") >= tree.min_contexts) & (F.col("low") != F.col("high"))).select("leaf"))
    # only documents with a line in such a leaf are read again
    having = tools.stage(lines.join(tools.broadcast_if_small(several), "leaf").select(F.col("doc").alias("__doc")).distinct())
    having = tools.broadcast_if_small(having)
    again = docs.join(having, F.xxhash64(F.coalesce(docs[text], F.lit(""))) == having["__doc"], "left_semi")
    texts = _exploded(again, text, tree).join(tools.broadcast_if_small(several), "leaf")
    left = tools.stage(texts.groupBy("leaf", "h").agg(F.count("*").alias("n"), F.min("line").alias("line")).withColumn("tokens", F.split("line", " ")))

    def agrees(a: Column, b: Column) -> Column:
        same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        return same >= tree.min_agreement * F.size(a)

    found, elected = [], tree.elected
    while left.limit(1).count():
        place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("n"), "line"))
        top = left.withColumn("place", place).where(F.col("place") <= elected)
        by_place = top.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", "tokens"))).alias("top"))
        # a line is elected unless it agrees with one elected before it
        none = F.array().cast("array<array<string>>")
        ballot = F.aggregate("top", none, lambda won, x: F.when(F.exists(won, lambda w: agrees(w, x["tokens"])), won).otherwise(F.array_append(won, x["tokens"])))
        votes = tools.stage(by_place.select("leaf", ballot.alias("patterns")))
        first = F.get(F.filter("patterns", lambda p: agrees(p, F.col("tokens"))), F.lit(0))
        voted = tools.stage(left.join(tools.broadcast_if_small(votes), "leaf").withColumn("pattern", first).drop("patterns"))
        found.append(voted.where("pattern is not null").select("h", F.xxhash64("leaf", F.array_join("pattern", " ")).alias("template")))
        left, elected = voted.where("pattern is null").drop("pattern"), min(4 * elected, tree.most_elected)
    every = found[0] if found else left.select("h", F.col("h").alias("template"))
    for f in found[1:]:
        every = every.union(f)
    return tools.stage(every)


def boilerplate(docs: DataFrame, text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """(doc, h): the masked lines to drop of every text, both as hashes."""
    lines = tools.stage(_exploded(docs, text, tree).drop("line"))
    known = tools.broadcast_if_small(_generalised(docs, lines, text, tree))
    for c in ("h", "before", "after"):  # neighbours are compared by template too
        of = known.select(F.col("h").alias(f"{c}_h"), F.col("template").alias(f"{c}_t"))
        lines = lines.join(of, F.col(c) == F.col(f"{c}_h"), "left")
    marked = lines.select("doc", "pos", "h", "total", "n_tokens", *(F.coalesce(f"{c}_t", c).alias(n) for c, n in (("h", "t"), ("before", "b"), ("after", "a"))))
    seen = marked.groupBy("t").agg(*(F.count_distinct(c).alias(f"n_{c}") for c in ("b", "a", "doc")))
    around = (F.col("n_b") >= tree.min_contexts) & (F.col("n_a") >= tree.min_contexts)
    common = F.col("n_doc") >= tree.min_contexts
    recurring = tools.stage(seen.select("t", around.alias("around"), common.alias("common")).where("around or common"))
    hits = tools.stage(marked.join(tools.broadcast_if_small(recurring), "t").select("doc", "pos", "h", "t", "total", "n_tokens", "around", "common"))
    own = tools.stage(hits.where("common").select("doc", "pos", "t", "total", "n_tokens").distinct())  # repeated texts once
    shared = own.groupBy("doc").agg(F.sum("n_tokens").alias("shared"), F.first("total").alias("total"))
    originals = tools.stage(shared.where(F.col("shared") <= tree.max_shared * F.col("total")).select("doc"))
    evidence = own.join(tools.broadcast_if_small(originals), "doc", "left_semi").groupBy("t").agg(F.count_distinct("doc").alias("n"))
    told = tools.stage(evidence.where(F.col("n") >= tree.min_contexts).select("t"))
    by_document = hits.join(tools.broadcast_if_small(told), "t").select("doc", "h")
    return hits.where("around").select("doc", "h").union(by_document).distinct()


def _dropped(docs: DataFrame, text: str, tree: Tree) -> DataFrame:
    """docs with __drop, the hashes of the masked lines that go (null: none)."""
    pairs = boilerplate(docs, text, tree)
    drops = tools.broadcast_if_small(tools.stage(pairs.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("h").alias("__drop"))))
    own = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(drops, own == drops["__doc"], "left").drop("__doc")


def _kept(text: Column) -> Column:
    """The lines that stay, as an array."""
    return F.filter(_lines(text), lambda x: ~(x.rlike(tools.WORD) & F.array_contains("__drop", F.xxhash64(_masked(x)))))


def drop_lines(docs: DataFrame, text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """The documents with boilerplate lines cut from the text; the columns of docs."""
    cut = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(_kept(F.col(text)), "\n"))
    return _dropped(docs, text, tree).withColumn(text, cut).select(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = F.when(F.col("__drop").isNotNull(), _kept(F.col("text")))
    d = _dropped(slim, "text", tree).withColumn("__stay", cut)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    kept = F.when(F.col("__stay").isNull(), F.col("text")).otherwise(F.array_join("__stay", "\n"))
    return d.select("doc_id", n.alias("n_lines"), F.when(F.col("__stay").isNull(), 0).otherwise(n - F.size("__stay")).cast("long").alias("n_dropped"), kept.alias("kept"))
