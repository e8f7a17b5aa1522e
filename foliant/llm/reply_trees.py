"""Chat formatting from reply trees.

Messages know their parent. Self-joins find each message's ancestors by pointer doubling: after
round k every message holds its 2^k-th ancestor, its score over those steps, and its root, so
the rounds are logarithmic in the deepest thread. Leaves are ranked by the score of their path
(mean by default; ties go to the longer path, then the smaller leaf), the best leaves of each
tree are chosen, and their paths are enumerated by running the same jumps from the leaf. Each
path is formatted as one conversation.

Format: every turn is `<|turn|>` role newline text `<|end|>` newline. In roles and texts a backslash
is doubled and a control string gets a backslash after its first character, so a text can never
speak as the template and reading back restores it. The loss mask covers the texts of the trained
role.

Defined cases: null texts and roles are empty; a parent that is missing, null or in another tree
makes a root; messages on or under a cycle have no root and are left out; repeated messages are repeated turns when given as turns; an empty table gives an
empty one; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import _tools as tools

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings of this and other chat templates (fixed values).
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str | None, str | None]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the spans in it that the loss covers (code points)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n", escape(text or "")
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        at += len(OPEN)
        head = re.compile(r"(?:[^\\\n]|\\.)*", re.S).match(formatted, at).end()
        end = formatted.index(CLOSE, head + 1)
        turns.append((unescape(formatted[at:head]), unescape(formatted[head + 1 : end])))
        at = end + len(CLOSE)
    return turns


def chosen_paths(messages: DataFrame, per_tree: int = 1, score: str = "score", mean: bool = True) -> DataFrame:
    """(tree, leaf, depth, node) of the best `per_tree` root-to-leaf paths.

    messages: tree, node (unique), parent (null at roots) and the score column. Only these
    travel through the joins; texts stay behind.
    """
    m = messages.select("tree", "node", "parent", F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    known = m.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    m = m.join(known, (m.parent == known.pn) & m.tree.eqNullSafe(known.pt), "left").select("tree", "node", F.col("pn").alias("up"), "score")
    # `up` is the 2^k-th ancestor, total and steps cover the messages from node to before it.
    # A round works on the messages that had an ancestor in the last one; the others are done.
    jumps = [tools.stage(m.select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))]
    n = jumps[0].count()
    done = jumps[0].where("up is null")
    while 1 << (len(jumps) - 1) <= n:
        near = jumps[-1].where("up is not null")
        if not near.limit(1).count():
            break
        far = near.union(done).select(F.col("node").alias("fn"), F.col("up").alias("fu"), F.col("total").alias("ft"), F.col("steps").alias("fs"))
        joined = near.join(far, near.up == far.fn, "left")
        jumps.append(tools.stage(joined.select("tree", "node", F.col("fu").alias("up"), (F.col("total") + F.coalesce("ft", F.lit(0.0))).alias("total"), (F.col("steps") + F.coalesce("fs", F.lit(0))).alias("steps"))))
        done = done.union(jumps[-1].where("up is null"))
    inner = jumps[0].where("up is not null").select(F.col("up").alias("node")).distinct()
    value = F.col("total") / F.col("steps") if mean else F.col("total")
    leaves = done.join(inner, "node", "left_anti").withColumn("value", value)
    order = Window.partitionBy("tree").orderBy(F.desc("value"), F.desc("steps"), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)
    path = best.select("tree", F.col("node").alias("leaf"), "node", F.col("steps").alias("depth"))
    for k in range(len(jumps) - 2, -1, -1):  # the jumps of 2^k messages, from all found so far
        hop = jumps[k].where("up is not null").select(F.col("node").alias("hn"), "up", F.col("steps").alias("hs"))
        path = tools.stage(path.union(path.join(hop, path.node == hop.hn).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - F.col("hs")).alias("depth"))))
    return path.dropDuplicates(["leaf", "node"]).select("tree", "leaf", "depth", "node")


def format_paths(paths: DataFrame, messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """tree, leaf, n_turns, formatted and loss_spans of each path.

    The turns of one path come together in one row, which is what the output is.
    """
    texts = messages.select("node", "role", "text")
    turns = paths.join(texts, "node").groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):  # bounded strings in memory
                part = batch.slice(begin, 64)
                made = [render([(t["role"], t["text"]) for t in turns], trained) for turns in part.column(2).to_pylist()]
                n = pa.array([len(t) for t in part.column(2)], pa.int64())
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array([f for f, _ in made], pa.string()), spans], ["tree", "leaf", "n_turns", "formatted", "loss_spans"])

    kind = {c: turns.schema[c].dataType.simpleString() for c in ("tree", "leaf")}
    return turns.mapInArrow(run, f"tree {kind['tree']}, leaf {kind['leaf']}, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>")


def threads(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: every row replies to the row before it.

    A conversation's rows are ordered by turn (null first), role and text, so equal turns follow each
    other by role and text. The rows of one conversation are sorted in one task, which spills. A message's key is
    its conversation and its number in it.
    """
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    at = F.row_number().over(order)
    node = F.struct(F.col("tree").alias("t"), F.col("at").alias("n"))
    up = F.when(F.col("at") > 1, F.struct(F.col("tree").alias("t"), (F.col("at") - 1).alias("n")))
    return tools.stage(rows.withColumn("at", at).select("tree", node.alias("node"), up.alias("parent"), "role", "text", F.lit(1.0).alias("score")))


def format_trees(messages: DataFrame, per_tree: int = 1, mean: bool = True, trained: str = "assistant") -> DataFrame:
    """Best paths of reply trees (tree, node, parent, role, text, score), formatted."""
    return format_paths(chosen_paths(messages, per_tree, mean=mean), messages, trained)
