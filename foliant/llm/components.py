"""Connected components of a link table by alternating large and small stars.

Each round re-hangs every node's larger neighbours, then its smaller ones, on the least node
near it. The number of links never grows and rounds are logarithmic in the longest chain. Links
stay in tables: nothing but a count and a checksum reaches the driver. A node with very many
links meets its own minimum in a join whose large side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import _tools as tools


def _large_star(links: DataFrame) -> DataFrame:
    """Links (v, m) for each u and its larger neighbours v, m being the least of u and them all."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links of each b and its smaller neighbours a to the least of these."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    hung = links.join(least, "b")
    return hung.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of one type to (node, root), root the least node of the component.

    Order and direction of links, repeats and links of a node to itself make no difference; nodes
    without a link to another are absent; no links give an empty table.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links, seen = tools.stage(links), None
    while True:
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now[0] == 0 or tuple(now) == seen:
            break
        seen = tuple(now)
        links = tools.stage(_small_star(_large_star(links)))
    hung = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return hung.union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))
