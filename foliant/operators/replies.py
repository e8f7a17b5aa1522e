"""What is taken from the replies of a model: usage, weak blocks, renderings of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T


def _number(raw: Column, path: str) -> Column:
    """A JSON number; null for anything else, text that looks like one included."""
    v = F.try_parse_json(raw)
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))


def usage(raw: Column) -> Column:
    """Struct of input, output and cached tokens by either set of names, 0 where absent."""
    first = lambda *paths: F.coalesce(*(_number(raw, f"$.{p}") for p in paths), F.lit(0.0)).cast("long")
    return F.struct(
        first("prompt_tokens", "input_tokens").alias("input"),
        first("completion_tokens", "output_tokens").alias("output"),
        first("prompt_tokens_details.cached_tokens", "total_cached_tokens").alias("cached"),
    )


def weak_blocks(raw: Column) -> Column:
    """The whole numbers from 0 on in the verdict's weak_blocks; null without one."""
    found = F.from_json(F.get_json_object(raw, "$.weak_blocks"), "array<variant>")
    whole = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(v, "$", "double") >= 0) & (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")))
    kept = F.transform(F.filter(found, whole), lambda v: F.try_variant_get(v, "$", "double").cast("int"))
    return F.when(F.size(kept) > 0, kept)


def accepted_renderings(requests: DataFrame, key: str, terms: str, reply: str) -> DataFrame:
    """key, term, rendering: what a reply says of terms that were asked for, trimmed and not blank."""
    said = requests.select(key, terms, F.explode(F.from_json(reply, "map<string,variant>")).alias("term", "v"))
    text = T.trim(F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")))
    return said.where(F.array_contains(terms, F.col("term"))).select(key, "term", text.alias("rendering")).where("rendering <> ''")
