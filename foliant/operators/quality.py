"""Checks of translated text: local flags, guard reasons, routing, job outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T


def band(mode: str, source: str = "en", target: str = "hu") -> tuple[float, float]:
    """Healthy length ratios of a language pair; natural counts as balanced."""
    for s, t, _, b0, b1, f0, f1 in fixed.PAIRS:
        if (s, t) == (source, target):
            return (f0, f1) if mode == "fidelity" else (b0, b1)
    return fixed.UNMEASURED["fidelity" if mode == "fidelity" else "balanced"]


def band_of(source: Column, target: Column, mode: str) -> tuple[Column, Column]:
    """The same as columns, for pairs in data."""
    at = 5 if mode == "fidelity" else 3
    least, most = fixed.UNMEASURED["fidelity" if mode == "fidelity" else "balanced"]
    out = []
    for k, default in ((at, least), (at + 1, most)):
        c = F.when(F.lit(False), 0.0)
        for p in fixed.PAIRS:
            c = c.when((source == p[0]) & (target == p[1]), p[k])
        out.append(c.otherwise(default))
    return out[0], out[1]


def omission(source: Column, target: Column, least: Column, most: Column) -> Column:
    n = T.utf16_length(T.trim(source))
    ratio = F.try_divide(T.utf16_length(T.trim(target)), n)
    return F.coalesce((n >= fixed.OMISSION_MIN_CHARS) & ((ratio < least) | (ratio > most)), F.lit(False))


def flags(source: Column, target: Column, least: Column, most: Column, missing: Column) -> Column:
    """Array of tokens, omission and glossary, as far as they apply."""
    tokens = T.count_of(source, fixed.TOKEN_OPEN) != T.count_of(target, fixed.TOKEN_OPEN)
    found = F.array(F.when(tokens, "tokens"), F.when(omission(source, target, least, most), "omission"), F.when(missing > 0, "glossary"))
    return F.filter(found, lambda x: x.isNotNull())


def untranslated(text: Column, source: str, target: str) -> Column:
    """Reads as the source, has none of the target's own characters and doesn't read as the target."""
    if source == target or source not in fixed.STOPWORDS:
        return F.lit(False)
    out = (T.stopword_hits(text, source) >= fixed.LANGUAGE_HITS) & (T.stopword_hits(text, target) < fixed.LANGUAGE_HITS)
    # one character of its own settles it, before words are looked for
    return ~text.rlike(fixed.DISTINCTIVE[target]) & out if target in fixed.DISTINCTIVE else out


def guard(source: Column, target_html: Column, target: Column, pair: tuple[str, str] = ("en", "hu")) -> Column:
    """The first reason that applies: residual, refusal, foreign, untranslated; else null."""
    text = T.trim(target)
    enough = (T.utf16_length(T.trim(source)) >= fixed.GUARD_MIN_TEXT) & (T.utf16_length(text) >= fixed.GUARD_MIN_TEXT)
    return (
        F.when(T.has_residual(target_html), "residual")
        .when(text.rlike(f"(?i){T.LEFT}{fixed.REFUSAL}{T.RIGHT}"), "refusal")
        .when(text.rlike(fixed.CJK), "foreign")
        .when(enough & untranslated(text, *pair), "untranslated")
    )


def route(local: Column, score: Column, judged_omission: Column, judged_accuracy: Column, iteration: Column, mode: str) -> Column:
    """(action, deep, back_translate) of a draft; the first rule that applies."""
    severe = F.array_contains(local, "omission") | judged_omission | judged_accuracy | F.coalesce(score <= 2, F.lit(False))
    mild = F.coalesce(score == 3, F.lit(False)) | F.array_contains(local, "glossary") | F.array_contains(local, "tokens")

    def decision(action: str, deep: bool, back: bool) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(deep).alias("deep"), F.lit(back).alias("back_translate"))

    return (
        F.when(iteration >= 2, decision("accept", False, False))
        .when(severe, decision("refine", True, mode == "fidelity"))
        .when(mild, decision("refine", False, False))
        .otherwise(decision("accept", False, False))
    )


def outcome(stop: Column, ceiling_hit: Column, refused: Column, failed: Column) -> Column:
    """Status of a job whose chunks have ended."""
    return (
        F.when(stop == "pause", "paused")
        .when(stop.isNotNull(), "cancelled")
        .when(ceiling_hit, "error:ceiling")
        .when(refused > 0, "error:moderation_refusal")
        .when(failed > 0, "error:transient")
        .otherwise("done")
    )


def score_of(raw: Column) -> Column:
    """A judge's score from JSON, rounded into 1..5; null when absent or unreadable."""
    value = F.get_json_object(raw, "$.score").try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(value + 0.5)))).cast("int")
