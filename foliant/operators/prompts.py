"""What is said to a model besides the text: agreed terms, known problems, context. Formats are fixed values.

The wording of a task (a system prompt) is the caller's; what varies by payload is rendered here, as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of a prompt.
TERMS_HEAD = "Maintain consistent translations for these names/terms across the whole book:"
TERM_OPEN = "(keep one consistent rendering)"
PROBLEMS_HEAD = "KNOWN PROBLEMS with this draft (fix these first):"
OMISSION = "- Part of the source appears to be missing or untranslated. Restore every sentence."
ACCURACY = "- Some meaning is wrong or invented. Check the draft against the source."
FLUENCY = "- The text reads awkward or unnatural. Fix the phrasing, keep the meaning."
GLOSSARY = "- These names/terms occur in the source but their agreed rendering is missing from the draft: "
TOKENS = "- A text-segment token or block marker was lost. Restore the exact set from the source."
CONTEXT_HEAD = "PRECEDING CONTEXT (for continuity only, do not translate):"
SOURCE_HEAD = "PRECEDING SOURCE (for reference resolution only, do not translate):"
TEXT_HEAD = "TEXT TO TRANSLATE:"


def terms(glossary: Column) -> Column:
    """Lines of an array of (term, rendering) in its order; empty without terms."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = lambda x: F.concat(F.lit("- "), quoted(x["term"]), F.when(F.coalesce(x["rendering"], F.lit("")) != "", F.concat(F.lit(" -> "), quoted(x["rendering"]))).otherwise(F.lit(f" {TERM_OPEN}")))
    return F.when(F.coalesce(F.size(glossary), F.lit(0)) > 0, F.array_join(F.concat(F.array(F.lit(TERMS_HEAD)), F.transform(glossary, line)), "\n")).otherwise("")


def problems(flags: Column, omission: Column, accuracy: Column, fluency: Column, missing: Column) -> Column:
    """What is known to be wrong with a draft, as a list that ends with an empty line; empty if nothing is."""
    has = lambda name: F.coalesce(F.array_contains(flags, name), F.lit(False))
    told = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text)
    listed = F.concat(F.lit(GLOSSARY), F.array_join(F.transform(missing, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("."))
    items = F.array_compact(F.array(told(F.coalesce(omission, F.lit(False)) | has("omission"), F.lit(OMISSION)), told(accuracy, F.lit(ACCURACY)), told(fluency, F.lit(FLUENCY)), told(F.size(missing) > 0, listed), told(has("tokens"), F.lit(TOKENS))))
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{PROBLEMS_HEAD}\n"), F.array_join(items, "\n"), F.lit("\n\n"))).otherwise("")


def with_context(text: Column, before: Column, source_before: Column) -> Column:
    """The text behind its contexts, the one that changes least first; as it is without any. Empty contexts are none."""
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'{head}\n"""'), c, F.lit('"""')))
    parts = F.array_compact(F.array(part(CONTEXT_HEAD, before), part(SOURCE_HEAD, source_before)))
    whole = F.array_join(F.array_append(parts, F.concat(F.lit(f"{TEXT_HEAD}\n"), text)), "\n\n")
    return F.when(F.size(parts) == 0, text).otherwise(whole)
