"""String expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inside a character class: every character Python's str.strip() removes.
# Java's \s and Spark's trim know fewer of them.
SPACE = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
# Inside a character class: letters, digits and underscore of any script.
WORD = r"\p{L}\p{N}_"
# The characters of SPACE one by one.
_SPACE_CHARS = "".join(chr(i) for i in range(0x110000 >> 4) if chr(i).isspace())
# A run of whitespace that is not already one plain space.
_UNEVEN = f"(?: [{SPACE}]|[{SPACE}&&[^ ]])[{SPACE}]*"


def strip_text(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, _UNEVEN, " ")


def null_tokens_to_null(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~c.isin(list(tokens)), c)


def title_case_clean(c: Column) -> Column:
    """Strip, collapse whitespace, capitalise after every non-letter (``Bbq-Nation``, ``3Rd``)."""
    runs = F.regexp_extract_all(collapse_spaces(strip_text(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_list_spacing(c: Column) -> Column:
    """One space after each comma, none before."""
    return F.regexp_replace(strip_text(c), f"[{SPACE}]*,[{SPACE}]*", ", ")


def encode_yes_no(c: Column) -> Column:
    """yes -> 1, anything else (also null) -> 0."""
    return F.when(F.lower(strip_text(c)) == "yes", 1).otherwise(0)


def primary_value(c: Column, sep: str = ",", unknown: str | None = "Unknown") -> Column:
    """First element of a separated list; the placeholder becomes null."""
    first = strip_text(F.substring_index(c, sep, 1))
    return first if unknown is None else F.nullif(first, F.lit(unknown))


def unescape_newline(c: Column) -> Column:
    r"""The two characters ``\n`` become a space; real newlines inside the text stay."""
    return strip_text(F.replace(c, F.lit("\\n"), F.lit(" ")))


def clean_review_text(c: Column) -> Column:
    """Remove links, then odd characters, then surplus whitespace, then dot runs.

    Runs of odd characters and whitespace end up as one space, so one pattern
    does both; it skips the plain single spaces, which are most of them.
    """
    kept = f"{WORD}.,!?'-"
    text = F.regexp_replace(c, f"http[^{SPACE}]+|www[^{SPACE}]+", "")
    text = F.regexp_replace(text, f"[^ {kept}][^{kept}]*| [^{kept}]+", " ")
    text = F.regexp_replace(text, r"\.{2,}", ".")
    return strip_text(text)


def truncate_for_model(c: Column, n: int | None = None) -> Column:
    """Newlines to spaces, strip; the whole text, or its first ``n`` characters for a model that needs a limit."""
    text = strip_text(F.replace(c, F.lit("\n"), F.lit(" ")))
    return text if n is None else F.substring(text, 1, n)


def token_count(c: Column) -> Column:
    """Number of whitespace-separated tokens; 0 for a blank text."""
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def has_min_tokens(c: Column, n: int) -> Column:
    """At least n tokens; reads no further than the n-th."""
    return c.rlike(f"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{n - 1}}}[^{SPACE}]") if n > 0 else c.isNotNull()


def split_keywords(c: Column, k: int = 8) -> Column:
    return F.slice(F.transform(F.split(c, ","), strip_text), 1, k)


def join_keywords(c: Column) -> Column:
    return F.array_join(c, ", ")


def short_name(c: Column, n: int = 30) -> Column:
    return F.substring(c, 1, n)


def topic_short_name(c: Column, n: int = 12) -> Column:
    """Second part of ``3_delivery_late``; without an underscore the first ``n`` characters."""
    return F.when(c.contains("_"), F.split_part(c, F.lit("_"), F.lit(2))).otherwise(F.substring(c, 1, n))


def _pattern(query: str, mode: str) -> str:
    if mode not in ("regex", "literal"):
        raise ValueError(f"mode must be regex or literal, not {mode!r}")
    # In a literal every non-word character is escaped, which Java reads as itself.
    return "(?iu)(" + (query if mode == "regex" else re.sub(r"([^\w\s])", r"\\\1", query)) + ")"


def search_predicate(c: Column, query: str, mode: str = "regex") -> Column:
    """Case-insensitive contains; false for null text."""
    return F.coalesce(c.rlike(_pattern(query, mode)), F.lit(False))


def highlight_matches(
    c: Column, query: str, mode: str = "literal", start: str = "<mark>", end: str = "</mark>"
) -> Column:
    """Wrap each match; an empty query leaves the text alone."""
    return F.regexp_replace(c, _pattern(query, mode), f"{start}$1{end}") if query else c


def derive_label(
    keywords: Column,
    taxonomy: Sequence[tuple[str, Sequence[str]]],
    default: str = "Other complaints",
    split_phrases: bool = False,
) -> Column:
    """The category sharing most words with the keyword list; the first one wins ties.

    Without any overlap the first three keywords are joined and title-cased.
    The taxonomy is a literal, so this is one expression and needs no join.
    ``split_phrases`` also matches the single words of multi-word keywords.
    """
    words = F.transform(keywords, F.lower)
    if split_phrases:
        words = F.flatten(F.transform(words, lambda w: F.split(w, " ")))
    candidates = [
        F.struct(
            F.size(F.array_intersect(words, F.array(*[F.lit(s) for s in signals]))).alias("overlap"),
            F.lit(-ordinal).alias("ordinal"),
            F.lit(label).alias("label"),
        )
        for ordinal, (label, signals) in enumerate(taxonomy)
    ]
    best = F.array_max(F.array(*candidates))
    joined = title_case_clean(F.array_join(F.slice(keywords, 1, 3), " / "))
    return (
        F.when(best["overlap"] > 0, best["label"])
        .when(F.size(keywords) > 0, joined)
        .otherwise(F.lit(default))
    )
