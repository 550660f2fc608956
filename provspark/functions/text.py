"""Text functions used by the data preparation and the encoders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Own default lexicon of the rule-based sentiment scorer (fixed values).
NEGATIVE_WORDS = (
    "angry", "bad", "broken", "complaint", "disappointed", "error", "fail", "failed", "never",
    "problem", "refund", "scam", "terrible", "unacceptable", "unbelievable", "worst", "wrong",
)
POSITIVE_WORDS = (
    "awesome", "best", "excellent", "friendly", "good", "great", "happy", "helpful", "love",
    "nice", "perfect", "recommend", "satisfied", "thank", "thanks", "wonderful",
)


def contains_any(text: Column, needles) -> Column:
    """True if at least one of the substrings occurs in the text."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def tokens(text: Column) -> Column:
    """Pieces between single spaces; empty pieces count, the empty text has one."""
    return F.split(text, " ", -1)


def word_count(text: Column) -> Column:
    # One piece more than there are spaces (of one byte each): no array is built for a count.
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def char_count(text: Column) -> Column:
    return F.char_length(text)


def one_line(text: Column, separator: str = ",") -> Column:
    """Blank out the field separator and line breaks, as a delimited line needs it."""
    return F.translate(text, separator + "\n\r", " " * (len(separator) + 2))


def parse_date(text: Column, formats=(), strict: bool = True) -> Column:
    """ISO timestamps first, then the given patterns; unparsable text raises, or is null.

    ``strict=False`` yields null where nothing matches. Null stays null in both modes.
    """
    attempts = [F.try_to_timestamp(text)]
    attempts += [F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats]
    parsed = F.coalesce(*attempts)
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit("unparsable date: "), text)).cast("timestamp")
    return F.when(parsed.isNull() & text.isNotNull(), complaint).otherwise(parsed)


def lexicon_sentiment(text: Column, negative=NEGATIVE_WORDS, positive=POSITIVE_WORDS) -> Column:
    """``negative`` if more negative than positive words occur, else ``positive``."""
    words = F.split(F.lower(text), "[^a-z]+", -1)
    score = F.aggregate(
        words,
        F.lit(0),
        lambda acc, w: acc
        + F.when(w.isin(list(positive)), 1).when(w.isin(list(negative)), -1).otherwise(0),
    )
    return F.when(score < 0, "negative").otherwise("positive")
