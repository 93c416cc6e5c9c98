"""Parsers from model output to predictions.

Invalid answers are NULL, never a sentinel string or -1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corefkit.functions.text import _c, contains, has_word, occurrences, part, strip

# The markers the reference's parsers split on.
ANSWER_MARKER = "Answer:"
ANSWER_OPEN = "<answer>"
ANSWER_CLOSE = "</answer>"
THINK_CLOSE = "</think>"


def answer_after_marker(s) -> Column:
    """N1 ``s.split('Answer:')[-1].strip()``."""
    return strip(part(s, ANSWER_MARKER, -1))


def yes_no(s) -> Column:
    """N2 'yes' anywhere -> 1, else 'no' anywhere -> 0, else NULL.

    Substring tests: 'eyes' is yes, 'cannot' and 'know' are no.
    """
    x = F.lower(_c(s))
    return F.when(contains(x, "yes"), F.lit(1)).when(contains(x, "no"), F.lit(0))


def yes_else_no(s) -> Column:
    """N3 'yes' anywhere -> 1 else 0; NULL only for a NULL input."""
    return contains(F.lower(_c(s)), "yes").cast("int")


def tagged_answer(s) -> Column:
    """N4 text between the first and second ``<answer>``; N2 on it.

    No ``<answer>`` at all is invalid; a closing tag is not needed.
    """
    return F.when(contains(s, ANSWER_OPEN), yes_no(part(s, ANSWER_OPEN, 2)))


def xml_answer(s) -> Column:
    """N5 after the last ``<answer>``, before the next ``</answer>``, stripped."""
    return strip(part(part(s, ANSWER_OPEN, -1), ANSWER_CLOSE, 1))


def after_think(s) -> Column:
    """N6 N2 on the text after the last ``</think>``; no tag -> invalid."""
    return F.when(contains(s, THINK_CLOSE), yes_no(strip(part(s, THINK_CLOSE, -1))))


def label_from_text(text) -> Column:
    """N7 whole word 'yes' (case-insensitive) -> 1, else 0."""
    return has_word(text, "yes").cast("int")


def count_tag(s, tag: str) -> Column:
    return occurrences(s, tag)
