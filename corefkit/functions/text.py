"""Python string semantics as JVM-side column expressions.

Every function takes and returns ``Column``; nothing here leaves the JVM,
so callers stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the 29 code points Python's str.split()/str.strip() treat as
# whitespace, as a Java regex character class.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same class by Unicode's White_Space, which is one test a character. ``WS`` takes a test for each of its
# ranges, which was a third to half of the time of the pair queries.
BLANK = r"[\x1c\x1d\x1e\x1f\p{IsWhite_Space}]"
# The same code points as a string.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The same class in RE2 notation, for DuckDB oracles.
WS_DUCK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    A one-element ``transform``: an expression used inside a lambda is
    otherwise re-evaluated for every element, and Catalyst may inline an
    expensive derived column into such a lambda when it pushes a filter down.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df.withColumns(columns)``, each evaluated once per row whatever reads it.

    Catalyst copies a derived column into the filters and projections above it, so that an
    expensive one is evaluated for each. It does not look into a generator, and this one
    gives exactly one row per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def words(s) -> Column:
    """S01 ``s.split()``: runs of Unicode whitespace, no empty items."""
    # array_remove is code-generated; a filter lambda would be interpreted.
    return F.array_remove(F.split(_c(s), BLANK + "+", -1), "")


def strip(s) -> Column:
    """S02 ``s.strip()``: ``trim`` over the code points of ``WS``, which looks at both ends only and runs no pattern."""
    return F.trim(_c(s), F.lit(WS_CHARS))


def lower(s) -> Column:
    """S03."""
    return F.lower(_c(s))


def contains(s, sub: str) -> Column:
    """S04 substring test."""
    return _c(s).contains(sub)


def has_word(s, word: str) -> Column:
    """S05 ``word in s.lower().split()``."""
    return F.array_contains(words(F.lower(_c(s))), word)


def part(s, sep: str, n: int) -> Column:
    """S06 ``s.split(sep)[k]`` with a literal separator.

    ``n`` is 1-based; negative counts from the end (-1 is the last part).
    A missing part is ''. ``split_part`` scans left to right without
    overlap, like Python, and builds no array.
    """
    return F.split_part(_c(s), F.lit(sep), F.lit(n))


def count_parts(s, sep: str) -> Column:
    """``len(s.split(sep))`` = occurrences + 1."""
    return occurrences(s, sep) + F.lit(1)


def occurrences(s, sub: str) -> Column:
    """S07 ``s.count(sub)``: non-overlapping occurrences."""
    x = _c(s)
    return ((F.length(x) - F.length(F.replace(x, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def match_start(s, pattern: str) -> Column:
    """S08 ``re.match(pattern, s)``: anchored at the start; ``.`` stops at
    newline only and ``$`` also matches before one final newline
    (Java's UNIX_LINES flag ``(?d)``)."""
    return _c(s).rlike("(?d)^(?:" + pattern + ")")


def length(s) -> Column:
    """S09 length in code points."""
    return F.length(_c(s))


def join_words(a) -> Column:
    """S10 ``' '.join(a)``."""
    return F.array_join(_c(a), " ")


def safe_div(a, b) -> Column:
    """S20 ``a / b if b > 0 else 0``."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def eps_div(a, b, eps: float = 1e-10) -> Column:
    """S20 ``a / (b + eps)``."""
    return _c(a).cast("double") / (_c(b).cast("double") + F.lit(eps))


def hash_int(s) -> Column:
    """First 32 bits of md5 as a non-negative bigint (stable across engines)."""
    return F.conv(F.substring(F.md5(_c(s).cast("string")), 1, 8), 16, 10).cast("bigint")


def timestamp_text(fmt: str = "yyyy-MM-dd HH:mm:ss", clock: Column | datetime.datetime | None = None) -> Column:
    """S18 a time as text (``%Y-%m-%d %H:%M:%S``): ``clock``, or else the time of the run, which is not repeatable."""
    at = F.current_timestamp() if clock is None else clock if isinstance(clock, Column) else F.lit(clock)
    return F.date_format(at, fmt)
