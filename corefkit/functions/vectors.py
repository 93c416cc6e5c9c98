"""Vector columns: argmax, softmax, shifted argmax, sentinel filtering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corefkit.functions.text import _c, let

IGNORE_INDEX = -100


def argmax(v) -> Column:
    """S14 0-based index of the first maximum."""
    x = _c(v)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def softmax(v) -> Column:
    """S15 ``exp(x - max) / sum(exp(x - max))``.

    The max and the sum are bound once per row so the per-element lambdas
    stay linear in the vector length.
    """
    x = _c(v).cast("array<double>")

    def shifted(b):
        ex = F.transform(b["x"], lambda t: F.exp(t - b["m"]))
        total = F.aggregate(ex, F.lit(0.0), lambda acc, u: acc + u)
        return let(F.struct(ex.alias("ex"), total.alias("s")), lambda c: F.transform(c["ex"], lambda t: t / c["s"]))

    return let(F.struct(x.alias("x"), F.array_max(x).alias("m")), shifted)


def shifted_argmax(m) -> Column:
    """S16 argmax per position of token logits, last position dropped."""
    x = _c(m)
    return F.transform(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda row: argmax(row))


def drop_ignored(a) -> Column:
    """S17 drop the ``-100`` sentinel."""
    return F.filter(_c(a), lambda t: t != IGNORE_INDEX)
