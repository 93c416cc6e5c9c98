"""Inclusive word spans over whitespace tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corefkit.functions.text import _c, let, once, words


def _extract_words(w: Column, s: Column, e: Column) -> Column:
    n = F.size(w)
    stop = F.when(e < -1, F.greatest(F.lit(0), n + e + 1)).otherwise(e + 1)
    return F.when((s >= 0) & (e < n), F.array_join(F.slice(w, s + 1, F.greatest(F.lit(0), stop - s)), " "))


def extract_span(sentence, start, end) -> Column:
    """P1 ``' '.join(words[start:end+1])`` when ``start >= 0 and end < len``.

    Out of bounds or NULL offsets give NULL (the reference prints and
    returns None); ``end < start`` gives ''. A negative ``end`` follows
    Python's slice rule.
    """
    bound = F.struct(words(sentence).alias("w"), _c(start).alias("s"), _c(end).alias("e"))
    return let(bound, lambda b: _extract_words(b["w"], b["s"], b["e"]))


def pair_length(sentence1, sentence2) -> Column:
    """P2 words in sentence1 plus words in sentence2."""
    return F.size(words(sentence1)) + F.size(words(sentence2))


def _edit_at(w: Column, k: Column, prefix: str, suffix: str) -> Column:
    """``w`` with element ``k`` (0-based) wrapped in prefix/suffix.

    ``k`` is clamped into range so an invalid span never makes ``slice``
    fail; callers discard the result for invalid spans.
    """
    n = F.size(w)
    k = F.greatest(F.least(k, n - 1), F.lit(0))
    item = F.concat(F.lit(prefix), F.try_element_at(w, k + 1), F.lit(suffix))
    return F.concat(F.slice(w, 1, k), F.array(item), F.slice(w, k + 2, F.greatest(n - k - 1, F.lit(0))))


def mark_words(w: Column, start, end, on_bad_span: str = "null") -> Column:
    """P3 over an already split word array (slices and concat, no per-word lambda).

    The start word gets its ``*`` first and the end word second, like the
    reference's two assignments, so ``start == end`` gives ``*word*``.
    """
    n = F.size(w)
    s, e = _c(start), _c(end)
    s_eff = F.when(s < 0, s + n).otherwise(s)
    e_eff = F.when(e < 0, e + n).otherwise(e)
    ok = (s_eff >= 0) & (s_eff < n) & (e_eff >= 0) & (e_eff < n)
    first = F.struct(_edit_at(w, s_eff, "*", "").alias("w1"), e_eff.alias("e"), ok.alias("ok"))
    marked = let(first, lambda c: F.when(c["ok"], F.array_join(_edit_at(c["w1"], c["e"], "", "*"), " ")))
    if on_bad_span == "error":
        return F.coalesce(marked, F.raise_error(F.lit("trigger span outside the sentence")))
    return marked


def mark_span(sentence, start, end, on_bad_span: str = "null") -> Column:
    """P3 put ``*`` before the start word and after the end word.

    Negative indices wrap as in Python. An index outside the sentence
    gives NULL (``on_bad_span='null'``) or fails the job (``'error'``).
    The words and both offsets are bound once per row (``let``), so
    inlined inputs are never re-evaluated.
    """
    bound = F.struct(words(sentence).alias("w"), _c(start).alias("s"), _c(end).alias("e"))
    return let(bound, lambda b: mark_words(b["w"], b["s"], b["e"], on_bad_span))


def with_triggers(df):
    """Add ``e1_trigger``, ``e2_trigger`` and ``length`` to a pair table; each sentence is split into words once."""
    sides = {"w1": words("sentence1"), "w2": words("sentence2")}
    offsets = {f"{k}{i}": F.col(f"e{i}_trigger_{name}") for i in (1, 2) for k, name in (("s", "start"), ("e", "end"))}
    bound = F.struct(*[c.alias(k) for k, c in (sides | offsets).items()])
    row = let(bound, lambda b: F.struct(
        _extract_words(b["w1"], b["s1"], b["e1"]).alias("e1_trigger"), _extract_words(b["w2"], b["s2"], b["e2"]).alias("e2_trigger"),
        (F.size(b["w1"]) + F.size(b["w2"])).alias("length")))
    others = [c for c in df.columns if c not in ("e1_trigger", "e2_trigger", "length")]
    return df.select(*others, F.inline(F.array(row)))


def with_marked(df, on_bad_span: str = "null"):
    """Add ``marked1``/``marked2``: both sentences with triggers starred."""
    return once(df, {
        "marked1": mark_span("sentence1", "e1_trigger_start", "e1_trigger_end", on_bad_span),
        "marked2": mark_span("sentence2", "e2_trigger_start", "e2_trigger_end", on_bad_span),
    })
