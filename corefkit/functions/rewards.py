"""Completion rewards (R1-R5) as column expressions.

Each reward is ``Column -> Column`` (double); ``score`` evaluates any list
of them in one projection and adds the total.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefkit.functions.parse import xml_answer
from corefkit.functions.text import WS, _c, match_start, occurrences, part

# The reference's reward patterns and weights.
STRICT_PATTERN = r"<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n$"
SOFT_PATTERN = r"<reasoning>.*?</reasoning>" + WS + r"*<answer>.*?</answer>"
CORRECT_REWARD = 2.0
FORMAT_REWARD = 0.5
TAG_REWARD = 0.125
TRAILING_PENALTY = 0.001


def correctness(completion, answer) -> Column:
    """R1 2.0 when the extracted answer equals ``answer`` exactly."""
    return F.when(xml_answer(completion) == _c(answer), F.lit(CORRECT_REWARD)).otherwise(F.lit(0.0))


def strict_format(completion) -> Column:
    """R2 0.5 for the exact one-line-reasoning layout."""
    return F.when(match_start(completion, STRICT_PATTERN), F.lit(FORMAT_REWARD)).otherwise(F.lit(0.0))


def soft_format(completion) -> Column:
    """R3 0.5 when reasoning and answer tags follow each other, each on one line."""
    return F.when(match_start(completion, SOFT_PATTERN), F.lit(FORMAT_REWARD)).otherwise(F.lit(0.0))


def xml_count(completion) -> Column:
    """R4 0.125 per tag found exactly once, minus 0.001 per trailing character.

    Terms are added in the reference's order so the doubles are identical.
    """
    s = _c(completion)
    tag = F.lit(TAG_REWARD)
    pen = F.lit(TRAILING_PENALTY)
    c = F.when(occurrences(s, "<reasoning>\n") == 1, F.lit(0.0) + tag).otherwise(F.lit(0.0))
    c = F.when(occurrences(s, "\n</reasoning>\n") == 1, c + tag).otherwise(c)
    c = F.when(occurrences(s, "\n<answer>\n") == 1,
               (c + tag) - F.length(part(s, "\n</answer>\n", -1)) * pen).otherwise(c)
    c = F.when(occurrences(s, "\n</answer>") == 1,
               (c + tag) - (F.length(part(s, "\n</answer>", -1)) - 1) * pen).otherwise(c)
    return c


RewardFn = Callable[[Column, Column], Column]

DEFAULT_REWARDS: dict[str, RewardFn] = {
    "xmlcount": lambda comp, ans: xml_count(comp),
    "soft_format": lambda comp, ans: soft_format(comp),
    "strict_format": lambda comp, ans: strict_format(comp),
    "correctness": lambda comp, ans: correctness(comp, ans),
}


def score(df: DataFrame, completion: str = "completion", answer: str = "answer",
          rewards: dict[str, RewardFn] | None = None,
          extra: Sequence[tuple[str, RewardFn]] = ()) -> DataFrame:
    """R5 one column per reward plus ``reward`` = their sum, in one select."""
    funcs = dict(rewards or DEFAULT_REWARDS)
    funcs.update(dict(extra))
    cols = {f"reward_{k}": f(F.col(completion), F.col(answer)) for k, f in funcs.items()}
    total = None
    for name in cols:
        total = F.col(name) if total is None else total + F.col(name)
    return df.withColumns(cols).withColumn("reward", total)
