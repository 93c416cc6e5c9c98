"""Deterministic stand-ins for models and services, so that oracles can restate model calls."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd


def _h(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16)


class HashLogitModel:
    """Deterministic stand-in for an encoder classifier (tests, oracle checks).

    ``s = sum(ids[i] * (i + 1))``; logits ``((s % 2001) - 1000) / 1000`` and
    ``((7 s % 2001) - 1000) / 1000``.
    """

    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        if len(batch) == 0:
            return np.empty((0, 2))
        ids = np.stack(batch["input_ids"].to_numpy()).astype(np.int64)   # one matrix per batch
        s = ids @ np.arange(1, ids.shape[1] + 1, dtype=np.int64)
        return np.column_stack((((s % 2001) - 1000) / 1000.0, ((s * 7 % 2001) - 1000) / 1000.0))


class HashShapeGenerator:
    """Deterministic stand-in for a generator: the output shape and answer
    come from md5 of the salted prompt (0 strict layout, 1 one-line layout, 2 no
    answer tag, 3 nothing)."""

    def __init__(self, salt: str = ""):
        self.salt = salt

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            h = _h(self.salt + p)
            yn = "Yes" if (h // 4) % 2 == 0 else "No"
            shape = h % 4
            if shape == 0:
                out.append(f"<reasoning>\n{len(p)}\n</reasoning>\n<answer>\n{yn}\n</answer>\n")
            elif shape == 1:
                out.append(f"<reasoning>short</reasoning> <answer>{yn}</answer>")
            elif shape == 2:
                out.append(f"Answer: {yn}")
            else:
                out.append(None)
        return out


class HashStubClient:
    """Deterministic stand-in for a remote chat API.

    ``complete(content, attempt)`` fails for md5(content) % ``fail_mod`` == 0
    (only on the first attempt when ``fail_once``); otherwise answers
    Yes/No with a short reasoning.
    """

    def __init__(self, fail_mod: int = 11, fail_once: bool = False):
        self.fail_mod = fail_mod
        self.fail_once = fail_once

    async def complete(self, content: str, attempt: int) -> tuple[str, str]:
        h = _h(content)
        if h % self.fail_mod == 0 and (attempt == 1 or not self.fail_once):
            raise RuntimeError("stub API error")
        return ("Yes" if (h // 16) % 2 == 0 else "No"), f"thought {h % 1000}"
