"""One registry of named queries, each with its DuckDB oracle (or none).

Keeping the Spark callable and the oracle text in one entry means
``queries()`` and ``oracle_sql()`` cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    oracle: str | None
    inventory: tuple[str, ...]


_ENTRIES: dict[str, Entry] = {}


def register(name: str, oracle: str | None, *inventory: str):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``.

    ``oracle`` is DuckDB SQL over the pre-registered tables, or None for a
    rows-only check. ``inventory`` lists the SURVEY ids the entry covers.
    """

    def deco(fn: QueryFn) -> QueryFn:
        if name in _ENTRIES:
            raise ValueError(f"query {name!r} registered twice")
        _ENTRIES[name] = Entry(name, fn, oracle, tuple(inventory))
        return fn

    return deco


def _load_all() -> None:
    # Importing the plan modules fills the registry.
    from corefkit.plans import (  # noqa: F401
        q_evaluation, q_flows, q_ingest, q_models, q_prompts, q_reports, q_sampling, q_text,
    )


def entries() -> dict[str, Entry]:
    _load_all()
    return dict(_ENTRIES)
