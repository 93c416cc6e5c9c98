"""One instance of a model or tokenizer per Python worker."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable


def once_per_worker(factory: Callable[[], object]) -> Callable[[], object]:
    """``factory`` as a getter that makes one instance per Python worker.

    The key is drawn here, on the driver, once per call of an operator: a worker
    that Spark reuses drops what an earlier call left there.
    """
    key = uuid.uuid4().hex

    def get() -> object:
        # functions travel by value, so the instance is held by the worker process itself
        held = sys.modules.setdefault("_corefkit_instance", types.ModuleType("_corefkit_instance"))
        if getattr(held, "key", None) != key:
            held.key, held.value = None, None
            held.value = factory()
            held.key = key
        return held.value

    return get
