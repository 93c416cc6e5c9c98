"""corefkit: Spark-native processing of labelled event-mention pairs.

Ingest raw pairs, extract and mark triggers, sample training sets, build
prompts and encoder inputs, run pluggable models over Arrow batches, parse
and score their output, and compute evaluation reports and curve tables.
Everything except the model call is a DataFrame expression planned by
Catalyst.
"""

import sys

from pyspark import cloudpickle

from corefkit.session import build_session, shared_dir

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_dir"]
