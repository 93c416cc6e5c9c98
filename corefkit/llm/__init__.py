"""Operators of a training-data pipeline over a table of documents.

One module per operator, each with its own general interface and a thin
``opN_<name>`` query. Nothing else in the library imports this package.
"""
