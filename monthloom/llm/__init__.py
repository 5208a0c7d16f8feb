"""Operators for preparing training text, each an ordinary function on DataFrames.

Nothing outside this package imports it.  Documents are rows with ``doc_id`` and ``text``;
other columns may be present and are left alone.  See ``queries`` for how each operator is
applied to the driver's tables.
"""
