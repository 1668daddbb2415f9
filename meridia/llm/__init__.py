"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries in :mod:`meridia.llm.queries` apply them
to whole tables.
"""
