"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  The queries that apply the operators to
the given tables are in :mod:`lapidary.llm.catalog`.
"""
