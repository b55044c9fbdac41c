"""Operators that prepare text corpora for language-model training.

Nothing outside this package imports it. ``registry.queries()`` and
``registry.oracle_sql()`` hold the queries of the ten problems.
"""
