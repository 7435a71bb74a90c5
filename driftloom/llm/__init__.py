"""Operators for large text corpora, and the queries that apply them.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` hold what ``__spark_entry__`` registers.
"""
