"""The entry module registers every corpus query."""

import re


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    numbers = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
