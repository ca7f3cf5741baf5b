"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import annotated, domain, nulls, records, results, signals, statistics, whole

QUERIES = {**statistics.QUERIES, **domain.QUERIES, **signals.QUERIES, **whole.QUERIES, **records.QUERIES, **nulls.QUERIES, **annotated.QUERIES, **results.QUERIES}
SQL = {**statistics.SQL, **domain.SQL, **signals.SQL, **whole.SQL, **records.SQL, **nulls.SQL, **annotated.SQL, **results.SQL}
