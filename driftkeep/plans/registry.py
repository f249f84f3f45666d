"""Registered queries and the SQL that gives the same rows."""

from driftkeep.plans import files, reporting, retention, search, sweeps

_ENTRIES = search.ENTRIES | retention.ENTRIES | reporting.ENTRIES | sweeps.ENTRIES | files.ENTRIES
QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLE_SQL = {k: v[1] for k, v in _ENTRIES.items() if v[1]}
