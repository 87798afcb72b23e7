"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import cascade_queries, hint_queries, household_queries, ingest_queries, ledger_queries, matching_queries, rule_queries, statement_queries, text_queries, trip_queries

QUERIES = {**ledger_queries.QUERIES, **matching_queries.QUERIES, **text_queries.QUERIES, **ingest_queries.QUERIES, **cascade_queries.QUERIES, **rule_queries.QUERIES, **statement_queries.QUERIES, **trip_queries.QUERIES, **hint_queries.QUERIES, **household_queries.QUERIES}
ORACLE_SQL = {**ledger_queries.ORACLE_SQL, **matching_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **ingest_queries.ORACLE_SQL, **cascade_queries.ORACLE_SQL, **rule_queries.ORACLE_SQL, **statement_queries.ORACLE_SQL, **trip_queries.ORACLE_SQL, **hint_queries.ORACLE_SQL, **household_queries.ORACLE_SQL}
