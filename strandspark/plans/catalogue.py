"""All registered queries of the engine."""

from . import cases, documents, experiments, regressions, reports, retrieval, search, tables

QUERIES = {**retrieval.QUERIES, **documents.QUERIES, **tables.QUERIES, **experiments.QUERIES, **cases.QUERIES, **search.QUERIES, **reports.QUERIES, **regressions.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **documents.ORACLE_SQL, **tables.ORACLE_SQL, **experiments.ORACLE_SQL, **cases.ORACLE_SQL, **search.ORACLE_SQL, **reports.ORACLE_SQL, **regressions.ORACLE_SQL}
