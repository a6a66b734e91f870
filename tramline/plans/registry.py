"""Queries of the library for the driver, with their SQL."""

from tramline.plans import catalog_queries, exchange_queries, network_queries, path_queries, profile_queries, required_queries, timetable_queries

_MODULES = (timetable_queries, catalog_queries, required_queries, path_queries, exchange_queries, profile_queries, network_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in _MODULES for name, text in m.ORACLE_SQL.items()}
