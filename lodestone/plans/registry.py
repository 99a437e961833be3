"""Importing this module registers all queries in the catalogue."""

from . import analytic_queries, clause_queries, family_queries, function_queries, geography_queries, graph_queries, model_queries, relational_queries, script_queries, store_queries  # noqa: F401
