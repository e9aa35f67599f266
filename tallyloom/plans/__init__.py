"""Named queries over the driver tables, each with the SQL that checks it."""

from tallyloom.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
