"""Queries over the driver's tables, one for each operator, with the same rule in SQL where it has one."""

from .contracts import oracle_sql, queries
