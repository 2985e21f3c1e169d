"""Registered queries and the SQL they are held against."""

from .oracles import ORACLE_SQL
from .queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
