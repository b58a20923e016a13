"""The registered queries over the given tables, and their SQL twins."""

from gridtide.plans.oracle import ORACLE
from gridtide.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
