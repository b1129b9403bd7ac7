"""Queries over the driver's tables, one or more for each operator."""

from . import domain, relational, scans
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "domain", "relational", "scans"]
