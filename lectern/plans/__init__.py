"""Named queries, each with the SQL that it is checked against."""

from lectern.plans import analytics, classify, evaluation, files, inference, mentions, relational, text  # noqa: F401
from lectern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
