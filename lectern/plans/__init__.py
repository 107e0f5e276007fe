"""Named queries over the test tables; importing this package registers all of them."""

from . import narrowing_queries, pdf_queries, report_queries, source_queries, state_queries, text_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
