"""The registered queries of the library's own operators."""

from . import document_plans, evaluation_plans, retrieval_plans, runlog_plans, source_plans, streaming_plans, text_plans  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
