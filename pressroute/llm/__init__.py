"""Operators for training-data pipelines. ``LLM_QUERIES`` and ``LLM_ORACLE`` hold their registered queries and SQL."""

from pressroute.llm.queries import LLM_ORACLE, LLM_QUERIES

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]
