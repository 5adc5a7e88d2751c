"""The registered queries of the engine."""

from . import accuracy, extras, files, integration, performance  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
