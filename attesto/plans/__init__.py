"""Named queries over the test tables with their SQL."""

from . import analyses, documents, evaluation, experiments, questions, retrieval, runs, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
