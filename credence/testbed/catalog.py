"""All registered queries."""

from credence.testbed import batch, retrieval, storage  # noqa: F401  (importing registers)
from credence.testbed.registry import QUERIES

__all__ = ["QUERIES"]
