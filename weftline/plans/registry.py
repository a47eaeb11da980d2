"""The library's queries by name, with their SQL."""

from __future__ import annotations

from . import corpora, curating, evaluating, generating, retrieving, sampling  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
