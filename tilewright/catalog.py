"""The registry of the library's own queries and their SQL twins."""

from __future__ import annotations

from .plans import audits, classifiers, evaluation, keys, prep, splits, tiles  # noqa: F401
from .plans.base import ORACLE, QUERIES  # noqa: F401
