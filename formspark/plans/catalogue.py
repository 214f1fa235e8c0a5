"""All queries of the form operators and their SQL."""

from __future__ import annotations

from formspark.plans import fields, flagship, images, layout, records  # noqa: F401  they register
from formspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
