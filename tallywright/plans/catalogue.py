"""Importing this module registers every query."""

from tallywright.plans import applications, extraction, files, images, intake, statements, stubs  # noqa: F401
from tallywright.plans.registry import ORACLES, QUERIES  # noqa: F401
