"""Imports every module that registers queries."""

from tidemill.plans import audits, catalog, cleaning, loads, marts, taskstats, textjobs  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES  # noqa: F401
