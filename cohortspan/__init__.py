"""Cohort completion analytics as Spark DataFrame jobs."""

from cohortspan.config import CohortConfig, Selection
from cohortspan.staging import stage

__all__ = ["CohortConfig", "Selection", "stage"]
