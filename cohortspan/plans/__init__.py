"""End-to-end jobs put together from the operators."""

from cohortspan.plans.pipeline import build_app_data, selection_outputs
from cohortspan.plans.refresh import Refresh, drop_app_data, refresh_app_data

__all__ = ["Refresh", "build_app_data", "drop_app_data", "refresh_app_data", "selection_outputs"]
