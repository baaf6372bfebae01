"""From source tables to the summary table, and from there to one selection's outputs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame

from cohortspan.config import CohortConfig, Selection
from cohortspan.operators import detail, trend
from cohortspan.operators.extract import build_extract
from cohortspan.operators.gates import Gates
from cohortspan.operators.prep import prepare, summary_columns
from cohortspan.operators.summary import summarise_levels
from cohortspan.staging import stage


def build_app_data(
    sources: Mapping[str, DataFrame], cfg: CohortConfig, as_of: dt.date | None = None,
    snapshots: DataFrame | None = None, gates: Gates | None = None,
) -> DataFrame:
    """Extract, preparation and summary; ``gates`` measures what it is made from on the way.

    The extract is staged, as it is read three times, and without the columns
    the summary does not need: they then drop out of its last shuffles too.
    """
    extract = build_extract(sources, cfg, as_of=as_of, snapshots=snapshots).select(*summary_columns(cfg))
    return summarise_levels(prepare(stage(extract, "extract"), cfg), cfg, gates)


def selection_outputs(app: DataFrame, selection: Selection, cfg: CohortConfig) -> dict[str, DataFrame]:
    """Trend, description and detail table of one selection, from one filtered set.

    With genders and races the trend is cumulative over the range of years,
    without them it is monthly. The filtered set is persisted, as all outputs
    read it; it is returned as ``rows`` so that the caller can unpersist it.
    """
    with_subgroups = bool(selection.subgroup_values)
    if not with_subgroups and selection.first_year != selection.last_year:
        raise ValueError("a selection without subgroups covers one school year")
    rows = detail.scope_filter(app, selection).persist()
    if with_subgroups:
        lines = trend.trend_labels(trend.cumulative_trend(rows, cfg))
        note = detail.scope_note(rows)
    else:
        cfg = replace(cfg, subgroups=())
        lines = trend.trend_labels(trend.monthly_trend(rows, cfg), decimals=1)
        note = detail.scope_note_year(rows)
    return {
        "rows": rows, "trend": lines, "note": note,
        "table": detail.detail_table(rows, cfg.subgroups),
    }
