"""Completion over the months of the academic year, one line per scope.

A line is a school, a district or the state, within one combination of
subgroups. Each trend is a plain aggregation: the months become conditional
sums, so missing months, the denominators and the running totals all come out
of one wide row per line, which is then unfolded into one row per month. The
same job serves one selection or every school at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan import config as c
from cohortspan.config import CohortConfig
from cohortspan.functions import columns as col
from cohortspan.functions.relational import complete_grid, fill_downup, null_safe_join
from cohortspan.staging import stage

# With the subgroups these identify a line. Districts and the state carry their
# sentinel labels, so equal school and district names stay apart.
LINE = ("level", "DistrictName", "SchoolName")


def _line_keys(cfg: CohortConfig) -> list[str]:
    return [*LINE, *cfg.subgroups]


def completed_rows(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Complete rows received in a trend month, race known where race is a subgroup."""
    rows = app.filter(
        (F.col("completedFAFSA") == cfg.complete) & F.col("month_idx").between(1, cfg.trend_months)
    )
    return rows.filter(F.col("race") != c.MISSING_RACE) if "race" in cfg.subgroups else rows


def _with_label(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "group", col.line_label(F.col("level"), F.col("DistrictName"), F.col("SchoolName"))
    ).withColumn("group_idx", col.level_index(F.col("level")))


def _month_totals(cfg: CohortConfig) -> list[Column]:
    """One sum of ``n`` per trend month."""
    return [
        F.expr(f"coalesce(sum(n) FILTER (WHERE month_idx = {month}), 0) AS m{month}")
        for month in range(1, cfg.trend_months + 1)
    ]


def _unfold(wide: DataFrame, keys: Sequence[str], cfg: CohortConfig, cumulative: bool) -> DataFrame:
    """One row per month from the wide rows."""
    months = []
    for month in range(1, cfg.trend_months + 1):
        fields = f"{month} AS month_idx, '{c.MONTHS[month - 1]}' AS ApplicationReceiptMonth, m{month} AS completed"
        if cumulative:
            fields += ", " + " + ".join(f"m{m}" for m in range(1, month + 1)) + " AS cum_completed"
        months.append(f"struct({fields})")
    long = wide.select(*keys, "seniors", F.expr(f"inline(array({', '.join(months)}))"))
    part = F.col("cum_completed" if cumulative else "completed")
    return long.withColumn("completion_rate", col.rate(part, F.col("seniors")))


def _pooled_lines(app: DataFrame, cfg: CohortConfig, *per: str) -> DataFrame:
    """Wide cumulative lines: months and pooled denominator per line.

    Grouping by year and denominator first makes every denominator count once
    per year, however many rows repeat it.
    """
    keys = _line_keys(cfg)
    per_year = completed_rows(app, cfg).groupBy(*keys, "SchoolYear", "seniors").agg(*_month_totals(cfg))
    keys = [*keys, *per]
    months = [f"m{m}" for m in range(1, cfg.trend_months + 1)]
    return per_year.groupBy(*keys).agg(
        F.coalesce(F.sum("seniors"), F.lit(0)).alias("seniors"),
        *[F.sum(m).alias(m) for m in months],
    )


def cumulative_trend(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Share of the cohort that had completed by the end of each month.

    Lines without a completion in the trend months do not appear.
    """
    lines = _with_label(_pooled_lines(app, cfg))
    keys = ["group", "group_idx", "level", *cfg.subgroups]
    return _unfold(lines, keys, cfg, cumulative=True)


def pooled_denoms(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Denominator of each line over the selected years."""
    keys = _line_keys(cfg)
    pooled = (
        completed_rows(app, cfg)
        .select(*keys, "SchoolYear", "seniors")
        .distinct()
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("seniors"), F.lit(0)).alias("seniors"))
    )
    return _with_label(pooled).select("group", "group_idx", "level", *cfg.subgroups, "seniors")


def monthly_completed(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Completions of each line in the months that have any, with the denominator."""
    keys = ["group", "group_idx", "level", *cfg.subgroups]
    monthly = (
        _with_label(completed_rows(app, cfg))
        .groupBy(*keys, "month_idx", "ApplicationReceiptMonth")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("completed"))
    )
    return null_safe_join(monthly, pooled_denoms(app, cfg), keys, "left")


def complete_months(monthly: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Every line in every trend month; added rows count 0, denominator open."""
    keys = ["group", "group_idx", "level", *cfg.subgroups]
    months = range(1, cfg.trend_months + 1)
    full = complete_grid(
        monthly.drop("ApplicationReceiptMonth"), keys, "month_idx", list(months), {"completed": 0}
    )
    return full.withColumn("ApplicationReceiptMonth", col.month_name(F.col("month_idx")))


def fill_denominators(monthly: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Give added months the denominator of their line."""
    keys = ["group", "group_idx", "level", *cfg.subgroups]
    return fill_downup(monthly, keys, "month_idx", "seniors")


def trend_labels(trend: DataFrame, decimals: int = 0) -> DataFrame:
    """Short month names and the rate as text."""
    return trend.withColumns(
        {
            "month_label": col.month_abbreviation(F.col("ApplicationReceiptMonth")),
            "rate_label": col.percent_text(F.col("completion_rate"), decimals),
        }
    )


def _monthly_lines(app: DataFrame, cfg: CohortConfig) -> tuple[DataFrame, list[str]]:
    """Wide monthly lines and their keys.

    Every scope of the data is a line, with or without completions. A line is
    one scope by code, so no two counts are ever added up.
    """
    keys = ["level", "SchoolYear", "DistrictCode", "DistrictName", "SchoolCode", "SchoolName",
            "Grade", *cfg.subgroups]
    done = F.when(F.col("completedFAFSA") == cfg.complete, F.col("n")).alias("n")
    rows = app.select(*keys, "seniors", "month_idx", done)
    wide = rows.groupBy(*keys, "seniors").agg(*_month_totals(cfg))
    return _with_label(wide), ["group", "group_idx", *keys]


def monthly_trend(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Share of the cohort that completed within each month, per school year."""
    wide, keys = _monthly_lines(app, cfg)
    return _unfold(wide, keys, cfg, cumulative=False)


def monthly_trend_empty(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """The monthly lines that have no completion in any trend month."""
    wide, keys = _monthly_lines(app, cfg)
    empty = " AND ".join(f"m{month} = 0" for month in range(1, cfg.trend_months + 1))
    return _unfold(wide.filter(empty), keys, cfg, cumulative=False)


def _with_requests(app: DataFrame, lines: DataFrame, cfg: CohortConfig, *per: str) -> DataFrame:
    """Every school's own line, its district's and the state's, by equi-join.

    Lines of a school are asked for within the school's own categories, and
    separately for each value of the ``per`` columns.

    A third of the requests are for the state. While the lines are few they are
    broadcast, and no request moves; otherwise both sides of the join are bare
    shuffles, which adaptive execution splits where one line is in demand.
    """
    subgroups = list(cfg.subgroups)
    at_school = app.filter(
        (F.col("level") == "school") & F.col("DistrictName").isNotNull() & F.col("SchoolName").isNotNull()
    ).withColumnsRenamed({"DistrictName": "scope_district", "SchoolName": "scope_school"})
    scope = [*per, "scope_district", "scope_school"]
    scopes = at_school.select(*scope).distinct()
    if subgroups:
        # A school's own categories: short sets of labels, unfolded into its facets.
        scopes = at_school.groupBy(*scope).agg(*[F.collect_set(name).alias(name) for name in subgroups])
        for name in subgroups:
            scopes = scopes.withColumn(name, F.explode(name))

    def wanted(level: str, district: Column, school: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), district.alias("DistrictName"), school.alias("SchoolName")
        )

    district, school = F.col("scope_district"), F.col("scope_school")
    requests = scopes.select(
        *scope, *subgroups,
        F.inline(
            F.array(
                wanted("school", district, school),
                wanted("lea", district, F.lit(c.ALL_SCHOOLS)),
                wanted("state", F.lit(c.ALL_DISTRICTS), F.lit(c.ALL_SCHOOLS)),
            )
        ),
    )
    return requests.join(lines, [*LINE, *per, *subgroups])


def trend_all_scopes(
    app: DataFrame, cfg: CohortConfig, years: tuple[int, int] | None = None, per_year: bool = False
) -> DataFrame:
    """The cumulative trend of every school beside its district and the state.

    What a reader would see after picking each school in turn with all its
    genders and races, over all years or those from the first to the last of
    ``years``; with ``per_year`` also each of the years alone. Lines are computed
    once and staged, joined as wide rows, and the months are unfolded last.
    ``app`` is read twice.
    """
    if years is not None:
        app = app.filter(F.col("SchoolYear").between(*years))
    per = ("SchoolYear",) if per_year else ()
    pooled = stage(_pooled_lines(app, cfg, *per), "trend_lines")
    lines = _with_label(_with_requests(app, pooled, cfg, *per))
    keys = [*per, "scope_district", "scope_school", "group", "group_idx", "level", *cfg.subgroups]
    return _unfold(lines, keys, cfg, cumulative=True)


def monthly_trend_all_scopes(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """The monthly trend of every school, year by year, beside its district and the state."""
    wide, keys = _monthly_lines(app, cfg)
    lines = _with_requests(app, stage(wide, "trend_lines"), cfg, "SchoolYear")
    return _unfold(lines, ["scope_district", "scope_school", *keys], cfg, cumulative=False)
