"""Settings of the pipeline: lists, recodes and labels, all overridable.

The defaults are the values a result has to agree on; everything that reads
them takes a ``CohortConfig`` so another cohort or another measure can be run
through the same jobs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Codes, labels, names and formats the results must agree on.
# ---------------------------------------------------------------------------
EXCLUDED_SCHOOLS = (
    "516", "530", "650", "545", "655", "750", "689", "522",
    "630", "538", "108", "537", "514", "540", "977", "728",
)
COHORT_GRADE = "12"
MIN_YEAR = 2015
NA_TOKENS = ("", "NA", "NULL")
GENDER_LABELS = {"F": "Female", "M": "Male"}
RACE_LABELS = {
    "African American": "Black",
    "American Indian": "AI & AN",
    "Hispanic/Latino": "Latine",
    "Hawaiian": "NH & PI",
}
STATUS_LABELS = {"Y": "Complete", "N": "Incomplete"}
MONTHS = (
    "October", "November", "December", "January", "February", "March",
    "April", "May", "June", "July", "August", "September",
)
NO_RECEIPT = "No Receipt"
TREND_MONTHS = 9  # October to June
ALL_DISTRICTS = "All LEAs"
ALL_SCHOOLS = "All Schools"
STATE = "State"
LEVELS = ("school", "lea", "state")
MISSING_RACE = "NA"
EXPORT_PREFIX = "fafsa_completion"
NOTE = (
    "Showing ", " compared with ", " and the state for school year ",
    ". Rates are subgroup-specific within the selected gender and race filters.",
)
NOTE_YEAR = (
    "Showing monthly FAFSA completion percentages for ", ", compared with ",
    " and the state for school year ", ".",
)
DETAIL_NAMES = {
    "SchoolYear": "School Year",
    "DistrictName": "District Name",
    "SchoolName": "School Name",
    "Grade": "Grade",
    "gender": "Gender",
    "race": "Race",
    "ApplicationReceiptMonth": "Application Receipt Month",
    "completedFAFSA": "Status",
    "n": "Count",
    "seniors": "Seniors",
}
# ---------------------------------------------------------------------------

FIRST_MONTH = 10  # calendar number of MONTHS[0]
SUBGROUPS = ("gender", "race")


@dataclass(frozen=True)
class Subgroup:
    """Where a subgroup comes from: a column of the extract and labels for its codes."""

    source: str
    labels: Mapping[str, str]
    keeps_others: bool = False  # codes without a label stay as they are, else they are missing


@dataclass(frozen=True)
class CohortConfig:
    """One run's settings."""

    cohort_grade: str = COHORT_GRADE
    excluded_schools: tuple[str, ...] = EXCLUDED_SCHOOLS
    min_year: int = MIN_YEAR
    gender_labels: dict[str, str] = field(default_factory=lambda: dict(GENDER_LABELS))
    race_labels: dict[str, str] = field(default_factory=lambda: dict(RACE_LABELS))
    status_labels: dict[str, str] = field(default_factory=lambda: dict(STATUS_LABELS))
    subgroups: tuple[str, ...] = SUBGROUPS
    # Subgroups beside gender and race, by the name that ``subgroups`` uses.
    more_subgroups: Mapping[str, Subgroup] = field(default_factory=dict)
    trend_months: int = TREND_MONTHS
    # A Spark collation for matching names, e.g. "UTF8_LCASE_RTRIM"; None is exact.
    name_collation: str | None = None
    # Person keys that so many students of a snapshot share are looked for and matched apart; None looks for none.
    hot_rows: int | None = None

    def subgroup(self, name: str) -> Subgroup:
        own = {
            "gender": Subgroup("Gender", self.gender_labels),
            "race": Subgroup("RaceReportTitle", self.race_labels, keeps_others=True),
        }
        known = {**own, **self.more_subgroups}
        if name not in known:
            raise ValueError(f"subgroup {name!r} has no source column: add it to more_subgroups")
        return known[name]

    @property
    def complete(self) -> str:
        return self.status_labels["Y"]

    @property
    def statuses(self) -> tuple[str, ...]:
        return tuple(self.status_labels.values())


@dataclass(frozen=True)
class Selection:
    """What a reader picked: a year range, one district, one school, subgroups.

    ``genders``/``races`` stay ``None`` for data without subgroups; where they
    are given they must hold at least one value.
    """

    years: tuple[int, ...]
    district: str
    school: str
    genders: tuple[str, ...] | None = None
    races: tuple[str, ...] | None = None
    # Chosen values of other subgroups, by name.
    others: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("years", "district", "school"):
            if not getattr(self, name):
                raise ValueError(f"selection needs a value for {name!r}")
        for name, value in {"genders": self.genders, "races": self.races, **self.others}.items():
            if value is not None and len(value) == 0:
                raise ValueError(f"selection needs a value for {name!r}")

    @property
    def subgroup_values(self) -> dict[str, tuple[str, ...]]:
        """The chosen values per subgroup, for those that are restricted."""
        values = {"gender": self.genders, "race": self.races, **self.others}
        return {name: tuple(chosen) for name, chosen in values.items() if chosen is not None}

    @property
    def first_year(self) -> int:
        return min(self.years)

    @property
    def last_year(self) -> int:
        return max(self.years)
