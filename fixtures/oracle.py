"""The same queries as DuckDB SQL, written from the definitions, not from the Spark code.

``STEPS`` are named intermediate results; ``_sql`` puts the ones a query needs
in front of it.
"""

from __future__ import annotations

import re

from cohortspan import config as c
from cohortspan.sources.schemas import EXTRACT_SCHEMA, SOURCE_SCHEMAS
from fixtures.queries import DISTRICT, ENDS, ONE_YEAR, SCHOOL, SELECTION, YEARS
from fixtures.views import AS_OF, CONFIG, EXCLUDED, LOW_INCOME, VIEWS_SQL

LO, HI = min(YEARS), max(YEARS)


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(column: str, labels: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {column} {whens} ELSE {default} END"


MONTH_IDX = "CASE WHEN {d} IS NULL THEN 13 ELSE CAST((month({d}) + 2) % 12 + 1 AS INTEGER) END"
MONTH_NAME = "CASE WHEN {d} IS NULL THEN 'No Receipt' ELSE monthname({d}) END"
TREND_MONTHS = c.MONTHS[:9]
CARRIED = [x for x in SOURCE_SCHEMAS["enrollment"] if x not in ("AsOf", "RaceEDEN")]
COHORT_COLUMNS = [*CARRIED, "SchoolName", "DistrictName", "RaceReportCode"]
_TIES = sorted(x for x in COHORT_COLUMNS if x not in
               ("SchoolYear", "StudentID", "SchoolCode", "LastName", "FirstName", "BirthDate"))
DEDUP_ORDER = ", ".join(f"{x} ASC NULLS FIRST" for x in ("LastName", "FirstName", "BirthDate", *_TIES))
PREP_COLUMNS = [x for x in EXTRACT_SCHEMA if x not in ("asOf", "BirthDate", "SPEDCode")]
SCOPE = "DistrictCode, DistrictName, SchoolCode, SchoolName"
PREP_KEPT = ", ".join(x for x in PREP_COLUMNS if x not in ("Gender", "CompletedFAFSA"))

STEPS: dict[str, str] = dict(VIEWS_SQL)
STEPS["newest"] = """
    SELECT * FROM fx_enrollment e
    WHERE NOT EXISTS (SELECT 1 FROM fx_enrollment later
        WHERE later.SchoolYear = e.SchoolYear AND later."AsOf" > e."AsOf")"""
STEPS["cohort_all"] = f"""
    SELECT {", ".join("e." + x for x in CARRIED)}, s.SchoolName, d.DistrictName, e.RaceEDEN AS RaceReportCode
    FROM newest e
    JOIN fx_school s USING (SchoolYear, SchoolCode)
    JOIN fx_district d USING (SchoolYear, DistrictCode)
    WHERE e.Grade = '12' AND NOT list_contains([{_quoted(EXCLUDED)}], e.SchoolCode)"""
STEPS["students"] = f"""
    SELECT DISTINCT ON (SchoolYear, StudentID, SchoolCode) * FROM cohort_all ORDER BY {DEDUP_ORDER}"""
STEPS["last_receipt"] = """
    SELECT ISIRYear, StudentFirstName, StudentLastName, StudentDateOfBirth,
        max(ApplicationReceiptDate) AS ApplicationReceiptDate
    FROM fx_isir GROUP BY ALL"""
STEPS["last_application"] = """
    SELECT arg_max(a, (a.ApplicationReceiptDate IS NOT NULL, coalesce(a.ApplicationReceiptDate, DATE '0001-01-01'),
        coalesce(a.TransactionReceiptDate, DATE '0001-01-01'), a.ISIRID)) AS best
    FROM fx_isir a
    GROUP BY a.ISIRYear, a.StudentFirstName, a.StudentLastName, a.StudentDateOfBirth"""
STEPS["matched"] = """
    SELECT t.*, i.ApplicationReceiptDate,
        CASE WHEN i.ApplicationReceiptDate IS NOT NULL THEN 'Y' ELSE 'N' END AS CompletedFAFSA
    FROM students t LEFT JOIN last_receipt i
        ON i.ISIRYear = t.SchoolYear AND i.StudentLastName = t.LastName
        AND i.StudentFirstName = t.FirstName AND i.StudentDateOfBirth = t.BirthDate"""
STEPS["labelled"] = f"""
    SELECT m.*, DATE '{AS_OF}' AS "asOf", se.SpEdDefinition,
        coalesce(r.RaceReportTitle, CAST(m.RaceReportCode AS VARCHAR)) AS RaceReportTitle
    FROM matched m
    LEFT JOIN fx_race_code r ON CAST(m.RaceReportCode AS VARCHAR) = CAST(r.RaceReportCode AS VARCHAR)
    LEFT JOIN fx_sped_code se ON m.SPEDCode = se.SpEd"""
STEPS["extract_rows"] = "SELECT {} FROM labelled".format(
    ", ".join('"asOf"' if x == "asOf" else x for x in EXTRACT_SCHEMA)
)
STEPS["roster"] = f"""
    SELECT DISTINCT {SCOPE} FROM extract_rows
    WHERE SchoolYear = (SELECT max(SchoolYear) FROM extract_rows)"""
STEPS["restricted"] = "SELECT {} FROM extract_rows e JOIN roster r ON {} AND {}".format(
    ", ".join(("r." if x in ("DistrictName", "SchoolName") else "e.") + x for x in PREP_COLUMNS),
    "e.DistrictCode IS NOT DISTINCT FROM r.DistrictCode",
    "e.SchoolCode IS NOT DISTINCT FROM r.SchoolCode",
)
_PREPARED = f"""
    SELECT {{columns}}, {_case("CompletedFAFSA", CONFIG.status_labels)} AS completedFAFSA,
        {MONTH_IDX.format(d="ApplicationReceiptDate")} AS month_idx,
        {MONTH_NAME.format(d="ApplicationReceiptDate")} AS ApplicationReceiptMonth
    FROM restricted WHERE SchoolYear >= {CONFIG.min_year}"""
STEPS["prepared_rows"] = _PREPARED.format(columns=f"""{PREP_KEPT},
        {_case("Gender", CONFIG.gender_labels)} AS gender,
        {_case("RaceReportTitle", CONFIG.race_labels, "RaceReportTitle")} AS race""")

STEPS["prepared_low"] = _PREPARED.format(columns=f"""{PREP_KEPT},
        {_case("LowIncome", LOW_INCOME.more_subgroups["low_income"].labels)} AS low_income""")

LEVEL_SCOPE = {"school": SCOPE, "lea": "DistrictCode, DistrictName", "state": ""}
LEVEL_LABELS = {
    "school": SCOPE,
    "lea": "DistrictCode, DistrictName, 'All Schools' AS SchoolCode, 'All Schools' AS SchoolName",
    "state": "'All LEAs' AS DistrictCode, 'All LEAs' AS DistrictName, "
             "'All Schools' AS SchoolCode, 'All Schools' AS SchoolName",
}


def _comma(*parts: str) -> str:
    return ", ".join(p for p in parts if p)


for _suffix, _subgroups, _rows in (
    ("", "gender, race", "prepared_rows"), ("_nosub", "", "prepared_rows"), ("_low", "low_income", "prepared_low"),
):
    for _position, _level in enumerate(c.LEVELS, start=1):
        _family = _comma("SchoolYear", LEVEL_SCOPE[_level], "Grade", _subgroups)
        STEPS[f"denoms_{_level}{_suffix}"] = f"""
            SELECT {_family}, count(*) AS seniors
            FROM (SELECT DISTINCT {_family}, StudentID FROM {_rows}) GROUP BY {_family}"""
        _cell = f"{_family}, ApplicationReceiptMonth, completedFAFSA, month_idx"
        _match = " AND ".join(
            f"x.{k.strip()} IS NOT DISTINCT FROM d.{k.strip()}" for k in _family.split(",")
        )
        STEPS[f"summary_{_level}{_suffix}"] = f"""
            SELECT '{_level}' AS level, {_comma(
                "SchoolYear", LEVEL_LABELS[_level], "Grade", _subgroups)},
                ApplicationReceiptMonth, completedFAFSA, n, seniors, month_idx,
                {_position} AS level_idx
            FROM (
                SELECT x.*, d.seniors FROM (
                    SELECT {_cell}, count(DISTINCT StudentID)
                        + max(CASE WHEN StudentID IS NULL THEN 1 ELSE 0 END) AS n
                    FROM {_rows} GROUP BY {_cell}) x
                LEFT JOIN denoms_{_level}{_suffix} d ON {_match})"""
    STEPS[f"app{_suffix}"] = " UNION ALL BY NAME ".join(
        f"SELECT * FROM summary_{level}{_suffix}" for level in c.LEVELS
    )

LABEL = "CASE level WHEN 'school' THEN SchoolName WHEN 'lea' THEN DistrictName WHEN 'state' THEN 'State' END"
STEPS["months"] = "SELECT * FROM (VALUES {}) AS t(month_idx, ApplicationReceiptMonth)".format(
    ", ".join(f"({i}, '{name}')" for i, name in enumerate(TREND_MONTHS, start=1))
)
STEPS["selected"] = f"""
    SELECT * FROM app WHERE SchoolYear >= {LO} AND SchoolYear <= {HI}
        AND DistrictName IN ('{DISTRICT}', 'All LEAs') AND SchoolName IN ('{SCHOOL}', 'All Schools')
        AND gender IN ({_quoted(SELECTION.genders)}) AND race IN ({_quoted(SELECTION.races)})"""
STEPS["selected_year"] = f"""
    SELECT * FROM app_nosub WHERE SchoolYear = {ONE_YEAR}
        AND DistrictName IN ('{DISTRICT}', 'All LEAs') AND SchoolName IN ('{SCHOOL}', 'All Schools')"""

_PLOT = f"""
    SELECT *, {LABEL} AS "group", level_idx AS group_idx FROM {{source}}
    WHERE completedFAFSA = 'Complete' AND {{known}} AND ApplicationReceiptMonth IN ({_quoted(TREND_MONTHS)})"""


def _trend_steps(prefix: str, source: str, line: str) -> None:
    """Denominators, monthly counts, grid, fill and running sum, step by step."""
    same = lambda a, b: " AND ".join(
        f"{a}.{k.strip()} IS NOT DISTINCT FROM {b}.{k.strip()}" for k in line.split(",")
    )
    yearly = line if "SchoolYear" in line else f"SchoolYear, {line}"
    STEPS[f"{prefix}plot"] = _PLOT.format(source=source, known="race <> 'NA'" if "race" in line else "TRUE")
    STEPS[f"{prefix}denoms"] = f"""
        SELECT {line}, CAST(coalesce(sum(seniors), 0) AS BIGINT) AS seniors
        FROM (SELECT DISTINCT {yearly}, seniors FROM {prefix}plot) GROUP BY {line}"""
    STEPS[f"{prefix}monthly"] = f"""
        SELECT m.*, d.seniors FROM (
            SELECT {line}, month_idx, ApplicationReceiptMonth,
                CAST(coalesce(sum(n), 0) AS BIGINT) AS completed
            FROM {prefix}plot GROUP BY {line}, month_idx, ApplicationReceiptMonth) m
        LEFT JOIN {prefix}denoms d ON {same("m", "d")}"""
    STEPS[f"{prefix}grid"] = f"""
        SELECT {", ".join("g." + k.strip() for k in line.split(","))}, g.month_idx, g.ApplicationReceiptMonth,
            coalesce(m.completed, 0) AS completed, m.seniors
        FROM (SELECT * FROM (SELECT DISTINCT {line} FROM {prefix}monthly), months) g
        LEFT JOIN {prefix}monthly m ON {same("g", "m")} AND g.month_idx = m.month_idx"""
    STEPS[f"{prefix}filled"] = f"""
        SELECT * REPLACE (coalesce(
            last_value(seniors IGNORE NULLS) OVER (PARTITION BY {line} ORDER BY month_idx
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(seniors IGNORE NULLS) OVER (PARTITION BY {line} ORDER BY month_idx
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS seniors)
        FROM {prefix}grid"""
    STEPS[f"{prefix}cumulative"] = f"""
        SELECT *, CASE WHEN seniors > 0 THEN CAST(cum_completed AS DOUBLE) / seniors END AS completion_rate
        FROM (SELECT *, CAST(sum(completed) OVER (PARTITION BY {line} ORDER BY month_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_completed
            FROM {prefix}filled)"""


_trend_steps("sel_", "selected", 'level, "group", group_idx, gender, race')
_trend_steps("all_", "app", "level, DistrictName, SchoolName, gender, race")
STEPS["app_range"] = f"SELECT * FROM app WHERE SchoolYear BETWEEN {LO} AND {HI}"
_trend_steps("range_", "app_range", "level, DistrictName, SchoolName, gender, race")
_trend_steps("each_", "app", "SchoolYear, level, DistrictName, SchoolName, gender, race")
_trend_steps("low_", "app_low", "level, DistrictName, SchoolName, low_income")

MONTHLY_LINE = f"level, SchoolYear, {SCOPE}, Grade"


def _monthly(source: str) -> str:
    keys = [k.strip() for k in MONTHLY_LINE.split(",")]
    same = " AND ".join(f"g.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""
        SELECT {LABEL.replace("level", "g.level", 1)} AS "group", g.level_idx AS group_idx,
            {", ".join("g." + k for k in keys)}, g.seniors, g.month_idx, g.ApplicationReceiptMonth,
            coalesce(p.n, 0) AS completed,
            CAST(coalesce(p.n, 0) AS DOUBLE) / nullif(g.seniors, 0) AS completion_rate
        FROM (SELECT * FROM (SELECT DISTINCT {MONTHLY_LINE}, level_idx, seniors FROM {source}), months) g
        LEFT JOIN (SELECT * FROM {source} WHERE completedFAFSA = 'Complete') p
            ON {same} AND g.month_idx = p.month_idx""".replace(
        "THEN SchoolName", "THEN g.SchoolName").replace("THEN DistrictName", "THEN g.DistrictName")


STEPS["monthly_year"] = _monthly("selected_year")
STEPS["monthly_all"] = _monthly("app_nosub")

STEPS["first_district"] = f"""
    SELECT min(DistrictName) AS district FROM app WHERE level = 'lea' AND SchoolYear IN ({LO}, {HI})"""
STEPS["first_school"] = f"""
    SELECT district, min(SchoolName) AS school FROM app, first_district
    WHERE level = 'school' AND SchoolYear IN ({LO}, {HI}) AND DistrictName = district GROUP BY district"""


def _facets(source: str, subgroups: tuple[str, ...], per: str = "") -> str:
    """Every school with each combination of its own categories."""
    scope = _comma(per, "DistrictName", "SchoolName")
    rows = f"FROM {source} WHERE level = 'school' AND DistrictName IS NOT NULL AND SchoolName IS NOT NULL"
    own = [f"(SELECT DISTINCT {scope}, {s} {rows} AND {s} IS NOT NULL)" for s in subgroups]
    return f"SELECT {scope}, {', '.join(subgroups)} FROM {own[0]}" + "".join(f" JOIN {x} USING ({scope})" for x in own[1:])


def _all_scopes(lines: str, source: str, subgroups: tuple[str, ...], per: str = "") -> str:
    """The lines of every school, its district and the state."""
    same = " AND ".join(f"f.{k} = l.{k}" for k in (*subgroups, *([per] if per else [])))
    return f"""
        SELECT {_comma(per and "l." + per, "f.DistrictName AS scope_district", "f.SchoolName AS scope_school")},
            CASE level WHEN 'school' THEN l.SchoolName WHEN 'lea' THEN l.DistrictName ELSE 'State' END AS "group",
            CASE level WHEN 'school' THEN 1 WHEN 'lea' THEN 2 ELSE 3 END AS group_idx,
            l.level, {", ".join("l." + s for s in subgroups)}, l.seniors, l.month_idx, l.ApplicationReceiptMonth,
            l.completed, l.cum_completed, l.completion_rate
        FROM ({_facets(source, subgroups, per)}) f JOIN {lines} l ON {same} AND (
            (l.level = 'school' AND l.DistrictName = f.DistrictName AND l.SchoolName = f.SchoolName)
            OR (l.level = 'lea' AND l.DistrictName = f.DistrictName)
            OR l.level = 'state')"""


def _sql(body: str) -> str:
    """``body`` preceded by the steps it needs, in order of definition."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(STEPS[name])
    steps = ",\n".join(f"{name} AS ({STEPS[name]})" for name in STEPS if name in needed)
    return f"WITH {steps}\n{body}" if steps else body


def _crosstab(column: str) -> str:
    return f"""
        SELECT CAST(a.SchoolYear AS INTEGER) AS SchoolYear, b.{column}, count(e.hit) AS count
        FROM (SELECT DISTINCT SchoolYear FROM extract_rows WHERE SchoolYear IS NOT NULL
              UNION ALL SELECT NULL) a
        CROSS JOIN (SELECT DISTINCT {column} FROM extract_rows WHERE {column} IS NOT NULL
              UNION ALL SELECT NULL) b
        LEFT JOIN (SELECT SchoolYear, {column}, 1 AS hit FROM extract_rows) e
            ON e.SchoolYear IS NOT DISTINCT FROM a.SchoolYear
            AND e.{column} IS NOT DISTINCT FROM b.{column}
        GROUP BY a.SchoolYear, b.{column}"""


def _coverage(source: str, subgroups: str) -> str:
    family = _comma("level", "SchoolYear", SCOPE, "Grade", subgroups)
    return f"""
        SELECT *, total_n - seniors AS diff FROM (
            SELECT {family}, min(seniors) AS seniors, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_n
            FROM {source} GROUP BY {family})"""


GRAIN = "SchoolYear, StudentID, SchoolCode"
ENROLMENT_KEY = "SchoolYear, DistrictCode, SchoolCode, StudentID"
PERCENT = "CASE WHEN seniors > 0 THEN round_even(CAST(n AS DOUBLE) / seniors * 100, 1) END AS \"Percent\""


def _detail(source: str, subgroups: bool) -> str:
    names = [f'{k} AS "{v}"' for k, v in c.DETAIL_NAMES.items() if subgroups or k not in c.SUBGROUPS]
    return f"SELECT {', '.join(names)}, {PERCENT} FROM {source}"


def _choice(column: str, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT {column} FROM app WHERE {column} IS NOT NULL AND {where} ORDER BY 1"


def _labels(source: str, decimals: int) -> str:
    return f"""
        SELECT *, substr(ApplicationReceiptMonth, 1, 3) AS month_label,
            printf('%.{decimals}f%%', round_even(completion_rate * 100, {decimals})) AS rate_label
        FROM {source}"""


ENDPOINTS = f"SchoolYear IN ({LO}, {HI})"
SORT_KEYS = "SchoolYear NULLS LAST, DistrictCode NULLS LAST, SchoolCode NULLS LAST"

_BODIES = {
    "src_enrollment": "SELECT * FROM fx_enrollment",
    "src_isir": "SELECT * FROM fx_isir",
    "csv_na_tokens": "SELECT * FROM extract_rows",
    "optional_year_filter":
        "SELECT SchoolYear, StudentID, SchoolCode, Grade FROM fx_enrollment WHERE SchoolYear = 1999",
    "latest_snapshot": 'SELECT DISTINCT SchoolYear, "AsOf" AS maxasof FROM newest',
    "dim_join": """
        SELECT e.SchoolYear, e.StudentID, e.SchoolCode, s.SchoolName, e.DistrictCode, d.DistrictName
        FROM fx_enrollment e
        JOIN fx_school s ON e.SchoolCode = s.SchoolCode AND e.SchoolYear = s.SchoolYear
        JOIN fx_district d ON e.DistrictCode = d.DistrictCode AND e.SchoolYear = d.SchoolYear""",
    "snapshot_rows": """
        SELECT SchoolYear, "AsOf", StudentID, SchoolCode, Grade FROM newest""",
    "cohort_filter": f"""
        SELECT SchoolYear, StudentID, SchoolCode, Grade FROM fx_enrollment
        WHERE Grade = '12' AND SchoolCode NOT IN ({_quoted(EXCLUDED)})""",
    "dedup_cohort": "SELECT * FROM students",
    "latest_application": "SELECT * FROM last_receipt",
    "latest_application_rows": "SELECT best.* FROM last_application",
    "match_applications":
        f"SELECT {GRAIN}, LastName, FirstName, BirthDate, ApplicationReceiptDate FROM matched",
    "race_title": f"SELECT {GRAIN}, RaceReportCode, RaceReportTitle FROM labelled",
    "sped_lookup": f"SELECT {GRAIN}, SPEDCode, SpEdDefinition FROM labelled",
    "completion_flag": f"SELECT {GRAIN}, ApplicationReceiptDate, CompletedFAFSA FROM matched",
    "extract": "SELECT * FROM extract_rows",
    "extract_one_school":
        f"SELECT * FROM extract_rows WHERE SchoolYear = 2001 AND SchoolName = '{SCHOOL}'",
    "extract_sorted": """
        SELECT * FROM extract_rows ORDER BY SchoolYear DESC NULLS LAST,
            DistrictName NULLS FIRST, SchoolName NULLS FIRST, StudentID NULLS FIRST""",
    "latest_year": "SELECT max(SchoolYear) AS latest_year FROM extract_rows",
    "school_roster": "SELECT * FROM roster",
    "qa_duplicate_keys":
        f"SELECT {ENROLMENT_KEY}, count(*) AS n FROM extract_rows GROUP BY {ENROLMENT_KEY} HAVING count(*) > 1",
    "qa_duplicate_keys_raw":
        f"SELECT {ENROLMENT_KEY}, count(*) AS n FROM cohort_all GROUP BY {ENROLMENT_KEY} HAVING count(*) > 1",
    "qa_multi_enrolled": f"""
        SELECT SchoolYear, StudentID, count(*) AS n
        FROM (SELECT DISTINCT {ENROLMENT_KEY} FROM extract_rows)
        GROUP BY SchoolYear, StudentID HAVING count(*) > 1""",
    "qa_lookup_codes": " UNION ALL ".join(
        f"""SELECT '{table}' AS code_table, count(*) AS codes, count(*) FILTER (n > 1) AS repeated
            FROM (SELECT {keys}, count(*) AS n FROM fx_{table} GROUP BY {keys})"""
        for table, keys in (("school", "SchoolYear, SchoolCode"), ("district", "SchoolYear, DistrictCode"),
                            ("race_code", "RaceReportCode"), ("sped_code", "SpEd"))),
    "qa_crosstab_status": _crosstab("CompletedFAFSA"),
    "qa_crosstab_gender": _crosstab("Gender"),
    "qa_crosstab_race": _crosstab("RaceReportTitle"),
    "restrict_relabel": "SELECT * FROM restricted",
    "year_floor": f"SELECT {GRAIN}, CompletedFAFSA FROM restricted WHERE SchoolYear >= {CONFIG.min_year}",
    "recode_gender": f"""
        SELECT SchoolYear, StudentID, Gender AS gender_code,
            {_case("Gender", CONFIG.gender_labels)} AS gender FROM fx_enrollment""",
    "recode_race": f"""
        SELECT SchoolYear, StudentID, RaceReportTitle,
            {_case("RaceReportTitle", CONFIG.race_labels, "RaceReportTitle")} AS race
        FROM (SELECT e.SchoolYear, e.StudentID, coalesce(r.RaceReportTitle, e.RaceEDEN) AS RaceReportTitle
              FROM fx_enrollment e LEFT JOIN fx_race_code r ON e.RaceEDEN = r.RaceReportCode)""",
    "recode_status": f"""
        SELECT {GRAIN}, CompletedFAFSA AS status_code,
            {_case("CompletedFAFSA", CONFIG.status_labels)} AS completedFAFSA FROM extract_rows""",
    "receipt_month": f"""
        SELECT ISIRYear, ISIRID, ApplicationReceiptDate,
            {MONTH_NAME.format(d="ApplicationReceiptDate")} AS ApplicationReceiptMonth,
            {MONTH_IDX.format(d="ApplicationReceiptDate")} AS month_idx FROM fx_isir""",
    "prepared": "SELECT * FROM prepared_rows",
    **{f"{kind}_{level}": f"SELECT * FROM {kind}_{level}"
       for kind in ("denoms", "summary") for level in c.LEVELS},
    "app_data": "SELECT * FROM app",
    "app_data_nosub": "SELECT * FROM app_nosub",
    "app_data_sorted": f"""
        SELECT * FROM app ORDER BY level, {SORT_KEYS}, gender NULLS LAST, race NULLS LAST,
            month_idx NULLS LAST, completedFAFSA NULLS LAST""",
    "app_data_nosub_sorted": f"""
        SELECT * FROM app_nosub ORDER BY level_idx, {SORT_KEYS}, month_idx NULLS LAST,
            completedFAFSA NULLS LAST""",
    "app_data_roundtrip": "SELECT * FROM app",
    "qa_coverage": _coverage("app", "gender, race"),
    "qa_coverage_nosub": _coverage("app_nosub", ""),
    "choice_years": _choice("SchoolYear"),
    "choice_districts": _choice("DistrictName", "level = 'school'"),
    "choice_schools": _choice("SchoolName", "level = 'school'"),
    "choice_genders": _choice("gender"),
    "choice_races": _choice("race", "race <> 'NA'"),
    "default_selection": """
        SELECT (SELECT max(SchoolYear) FROM app) AS year,
            (SELECT min(DistrictName) FROM app WHERE level = 'school') AS district,
            (SELECT min(SchoolName) FROM app WHERE level = 'school') AS school,
            (SELECT min(gender) FROM app) AS gender,
            (SELECT min(race) FROM app WHERE race <> 'NA') AS race""",
    "district_choices": _choice("DistrictName", f"level = 'lea' AND {ENDPOINTS}"),
    "school_choices":
        _choice("SchoolName", f"level = 'school' AND SchoolYear IN {ENDS} AND DistrictName = '{DISTRICT}'"),
    "school_choices_range": _choice(
        "SchoolName", f"level = 'school' AND SchoolYear BETWEEN {ENDS[0]} AND {ENDS[1]} AND DistrictName = '{DISTRICT}'"),
    "subgroup_choices": f"""
        SELECT DISTINCT kind, value FROM (
            SELECT 'gender' AS kind, gender AS value, * FROM app
            UNION ALL SELECT 'race' AS kind, race AS value, * FROM app)
        WHERE value IS NOT NULL AND level = 'school' AND {ENDPOINTS}
            AND DistrictName = '{DISTRICT}' AND SchoolName = '{SCHOOL}' ORDER BY 1, 2""",
    "resolve_selection": f"""
        SELECT {LO} AS first_year, {HI} AS last_year, district, school,
            min(gender) AS gender, min(race) AS race
        FROM app, first_school
        WHERE level = 'school' AND {ENDPOINTS} AND DistrictName = district AND SchoolName = school
        GROUP BY district, school""",
    "scope_filter": "SELECT * FROM selected",
    "scope_filter_year": "SELECT * FROM selected_year",
    "scope_meta": """
        SELECT DISTINCT SchoolName, DistrictName FROM selected WHERE level = 'school'
        ORDER BY SchoolName, DistrictName LIMIT 1""",
    "detail_table": _detail("selected", True),
    "detail_table_nosub": _detail("selected_year", False),
    "export_detail": _detail("selected", True),
    "scope_note": f"""
        SELECT 'Showing ' || s.SchoolName || ' compared with ' || s.DistrictName
            || ' and the state for school year '
            || CASE WHEN y.a = y.b THEN CAST(y.a AS VARCHAR) ELSE y.a || '–' || y.b END
            || '. Rates are subgroup-specific within the selected gender and race filters.' AS note
        FROM (SELECT min(SchoolYear) AS a, max(SchoolYear) AS b FROM selected) y,
            (SELECT DISTINCT SchoolName, DistrictName FROM selected WHERE level = 'school'
             ORDER BY 1, 2 LIMIT 1) s""",
    "scope_note_year": """
        SELECT 'Showing monthly FAFSA completion percentages for ' || SchoolName
            || ', compared with ' || DistrictName || ' and the state for school year '
            || (SchoolYear - 1) || '–' || (SchoolYear - 2000) || '.' AS note
        FROM (SELECT DISTINCT SchoolYear, SchoolName, DistrictName FROM selected_year
              WHERE level = 'school' ORDER BY 1, 2, 3 LIMIT 1)""",
    "pooled_denoms": "SELECT * FROM sel_denoms",
    "monthly_completed": "SELECT * FROM sel_monthly",
    "complete_months": "SELECT * FROM sel_grid",
    "fill_downup": "SELECT * FROM sel_filled",
    "cumulative_trend": "SELECT * FROM sel_cumulative",
    "trend_labels": _labels("sel_cumulative", 0),
    "monthly_trend": "SELECT * FROM monthly_year",
    "monthly_trend_labels": _labels("monthly_year", 1),
    "monthly_trend_lines": "SELECT * FROM monthly_all",
    "trend_zero_scope": f"""
        SELECT * EXCLUDE (total) FROM (
            SELECT *, sum(completed) OVER (PARTITION BY {MONTHLY_LINE}) AS total FROM monthly_all)
        WHERE total = 0""",
    "trend_all_scopes": _all_scopes("all_cumulative", "app", c.SUBGROUPS),
    "trend_all_scopes_range": _all_scopes("range_cumulative", "app_range", c.SUBGROUPS),
    "trend_all_scopes_per_year": _all_scopes("each_cumulative", "app", c.SUBGROUPS, "SchoolYear"),
    "app_data_other_subgroup": "SELECT * FROM app_low",
    "trend_other_subgroup": _all_scopes("low_cumulative", "app_low", ("low_income",)),
    "monthly_trend_all_scopes": """
        SELECT s.scope_district, s.scope_school, l.* FROM (
            SELECT DISTINCT SchoolYear, DistrictName AS scope_district, SchoolName AS scope_school
            FROM app_nosub WHERE level = 'school' AND DistrictName IS NOT NULL AND SchoolName IS NOT NULL) s
        JOIN monthly_all l ON l.SchoolYear = s.SchoolYear AND (
            (l.level = 'school' AND l.DistrictName = s.scope_district AND l.SchoolName = s.scope_school)
            OR (l.level = 'lea' AND l.DistrictName = s.scope_district)
            OR l.level = 'state')""",
}



def _outputs(trend: str, note: str, rows: str) -> str:
    return f"""
        SELECT 'trend' AS part, NULL::INTEGER AS year, "group" AS line, ApplicationReceiptMonth AS month,
            completed AS n, seniors, rate_label AS label FROM ({trend})
        UNION ALL SELECT 'note', NULL, NULL, NULL, NULL, NULL, note FROM ({note})
        UNION ALL SELECT 'table', SchoolYear, SchoolName, ApplicationReceiptMonth, n, seniors, completedFAFSA
        FROM {rows}"""


_BODIES["selection_outputs_range"] = _outputs(_BODIES["trend_labels"], _BODIES["scope_note"], "selected")
_BODIES["selection_outputs_year"] = _outputs(
    _BODIES["monthly_trend_labels"], _BODIES["scope_note_year"], "selected_year"
)
# Other ways to the same rows.
_BODIES |= {
    "latest_snapshot_folders": _BODIES["latest_snapshot"],
    "latest_snapshot_footers": _BODIES["latest_snapshot"],
    "extract_listed_snapshots": _BODIES["extract"],
    "extract_hot_people": _BODIES["extract"],
    "app_data_refreshed": _BODIES["app_data"],
    "indexed_districts": _BODIES["district_choices"],
    "indexed_schools": _BODIES["school_choices"],
    "indexed_schools_range": _BODIES["school_choices_range"],
    "indexed_subgroups": _BODIES["subgroup_choices"],
    "indexed_selection": _BODIES["resolve_selection"],
    "export_whole_file": _BODIES["app_data"],
    "qa_gates": f"""
        SELECT (SELECT count(*) FROM (SELECT 1 FROM prepared_rows
                GROUP BY SchoolYear, DistrictCode, SchoolCode, StudentID HAVING count(*) > 1)) AS duplicate_keys,
            (SELECT count(*) FROM (SELECT 1 FROM prepared_rows GROUP BY SchoolYear, StudentID
                HAVING count(DISTINCT (DistrictCode, SchoolCode)) > 1)) AS multi_enrolled,
            (SELECT count(*) FROM (SELECT DISTINCT SchoolYear, StudentID FROM prepared_rows)) AS students,
            count(*) AS families, count(*) FILTER (diff > 0) AS families_over, count(*) FILTER (diff < 0) AS families_short,
            CAST(max(diff) AS BIGINT) AS largest_excess
        FROM ({_BODIES["qa_coverage"]})""",
    "served_trends": _BODIES["trend_all_scopes"],
    "served_school_trend": f"""
        SELECT * FROM ({_BODIES["trend_all_scopes"]})
        WHERE scope_school = '{SCHOOL}' AND scope_district = '{DISTRICT}'""",
}
ORACLES = {name: _sql(body) for name, body in _BODIES.items()}
