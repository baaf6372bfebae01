"""The driver's tables seen as the pipeline's source tables.

Orders stand for enrolment snapshots, line items for applications, nations for
districts. All rows of the tables take part. One SQL text describes a view for
both engines; ``{asof}`` is a column name that DuckDB wants quoted. The school
and district code tables are unfolded from the nation table, the two short code
lists are fixed, as in any warehouse.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.config import CohortConfig, Subgroup
from cohortspan.sources import load_sources

AS_OF = dt.date(2024, 7, 1)
EXCLUDED = ("16", "30", "50", "145")
CONFIG = CohortConfig(excluded_schools=EXCLUDED, min_year=1996)
LOW_INCOME = replace(
    CONFIG, subgroups=("low_income",),
    more_subgroups={"low_income": Subgroup("LowIncome", {"Y": "Low income", "N": "Other"})},
)

# Code 5 and the SpEd codes 4 and 5 have no entry, so lookups also miss.
RACE_TITLES = {
    "1": "African American", "2": "American Indian", "3": "Hispanic/Latino", "4": "Hawaiian",
}
SPED_DEFINITIONS = {"1": "Speech", "2": "Learning", "3": "Hearing"}

# A person's names and birth date follow from the customer key alone.
_PERSON = """
    'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS {last},
    'F' || CAST(o_custkey % 101 AS STRING) AS {first},
    CAST(DATE '1980-01-01' + CAST(o_custkey % 5000 AS INTEGER) AS DATE) AS {born}"""

ENROLLMENT_SQL = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS SchoolYear,
        make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1) AS {asof},
        o_custkey AS StudentID,""" + _PERSON.format(
    last="LastName", first="FirstName", born="BirthDate") + """,
        CAST(c_nationkey * 10 + o_orderkey % 10 AS STRING) AS SchoolCode,
        CAST(c_nationkey AS STRING) AS DistrictCode,
        'Statewide' AS Geography, 'Z' || CAST(c_nationkey AS STRING) AS ZipCode,
        CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS Gender,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2'
            WHEN 'FURNITURE' THEN '3' WHEN 'HOUSEHOLD' THEN '4' WHEN 'MACHINERY' THEN '5' END AS RaceEDEN,
        CASE WHEN o_totalprice < 100000 THEN 'Y' ELSE 'N' END AS LowIncome,
        CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS Medicaid,
        substr(o_orderpriority, 1, 1) AS SPEDCode,
        CAST(NULL AS STRING) AS CD504, CAST(NULL AS STRING) AS ELL, CAST(NULL AS STRING) AS Migrant,
        CAST(NULL AS STRING) AS Homeless, CAST(NULL AS STRING) AS FosterCare,
        CAST(NULL AS STRING) AS MilitaryDep, CAST(NULL AS STRING) AS Immersion,
        CASE WHEN o_orderpriority = '5-LOW' THEN '11' ELSE '12' END AS Grade,
        '4' AS YearInHS, CAST(NULL AS STRING) AS GradeRepeater, CAST(NULL AS STRING) AS GradeSkipper
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

ISIR_SQL = """
    SELECT ISIRYear, l_orderkey * 10 + l_linenumber AS ISIRID,
        StudentFirstName, StudentLastName, StudentDateOfBirth,
        CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END AS ApplicationReceiptDate,
        CAST(l_shipdate AS DATE) AS TransactionReceiptDate
    FROM {lineitem} JOIN (
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS ISIRYear,""" + _PERSON.format(
    last="StudentLastName", first="StudentFirstName", born="StudentDateOfBirth") + """
        FROM {orders}) applicant ON l_orderkey = o_orderkey"""


def _values(entries: dict[str, str], code: str, text: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in entries.items())
    return f"SELECT * FROM (VALUES {rows}) AS t({code}, {text})"


RACE_CODE_SQL = _values(RACE_TITLES, "RaceReportCode", "RaceReportTitle")
SPED_CODE_SQL = _values(SPED_DEFINITIONS, "SpEd", "SpEdDefinition")

_tables: dict[tuple[str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; its footer is read for the schema once per application."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _tables:
        _tables[key] = spark.read.parquet(path)
    return _tables[key]


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (_table(spark, sf_dir, name) for name in ("orders", "customer"))
    return spark.sql(ENROLLMENT_SQL.replace("{asof}", "AsOf"), orders=orders, customer=customer)


def isir(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = (_table(spark, sf_dir, name) for name in ("lineitem", "orders"))
    return spark.sql(ISIR_SQL, lineitem=lineitem, orders=orders)


def _yearly(spark: SparkSession, sf_dir: str, codes: DataFrame) -> DataFrame:
    """Each code in every year that has an order."""
    years = spark.sql(
        "SELECT collect_set(CAST(year(o_orderdate) AS INT)) AS years FROM {orders}",
        orders=_table(spark, sf_dir, "orders"),
    )
    return codes.select("*", F.explode(years.scalar()).alias("SchoolYear"))


def school(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = (
        _table(spark, sf_dir, "nation")
        .selectExpr("n_nationkey", "explode(sequence(0, 9)) AS digit")
        .selectExpr("CAST(n_nationkey * 10 + digit AS STRING) AS SchoolCode")
    )
    return _yearly(spark, sf_dir, codes).selectExpr(
        "*", "'School ' || SchoolCode || ' (' || SchoolYear || ')' AS SchoolName"
    )


def district(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS STRING) AS DistrictCode", "n_name AS DistrictName"
    )
    return _yearly(spark, sf_dir, codes)


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All six source tables."""
    return load_sources(
        spark,
        {
            "enrollment": enrollment(spark, sf_dir),
            "school": school(spark, sf_dir),
            "district": district(spark, sf_dir),
            "isir": isir(spark, sf_dir),
            "race_code": spark.sql(RACE_CODE_SQL),
            "sped_code": spark.sql(SPED_CODE_SQL),
        },
    )


VIEWS_SQL = {
    "fx_enrollment": ENROLLMENT_SQL.format(asof='"AsOf"', orders="orders", customer="customer"),
    "fx_isir": ISIR_SQL.format(lineitem="lineitem", orders="orders"),
    "fx_school": """
        SELECT SchoolYear, SchoolCode, 'School ' || SchoolCode || ' (' || SchoolYear || ')' AS SchoolName
        FROM (
            SELECT CAST(y.y AS INTEGER) AS SchoolYear,
                CAST(n_nationkey * 10 + d.d AS VARCHAR) AS SchoolCode
            FROM nation, range(0, 10) AS d(d), (SELECT DISTINCT year(o_orderdate) AS y FROM orders) AS y
        ) codes""",
    "fx_district": """
        SELECT CAST(y.y AS INTEGER) AS SchoolYear, CAST(n_nationkey AS VARCHAR) AS DistrictCode,
            n_name AS DistrictName
        FROM nation, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) AS y""",
    "fx_race_code": RACE_CODE_SQL,
    "fx_sped_code": SPED_CODE_SQL,
}
