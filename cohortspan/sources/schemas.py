"""Column names and types of the source tables, the extract and the summary."""

from __future__ import annotations

# Carried through from enrolment to the extract without being interpreted.
STUDENT_FLAGS = (
    "CD504", "ELL", "Migrant", "Homeless", "FosterCare", "MilitaryDep", "Immersion",
    "Grade", "YearInHS", "GradeRepeater", "GradeSkipper",
)

_strings = lambda *names: {name: "string" for name in names}

SOURCE_SCHEMAS: dict[str, dict[str, str]] = {
    "enrollment": {
        "SchoolYear": "int", "AsOf": "date", "StudentID": "bigint",
        **_strings("LastName", "FirstName"), "BirthDate": "date",
        **_strings("SchoolCode", "DistrictCode", "Geography", "ZipCode", "Gender", "RaceEDEN",
                   "LowIncome", "Medicaid", "SPEDCode", *STUDENT_FLAGS),
    },
    "school": {"SchoolYear": "int", **_strings("SchoolCode", "SchoolName")},
    "district": {"SchoolYear": "int", **_strings("DistrictCode", "DistrictName")},
    "isir": {
        "ISIRYear": "int", "ISIRID": "bigint",
        **_strings("StudentFirstName", "StudentLastName"),
        "StudentDateOfBirth": "date", "ApplicationReceiptDate": "date",
        "TransactionReceiptDate": "date",
    },
    "race_code": _strings("RaceReportCode", "RaceReportTitle"),
    "sped_code": _strings("SpEd", "SpEdDefinition"),
}

EXTRACT_SCHEMA: dict[str, str] = {
    "asOf": "date", "SchoolYear": "int", "StudentID": "bigint", "BirthDate": "date",
    **_strings("SchoolName", "SchoolCode", "DistrictName", "DistrictCode", "Geography", "ZipCode",
               "Gender", "RaceReportTitle", "LowIncome", "Medicaid", "SPEDCode", "SpEdDefinition",
               *STUDENT_FLAGS),
    "ApplicationReceiptDate": "date", "CompletedFAFSA": "string",
}
