"""Reading the source tables and the extract, reading and writing results."""

from cohortspan.sources.app_data import load_app_data, write_app_data
from cohortspan.sources.export import export_csv, export_file
from cohortspan.sources.extract_csv import read_extract
from cohortspan.sources.snapshots import latest_snapshots
from cohortspan.sources.tables import conform, load_sources, read_source

__all__ = [
    "conform", "export_csv", "export_file", "latest_snapshots", "load_app_data", "load_sources", "read_extract",
    "read_source", "write_app_data",
]
