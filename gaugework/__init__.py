"""Spark-native profiling, structural quality and governance of tables and whole catalogues."""

from gaugework.plans.analysis import Analysis, analyze, analyze_catalog
from gaugework.plans.report import IncompleteRun, analysis_report, json_reports, read_tables, write_reports, write_tables

__all__ = [
    "Analysis",
    "IncompleteRun",
    "analysis_report",
    "analyze",
    "analyze_catalog",
    "json_reports",
    "read_tables",
    "write_reports",
    "write_tables",
]
