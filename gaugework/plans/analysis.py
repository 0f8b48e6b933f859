"""From tables to all result tables: profile, quality, governance, recommendations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gaugework.operators import cells as C
from gaugework.operators import governance as G
from gaugework.operators import judgements as J
from gaugework.operators import numbers
from gaugework.operators import quality as Q
from gaugework.operators.column_profile import column_counts, column_profile, column_types
from gaugework.operators.duplicates import duplicate_patterns, duplicate_rows
from gaugework.operators.histogram import measured_values, value_histogram
from gaugework.operators.identifiers import candidate_identifiers
from gaugework.operators.profile_findings import profiling_judgements
from gaugework.operators.recommendations import recommendation_summary, recommendations
from gaugework.session import materialize


@dataclass(frozen=True)
class Analysis:
    """The measured frames and everything that follows from them.

    ``tables`` has one row per table, ``profile`` one per column and ``patterns`` one per table and
    set of null columns among repeated rows; all other frames are derived from these three.
    """

    tables: DataFrame
    profile: DataFrame
    patterns: DataFrame

    @cached_property
    def duplicates(self) -> DataFrame:
        return duplicate_rows(self.patterns, self.tables)

    @cached_property
    def candidates(self) -> DataFrame:
        return candidate_identifiers(self.profile)

    @cached_property
    def quality(self) -> DataFrame:
        return Q.quality_by_table(self.profile, self.patterns)

    @cached_property
    def quality_dimensions(self) -> DataFrame:
        return Q.quality_dimensions(self.quality)

    @cached_property
    def quality_score(self) -> DataFrame:
        return Q.quality_score(self.quality)

    @cached_property
    def classifications(self) -> DataFrame:
        return G.classifications(self.profile)

    @cached_property
    def signals(self) -> DataFrame:
        return G.signals(self.classifications)

    @cached_property
    def governance_summary(self) -> DataFrame:
        return G.governance_summary(self.classifications)

    @cached_property
    def quality_judgements(self) -> DataFrame:
        return Q.quality_judgements(self.profile)

    @cached_property
    def governance_judgements(self) -> DataFrame:
        return G.governance_judgements(self.classifications)

    @cached_property
    def profiling_judgements(self) -> DataFrame:
        return profiling_judgements(self.profile, self.duplicates)

    @cached_property
    def actionable(self) -> DataFrame:
        """The judgements recommendations are drawn from."""
        return self.quality_judgements.unionByName(self.governance_judgements)

    @cached_property
    def judgements(self) -> DataFrame:
        return self.profiling_judgements.unionByName(self.actionable)

    @cached_property
    def findings(self) -> DataFrame:
        return J.findings(self.judgements)

    @cached_property
    def evidence(self) -> DataFrame:
        return J.evidence_rows(self.judgements)

    @cached_property
    def recommendations(self) -> DataFrame:
        # Only repeated identifiers quote their evidence, so governance evidence need not be built.
        return recommendations(J.findings(self.actionable), J.evidence_rows(self.quality_judgements))

    @cached_property
    def recommendation_summary(self) -> DataFrame:
        return recommendation_summary(self.recommendations)


@dataclass(frozen=True)
class Catalogue:
    """The tables of an analysis with the metadata known from their schemas."""

    spark: SparkSession
    tables: dict[str, DataFrame]

    @cached_property
    def entries(self) -> list[C.ColumnEntry]:
        return C.catalogue_entries(self.tables)

    @cached_property
    def columns(self) -> DataFrame:
        return C.catalogue_frame(self.spark, self.entries)

    @cached_property
    def table_rows(self) -> DataFrame:
        return C.catalogue_frame(self.spark, self.entries, rows=True)

    def keys(self, rows: bool) -> set[int]:
        return {entry.column_key for entry in self.entries if (entry.lane == C.ROW) == rows}

    def histogram(self, keys: set[int] | None = None) -> DataFrame:
        return value_histogram(C.catalogue_cells(self.tables, self.entries, keys))


def profile_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Counts, ratios, flags and candidates of every column, without parsing values."""
    catalogue = Catalogue(spark, tables)
    return column_counts(catalogue.histogram(catalogue.keys(rows=False)), catalogue.columns)


def profile_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The full column profile of a catalogue."""
    catalogue = Catalogue(spark, tables)
    measured = materialize(numbers.in_ranges(measured_values(catalogue.histogram(catalogue.keys(rows=False)))), "measured")
    return _profile(catalogue, measured)


def _profile(catalogue: Catalogue, measured: DataFrame) -> DataFrame:
    # A few rows per column, which both the profile and the numeric columns are read from.
    types = materialize(column_types(measured), "types")
    return column_profile(types, catalogue.columns, numbers.numeric_statistics(measured, types))


def count_repeated_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Complete-row duplicates of every table."""
    catalogue = Catalogue(spark, tables)
    histogram = catalogue.histogram(catalogue.keys(rows=True))
    return duplicate_rows(duplicate_patterns(histogram, catalogue.table_rows), catalogue.table_rows)


def analyze_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> Analysis:
    """Analyses all tables in one plan: one scan of each, one wide shuffle for all of them.

    What is measured, the different numbers of each column and a few rows besides, is written to the shared folder, so that types, medians
    and the many result tables do not scan again.
    """
    catalogue = Catalogue(spark, tables)
    histogram = catalogue.histogram()
    values = measured_values(histogram)
    patterns = duplicate_patterns(histogram, catalogue.table_rows)
    # One write for both, so that they come from one run over the histogram.
    measured = materialize(numbers.in_ranges(values.unionByName(patterns, allowMissingColumns=True)), "measured")
    profile = materialize(_profile(catalogue, measured.where("family is not null")), "column_profile")
    return Analysis(catalogue.table_rows, profile, measured.where("table_name is not null").select(patterns.columns))


def analyze(frame: DataFrame, table_name: str = "dataset") -> Analysis:
    """Analyses one table."""
    return analyze_catalog(frame.sparkSession, {table_name: frame})
