"""Findings and the evidence behind them, as SQL structs built next to the measured values."""

from __future__ import annotations

from pyspark.sql import DataFrame

VERSION = "0.1"
_DETAILS = "array<struct<key:string,value:string>>"
_FINDING = (
    "finding_id", "assertion_level", "severity", "confidence", "category", "subject", "title", "description", "method",
)


def text(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("'", "\\'") + "'"


def detail(key: str, value: str) -> str:
    return f"named_struct('key', '{key}', 'value', cast({value} as string))"


def finding(**fields: str) -> str:
    """Struct of a finding; every field is SQL, see ``text`` for literals."""
    return "named_struct(" + ", ".join(f"'{name}', cast({fields[name]} as string)" for name in _FINDING) + ")"


def evidence(
    evidence_id: str,
    type: str,
    subject: str,
    rule_id: str,
    metric: str,
    observed: str,
    observed_number: str = "null",
    denominator: str = "null",
    affected_rows: str = "null",
    details: list[str] | None = None,
) -> str:
    listed = f"array({', '.join(details)})" if details else f"cast(array() as {_DETAILS})"
    return (
        f"named_struct('evidence_id', {evidence_id}, 'type', '{type}', 'subject', {subject}, 'rule_id', {rule_id},"
        f" 'rule_version', '{VERSION}', 'metric', '{metric}', 'observed_value', cast({observed} as string),"
        f" 'observed_number', cast({observed_number} as double), 'denominator', cast({denominator} as bigint),"
        f" 'affected_rows', cast({affected_rows} as bigint), 'sample_policy', 'none', 'details', {listed})"
    )


def judgement(order: str, finding_struct: str, evidence_array: str, where: str = "true") -> str:
    """One finding with its evidence, null unless ``where`` holds; ``order`` is its place within the
    source."""
    return (
        f"case when {where} then named_struct('finding_order', cast({order} as bigint),"
        f" 'finding', {finding_struct}, 'evidence', {evidence_array}) end"
    )


def explode_judgements(frame: DataFrame, source: str, judgements: list[str]) -> DataFrame:
    """``table_name, source, finding_order, finding, evidence`` from nullable judgement structs."""
    return frame.selectExpr(
        "table_name", f"'{source}' as source", f"explode(array_compact(array({', '.join(judgements)}))) as judgement"
    ).select("table_name", "source", "judgement.*")


def findings(judgements: DataFrame) -> DataFrame:
    return judgements.selectExpr(
        "table_name", "source", "finding_order", "finding.*", "transform(evidence, e -> e.evidence_id) as evidence_ids"
    )


def evidence_rows(judgements: DataFrame) -> DataFrame:
    return judgements.selectExpr(
        "table_name", "source", "finding_order", "posexplode(evidence) as (evidence_order, item)"
    ).select("table_name", "source", "finding_order", "evidence_order", "item.*")
