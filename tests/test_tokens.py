"""Lexical rules against Python's own parsers."""

import re
from datetime import date, datetime, timezone

import pytest

from gaugework.functions.names import name_tokens
from gaugework.functions.tokens import datetime_number, is_strict, token_family, token_of

TEXTS = [
    "", " ", "1", "+1", "-0", "007", "0", "00", "01a", "1.5", "+1.50", "-0.1", ".5", "1.", "1e5", "NaN", "true", "TRUE",
    "True", "tRUE", "yes", "No", "nO", " true ", "\t12\n", "12\n", " 12 ", "1 2", "--1", "٣",
    "2026-02-28", "2026-02-29", "2024-02-29", "1900-02-29", "2000-02-29", "0000-01-01", "2026-13-01", "2026-1-1",
    "2026-01-01T00:00:00", "2026-01-01T24:00:00", "2026-01-01T23:59:59.1234567Z", "2026-01-01T00:00:60",
    "2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00-23:59", "2026-01-01T00:00:00+24:00", "2026-01-01T00:00:00+23:60",
    "2026-01-01T00:00:00+05:99", "2026-01-01 00:00:00", "2026-01-01T00:00:00z", "9" * 80, "  " + "7" * 70, "prose, long",
]


def expected_family(text: str) -> str:
    token = text.strip()
    if len(token) > 1 and token.isascii() and token.isdigit() and token[0] == "0":
        return "LEADING_ZERO"
    sign = {"+": "PLUS", "-": "MINUS"}.get(token[:1], "UNSIGNED")
    if re.fullmatch(r"[+-]?(0|[1-9][0-9]*)", token):
        return f"INTEGER_{sign}"
    if re.fullmatch(r"[+-]?(0|[1-9][0-9]*)\.[0-9]+", token):
        return f"FLOAT_{sign}"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", token):
        try:
            date.fromisoformat(token)
            return "DATE_ISO"
        except ValueError:
            return ""
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?", token):
        try:
            datetime.fromisoformat(token)
        except ValueError:
            return ""
        return "DATETIME_Z" if token.endswith("Z") else "DATETIME_OFFSET" if token[-6] in "+-" else "DATETIME_NO_TIMEZONE"
    if token.casefold() in ("true", "false", "yes", "no"):
        for name, form in (("LOWER", str.lower), ("UPPER", str.upper), ("TITLE", str.title)):
            if token == form(token):
                return f"BOOLEAN_{name}"
        return "BOOLEAN_OTHER"
    return ""


def test_families_and_strictness_match_python(spark):
    frame = spark.createDataFrame([(text,) for text in TEXTS], "text string")
    rows = (
        frame.selectExpr("text", f"{token_of('text')} as token")
        .selectExpr("*", f"{token_family('token')} as family")
        .selectExpr("*", f"coalesce({is_strict('text', 'token', 'family')}, false) as strict")
        .collect()
    )
    assert {row.text: row.family for row in rows} == {text: expected_family(text) for text in TEXTS}
    for row in rows:
        untrimmed = row.text == row.text.strip() and row.family != ""
        assert row.strict == (untrimmed and row.text.lower() not in ("yes", "no")), row


@pytest.mark.parametrize(
    "text", ["2026-03-01T09:30:00", "2026-03-01T09:30:00.1Z", "2026-03-01T09:30:00.1234569+05:30", "1969-12-31T23:00:00-02:15"]
)
def test_datetimes_become_utc_micros(spark, text):
    parsed = datetime.fromisoformat(text)
    parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
    micros = (parsed - datetime(1970, 1, 1, tzinfo=timezone.utc)) // (datetime.resolution)
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"{datetime_number('t')} as us").head()
    assert row.us == micros


def test_name_tokens(spark):
    names = {"customerId": "customer id", "zip-code": "zip code", "Free Text": "free text", "a__b": "a b", "HTTPServer": "httpserver", "": ""}
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    rows = frame.selectExpr("name", f"array_join({name_tokens('name')}, ' ') as words").collect()
    assert {row.name: row.words for row in rows} == names
