"""Deterministic input tables as pure functions of a row index.

Each generator takes a frame with a non-negative ``bigint`` index column, so rows come from any
table or from ``spark.range`` and are made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import base36

SEED = 20_260_909

# What the repeated cells of the standard and mixed tables are drawn from.
COMPASS = ("n", "s", "e", "w")
STATES = ("a", "i", "p")
COUNTRIES = ("ES", "PT", "FR")
LETTERS = tuple("abcdefghij")
MIXED_REGIONS = ("North", "north", "NORTH", "South")
MIXED_STATES = ("active", "Active", "ACTIVE", "inactive")
MIXED_SEGMENTS = ("A", "B", "C", "D")
MIXED_CATEGORIES = ("retail", "Retail", "enterprise", "SMB")
MIXED_GENDERS = ("F", "M", "X", "")
MIXED_CITIES = ("MAD", "BCN", "LIS", "PAR")
MIXED_FLAGS = ("true", "false", "1", "0")
SENTINEL = "RAW_SENTINEL_DO_NOT_RETURN"
DEMO_REGIONS = ("North Lab", "South Lab", "East Lab", "West Lab")
DEMO_STATES = ("active", "review", "paused")


def standard_rows(frame: DataFrame, index: str = "id", width: int = 20) -> DataFrame:
    """Twenty realistic text columns; fewer or more on request."""
    i = F.col(index).cast("bigint")
    columns = {
        "record_id": base36(i),
        "email": F.concat(F.lit("u"), base36(i % 4096), F.lit("@x.test")),
        "region": _cycle(COMPASS, i),
        "revenue": F.concat(_text(i % 997), F.lit("."), _padded(i % 100, 2)),
        "created_at": _date_text(i, i),
        "status": _cycle(STATES, i),
        "phone": F.concat(F.lit("555"), _padded(i % 10_000_000, 7)),
        "postal_code": _padded(i % 100_000, 5),
        "age": _text(i % 73 + 18),
        "department": _cycle(LETTERS[:8], i),
        "score": _text(i % 101),
        "active": _text(1 - i % 2),
        "category": _cycle(LETTERS[:6], i),
        "country": _cycle(COUNTRIES, i),
        "cost": _text(i % 701),
        "quantity": _text(i % 9),
        "account_code": F.concat(F.lit("a"), _padded(i % 997, 3)),
        "segment": _cycle(LETTERS[:5], i),
        "updated_at": _date_text(i + 3, i + 7),
        "note": _cycle(LETTERS, i),
    }
    for extra in range(len(columns), width):
        columns[f"c{extra}"] = _text((i + extra) % 10)
    return frame.select(*[value.alias(name) for name, value in list(columns.items())[:width]])


def compact_rows(frame: DataFrame, index: str = "id", width: int = 10, names: list[str] | None = None) -> DataFrame:
    """A key column and ``width - 1`` digit columns."""
    i = F.col(index).cast("bigint")
    names = names or ["record_id", *[f"c{column}" for column in range(1, width)]]
    values = [base36(i), *[_text((i + column) % 10) for column in range(1, width)]]
    return frame.select(*[value.alias(name) for name, value in zip(names, values)])


def mixed_rows(frame: DataFrame, index: str = "id", seed: int = SEED) -> DataFrame:
    """Twenty dirty text columns: every hundredth row repeats the one before it, formats are mixed.

    Random picks are a hash of index and seed, so a row depends on nothing but its index.
    """
    given = F.col(index).cast("bigint")
    i = F.when((given > 0) & (given % 100 == 0), given - 1).otherwise(given)

    def pick(values: tuple[str, ...], salt: int) -> Column:
        return _cycle(values, F.pmod(F.xxhash64(i, F.lit(seed + salt)), F.lit(len(values))))

    identifier = F.when((i > 0) & (i % 20 == 0), i - 1).otherwise(i)
    cents = _padded(i % 100, 2)
    columns = {
        "customer_id": F.concat(F.lit("c"), base36(identifier)),
        "email": F.when(i % 8 == 0, "")
        .when(i % 20 == 1, F.concat(F.lit("bad-"), base36(i)))
        .otherwise(F.concat(F.lit("u"), base36(i % 10_000), F.lit("@example.test"))),
        "phone": F.when(i % 9 == 0, "")
        .when(i % 31 == 0, "oops")
        .otherwise(F.concat(F.lit("555"), _padded(i % 10_000_000, 7))),
        "postal_code": _padded(i % 100_000, 5),
        "region": F.when(i % 8 == 0, "").otherwise(pick(MIXED_REGIONS, 1)),
        "age": F.when(i % 11 == 0, "").when(i % 37 == 0, "unknown").otherwise(_text(i % 73 + 18)),
        "revenue": F.when(i % 29 == 0, "bad").otherwise(
            F.concat(_text(i % 997), F.when(i % 4 == 0, ",").otherwise("."), cents)
        ),
        "created_at": F.when(i % 23 == 0, "not-a-date")
        .when(i % 3 == 0, F.concat_ws("/", _padded(i % 28 + 1, 2), _padded(i % 12 + 1, 2), F.lit("2026")))
        .otherwise(_date_text(i, i)),
        "updated_at": F.when(i % 10 == 0, "").otherwise(_date_text(i + 1, i + 5)),
        "status": pick(MIXED_STATES, 2),
        "country": pick(COUNTRIES, 3),
        "segment": pick(MIXED_SEGMENTS, 4),
        "category": pick(MIXED_CATEGORIES, 5),
        "quantity": _text(i % 9),
        "discount": F.concat(F.lit("0."), _padded(i % 30, 2)),
        "account_code": F.concat(F.lit("acct-"), _padded(i % 997, 3)),
        "free_text": F.when(i == 0, SENTINEL).otherwise(F.concat(F.lit("note-"), _text(i % 100))),
        "gender": pick(MIXED_GENDERS, 6),
        "city": pick(MIXED_CITIES, 7),
        "active": pick(MIXED_FLAGS, 8),
    }
    return frame.select(*[value.alias(name) for name, value in columns.items()])


def demo_rows(frame: DataFrame, index: str = "id") -> DataFrame:
    """The 13-column customer operations sample; it is made for the indexes 1 to 50."""
    i = F.col(index).cast("bigint")
    days = (i - 1).cast("int")
    word = F.when(i % 2 == 1, "true").otherwise("false")
    number = F.when(i == 26, 25).otherwise(i)
    return frame.select(
        F.concat(F.lit("SYN-CUST-"), _padded(number, 3)).alias("customer_id"),
        F.concat(F.lit("Synthetic Customer "), _padded(i, 2)).alias("full_name"),
        F.when(~i.isin(7, 19, 33), F.concat(F.lit("customer"), _padded(i, 2), F.lit("@example.test"))).alias("email"),
        F.when(~i.isin(5, 18, 42), F.concat(F.lit("synthetic-phone-"), _padded(i, 3))).alias("phone"),
        F.when(~i.isin(12, 37), _cycle(DEMO_REGIONS, i)).alias("region"),
        F.date_add(F.lit("2025-01-01").cast("date"), days).alias("signup_date"),
        F.timestamp_micros((i - 1) * 86_400_000_000 + 1_743_499_800_000_000).alias("last_contact_at"),
        (i * 1_250 + 50_000).alias("annual_revenue"),
        _cycle(DEMO_STATES, i).alias("account_status"),
        F.when(~i.isin(9, 28), F.concat(F.lit("Synthetic operational note "), _padded(i, 2))).alias("notes"),
        F.when(i <= 40, word).otherwise(F.upper(word)).alias("active_flag"),
        F.when(i == 50, "unknown").otherwise(_text(i % 20 + 70)).alias("service_score"),
        (i % 32 + 24).alias("customer_age"),
    )


def _text(number: Column) -> Column:
    return number.cast("string")


def _padded(number: Column, width: int) -> Column:
    """Zero-padded to at least ``width`` digits, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def _cycle(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)


def _date_text(month: Column, day: Column) -> Column:
    return F.concat(F.lit("2026-"), _padded(month % 12 + 1, 2), F.lit("-"), _padded(day % 28 + 1, 2))
