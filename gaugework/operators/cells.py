"""Long form of tables: one row per cell, plus one row per table row.

Every cell becomes ``(column_key, whole, real, body)`` with exactly the typed slot of its column
filled, so a catalogue of tables of any types is counted by a single grouped aggregation and whole
numbers and doubles are never rendered as text. ``column_key = 16 * ordinal + lane``; the lane says
how the slot is read. Each table also owns a ROW lane whose body identifies the complete row.

Texts longer than ``RAW_BYTES`` that cannot be a typed token travel as a SHA-256 digest with their
length in ``whole``, so documents are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugework.functions.tokens import may_be_token

LANES = 16
TEXT, BOOLEAN, INTEGER, FLOAT, DATE, DATETIME, DECIMAL_WHOLE, DECIMAL, OPAQUE, ROW = range(10)
RAW_BYTES = 64

@dataclass(frozen=True)
class ColumnEntry:
    """One column of the catalogue, known from the schema alone."""

    column_key: int
    table_name: str
    position: int
    name: str
    physical_dtype: str
    lane: int


def lane_of(data_type: T.DataType) -> int:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.DecimalType):
        return DECIMAL_WHOLE if data_type.scale == 0 else DECIMAL
    return OPAQUE


def catalogue_entries(tables: dict[str, DataFrame]) -> list[ColumnEntry]:
    """Columns of all tables in order; each table is followed by one slot for its ROW lane."""
    entries: list[ColumnEntry] = []
    ordinal = 0
    for table_name, frame in tables.items():
        for position, field in enumerate(frame.schema.fields):
            lane = lane_of(field.dataType)
            entries.append(
                ColumnEntry(
                    ordinal * LANES + lane, table_name, position, field.name, field.dataType.simpleString(), lane
                )
            )
            ordinal += 1
        entries.append(ColumnEntry(ordinal * LANES + ROW, table_name, -1, "", "", ROW))
        ordinal += 1
    return entries


def catalogue_frame(spark: SparkSession, entries: list[ColumnEntry], rows: bool = False) -> DataFrame:
    """The schema metadata as a local relation: one row per column, or per table for ``rows``."""
    import pyarrow as pa

    kept = [entry for entry in entries if (entry.lane == ROW) == rows]
    return spark.createDataFrame(
        pa.table(
            {
                "column_key": pa.array([e.column_key for e in kept], pa.int32()),
                "table_name": pa.array([e.table_name for e in kept], pa.string()),
                "position": pa.array([e.position for e in kept], pa.int32()),
                "name": pa.array([e.name for e in kept], pa.string()),
                "physical_dtype": pa.array([e.physical_dtype for e in kept], pa.string()),
            }
        )
    )


def catalogue_cells(
    tables: dict[str, DataFrame], entries: list[ColumnEntry], keys: set[int] | None = None
) -> DataFrame:
    """Cells of the catalogue as one frame, of all or of the given column keys; each table is
    scanned once and columns that are not asked for are not read."""
    parts = []
    for table_name, frame in tables.items():
        own = [e for e in entries if e.table_name == table_name and (keys is None or e.column_key in keys)]
        part = _table_cells(frame, own)
        if part is not None:
            parts.append(part)
    return reduce(DataFrame.unionAll, parts)


def _table_cells(frame: DataFrame, entries: list[ColumnEntry]) -> DataFrame | None:
    fields = frame.schema.fields
    # Positional names keep odd column names (dots, spaces, equal but for case) out of the way.
    frame = _settled(frame.toDF(*[f"c{i}" for i in range(len(fields))]))
    fields = frame.schema.fields
    slots = []
    for entry in entries:
        if entry.lane != ROW:
            slots.append(_slot(entry.column_key, *_raw(f"c{entry.position}", fields[entry.position].dataType)))
        elif fields:
            columns = [(field.name, field.dataType) for field in fields]
            slots.append(_slot(entry.column_key, NO_WHOLE, NO_REAL, row_text(columns), null_positions(columns)))
    if not slots:
        return None
    # Typing and hashing are written once, for the exploded cell, so the plan does not grow with the width.
    return frame.selectExpr(f"explode(array({', '.join(slots)})) as cell").selectExpr(
        "cell.column_key", f"{_whole('cell')} as whole", "cell.real", f"{_body('cell')} as body"
    )


def _settled(frame: DataFrame) -> DataFrame:
    """Timestamps without zone as instants, where a UTC session makes that a plain cast."""
    if frame.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        return frame
    return frame.selectExpr(
        *[
            f"cast({f.name} as timestamp) as {f.name}" if isinstance(f.dataType, T.TimestampNTZType) else f.name
            for f in frame.schema.fields
        ]
    )


NO_WHOLE, NO_REAL, NO_BODY = "cast(null as bigint)", "cast(null as double)", "cast(null as string)"


def _slot(column_key: int, whole: str, real: str, body: str, nulls: str = NO_BODY) -> str:
    return f"named_struct('column_key', {column_key}, 'whole', {whole}, 'real', {real}, 'body', {body}, 'nulls', {nulls})"


def _raw(value: str, data_type: T.DataType) -> tuple[str, str, str]:
    """SQL for the three slots of one cell, texts as they are."""
    lane = lane_of(data_type)
    if lane in (BOOLEAN, INTEGER):
        return f"cast({value} as bigint)", NO_REAL, NO_BODY
    if lane == FLOAT:
        return NO_WHOLE, f"cast({value} as double)", NO_BODY
    if lane == DATE:
        return f"cast(unix_date({value}) as bigint)", NO_REAL, NO_BODY
    if lane == DATETIME:
        return epoch_micros(value, data_type), NO_REAL, NO_BODY
    if lane in (DECIMAL_WHOLE, DECIMAL):
        return NO_WHOLE, f"cast({value} as double)", f"cast({value} as string)"
    if lane == OPAQUE:
        return NO_WHOLE, NO_REAL, f"case when {value} is not null then {canonical_text(value, data_type)} end"
    return NO_WHOLE, NO_REAL, f"cast({value} as string)"


def _is_long(cell: str) -> str:
    return f"octet_length({cell}.body) > {RAW_BYTES} and not {may_be_token(f'{cell}.body')}"


def _whole(cell: str) -> str:
    is_long = f"{cell}.column_key % {LANES} = {TEXT} and {_is_long(cell)}"
    return f"case when {is_long} then cast(char_length({cell}.body) as bigint) else {cell}.whole end"


def _body(cell: str) -> str:
    """SQL for what identifies a cell's text or a complete row; never null for rows."""
    lane = f"{cell}.column_key % {LANES}"
    row_key = f"case when octet_length({cell}.body) <= {RAW_BYTES} then {cell}.body else concat('#', {_digest(f'{cell}.body')}) end"
    return (
        f"case when {lane} = {ROW} then concat_ws('|', {row_key}, {cell}.nulls) "
        f"when {lane} = {OPAQUE} or {lane} = {TEXT} and {_is_long(cell)} then {_digest(f'{cell}.body')} else {cell}.body end"
    )


def epoch_micros(value: str, data_type: T.DataType) -> str:
    """Microseconds since 1970; a timestamp without zone is read as UTC whatever the session says."""
    if isinstance(data_type, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {value})"
    return f"unix_micros({value})"


def canonical_text(value: str, data_type: T.DataType, exact: bool = False) -> str:
    """A text that is equal exactly when the values are, for types without statistics. ``exact`` tells the two zeros apart."""
    if isinstance(data_type, (T.MapType, T.ArrayType, T.StructType)):
        return f"to_json({canonical_value(value, data_type, exact)}, map('ignoreNullFields', 'false'))"
    return f"cast({canonical_value(value, data_type, exact)} as string)"


def canonical_value(value: str, data_type: T.DataType, exact: bool = False, depth: int = 0) -> str:
    """The value in types that JSON keeps whole: instants in microseconds, dates in days, bytes in hex, maps as entries in the order of their
    keys."""
    item = f"x{depth}"
    if isinstance(data_type, T.BinaryType):
        return f"hex({value})"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # Zero is one value unless its sign counts, and not-a-number is one.
        return f"cast(cast({value} as double) as string)" if exact else f"cast({value} as double) + 0D"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(value, data_type)
    if isinstance(data_type, T.DateType):
        return f"unix_date({value})"
    if isinstance(data_type, T.ArrayType):
        return f"transform({value}, {item} -> {canonical_value(item, data_type.elementType, exact, depth + 1)})"
    if isinstance(data_type, T.MapType):
        parts = [canonical_value(f"{item}.{name}", kind, exact, depth + 1) for name, kind in (("key", data_type.keyType), ("value", data_type.valueType))]
        order = "(a, b) -> case when a.key < b.key then -1 when a.key > b.key then 1 else 0 end"
        return f"transform(array_sort(map_entries({value}), {order}), {item} -> named_struct('key', {parts[0]}, 'value', {parts[1]}))"
    if isinstance(data_type, T.StructType):
        fields = ", ".join(f"'f{i}', {canonical_value(f'{value}.`{_quoted(field.name)}`', field.dataType, exact, depth + 1)}" for i, field in enumerate(data_type.fields))
        return f"case when {value} is not null then named_struct({fields or "'none', true"}) end"
    if isinstance(data_type, (T.StringType, T.BooleanType, T.IntegralType)):
        return value
    return f"cast({value} as string)"


def _quoted(name: str) -> str:
    return name.replace("`", "``")


def row_text(columns: list[tuple[str, T.DataType]], exact: bool = False) -> str:
    """SQL for a text that is equal exactly when the rows are; nulls equal nulls, and zeros do unless ``exact``.

    Free text is preceded by its byte length, so different rows never run into the same text.
    """
    return f"concat_ws(';', {', '.join(_row_field(*column, exact) for column in columns)})"


def row_body(text: str, columns: list[tuple[str, T.DataType]]) -> str:
    """SQL for the identity of the complete row, then ``|`` and the comma-joined positions of its
    nulls. Short rows stay as they are and longer ones become a digest."""
    key = f"case when octet_length({text}) <= {RAW_BYTES} then {text} else concat('#', {_digest(text)}) end"
    # Never null, which the optimizer must be able to see: it would otherwise carry the whole expression
    # through every join as a condition.
    return f"concat_ws('|', {key}, {null_positions(columns)})"


def null_positions(columns: list[tuple[str, T.DataType]]) -> str:
    """SQL for the comma-joined positions of a row's nulls."""
    nulls = ", ".join(f"case when {name} is null then '{i}' end" for i, (name, _) in enumerate(columns))
    return f"concat_ws(',', {nulls})"


def _row_field(value: str, data_type: T.DataType, exact: bool = False) -> str:
    lane = lane_of(data_type)
    if lane == FLOAT:
        text = f"cast({canonical_value(value, data_type, exact)} as string)"
    elif lane == DATE:
        text = f"cast(unix_date({value}) as string)"
    elif lane == DATETIME:
        text = f"cast({epoch_micros(value, data_type)} as string)"
    elif lane in (TEXT, OPAQUE):
        raw = f"cast({value} as string)" if lane == TEXT else canonical_text(value, data_type, exact)
        text = f"concat(octet_length({raw}), ':', {raw})"
    else:
        text = f"cast({value} as string)"
    return f"coalesce({text}, '~')"


def _digest(text: str) -> str:
    return f"base64(unhex(sha2({text}, 256)))"
