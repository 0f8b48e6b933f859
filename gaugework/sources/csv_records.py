"""Records of CSV files that are read in splits, though quoted fields may hold line breaks.

Whether a line begins inside quotes depends on all lines before it. What a line does to that is one of four functions of
one bit: it leaves the state, turns it, or ends closed or open however it began. Functions compose, so the state follows from a running
scan within each block of a file and another over the blocks, of which only numbers are moved. A quote opens a field only where a field
begins; elsewhere it is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block_start"]
ORDER = ["at", "sub"]
_QUOTED = r'"(?:[^"]++|"")*+"'
_UNENDED = r'"(?:[^"]++|"")*+\z'


def uri(column: str) -> Column:
    """File names as one spelling: listings and scans disagree about slashes after the scheme."""
    return F.regexp_replace(column, r"^(\w+):/+", "$1:/")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their break, their file, the start of the block they were read from, and two numbers that grow in the block.

    Large files are split. A line ends with a line feed, a carriage return or both; the reader leaves a byte order mark out.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        uri("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
        F.is_valid_utf8("value").alias("is_valid"),
    )
    # "a\rb\r" is two lines, of which the second is ended by the line feed too; "a\rb" ends with a line feed alone.
    crossed = F.col("line").endswith("\r")
    parts = F.split("line", "\r")
    own = F.when(crossed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    end = lambda i: F.when(i < F.size(own) - 1, "\r").when(crossed, "\r\n").otherwise("\n")
    several = F.transform(own, lambda part, i: F.struct(i.alias("sub"), part.alias("line"), end(i).alias("end")))
    single = F.array(F.struct(F.lit(0).alias("sub"), F.col("line").alias("line"), F.lit("\n").alias("end")))
    kept = ["file", "block_start", "at", "is_valid"]
    lines = read.select(*kept, F.explode(F.when(F.col("line").contains("\r"), several).otherwise(single)).alias("part"))
    return lines.select(*kept, "part.sub", "part.line", "part.end")


def _field(delimiter: Column) -> Column:
    return F.concat(F.lit(rf'(?:{_QUOTED}(?=['), delimiter, F.lit(r']|\z)|(?!")[^'), delimiter, F.lit(r"]*+)"))


def _is_whole(text: Column, delimiter: Column) -> Column:
    """Whether the text is fields and delimiters, with every quote closed."""
    field = _field(delimiter)
    return F.regexp_like(text, F.concat(F.lit(r"\A"), field, F.lit("(?:["), delimiter, F.lit("]"), field, F.lit(r")*+\z")))


def _is_unended(text: Column, delimiter: Column) -> Column:
    """Whether the text ends within quotes, after whole fields."""
    return F.regexp_like(text, F.concat(F.lit(r"\A(?:"), _field(delimiter), F.lit("["), delimiter, F.lit(rf"])*+{_UNENDED}")))


def _count(text: Column, delimiter: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, delimiter, F.lit("")))


def _separators(text: Column, delimiter: Column) -> Column:
    """Delimiters outside quotes."""
    quoted = F.concat(F.lit(r"(\A|["), delimiter, F.lit(rf'])(?:{_QUOTED}(?=['), delimiter, F.lit(rf"]|\z)|{_UNENDED})"))
    return _count(F.regexp_replace(text, quoted, F.lit("$1")), delimiter)


def quoting(lines: DataFrame, delimiter: Column) -> DataFrame:
    """Adds what each line does: ``closed`` if it begins outside quotes and ``open`` if within, both as (ends_open, separators, junk).

    Junk is anything but a delimiter after a closing quote. Lines without quotes are told by counting.
    """
    line = F.col("line")
    has_quote = line.contains('"')
    inside = F.concat(F.lit('"'), line)

    def seen(text: Column, ends_open: bool) -> Column:
        whole, unended = _is_whole(text, delimiter), _is_unended(text, delimiter)
        state = F.when(has_quote, ~whole & unended).otherwise(F.lit(ends_open))
        separators = F.when(has_quote, _separators(text, delimiter)).otherwise(F.lit(0) if ends_open else _count(text, delimiter))
        return F.struct(state.alias("ends_open"), separators.alias("separators"), (has_quote & ~whole & ~unended).alias("junk"))

    return lines.withColumn("closed", seen(line, False)).withColumn("open", seen(inside, True))


def _scanned(frame: DataFrame, part: list[str], order: list[str], closed: Column, opened: Column) -> DataFrame:
    """Adds ``known`` and ``turned`` before each row, and ``known_after`` and ``turned_after``, of the functions composed so far: the state is
    ``known``, or the one at the start where that is null, turned once if ``turned``."""
    window = Window.partitionBy(*part).orderBy(*order)
    frame = frame.withColumn("_turns", F.sum(F.when(closed & ~opened, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(closed == opened, F.struct(closed.alias("to"), F.col("_turns").alias("turns")))
    frame = frame.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    after = (F.col("_turns") - F.coalesce(F.col("_fixed.turns"), F.lit(0))) % 2 == 1
    frame = frame.withColumn("known_after", F.col("_fixed.to")).withColumn("turned_after", after)
    frame = frame.withColumn("known", F.lag("known_after").over(window)).withColumn("turned", F.coalesce(F.lag("turned_after").over(window), F.lit(False)))
    return frame.drop("_turns", "_fixed")


def state(known: Column, turned: Column, start: Column) -> Column:
    return F.coalesce(known, start) != turned


def line_states(lines: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Lines of :func:`quoting` with the composition before them, whose start is that of the part."""
    return _scanned(lines, part, order, F.col("closed.ends_open"), F.col("open.ends_open"))


def block_table(lines: DataFrame) -> DataFrame:
    """One row per block: ``starts_open``, ``starts`` (records that begin in it), ``starts_before`` in the file, ``goes_on`` (whether its last
    record does in the next block) and ``ends_open``. ``lines`` are those of :func:`quoting`."""
    scanned = line_states(lines.select(*BLOCK, *ORDER, "closed", "open"), BLOCK, ORDER)
    is_start = [F.when(state(F.col("known"), F.col("turned"), F.lit(start)), 0).otherwise(1) for start in (False, True)]
    end = F.max_by(F.struct("known_after", "turned_after"), F.struct(*ORDER))
    blocks = scanned.groupBy(*BLOCK).agg(end.alias("end"), F.sum(is_start[0]).alias("starts_closed"), F.sum(is_start[1]).alias("starts_open"))
    ends = [state(F.col("end.known_after"), F.col("end.turned_after"), F.lit(start)) for start in (False, True)]
    blocks = blocks.select(*BLOCK, *[end.alias(name) for end, name in zip(ends, ("from_closed", "from_open"))], F.array("starts_closed", "starts_open").alias("counts"))
    placed = _scanned(blocks, ["file"], ["block_start"], F.col("from_closed"), F.col("from_open"))
    order = Window.partitionBy("file").orderBy("block_start")
    starts_open = state(F.col("known"), F.col("turned"), F.lit(False))
    placed = placed.withColumn("starts_open", starts_open).withColumn("starts", F.when(F.col("starts_open"), F.col("counts")[1]).otherwise(F.col("counts")[0]))
    before = F.coalesce(F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends_open = F.when(F.col("starts_open"), F.col("from_open")).otherwise(F.col("from_closed"))
    return placed.select(*BLOCK, "starts_open", "starts", before.alias("starts_before"), F.coalesce(F.lead("starts_open").over(order), F.lit(False)).alias("goes_on"), ends_open.alias("ends_open"))


def numbered_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of :func:`quoting` with ``is_open`` and the number of their record in the file, from 1, which may have begun in an earlier block."""
    placed = line_states(lines, BLOCK, ORDER).join(blocks, BLOCK)
    placed = placed.withColumn("is_open", state(F.col("known"), F.col("turned"), F.col("starts_open")))
    here = Window.partitionBy(*BLOCK).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("in_block", F.sum(F.when(F.col("is_open"), 0).otherwise(1)).over(here))
    return placed.withColumn("record", F.col("starts_before") + F.col("in_block")).drop("known", "turned", "known_after", "turned_after")


def record_texts(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, record, text): whole records, with the breaks inside quotes as they were.

    A record's lines meet where their block already is. Only what crosses a border of blocks is moved again: the first piece and the last
    record of a block, however many blocks a record spans.
    """
    numbered = numbered_lines(lines, blocks)
    piece = F.array_sort(F.collect_list(F.struct(*ORDER, "line", "end")))
    crosses = (F.col("in_block") == 0) | F.col("goes_on") & (F.col("in_block") == F.col("starts"))
    pieces = numbered.groupBy(*BLOCK, "in_block", "record", crosses.alias("crosses")).agg(piece.alias("lines"))
    breaks = F.transform("lines", lambda line, i: F.concat(line["line"], F.when(i < F.size("lines") - 1, line["end"]).otherwise("")))
    pieces = pieces.select(*BLOCK, "record", "crosses", F.array_join(breaks, "").alias("text"), F.element_at("lines", -1)["end"].alias("end"))
    parts = F.array_sort(F.collect_list(F.struct("block_start", "text", "end")))
    crossing = pieces.where("crosses").groupBy("file", "record").agg(parts.alias("parts"))
    joined = F.transform("parts", lambda part, i: F.concat(part["text"], F.when(i < F.size("parts") - 1, part["end"]).otherwise("")))
    return pieces.where("not crosses").select("file", "record", "text").unionByName(crossing.select("file", "record", F.array_join(joined, "").alias("text")))


def record_fields(record: Column, delimiter: Column) -> Column:
    """The fields of one whole record without their quotes."""
    raw = F.regexp_extract_all(F.concat(delimiter, record), F.concat(F.lit("["), delimiter, F.lit("]("), _field(delimiter), F.lit(")")), F.lit(1))
    inner = lambda field: F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda field: F.when(field.startswith('"'), inner(field)).otherwise(field))
