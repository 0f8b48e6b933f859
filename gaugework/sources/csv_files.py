"""CSV sources: delimiter detection, header and row audit, and the text-only scan.

Files are judged and read in splits and with built-in functions only; :mod:`gaugework.sources.csv_records` tells which lines are one record.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.session import materialize
from gaugework.sources.csv_records import BLOCK, ORDER, block_table, csv_lines, line_states, numbered_lines, quoting, record_fields, record_texts, state, uri
from gaugework.sources.errors import EmptyDataset, FileTooLarge, LimitExceeded, Malformed, raise_for
from gaugework.sources.limits import Limits, beyond

# The delimiters tried, in order, and the records looked at.
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_RECORDS = 20
#: Lines of a file among which its first records are looked for at first.
HEAD_LINES = 400
#: Columns that the reader is prepared for.
READER_COLUMNS = 1_000_000
CORRUPT = "_corrupt_record"


def csv_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """The files below a path with their size and, for empty or oversized ones, a verdict. File
    contents are not read."""
    sizes = spark.read.format("binaryFile").load(path).select(uri("path").alias("file"), F.col("length").alias("bytes"))
    # Scans leave out files without content, so the names come from the listing that Spark's driver holds for any scan.
    names = pa.table({"name": pa.array(spark.read.text(path).inputFiles(), pa.string())})
    listed = spark.createDataFrame(names).select(uri("name").alias("file")).distinct()
    listed = listed.join(sizes, "file", "left").fillna(0, ["bytes"])
    verdict = F.when(F.col("bytes") == 0, EmptyDataset.code).when(
        beyond(F.col("bytes"), limits.max_file_bytes), FileTooLarge.code
    )
    return listed.withColumn("verdict", verdict)


def csv_heads(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Delimiter, header and header verdict of every file.

    The first records of a file are looked at, however long they are: as long as some delimiter has not met its twenty records, an error or
    the end of the file, more lines of that file are taken, eight times as many each time. The delimiter is the one that gives
    all of them one width, and the greatest if several do; two such are no decision, and none means a comma.
    """
    found, wanted, count = None, lines, HEAD_LINES
    while True:
        tried = materialize(_tried_delimiters(wanted, count), "heads")
        settled = tried.where("settled").drop("settled")
        found = settled if found is None else found.unionByName(settled)
        open_files = tried.where("not settled").select("file")
        if open_files.isEmpty():
            break
        # Files whose first records are that long; a row for each.
        wanted, count = lines.join(open_files, "file", "left_semi"), count * 8
    head = found.withColumn("header", F.when(F.col("delimiter").isNotNull(), record_fields(F.col("text"), F.col("delimiter"))).otherwise(F.array().cast("array<string>")))
    bad = F.col("broken") | F.exists("header", lambda name: F.trim(name) == "") | (F.size(F.array_distinct("header")) < F.size("header"))
    verdict = (
        F.when(F.col("delimiter").isNull(), Malformed.code)
        .when(F.col("text") == "", EmptyDataset.code)
        .when(beyond(F.size("header"), limits.max_columns), LimitExceeded.code)
        .when(bad, Malformed.code)
    )
    return head.select("file", "delimiter", "header", verdict.alias("verdict"))


def _tried_delimiters(lines: DataFrame, count: int) -> DataFrame:
    """What the first ``count`` lines of each file say: the delimiter, the first record under it, and whether that is settled."""
    order = Window.partitionBy("file").orderBy("block_start", *ORDER)
    # Ranked before the shuffle, so that only so many lines of each part of a file are moved; one more tells whether the file goes on.
    first = lines.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count + 1)
    first = first.withColumn("last", F.max("n").over(Window.partitionBy("file"))).where(F.col("n") <= count)
    tried = first.withColumn("delimiter", F.explode(F.array(*[F.lit(d) for d in DELIMITERS]))).select("file", "delimiter", "n", "line", "end", (F.col("last") <= count).alias("all_read"))
    each = ["file", "delimiter"]
    scanned = line_states(quoting(tried, F.col("delimiter")), each, ["n"]).withColumn("is_open", state(F.col("known"), F.col("turned"), F.lit(False)))
    begun = F.when(F.col("is_open"), 0).otherwise(1)
    scanned = scanned.withColumn("record", F.sum(begun).over(Window.partitionBy(*each).orderBy("n")))
    seen = F.when(F.col("is_open"), F.col("open")).otherwise(F.col("closed"))
    texts = F.array_sort(F.collect_list(F.when(F.col("record") == 1, F.struct("n", "line", "end"))))
    records = scanned.where(F.col("record") <= SAMPLE_RECORDS + 1).select(*each, "all_read", "n", "record", "line", "end", seen.alias("seen"), "is_open").groupBy(*each, "record").agg(
        F.first("all_read").alias("all_read"), F.sum("seen.separators").alias("separators"), F.max("seen.junk").alias("junk"),
        F.max_by("seen.ends_open", "n").alias("unended"), ((F.count(F.lit(1)) == 1) & (F.max("line") == "")).alias("blank"), texts.alias("lines"),
    )
    sampled, told = F.col("record") <= SAMPLE_RECORDS, ~F.col("blank")
    joined = F.array_join(F.transform("lines", lambda part, i: F.concat(part["line"], F.when(i < F.size("lines") - 1, part["end"]).otherwise(""))), "")
    facts = records.groupBy(*each).agg(
        F.max(F.when(sampled, F.col("junk") | (F.col("unended") & F.col("all_read")))).alias("error"),
        F.max(sampled & F.col("junk")).alias("early"), F.max("record").alias("begun"), F.first("all_read").alias("all_read"),
        F.min(F.when(sampled & told, F.col("separators"))).alias("least"), F.max(F.when(sampled & told, F.col("separators"))).alias("most"),
        F.max(F.when(F.col("record") == 1, joined)).alias("text"), F.max(F.when(F.col("record") == 1, F.col("junk") | F.col("unended"))).alias("broken"),
    )
    width = F.when(~F.col("error") & (F.col("least") == F.col("most")) & (F.col("most") > 0), F.col("most"))
    facts = facts.withColumn("width", width).withColumn("settled", F.col("all_read") | F.col("early") | (F.col("begun") > SAMPLE_RECORDS))
    best = facts.groupBy("file").agg(F.max("width").alias("widest"), F.min("settled").alias("settled"))
    chosen = facts.join(best.withColumnRenamed("settled", "all_settled"), "file").groupBy("file", "all_settled").agg(
        F.collect_list(F.when((F.col("width") == F.col("widest")), F.col("delimiter"))).alias("winners"),
        F.map_from_entries(F.collect_list(F.struct("delimiter", F.struct("text", "broken")))).alias("firsts"),
    )
    delimiter = F.when(F.size("winners") == 0, ",").when(F.size("winners") == 1, F.get("winners", F.lit(0)))
    chosen = chosen.withColumn("delimiter", delimiter).withColumn("first", F.try_element_at("firsts", F.col("delimiter")))
    return chosen.select("file", "delimiter", "first.text", F.coalesce("first.broken", F.lit(False)).alias("broken"), F.col("all_settled").alias("settled"))


def csv_line_audit(lines: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows, ragged rows, blank lines, junk after quotes and broken UTF-8 per file, and the blocks of the files with records over several lines.

    A file in which every line closes its quotes has a record per line, which is counted where it is read. In the others a line's record
    follows from the lines before it; only numbers are moved.
    """
    known = heads.where("verdict is null").select("file", "delimiter", F.size("header").alias("width"))
    per_file = lines.groupBy("file").agg(F.count_if(~F.col("is_valid")).alias("broken_lines"), F.max(F.regexp_like("line", F.lit(r"(?U)\S"))).alias("any"))
    facts = quoting(lines.join(known, "file"), F.col("delimiter")).select(*BLOCK, *ORDER, "width", (F.col("line") == "").alias("blank"), "closed", "open")
    # A row per file, all that is kept of a file without spanning records; the scan of the others starts from these.
    closed = F.col("closed")
    simple = facts.groupBy("file").agg(
        (F.count_if(~F.col("blank")) - 1).alias("row_count"),
        F.count_if(~F.col("blank") & (closed["separators"] + 1 != F.col("width"))).alias("ragged_rows"),
        F.count_if("blank").alias("blank_lines"),
        F.count_if(closed["junk"]).alias("junk_lines"),
        F.max(closed["ends_open"]).alias("is_spanning"),
    )
    simple = materialize(per_file.join(simple, "file", "left"), "audit")
    if simple.where("is_spanning").isEmpty():
        return simple, None
    spanning = facts.join(simple.where("is_spanning").select("file"), "file", "left_semi")
    blocks = materialize(block_table(spanning), "blocks")
    numbered = numbered_lines(spanning, blocks)
    seen = F.when(F.col("is_open"), F.col("open")).otherwise(closed)
    last = F.max_by(seen["ends_open"], F.struct(*BLOCK[1:], *ORDER))
    records = numbered.groupBy("file", "record").agg(
        F.sum(seen["separators"]).alias("separators"), F.first("width").alias("width"), (F.max("blank") & (F.count(F.lit(1)) == 1)).alias("blank"),
        F.count_if(seen["junk"]).alias("junk"), last.alias("unended"),
    )
    counted = records.groupBy("file").agg(
        (F.count_if(~F.col("blank")) - 1).alias("row_count"),
        F.count_if(~F.col("blank") & (F.col("separators") + 1 != F.col("width"))).alias("ragged_rows"),
        F.count_if("blank").alias("blank_lines"),
        # A file that ends inside quotes is broken too.
        (F.sum("junk") + F.count_if("unended")).alias("junk_lines"),
    )
    kept = ["file", "broken_lines", "any", "is_spanning"]
    return simple.where("not coalesce(is_spanning, false)").unionByName(simple.where("is_spanning").select(*kept).join(counted, "file")), blocks


def read_csv(spark: SparkSession, path: str, delimiter: str, header: list[str]) -> DataFrame:
    """Every cell of files whose records are one line each, as text, with rows of the wrong width kept in ``_corrupt_record``."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, CORRUPT]])
    reader = spark.read.schema(schema).option("header", True).option("sep", delimiter).option("quote", '"')
    reader = reader.option("escape", '"').option("mode", "PERMISSIVE")
    reader = reader.option("maxColumns", max(READER_COLUMNS, len(header) + 1)).option("maxCharsPerColumn", -1)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_records(spark: SparkSession, path: str, delimiter: str, header: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """(file, record, one column per name): the rows of any files, read in splits also where quoted fields hold line breaks.

    ``record`` counts from 2, as the header is the first record of its file. Cells that a short row lacks are null. ``blocks`` of all
    files are found in a pass of their own unless they are given.
    """
    lines = quoting(csv_lines(spark, path), F.lit(delimiter))
    blocks = materialize(block_table(lines), "blocks") if blocks is None else blocks
    texts = record_texts(lines, blocks).where("record > 1")
    fields = texts.select("file", "record", record_fields(F.col("text"), F.lit(delimiter)).alias("fields"))
    return fields.select("file", "record", *[F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(header)])


def load_csv(spark: SparkSession, path: str, limits: Limits = Limits(), position: str | None = None) -> DataFrame:
    """A table from the CSV files below a path, which must agree in delimiter and header.

    Anything malformed or beyond a limit raises, before rows are returned; an empty cell is an empty text, never null. ``position``
    names a further column for the place of each row, from 0, in the order of the files' names and their records.
    """
    judged, blocks = _judged(spark, path, limits)
    judged = materialize(judged, "judged")
    # One row per file is folded to what decides; the names of two heads tell one table from several.
    facts = judged.agg(
        F.min_by("file", F.struct(F.col("verdict") == "accepted", "file")).alias("file"),
        F.min_by("verdict", F.struct(F.col("verdict") == "accepted", "file")).alias("verdict"),
        F.min(F.struct("delimiter", "header")).alias("first"), F.max(F.struct("delimiter", "header")).alias("last"),
        F.sum("row_count").alias("rows"), F.max("is_spanning").alias("spanning"), F.min(F.coalesce("is_spanning", F.lit(False))).alias("all_spanning"), F.count(F.lit(1)).alias("files"),
    ).head()
    if not facts.files:
        raise EmptyDataset(f"{path} holds no records")
    if facts.verdict != "accepted":
        raise_for(facts.verdict, f"{facts.file} was not accepted")
    if facts.first != facts.last:
        raise Malformed(f"{path} mixes tables with different headers")
    delimiter, header = facts.first.delimiter, list(facts.first.header)
    for value, limit in ((facts.rows, limits.max_rows), (facts.rows * len(header), limits.max_cells)):
        if limit is not None and value > limit:
            raise LimitExceeded(f"{path} holds more than {limit} rows or cells")
    if position is None and not facts.spanning:
        return _texts(read_csv(spark, path, delimiter, header), header)
    # Names may clash with those of the reader, so columns go by number until the end.
    numbers = [f"c{i}" for i in range(len(header))]
    rows = read_records(spark, path, delimiter, numbers, blocks if facts.all_spanning else None)
    if position is None:
        return _texts(rows.select(*numbers).toDF(*header), header)
    # A row per file.
    offset = F.coalesce(F.sum("row_count").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(judged.select("file", offset.alias("offset")), "file")
    return _texts(placed.select((F.col("offset") + F.col("record") - 2).alias("position"), *numbers).toDF(position, *header), header, position)


def _judged(spark: SparkSession, path: str, limits: Limits) -> tuple[DataFrame, DataFrame | None]:
    lines = csv_lines(spark, path)
    heads = csv_heads(lines, limits)
    audit, blocks = csv_line_audit(lines, heads)
    joined = (
        csv_files(spark, path, limits)
        .withColumnRenamed("verdict", "file_verdict")
        .join(heads, "file", "left")
        .join(audit, "file", "left")
    )
    rows, width = F.col("row_count"), F.size("header")
    verdict = (
        F.when(F.col("file_verdict").isNotNull(), F.col("file_verdict"))
        .when(F.col("broken_lines") > 0, Malformed.code)
        .when(~F.coalesce("any", F.lit(False)), EmptyDataset.code)
        .when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in ("ragged_rows", "blank_lines", "junk_lines")]), Malformed.code)
        .when(beyond(rows, limits.max_rows) | beyond(rows * width, limits.max_cells), LimitExceeded.code)
        .otherwise("accepted")
    )
    return joined.withColumn("verdict", verdict), blocks


def csv_audit(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """One verdict row per file instead of an exception; ``accepted`` when nothing is wrong. Width is checked with each file's own
    header."""
    judged, _ = _judged(spark, path, limits)
    rows, width = F.col("row_count"), F.size("header")
    warnings = F.array_compact(F.array(F.when(rows == 0, "header_only_dataset")))
    return judged.select(
        "file", "bytes", "delimiter", "header", width.alias("column_count"), "row_count", "ragged_rows", "blank_lines",
        "junk_lines", "broken_lines", "verdict", warnings.alias("warnings"),
    )


def _texts(frame: DataFrame, header: list[str], position: str | None = None) -> DataFrame:
    kept = [F.col(f"`{position}`")] if position else []
    return frame.select(*kept, *[F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in header])
