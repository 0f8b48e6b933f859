"""Tables from spreadsheet cells: sheet choice, formula masking, header and row rules.

The input is long: ``file, sheet, sheet_index, visible, row, col, value, cell_type``, where the cell
type ``f`` marks a formula. Many workbooks are handled at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.sources.errors import EmptyDataset, LimitExceeded, Malformed, SheetNotFound, raise_for
from gaugework.sources.limits import Limits, beyond

FORMULA = "f"
#: Different column names that tables without a given header may have.
MOST_NAMES = 1_000_000


def choose_sheets(cells: DataFrame, sheet: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """The sheet to read per file: the named one, else the first visible one that holds anything.

    A workbook of too many sheets is beyond the limits, and so is one whose chosen sheet, or a visible one looked at before it, spans too
    many rows (the header not counted), columns or cells, filled or not.
    """
    usable = F.col("visible") & (F.col("value").isNotNull() | (F.col("cell_type") == FORMULA))
    rows, width = F.max("row") - F.min("row") + 1, F.max("col") + 1
    large = beyond(rows - 1, limits.max_rows) | beyond(width, limits.max_columns) | beyond(rows * width, limits.max_cells)
    sheets = cells.groupBy("file", "sheet", "sheet_index").agg(F.max("visible").alias("visible"), F.max(usable).alias("usable"), large.alias("large"))
    if sheet is None:
        chosen, missing = F.min(F.when(F.col("usable"), F.struct("sheet_index", "sheet"))), EmptyDataset
        looked_at = F.col("visible")
    else:
        chosen, missing = F.min(F.when(F.col("sheet") == sheet, F.struct("sheet_index", "sheet"))), SheetNotFound
        looked_at = F.col("sheet") == sheet
    files = sheets.groupBy("file").agg(chosen.alias("chosen"), F.count(F.lit(1)).alias("sheets"), F.min(F.when(looked_at & F.col("large"), F.col("sheet_index"))).alias("first_large"))
    first = F.col("first_large")
    verdict = (
        F.when(beyond(F.col("sheets"), limits.max_sheets), LimitExceeded.code)
        .when(first.isNotNull() & (F.col("chosen").isNull() | (first <= F.col("chosen.sheet_index"))), LimitExceeded.code)
        .when(F.col("chosen").isNull(), missing.code)
    )
    return files.select("file", "chosen.sheet", verdict.alias("verdict"))


def masked_cells(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells of the chosen sheets with formulas emptied and marked; formulas are never evaluated."""
    kept = chosen.where("verdict is null").select("file", "sheet")
    is_formula = F.col("cell_type") == FORMULA
    return cells.join(kept, ["file", "sheet"]).select(
        "file", "sheet", "row", "col", F.when(~is_formula, F.col("value")).alias("value"), is_formula.alias("is_formula")
    )


def grid_headers(masked: DataFrame) -> DataFrame:
    """Header cells: those of the first row of each sheet, as text, up to its last filled column."""
    first = masked.groupBy("file").agg(F.min("row").alias("row"))
    named = masked.join(first, ["file", "row"]).where("value is not null")
    return named.select("file", "row", "col", F.col("value").cast("string").alias("name"))


def grid_summary(cells: DataFrame, sheet: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Per file: sheet, rows, columns, formulas, warnings and verdict.

    Rows are first folded to one flag per row, so a long sheet is counted on the map side.
    """
    chosen = choose_sheets(cells, sheet, limits)
    masked = masked_cells(cells, chosen)
    headers = grid_headers(masked).groupBy("file").agg(
        F.min("row").alias("header_row"),
        (F.max("col") + 1).alias("column_count"),
        F.count_if(F.trim("name") != "").alias("named"),
        F.count_distinct("name").alias("distinct_names"),
    )
    last = masked.where("value is not null").groupBy("file").agg(F.max("row").alias("last_row"))
    # One row per file: bounded by the number of workbooks, left to the optimizer to place.
    placed = masked.join(headers, "file").join(last, "file")
    inside = F.col("col") < F.col("column_count")
    per_row = placed.groupBy("file", "header_row", "column_count", "named", "distinct_names", "last_row", "row").agg(
        F.count_if(inside & F.col("value").isNotNull()).alias("filled"),
        F.count_if(~inside & F.col("value").isNotNull()).alias("beyond"),
        F.count_if("is_formula").alias("formulas"),
    )
    is_data = F.col("row") > F.col("header_row")
    folded = per_row.groupBy("file", "column_count", "named", "distinct_names").agg(
        F.count_if(is_data & (F.col("filled") > 0)).alias("row_count"),
        F.count_if(is_data & (F.col("filled") == 0) & (F.col("row") < F.col("last_row"))).alias("blank_rows"),
        F.sum("formulas").alias("formula_count"),
        F.coalesce(F.sum(F.when(is_data, F.col("beyond"))), F.lit(0)).alias("beyond"),
    )
    joined = chosen.join(folded, "file", "left")
    bad_header = (F.col("named") < F.col("column_count")) | (F.col("distinct_names") < F.col("column_count"))
    verdict = F.coalesce(
        "verdict",
        F.when(F.col("column_count").isNull(), EmptyDataset.code)
        .when(beyond(F.col("column_count"), limits.max_columns), LimitExceeded.code)
        .when(bad_header | (F.col("beyond") > 0), Malformed.code)
        .when(beyond(F.col("row_count"), limits.max_rows) | beyond(F.col("row_count") * F.col("column_count"), limits.max_cells), LimitExceeded.code),
        F.lit("accepted"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("blank_rows") > 0, "blank_xlsx_rows_ignored"),
            F.when(F.col("row_count") == 0, "header_only_dataset"),
            F.when(F.col("formula_count") > 0, "formulas_not_evaluated"),
        )
    )
    return joined.select(
        "file", "sheet", "row_count", "column_count", "formula_count", "blank_rows", verdict.alias("verdict"),
        warnings.alias("warnings"),
    )


def grid_table(cells: DataFrame, header: list[str] | None = None, sheet: str | None = None, limits: Limits = Limits(), bad: str = "raise") -> DataFrame:
    """The rows of all workbooks: short rows padded with null, rows without any value dropped. Returns ``file, row`` and the columns.

    Every workbook's own first row says which of its columns is which, so their order may differ. Without a ``header`` the columns
    are all names found, in the order of their first place; with one they are those named, null where a workbook lacks them. A workbook
    that :func:`grid_summary` does not accept raises, or is left out if ``bad`` is "drop".
    """
    if bad not in ("raise", "drop"):
        raise ValueError("bad must be raise or drop")
    verdicts = grid_summary(cells, sheet, limits).select("file", "sheet", "verdict")
    if bad == "raise":
        worst = verdicts.where("verdict <> 'accepted'").orderBy("file").head()
        if worst is not None:
            raise_for(worst.verdict, f"{worst.file} was not accepted")
    accepted = verdicts.where("verdict = 'accepted'").select("file", "sheet", F.lit(None).cast("string").alias("verdict"))
    masked = masked_cells(cells, accepted)
    named = grid_headers(masked)
    if header is None:
        names = named.groupBy("name").agg(F.min(F.struct("col", "file")).alias("place")).orderBy("place").select("name").limit(MOST_NAMES + 1).collect()
        if len(names) > MOST_NAMES:
            raise LimitExceeded(f"more than {MOST_NAMES} different column names")
        header = [row.name for row in names]
    if not header:
        raise EmptyDataset("no workbook has a header")
    # One row per header cell; an accepted header has no name twice.
    places = named.groupBy("file", "name").agg(F.min("col").alias("col"), F.min("row").alias("first_row"))
    data = masked.join(places, ["file", "col"]).where("row > first_row and value is not null")
    columns = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in header]
    # Rows that hold values only in columns not asked for are rows of a workbook none the less.
    return data.groupBy("file", "row").agg(*columns)
