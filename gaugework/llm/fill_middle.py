"""Fill-in-middle: texts cut in three by one match of a counted pattern.

``regexp_count`` gives the number n of units (code points) of a text. The cuts a <= b are drawn from a hash of the row's id, and the row's
own pattern ``(unit{a}+)(unit{b-a}+)(rest)``, whose possessive groups never give back, captures prefix, middle and suffix in one match;
the replacement puts them in their new order. Everything runs on built-in functions, row by row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "(?s:.)"
#: Units counted at once, so that no list of all the units of a long text is made.
BLOCK = 4_096
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """The marks before prefix, suffix and middle. No mark may begin with what another, or itself, ends with, as a text beside it could
    then complete a mark that is not there."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must differ and not be empty")
        for left, right in product(marks, marks):
            if left != right and left in right or any(left.endswith(right[:k]) for k in range(1, min(len(left), len(right)))):
                raise ValueError(f"{left!r} overlaps {right!r}")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _quoted(text: str) -> str:
    """A text that stands for itself in a pattern or in a replacement."""
    return "".join("\\" + c if c in "\\$.[]{}()*+?^|-/#&~<>=!:" else c for c in text)


def count_units(text: Column) -> Column:
    """The number of units of a text: whole blocks, then what is left after them."""
    block = f"{UNIT}{{{BLOCK}}}+"
    left = F.regexp_replace(text, rf"\A(?:{block})*+", "")
    return (F.regexp_count(text, F.lit(block)).cast("bigint") * BLOCK + F.regexp_count(left, F.lit(UNIT))).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    Four numbers h1 to h4 come from the hex SHA-256 of ``seed:doc_id``, eight digits each. The cuts are h1 and h2 modulo n + 1, in order.
    A text stays ``plain`` if it is empty, holds a sentinel, or h3 % 100 >= 100 - plain_percent; else it is ``spm`` (suffix, prefix, middle)
    if h4 % 100 < spm_percent, or ``psm`` (prefix, suffix, middle). A null text is empty, a null doc_id counts as an empty one. Equal rows
    give equal rows, an empty table none; other columns are ignored. Plain rows have null cuts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = docs.select("doc_id", text.alias("text"), F.sha2(source, 256).alias("hash"))
    h = [F.conv(F.substring("hash", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    held = F.lit(False)
    for mark in sentinels.all:
        held = held | F.col("text").contains(F.lit(mark))
    is_plain = (F.col("text") == "") | (h[2] % 100 >= 100 - plain_percent) | held
    form = F.when(is_plain, PLAIN).when(h[3] % 100 < spm_percent, SPM).otherwise(PSM)
    counted = drawn.select("doc_id", "text", "hash", count_units(F.col("text")).alias("n"), form.alias("form"))
    cuts = [h[k] % (F.col("n") + 1) for k in range(2)]
    cut = counted.select("doc_id", "text", "n", "form", F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    size = [F.col("a").cast("string"), (F.col("b") - F.col("a")).cast("string")]
    pattern = F.concat(F.lit(rf"\A({UNIT}{{"), size[0], F.lit(rf"}}+)({UNIT}{{"), size[1], F.lit(rf"}}+)({UNIT}*+)\z"))
    p, s, m = (_quoted(mark) for mark in sentinels.all)
    order = F.when(F.col("form") == SPM, f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    moved = F.col("form") != PLAIN
    output = F.when(moved, F.regexp_replace("text", pattern, order)).otherwise(F.col("text"))
    return cut.select(
        "doc_id", "text", "n", "form", F.when(moved, F.col("a")).alias("prefix_chars"),
        F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of this form was made from. The first of each mark is the one that was put in."""
    p, s, m = (_quoted(mark) for mark in sentinels.all)
    any_text = f"({UNIT}*?)"
    psm = F.regexp_replace(output, rf"\A{p}{any_text}{s}{any_text}{m}({UNIT}*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"\A{s}{any_text}{p}{any_text}{m}({UNIT}*+)\z", "$2$3$1")
    return F.when(form == PLAIN, output).when(form == SPM, spm).otherwise(psm)
