"""CSV scan for files with different headers: splittable, with true row numbers.

Files are read as lines, so one large file is shared by many tasks. Line numbers come from a count
per file block, carried forward over the (small) table of blocks; there is no sort of a whole file.
Quoted line breaks are resolved the same way, by the parity of the quotes seen so far. The counting
pass tells whether any line has an odd number of quotes; without one, every line is a record and
the parity needn't be followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.headers import csv_headers
from ..operators.rows import split_valid, strict_csv_errors
from ..operators.spread import join_measured
from ..session import configure, write_through

BLOCK = ["document_id", "block"]
BROADCAST_BLOCKS = 200_000
#: A record whose quote never closes reaches to the end of its file; its error rows have so many
#: lines at most. A record that closes is whole, however many lines it has.
UNCLOSED_LINES = 100_000
# Stands for a comma outside quotes. Where a text holds the mark itself it is spelled out first.
MARK, SPELLED, ESCAPE, ESCAPED = "\x01", "\x02a", "\x02", "\x02b"


def split_fields(line: Column) -> Column:
    """Fields of one CSV record: commas inside quotes do not split, doubled quotes are one quote."""

    def quoted(text: Column) -> Column:
        spelled = F.replace(
            F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED)), F.lit(MARK), F.lit(SPELLED)
        )
        parts = F.split(spelled, '"', -1)
        marked = F.transform(
            parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(MARK)))
            .otherwise(p)
        )
        fields = F.split(F.array_join(marked, '"'), MARK, -1)
        return F.transform(fields, lambda f: plain(unquoted(f)))

    def plain(field: Column) -> Column:
        return F.replace(
            F.replace(field, F.lit(SPELLED), F.lit(MARK)), F.lit(ESCAPED), F.lit(ESCAPE)
        )

    def unquoted(field: Column) -> Column:
        wrapped = field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
        inner = F.when(wrapped, F.substr(field, F.lit(2), F.length(field) - 2)).otherwise(field)
        return F.replace(inner, F.lit('""'), F.lit('"'))

    def fields(text: Column) -> Column:
        return (
            F.when(text == "", F.array().cast("array<string>"))
            .when(text.contains('"'), quoted(text))
            .otherwise(F.split(text, ",", -1))
        )

    return let(line, fields)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, block and a number that grows along the block."""
    lines = configure(spark).read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("document_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _counted_blocks(lines: DataFrame) -> DataFrame:
    """Lines per block, the first line's id, and whether any line has an odd number of quotes."""
    blocks = lines.groupBy(*BLOCK).agg(
        F.min("line_id").alias("first_id"), F.count("*").alias("n"),
        F.max(_quotes(F.col("line")) % 2).alias("odd_line"),
    )
    before = W.partitionBy("document_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counted = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return write_through(counted, "blocks")


def _numbered_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with their number in the file, from 0."""
    offsets = blocks.select(*BLOCK, "first_id", F.col("before").alias("lines_before"))
    numbered = join_measured(lines, offsets, BLOCK, "inner", broadcast_rows=BROADCAST_BLOCKS)
    number = F.col("line_id") - F.col("first_id") + F.col("lines_before")
    return numbered.withColumn("line_no", number).drop("first_id", "lines_before")


def _joined_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered lines joined to records where quoted fields hold line breaks; ``n`` records by block.

    Each block is summarised for both cases: entered outside or inside quotes. The quotes counted
    in earlier blocks then tell which case holds, how many records came before, and where the
    record began that reaches into the block. They also tell, before any text is joined, whether
    the last record of a file closes: one that doesn't is cut into parts of ``UNCLOSED_LINES``
    lines, so that a stray quote doesn't gather the rest of a file.
    """
    along = W.partitionBy(*BLOCK).orderBy("line_id")
    seen = F.coalesce(F.sum("quotes").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = lines.withColumn("quotes", _quotes(F.col("line"))).withColumn("seen", seen % 2)

    def last_start(parity: int) -> Column:
        return F.max(F.when(F.col("seen") == parity, F.col("line_no")))

    blocks = local.groupBy(*BLOCK).agg(
        (F.sum("quotes") % 2).alias("odd"),
        F.count_if(F.col("seen") == 0).alias("starts_outside"),
        F.count_if(F.col("seen") == 1).alias("starts_inside"),
        last_start(0).alias("last_outside"), last_start(1).alias("last_inside"),
    )
    before = W.partitionBy("document_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    entered = blocks.withColumn(
        "inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    )

    def pick(outside: str, inside: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(outside)).otherwise(F.col(inside))

    whole = W.partitionBy("document_id")
    never = F.when(
        F.sum("odd").over(whole) % 2 == 1, F.max(pick("last_outside", "last_inside")).over(whole))
    offsets = write_through(entered.select(
        *BLOCK, "inside", never.alias("unclosed_from"),
        pick("starts_outside", "starts_inside").alias("n"),
        F.coalesce(F.sum(pick("starts_outside", "starts_inside")).over(before), F.lit(0))
        .alias("before"),
        F.max(pick("last_outside", "last_inside")).over(before).alias("open_since"),
    ), "block-offsets")
    marked = join_measured(
        local, offsets.drop("n"), BLOCK, "inner", broadcast_rows=BROADCAST_BLOCKS
    ).withColumn("starts", F.when((F.col("inside") + F.col("seen")) % 2 == 0, 1).otherwise(0))
    upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    began = F.coalesce(
        F.max(F.when(F.col("starts") == 1, F.col("line_no"))).over(upto), F.col("open_since")
    )
    unclosed = F.coalesce(began == F.col("unclosed_from"), F.lit(False))
    part = F.when(unclosed, F.floor((F.col("line_no") - began) / UNCLOSED_LINES)).otherwise(0)
    records = marked.withColumns(
        {
            "record_no": F.col("before") + F.sum("starts").over(upto) - 1, "part": part,
            "unclosed": unclosed,
        }
    ).groupBy("document_id", "record_no", "part", "unclosed")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(parts, lambda p: p["line"]), "\n")
    joined = records.agg(text.alias("line")).select("document_id", "line", "record_no", "unclosed")
    return joined, offsets.select(*BLOCK, "n")


def _rows_before(blocks: DataFrame) -> DataFrame:
    """Rows, headers not counted, of all files whose names come before a file's; one row per file."""
    sizes = blocks.groupBy("document_id").agg((F.sum("n") - 1).alias("n"))
    before = W.orderBy("document_id").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        "document_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))


def csv_rows(spark: SparkSession, path: str | list[str], one_table: bool = False) -> DataFrame:
    """Rows of CSV files: ``row_index`` (file row, header is 1), ``headers``, ``values``, ``raw``.

    Quoted fields may hold line breaks. A short row has nulls for its missing values and no key
    for them in ``raw``; values beyond the header are in ``extra_values`` and, as ``_<position>``,
    in ``raw``. ``unclosed`` marks a record whose quote never closes; it may come in several parts
    with one ``row_index``. With ``one_table`` the files are the parts of one table, each with the
    header: ``row_index`` runs on through them in the order of their names.
    """
    lines = read_lines(spark, path)
    blocks = _counted_blocks(lines)
    numbered = _numbered_lines(lines, blocks)
    line_end = F.regexp_replace("line", "\r$", "")
    if blocks.filter("odd_line = 1").isEmpty():
        numbered = numbered.select(
            "document_id", "line", F.col("line_no").alias("record_no"),
            F.lit(False).alias("unclosed"),
        )
    else:
        numbered, blocks = _joined_records(numbered)
    numbered = numbered.withColumn("line", line_end)
    names = csv_headers(split_fields(F.col("line")))
    heads = numbered.filter("record_no = 0").select("document_id", names.alias("headers"))
    before = F.lit(0)
    if one_table:
        heads, before = heads.join(_rows_before(blocks), "document_id"), F.col("rows_before")
    heads = write_through(heads, "headers")
    body = numbered.filter("record_no > 0").withColumn("fields", split_fields(F.col("line")))
    joined = join_measured(body, heads, ["document_id"], "inner")
    width, given = F.size("headers"), F.size("fields")
    keys = F.transform(
        F.col("fields"),
        lambda v, i: F.coalesce(
            F.get(F.col("headers"), i), F.concat(F.lit("_"), i.cast("string"))
        ),
    )
    return joined.select(
        "document_id",
        F.lit("").alias("sheet_name"),
        (F.col("record_no") + before + 1).alias("row_index"),
        "headers",
        F.transform("headers", lambda h, i: F.get(F.col("fields"), i)).alias("values"),
        F.slice("fields", width + 1, F.greatest(given - width, F.lit(0))).alias("extra_values"),
        F.map_from_arrays(keys, "fields").alias("raw"),
        "unclosed",
    )


def valid_csv_rows(
    spark: SparkSession, path: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and ``document_id, row_index, reason, warning`` for the others.

    The checked rows are written once, so that using both results reads the files once.
    """
    rows = csv_rows(spark, path)
    errors = strict_csv_errors(
        F.col("headers"), F.col("values"), F.col("raw"), F.col("extra_values")
    )
    unclosed = F.array(F.lit("Quoted value is not closed."))
    problems = F.when(F.col("unclosed"), unclosed).otherwise(errors)
    checked = write_through(rows.withColumn("_problems", problems), "csv-rows")
    good, bad = split_valid(checked, F.col("_problems"))
    text = F.concat(F.lit("row "), F.col("row_index").cast("string"), F.lit(": "), F.col("reason"))
    return good.drop("unclosed", "_problems"), bad.select(
        "document_id", "row_index", "reason", text.alias("warning")
    )
