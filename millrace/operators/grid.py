"""Tables inside spreadsheet grids, for any number of sheets at once.

Input is a long cells table (``file, sheet, row, col, text``), blank cells left out. Windows run per sheet; a sheet is
bounded by its format (about a million rows, sixteen thousand columns), so a group never grows with the data. The cells are
read many times over, so pass a written or checkpointed table; the steps here checkpoint what they read again themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.windows import row_numbers, running_total
from millrace.session import cut_lineage

SHEET = ("file", "sheet")
# Scan depth, prose length, number noise, total words, note shapes.
HEADER_SCAN = 20
PROSE_WORDS = 8
NOISE = r"[₹$€£¥₩₪₫฿¢%,\s  ']"
TOTAL_WORD = (r"(?i)\b(?:grand[\s-]*|sub[\s-]*)?(?:totals?|totaux|totale|totaal|gesamt\w*|summe|sum|somme|suma|aggregate)\b"
              r"|итого|всего|合计|合計|总计|總計|小计|小計")
FOOTNOTE = r"^(\*+|[†‡§¶]+|\(\w{1,2}\)|\[\w{1,2}\])\s*\S"
NOTE_LEAD = r"^[A-Za-z][A-Za-z .]{1,20}:\s*\S"


def number(c: Column) -> Column:
    """A cell as a number: accounting brackets are negative, currency and grouping marks are dropped."""
    bare = F.regexp_replace(F.trim(c), r"^\((.*)\)$", "-$1")
    return F.regexp_replace(bare, NOISE, "").try_cast("double")


def is_period(c: Column) -> Column:
    return F.trim(c).rlike(r"^(19|20)\d\d(\.0)?$")


def is_label(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[\s,$£€¥₹%()]", "").try_cast("double").isNull()


def is_prose(c: Column) -> Column:
    text = F.trim(c)
    return (text.endswith(".") & text.contains(" ")) | (F.size(F.split(text, r"\s+")) > PROSE_WORDS)


def filled_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("text").isNotNull() & (F.trim("text") != ""))


def header_rows(cells: DataFrame, scan: int = HEADER_SCAN) -> DataFrame:
    """(file, sheet, header_row): the first wide row of labels that stands over differing kinds; no row for a sheet without.

    Years may be headings when a label stands beside at least two different ones and no year stands below any.
    """
    filled = filled_cells(cells).withColumns({
        "label": is_label(F.col("text")), "period": is_period(F.col("text")),
        "name": F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))})
    first = filled.groupBy(*SHEET).agg(F.min("row").alias("_top"), F.countDistinct("col").alias("_width"))
    below = filled.select(*SHEET, (F.col("row") - 1).alias("row"), "col", F.col("period").alias("period_below"))
    near = filled.join(first, list(SHEET)).where(F.col("row") < scan)
    joined = near.join(below, [*SHEET, "row", "col"], "left")
    bare_year = F.col("period") & ~F.col("label")
    rows = joined.groupBy(*SHEET, "row").agg(
        F.count("*").alias("n"), F.count_if("label").alias("labels"), F.count_if(bare_year).alias("years"),
        F.countDistinct(F.when(bare_year, F.col("name"))).alias("distinct_years"),
        F.max((bare_year & F.coalesce("period_below", F.lit(False))).cast("int")).alias("year_below"),
        F.countDistinct(F.when(F.col("label"), F.col("name"))).alias("distinct_labels"),
        F.max(is_prose(F.col("text")).cast("int")).alias("prose"), F.max("_width").alias("width"))
    under = filled.groupBy(*SHEET, (F.col("row") - 1).alias("row")).agg(F.count("*").alias("n_below"))
    rows = rows.join(under, [*SHEET, "row"], "left")
    widest = F.max("n").over(Window.partitionBy(*SHEET))
    floor = F.greatest(F.least(F.lit(2), F.col("width")), widest * 0.6)
    wide = rows.withColumn("_floor", floor).where(F.col("n") >= F.col("_floor"))
    pick = F.min_by(F.struct(*[c for c in rows.columns if c not in SHEET]), "row").alias("c")
    chosen = wide.groupBy(*SHEET).agg(pick).select(*SHEET, "c.*")
    years_ok = (F.col("years") >= 2) & (F.col("labels") > 0) & (F.col("distinct_years") == F.col("years")) & (F.col("year_below") == 0)
    heads = F.col("labels") + F.when(years_ok, F.col("years")).otherwise(0)
    fine = (heads >= F.col("n") * 0.7) & (F.col("prose") == 0) & (F.col("distinct_labels") == F.col("labels")) & (
        F.coalesce("n_below", F.lit(0)) > 0)
    return chosen.where(fine).select(*SHEET, F.col("row").alias("header_row"))


def blocks(cells: DataFrame) -> DataFrame:
    """Adds ``block_col`` and ``block_row``: a blank column parts side-by-side tables, two blank rows stacked ones."""
    filled = filled_cells(cells)
    cols = filled.select(*SHEET, "col").distinct()
    w = Window.partitionBy(*SHEET).orderBy("col")
    cols = cols.withColumn("_gap", (F.col("col") - F.lag("col").over(w) > 1).cast("int"))
    cols = cols.withColumn("block_col", F.coalesce(F.sum("_gap").over(w), F.lit(0)).cast("int")).drop("_gap")
    placed = filled.join(cols, [*SHEET, "col"])
    rows = placed.select(*SHEET, "block_col", "row").distinct()
    w = Window.partitionBy(*SHEET, "block_col").orderBy("row")
    rows = rows.withColumn("_gap", (F.col("row") - F.lag("row").over(w) > 2).cast("int"))
    rows = rows.withColumn("block_row", F.coalesce(F.sum("_gap").over(w), F.lit(0)).cast("int")).drop("_gap")
    return placed.join(rows, [*SHEET, "block_col", "row"])


def column_names(cells: DataFrame, headers: DataFrame, sub_header: bool = False) -> DataFrame:
    """(file, sheet, col, name) from the header row, or from a group row and the row under it.

    A blank group cell continues the label on its left. Blank names become ``column_N``; repeats are numbered.
    """
    filled = filled_cells(cells)
    width = filled.groupBy(*SHEET).agg(F.max("col").alias("_last"))
    frame = headers.join(width, list(SHEET)).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_last"))))

    def row_text(offset: int, out: str) -> DataFrame:
        return filled.select(*SHEET, (F.col("row") - offset).alias("header_row"), "col",
                             F.regexp_replace(F.trim("text"), r"\s+", " ").alias(out))

    named = frame.join(row_text(0, "top"), [*SHEET, "header_row", "col"], "left")
    left_on = Window.partitionBy(*SHEET).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    if sub_header:
        named = named.join(row_text(1, "sub"), [*SHEET, "header_row", "col"], "left")
        named = named.withColumn("top", F.last("top", ignorenulls=True).over(left_on))
        text = F.nullif(F.concat_ws(" ", "top", "sub"), F.lit(""))
    else:
        text = F.col("top")
    text = F.coalesce(F.regexp_replace(text, r"^((19|20)\d\d)\.0$", "$1"), F.concat(
        F.lit("column_"), (F.col("col") + 1).cast("string")))
    named = named.withColumn("name", text)
    again = F.row_number().over(Window.partitionBy(*SHEET, "name").orderBy("col")) - 1
    return named.withColumn("_again", again).select(*SHEET, "col", F.when(
        F.col("_again") > 0, F.concat("name", F.lit("_"), F.col("_again").cast("string"))).otherwise(F.col("name")).alias("name"))


def adds_up(stated: Column, summed: Column) -> Column:
    near = F.abs(stated - summed) <= F.greatest(F.lit(0.011), 1e-9 * F.greatest(F.abs(stated), F.abs(summed)))
    return F.coalesce(near & ~((stated == 0) & (summed == 0)), F.lit(False))


def total_rows(body: DataFrame) -> DataFrame:
    """(file, sheet, row, kind): rows that are sums of other rows. The arithmetic decides, the wording only hints.

    A last row is a total when a labelled one agrees in one column, or an unlabelled one in all of at least two. With
    subtotals, every one must close its group and the grand total must equal the rows that are not subtotals, else
    nothing is taken out.
    """
    filled = filled_cells(body).withColumn("v", number(F.col("text")))
    rows = filled.groupBy(*SHEET, "row").agg(
        F.max((F.col("text").rlike(TOTAL_WORD) & F.col("v").isNull()).cast("int")).alias("labelled"))
    ends = rows.groupBy(*SHEET).agg(F.max("row").alias("last"), F.count("*").alias("n_rows")).where("n_rows >= 3")
    marked = cut_lineage(filled.join(rows, [*SHEET, "row"]).join(ends, list(SHEET)).where("v is not null"))
    above = marked.where(F.col("row") < F.col("last")).groupBy(*SHEET, "col").agg(F.sum("v").alias("s"))
    last = marked.where(F.col("row") == F.col("last")).join(above, [*SHEET, "col"], "left")
    plain = last.groupBy(*SHEET).agg(
        F.max("last").alias("row"), F.max("labelled").alias("labelled"), F.count("*").alias("measured"),
        F.count_if(adds_up(F.col("v"), F.col("s"))).alias("agreeing"), F.max("n_rows").alias("n_rows"))
    simple = plain.where(((F.col("labelled") == 1) & (F.col("agreeing") > 0)) | (
        (F.col("labelled") == 0) & (F.col("measured") >= 2) & (F.col("agreeing") == F.col("measured")) & (F.col("n_rows") >= 4)))
    simple = cut_lineage(simple)
    return simple.select(*SHEET, "row", F.lit("total").alias("kind")).unionByName(_grouped_totals(marked, rows, simple))


def _grouped_totals(marked: DataFrame, rows: DataFrame, simple: DataFrame) -> DataFrame:
    """Subtotals that close their groups, kept only where the grand total checks them.

    The labelled rows of a sheet are gone through from the top. One that equals, in some column, the sum of the rows since
    the last subtotal is a subtotal and closes the group; any other joins the open group as a record. Sums of groups are differences of running
    sums, so only the labelled rows of a sheet come together. The last row must equal the sum of all records.
    """
    rest = marked.join(simple.select(*SHEET), list(SHEET), "left_anti")
    placed = row_numbers(rows, "rank", ["row"], SHEET)
    # Every labelled row has a cell in every measured column, so that running sums are known there.
    columns = rest.select(*SHEET, "col", "last").distinct()
    called = placed.where("labelled = 1").select(*SHEET, "row").join(columns, list(SHEET))
    dense = called.join(rest.select(*SHEET, "row", "col", "v"), [*SHEET, "row", "col"], "left").withColumn("called", F.lit(True))
    others = rest.where("labelled = 0").select(*SHEET, "row", "col", "last", "v", F.lit(False).alias("called"))
    upto = running_total(dense.unionByName(others), F.coalesce("v", F.lit(0.0)), "upto", ["row"], [*SHEET, "col"])
    cells = upto.where("called").groupBy(*SHEET, "row", "last").agg(F.array_sort(F.collect_list(F.struct("col", "v", "upto"))).alias("cells"))
    lines = cells.join(placed.select(*SHEET, "row", "rank"), [*SHEET, "row"])
    per = lines.groupBy(*SHEET, "last").agg(F.array_sort(F.collect_list(F.struct("row", "rank", "cells"))).alias("lines"))
    per = per.where(F.element_at("lines", -1)["row"] == F.col("last"))
    nothing = F.transform(F.col("lines")[0]["cells"], lambda x: F.lit(0.0))
    start = F.struct(nothing.alias("since"), F.lit(0).cast("bigint").alias("rank"), F.array().cast("array<bigint>").alias("found"), nothing.alias("taken"))

    def before(x: Column) -> Column:
        return x["upto"] - F.coalesce(x["v"], F.lit(0.0))

    def step(state: Column, line: Column) -> Column:
        sums = F.zip_with(line["cells"], state["since"], lambda x, s: adds_up(x["v"], before(x) - s))
        closes = (line["rank"] - state["rank"] > 1) & F.exists(sums, lambda ok: ok)
        return F.struct(
            F.when(closes, F.transform(line["cells"], lambda x: x["upto"])).otherwise(state["since"]).alias("since"),
            F.when(closes, line["rank"]).otherwise(state["rank"]).alias("rank"),
            F.when(closes, F.array_append(state["found"], line["row"].cast("bigint"))).otherwise(state["found"]).alias("found"),
            F.when(closes, F.zip_with(state["taken"], line["cells"], lambda t, x: t + F.coalesce(x["v"], F.lit(0.0)))).otherwise(state["taken"]).alias("taken"))

    folded = per.select(*SHEET, "last", F.element_at("lines", -1)["cells"].alias("grand"), F.aggregate(
        F.slice("lines", 1, F.size("lines") - 1), start, step).alias("s"))
    checks = F.exists(F.zip_with("grand", F.col("s.taken"), lambda x, t: adds_up(x["v"], before(x) - t)), lambda ok: ok)
    checked = folded.where((F.size("s.found") > 0) & checks)
    kinds = F.concat(
        F.transform("s.found", lambda r: F.struct(r.alias("row"), F.lit("subtotal").alias("kind"))),
        F.array(F.struct(F.col("last").cast("bigint").alias("row"), F.lit("total").alias("kind"))))
    found = checked.select(*SHEET, F.explode(kinds).alias("k"))
    return found.select(*SHEET, F.col("k.row").cast(rows.schema["row"].dataType).alias("row"), "k.kind")


def labelled_rows_kept(body: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, sheet, row, label): rows called a total that stay data, because nothing shows that they are one.

    None for a sheet in which more than half of the rows are: there the word is simply common.
    """
    filled = filled_cells(body)
    said = filled.where(F.col("text").rlike(TOTAL_WORD) & number(F.col("text")).isNull())
    called = said.groupBy(*SHEET, "row").agg(F.trim(F.min_by("text", "col")).alias("label"))
    kept = called.join(totals.select(*SHEET, "row"), [*SHEET, "row"], "left_anti")
    sizes = filled.groupBy(*SHEET).agg(F.countDistinct("row").alias("_rows"))
    many = kept.groupBy(*SHEET).agg(F.count("*").alias("_kept")).join(sizes, list(SHEET)).where("_kept * 2 <= _rows")
    return kept.join(many.select(*SHEET), list(SHEET))


def without_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    return cells.join(rows.select(*SHEET, "row"), [*SHEET, "row"], "left_anti")


def trailing_notes(body: DataFrame) -> DataFrame:
    """(file, sheet, row, text): single first-column cells below a blank row under the last full record that read as notes."""
    filled = filled_cells(body)
    rows = filled.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.min("col").alias("first_col"),
                                             F.min_by("text", "col").alias("text"))
    left = filled.groupBy(*SHEET).agg(F.min("col").alias("left_col"), F.countDistinct("col").alias("width")).where("width >= 2")
    rows = rows.join(left, list(SHEET))
    lone = (F.col("n") == 1) & (F.col("first_col") == F.col("left_col"))
    last_record = rows.where(~lone).groupBy(*SHEET).agg(F.max("row").alias("last_record"), F.max_by("n", "row").alias("last_n"))
    notes = rows.where(lone).join(last_record, list(SHEET)).where((F.col("row") > F.col("last_record")) & (F.col("last_n") >= 2))
    text = F.trim("text")
    reads = text.rlike(FOOTNOTE) | text.rlike(NOTE_LEAD) | is_prose(F.col("text"))
    per = notes.groupBy(*SHEET).agg(F.min("row").alias("from"), F.min(reads.cast("int")).alias("all_notes"),
                                    F.max("last_record").alias("last_record"))
    per = per.where((F.col("all_notes") == 1) & (F.col("from") > F.col("last_record") + 1))
    return notes.join(per.select(*SHEET), list(SHEET), "left_semi").select(*SHEET, "row", F.trim("text").alias("text"))


def without_footnote_markers(body: DataFrame, notes: DataFrame) -> DataFrame:
    """Cells without a trailing marker that a note of their sheet defines; other endings stay as typed."""
    marks = notes.select(*SHEET, F.regexp_extract("text", FOOTNOTE, 1).alias("mark")).where("mark <> ''").distinct()
    ending = F.regexp_extract(F.rtrim("text"), r"(\*+|[†‡§¶]+|\(\w{1,2}\)|\[\w{1,2}\])$", 1)
    rows = body.withColumn("mark", ending)
    known = marks.withColumn("_known", F.lit(True))
    joined = rows.join(known, [*SHEET, "mark"], "left")
    bare = F.rtrim(F.substr(F.rtrim("text"), F.lit(1), F.length(F.rtrim("text")) - F.length("mark")))
    return joined.withColumn("text", F.when(F.col("_known") & (bare != ""), bare).otherwise(F.col("text"))).drop("mark", "_known")


def column_types(body: DataFrame) -> DataFrame:
    """(file, sheet, col, type): numeric or datetime only when every cell reads so; one odd cell makes it text."""
    from millrace.functions.missing import parse_day

    filled = filled_cells(body)
    per = filled.groupBy(*SHEET, "col").agg(
        F.count("*").alias("n"), F.count(number(F.col("text"))).alias("numbers"), F.count(parse_day(F.col("text"))).alias("days"))
    return per.select(*SHEET, "col", F.when(F.col("numbers") == F.col("n"), "numeric").when(
        F.col("days") == F.col("n"), "datetime").otherwise("text").alias("type"))


def body_below(cells: DataFrame, headers: DataFrame, header_height: int = 1) -> DataFrame:
    """Cells under each sheet's header."""
    return cells.join(headers, list(SHEET)).where(F.col("row") >= F.col("header_row") + header_height).drop("header_row")


def as_records(body: DataFrame, names: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per sheet row with the named columns, for sheets that share a layout."""
    named = filled_cells(body).join(names, [*SHEET, "col"])
    return named.groupBy(*SHEET, "row").pivot("name", list(columns)).agg(F.first("text"))
