"""Spreadsheet grids written from the test tables: one sheet per nation, suppliers as records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.operators.windows import row_numbers
from millrace.plans.registry import query
from millrace.session import cut_lineage
from millrace.session import read_table as t


def _cells(df: DataFrame, row, *texts) -> DataFrame:
    """Cells of one row kind: ``row`` is its number, ``texts`` its cells from the left."""
    at = [F.struct(F.lit(i).alias("col"), c.cast("string").alias("text")) for i, c in enumerate(texts)]
    return df.select(F.lit("book").alias("file"), F.col("n_name").alias("sheet"), row.cast("int").alias("row"),
                     F.inline(F.array(*at))).where("text is not null")


def sheets(spark, sf, subtotals: bool = False, notes: bool = False, years: bool = False, right: bool = False) -> DataFrame:
    supplier = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    money = F.col("s_acctbal").cast("decimal(14,2)")
    s = row_numbers(supplier.select("n_name", "s_suppkey", "s_name", money.alias("bal"), F.col("s_suppkey").alias("key")), "i",
                    ["s_suppkey"], ["n_name"])
    s = cut_lineage(s)
    per = s.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("bal").alias("bal"), F.sum("key").alias("key"))
    extra = 1 if subtotals else 0
    heads = (F.lit("Supplier*" if notes else "Supplier"), F.lit("2021" if years else "Balance"), F.lit("2022" if years else "Key"))
    marked = F.concat("s_name", F.lit("*")) if notes else F.col("s_name")
    parts = [
        _cells(per, F.lit(0), F.concat(F.lit("Report for "), "n_name")),
        _cells(per, F.lit(2), *heads),
        _cells(s, F.col("i") + 2, marked, F.concat(F.lit("$"), F.format_number("bal", 2)), F.col("key")),
        _cells(per, F.col("n") + 3 + extra, F.lit("Grand total" if subtotals else "Total"), F.col("bal"), F.col("key")),
    ]
    if subtotals:
        parts.append(_cells(per, F.col("n") + 3, F.lit("Region subtotal"), F.col("bal"), F.col("key")))
    if notes:
        parts.append(_cells(per, F.col("n") + 6, F.lit("* excludes closed accounts")))
        parts.append(_cells(per, F.col("n") + 7, F.lit("Source: ledger")))
    if right:
        side = _cells(s, F.col("i") + 2, *[F.lit(None)] * 5, F.lit("x"), F.col("i"))
        parts.append(side)
        parts.append(_cells(per, F.col("n") + 9, F.lit("Second"), F.lit("Table")))
        parts.append(_cells(per, F.col("n") + 10, F.lit("a"), F.lit("1")))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


PER = "SELECT n_name AS sheet, count(*)::INTEGER AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


@query("grid_header_rows", "B1", f"SELECT sheet, 2 AS header_row FROM ({PER})")
def grid_header_rows(spark, sf):
    return G.header_rows(sheets(spark, sf)).select("sheet", "header_row")


@query("grid_year_headings", "B1", f"SELECT sheet, 2 AS header_row FROM ({PER})")
def grid_year_headings(spark, sf):
    return G.header_rows(sheets(spark, sf, years=True)).select("sheet", "header_row")


@query("grid_blocks", "B2", f"""
SELECT sheet, 0 AS block_col, 0 AS block_row, 3 * n + 7 AS cells FROM ({PER}) UNION ALL SELECT sheet, 0, 1, 4 FROM ({PER}) UNION ALL SELECT sheet, 1, 0, 2 * n FROM ({PER})
""")
def grid_blocks(spark, sf):
    out = G.blocks(sheets(spark, sf, right=True))
    return out.groupBy("sheet", "block_col", "block_row").agg(F.count("*").cast("int").alias("cells"))


@query("grid_two_row_names", "B3", """
SELECT r_name AS sheet, c AS col, CASE c WHEN 0 THEN 'Store' WHEN 1 THEN 'Sales Count' WHEN 2 THEN 'Sales Value' WHEN 3 THEN 'Refunds Count' WHEN 4 THEN 'Refunds Value' ELSE 'column_6' END AS name
FROM region, range(6) g(c) WHERE c <> 5
UNION ALL SELECT r_name, 5, 'Refunds Count_1' FROM region
""")
def grid_two_row_names(spark, sf):
    region = t(spark, sf, "region").withColumnRenamed("r_name", "n_name")
    blank = F.lit(None)
    cells = _cells(region, F.lit(0), F.lit("Store"), F.lit("Sales"), blank, F.lit("Refunds"), blank, blank).unionByName(
        _cells(region, F.lit(1), blank, F.lit("Count"), F.lit("Value"), F.lit("Count"), F.lit("Value"), F.lit("Count"))).unionByName(
        _cells(region, F.lit(2), F.lit("North"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), F.lit("5")))
    heads = cells.select("file", "sheet").distinct().withColumn("header_row", F.lit(0))
    return G.column_names(cells, heads, sub_header=True).select("sheet", F.col("col").cast("bigint").alias("col"), "name")


@query("grid_names", "B3", f"""
SELECT sheet, 0 AS col, 'Supplier' AS name FROM ({PER}) UNION ALL SELECT sheet, 1, 'Balance' FROM ({PER}) UNION ALL SELECT sheet, 2, 'Key' FROM ({PER})
""")
def grid_names(spark, sf):
    cells = sheets(spark, sf)
    return G.column_names(cells, G.header_rows(cells)).select("sheet", "col", "name")


@query("grid_totals", "B4", f"SELECT sheet, n + 3 AS row, 'total' AS kind FROM ({PER}) WHERE n >= 2")
def grid_totals(spark, sf):
    cells = sheets(spark, sf)
    return G.total_rows(G.body_below(cells, G.header_rows(cells))).select("sheet", "row", "kind")


@query("grid_subtotals", "B4", f"""
SELECT sheet, n + 4 AS row, 'total' AS kind FROM ({PER}) UNION ALL SELECT sheet, n + 3, 'subtotal' FROM ({PER})
""")
def grid_subtotals(spark, sf):
    cells = sheets(spark, sf, subtotals=True)
    return G.total_rows(G.body_below(cells, G.header_rows(cells))).select("sheet", "row", "kind")


@query("grid_notes", "B5", f"""
SELECT sheet, n + 6 AS row, '* excludes closed accounts' AS text FROM ({PER}) UNION ALL SELECT sheet, n + 7, 'Source: ledger' FROM ({PER})
""")
def grid_notes(spark, sf):
    cells = sheets(spark, sf, notes=True)
    return G.trailing_notes(G.body_below(cells, G.header_rows(cells))).select("sheet", "row", "text")


@query("grid_without_markers", "B5", "SELECT n_name AS sheet, s_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def grid_without_markers(spark, sf):
    cells = sheets(spark, sf, notes=True)
    body = G.body_below(cells, G.header_rows(cells))
    clean = G.without_footnote_markers(body, G.trailing_notes(body))
    return clean.where("col = 0 and text like 'Supplier#%'").select("sheet", "text")


@query("grid_types", "B6", f"""
SELECT sheet, 0 AS col, 'text' AS type FROM ({PER}) UNION ALL SELECT sheet, 1, 'numeric' FROM ({PER}) UNION ALL SELECT sheet, 2, 'numeric' FROM ({PER})
""")
def grid_types(spark, sf):
    cells = sheets(spark, sf)
    return G.column_types(G.body_below(cells, G.header_rows(cells))).select("sheet", "col", "type")


@query("grid_records", "B4 B6", """
SELECT n_name AS sheet, s_name AS "Supplier", s_acctbal AS balance, s_suppkey::DOUBLE AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 2)
""")
def grid_records(spark, sf):
    cells = sheets(spark, sf)
    heads = G.header_rows(cells)
    body = G.body_below(cells, heads)
    rows = G.without_rows(body, G.total_rows(body))
    names = G.column_names(cells, heads)
    out = G.as_records(rows, names, ["Supplier", "Balance", "Key"])
    kept = out.where(~F.col("Supplier").rlike("^Total$"))
    big = kept.groupBy("sheet").count().where("count >= 2").select("sheet")
    return kept.join(big, "sheet", "left_semi").select("sheet", "Supplier", G.number(F.col("Balance")).alias("balance"),
                                                       G.number(F.col("Key")).alias("key"))
