"""Delimited text: delimiter, encoding, header position, strict rows, null words, blank columns."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.missing import DATE_HINT, parse_day
from millrace.session import cut_lineage

DELIMITERS = (",", ";", "\t", "|")
HEADER_SCAN, HEADER_LAST = 50, 20
#: Bytes that a quoted field may stay open, and rows of the table of splits that are sent to every task.
LONGEST, MOST_SPLITS = 1 << 30, 1_000_000
WINDOWS = "windows-1252"
#: The bytes 80 to 9F that Windows-1252 defines.
_C1 = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
# Words pandas-style readers take as missing (exact case), headers a spreadsheet export makes up, number-like cells.
NULL_WORDS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
              "NULL", "NaN", "None", "n/a", "nan", "null")
MADE_UP = r"^Unnamed: \d+(?:_level_\d+)?$"
NUMBERISH = (r"^[\s$€£₹(+-]*\d[\d,.\s]*%?\)?$|^\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4})?([ T]\d{1,2}:\d{2}(:\d{2})?)?$")


def head_lines(spark: SparkSession, path: str, n: int, encoding: str = "UTF-8") -> list[str]:
    """The first ``n`` lines; what sniffing looks at."""
    return [r["value"] for r in text_lines(spark, path, encoding).limit(n).collect()]


def text_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per line. Files are read in splits, each line exactly once; UTF-16 files as a whole each."""
    if encoding.upper() == "UTF-8":
        return spark.read.text(path)
    if encoding.upper() != "UTF-16":
        lines = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"))
        return lines.select(_decoded("value", encoding).alias("value"))
    whole = T.StructType([T.StructField("value", T.StringType())])
    reader = spark.read.schema(whole).options(**_stored_as(encoding)).option("sep", "\x01").option("quote", "")
    return reader.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def _stored_as(encoding: str) -> dict[str, str]:
    """Reader options: Spark has no reader of Windows-1252, which differs from Latin-1 in the bytes 80 to 9F only."""
    if encoding == WINDOWS:
        return {"encoding": "ISO-8859-1"}
    return {"encoding": encoding, "multiLine": str(encoding.upper() == "UTF-16").lower()}


def _decoded(c: str, encoding: str) -> Column:
    if encoding != WINDOWS:
        return F.col(c)
    return F.translate(c, "".join(map(chr, _C1)), bytes(_C1).decode("cp1252"))


def sniff_delimiter(header: str) -> str:
    """The delimiter the header line holds most often; a comma when it holds none."""
    best = max(DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def consistent_delimiter(lines: DataFrame) -> DataFrame:
    """(delimiter, width, rows): the delimiter that gives most lines the same field count, over all lines in one pass."""
    quoted = F.regexp_replace("value", r'"[^"]*"', "q")
    widths = F.array(*[F.struct(F.lit(i).alias("i"), F.size(F.split(quoted, re.escape(d))).alias("width")) for i, d in enumerate(DELIMITERS)])
    counted = lines.select(F.explode(widths).alias("w")).where("w.width > 1").groupBy("w.i", "w.width").agg(F.count("*").alias("rows"))
    best = counted.orderBy(F.desc("rows"), F.desc("width"), "i").limit(1)
    return best.select(F.element_at(F.array(*map(F.lit, DELIMITERS)), F.col("i") + 1).alias("delimiter"), "width", "rows")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 with a byte order mark, UTF-8 when every line is valid UTF-8, Windows-1252 when it defines every byte, else Latin-1.

    Checked on all lines, in the JVM.
    """
    lines = text_lines(spark, path, "ISO-8859-1")
    start = lines.first()
    if start and (start["value"] or "").startswith(("\xff\xfe", "\xfe\xff")):
        return "UTF-16"
    valid = F.is_valid_utf8(F.encode("value", "ISO-8859-1").cast("string"))
    if lines.where(~valid).isEmpty():
        return "UTF-8"
    undefined = "[" + "".join(chr(b) for b in range(0x80, 0xA0) if b not in _C1) + "]"
    return WINDOWS if lines.where(F.col("value").rlike(undefined)).isEmpty() else "ISO-8859-1"


def find_header(spark: SparkSession, rows: Sequence[Sequence[str]]) -> int | None:
    """The number of the header line among the first ``rows``, or None when the file should be read as it is.

    One row of facts per line: filled cells, those that are words, different ones. The usual width is the commonest count of
    filled cells below the first third. The first line about as wide, of words without repeats, is the header if only sparse
    lines lie above it and the next line that is not empty looks like data.
    """
    if len(rows) < 3:
        return None
    lines = spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "i int, cells array<string>")
    bare = F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    filled = lines.select("i", F.filter(bare, lambda c: (c != "") & ~c.rlike(MADE_UP)).alias("c"))
    facts = filled.select(
        "i", F.size("c").alias("n"), F.size(F.filter("c", lambda c: ~c.rlike(NUMBERISH))).alias("words"),
        F.size(F.array_distinct(F.transform("c", F.lower))).alias("kinds"))
    usual = facts.where((F.col("i") >= len(rows) // 3) & (F.col("n") > 1)).groupBy(F.col("n").alias("width")).agg(
        F.count("*").alias("lines"), F.min("i").alias("at")).orderBy(F.desc("lines"), "at").limit(1).select("width")
    order = Window.orderBy("i")  # at most HEADER_SCAN lines
    above = F.coalesce(F.max("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.first(F.when(F.col("n") > 0, F.col("n")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    around = facts.withColumns({"above": above, "below": below}).join(usual)
    like_header = F.col("i").between(0, HEADER_LAST) & (F.col("n") >= F.greatest(F.lit(2), F.floor(0.8 * F.col("width") + 0.5)))
    like_header &= (F.col("kinds") == F.col("n")) & (F.col("words") >= 0.6 * F.col("n"))
    fits = (F.col("above") <= F.greatest(F.lit(1), F.floor(F.col("width") / 2))) & (F.col("below") >= F.greatest(F.lit(2), F.floor(0.5 * F.col("width"))))
    first = around.where(like_header).orderBy("i").select("i", fits.alias("fits")).first()
    return first["i"] if first and first["fits"] else None


def _after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is open after a line, given whether one is before it.

    A quote opens a field only where the field begins, and closes it unless it is doubled; any other quote is a character.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        inside, at = False, line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _numbered(lines: DataFrame, head: Sequence[str], delimiter: str) -> DataFrame:
    """(value, file, block, line, from0, from1, open0, open1) of every line but the ``head`` of each file.

    What a line is depends on whether a quoted field is open where its split begins, so both cases are kept: ``from0`` and
    ``from1`` are the number of the line in this split where the record at hand began (-1: in an earlier split), ``open0`` and
    ``open1`` tell whether a field is open after the line. One pass in file order, a split per task or several.
    """
    head = list(head)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, line, state, begun = None, 0, [False, True], [-1, -1]
        for batch in batches:
            values, files, blocks = (batch.column(i) for i in range(3))
            out: list[list] = [[] for _ in range(6)]
            quoted = pc.match_substring(values, '"').to_pylist()
            texts = {}
            for i, (has, file, block) in enumerate(zip(quoted, files.to_pylist(), blocks.to_pylist(), strict=True)):
                if (file, block) != place:
                    place, line, state, begun = (file, block), 0, [False, True], [-1, -1]
                if block == 0 and line < len(head) and values[i].as_py() == head[line]:
                    line += 1
                    continue
                if has:
                    texts[i] = values[i].as_py()
                for s in (0, 1):
                    if not state[s]:
                        begun[s] = line
                    if has:
                        state[s] = _after(texts[i], state[s], delimiter)
                for column, v in zip(out, (i, line, *begun, *state), strict=True):
                    column.append(v)
                line += 1
            kept = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [values.take(kept), files.take(kept), blocks.take(kept), *(pa.array(c, pa.int64()) for c in out[1:4]), *(pa.array(c, pa.bool_()) for c in out[4:])],
                names=["value", "file", "block", "line", "from0", "from1", "open0", "open1"])

    schema = "value string, file string, block long, line long, from0 long, from1 long, open0 boolean, open1 boolean"
    return lines.mapInArrow(number, schema)


def whole_records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", head: Sequence[str] = ()) -> DataFrame:
    """(value): the records of delimited files, read in splits although quoted fields may hold line breaks.

    Whether a line begins a record depends on all quotes before it. Each split notes how it would change an open field into a
    closed one and back; a prefix scan over one row per split tells the state in which each begins and where its first record does. Lines
    that are records by themselves stay where they are; only the lines of longer records are brought together.
    Line breaks inside a field come out as a line feed. Lines of ``head`` at the beginning of each file are left out where they
    are equal by place and text. A field that is open for more than ``LONGEST`` bytes of a file is an error.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if encoding.upper() != "UTF-8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
        lines = lines.withColumn("value", _decoded("value", encoding))
    numbered = _numbered(lines, head, delimiter)
    final = [F.max_by(c, "line").alias(c) for c in ("open0", "open1", "from0", "from1")]
    splits = cut_lineage(numbered.groupBy("file", "block").agg(*final))
    # The state before a split: what the nearest split before it that ends alike from both states gives, turned once by each
    # split in between that swaps them. No quotes at all keep the state, which is neither.
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("open0") == F.col("open1")
    swaps = (F.col("open0") & ~F.col("open1")).cast("long")
    sums = splits.withColumns({"_swaps": F.sum(swaps).over(order), "_fixed": fixed})
    since = F.last(F.when(F.col("_fixed"), F.struct(F.col("open0").alias("state"), F.col("_swaps").alias("at"))), ignorenulls=True).over(before)
    placed = sums.withColumns({"_since": since, "_turned": F.coalesce(F.lag("_swaps").over(order), F.lit(0))})
    opened = F.coalesce(F.col("_since.state"), F.lit(False)).cast("long") + F.col("_turned") - F.coalesce(F.col("_since.at"), F.lit(0))
    placed = placed.withColumn("open", opened % 2 == 1)
    begins = F.when(F.col("open"), F.col("from1")).otherwise(F.col("from0"))
    latest = F.when(begins >= 0, F.struct(F.col("block").alias("at"), begins.alias("line")))
    starts = cut_lineage(placed.withColumn("_carried", F.last(latest, ignorenulls=True).over(before)).select("file", "block", "open", "_carried"))
    lost = starts.where(F.col("open") & (F.col("block") - F.coalesce(F.col("_carried.at"), F.lit(0)) > LONGEST)).select("file").first()
    if lost:
        raise ValueError(f"{lost['file']}: a quoted field is not closed")
    # One row of some 100 bytes per split: 100 TB in splits of 128 MB are 80 MB.
    small = starts.count() <= MOST_SPLITS
    known = numbered.join(F.broadcast(starts) if small else starts, ["file", "block"])
    own = F.when(F.col("open"), F.col("from1")).otherwise(F.col("from0"))
    known = known.withColumns({"_from": own, "_open": F.when(F.col("open"), F.col("open1")).otherwise(F.col("open0"))})
    alone = (F.col("_from") == F.col("line")) & ~F.col("_open")
    parts = known.where(~alone).select(
        "file", F.when(own >= 0, F.col("block")).otherwise(F.col("_carried.at")).alias("_b"), F.when(own >= 0, own).otherwise(F.col("_carried.line")).alias("_l"),
        F.struct("block", "line", "value").alias("_part"))
    joined = parts.groupBy("file", "_b", "_l").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return known.where(alone).select("value").unionByName(joined.select(F.concat_ws("\n", F.col("_parts.value")).alias("value")))


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, strict: bool = False,
) -> DataFrame:
    """All columns as text, the header wherever it is in the first rows.

    ``strict`` keeps only rows with exactly as many fields as the header. Preamble and header are left out by their place in each
    file, so data rows that equal them stay. Files are read in splits, also where quoted fields hold line breaks
    (``whole_records``); only UTF-16 files are read as a whole each.
    """
    encoding = encoding or detect_encoding(spark, path)
    lines = text_lines(spark, path, encoding)
    head = [h.removeprefix("\ufeff") for h in head_lines(spark, path, HEADER_SCAN, encoding)]
    if not head:
        raise ValueError(f"{path} is empty")
    if delimiter is None:
        found = consistent_delimiter(lines).first()
        delimiter = found["delimiter"] if found else sniff_delimiter(head[0])
    reader, parsed, ends = csv.reader((h + "\n" for h in head), delimiter=delimiter), [], []
    for cells in reader:
        parsed.append(cells)
        ends.append(reader.line_num)
    at = find_header(spark, parsed) or 0
    names = unique_names(parsed[at])
    options = {"sep": delimiter, "escape": '"', "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    in_utf16 = encoding.upper() == "UTF-16"
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    if in_utf16 or (at == 0 and ends[0] == 1 and lines.where(quotes % 2 == 1).isEmpty()):
        reader = spark.read.schema(_ddl(names)).option("header", "true").options(**_stored_as(encoding) | options)
        rows = reader.csv(path)
        if strict:
            rows = rows.where(F.col("_bad").isNull())
        return rows.select(*[_decoded("`" + n.replace("`", "``") + "`", encoding).alias(n) for n in names])
    raw = head_lines(spark, path, HEADER_SCAN, encoding)[: ends[at]]
    records = whole_records(spark, path, delimiter, encoding, raw).where(F.trim("value") != "")
    rows = records.select(F.from_csv("value", _ddl(names), options | {"multiLine": "true"}).alias("r"))
    if strict:
        rows = rows.where(F.col("r._bad").isNull())
    return rows.select(*[F.col("r").getField(n).alias(n) for n in names])


def _ddl(names: Sequence[str]) -> str:
    cells = ["`" + n.replace("`", "``") + "` string" for n in [*names, "_bad"]]
    return ", ".join(cells)


def unique_names(cells: Sequence[str]) -> list[str]:
    """Column names with blanks filled and repeats numbered."""
    out, seen = [], {}
    for i, c in enumerate(cells):
        name = re.sub(r"\s+", " ", c or "").strip() or f"Unnamed: {i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(name if not seen[name] else f"{name}_{seen[name]}")
    return out


def _cell(c: str) -> Column:
    return F.when(F.trim(c) != "", F.col(c))


def type_columns(df: DataFrame) -> DataFrame:
    """Types for all-text columns under the null-word rule, decided on every row in one pass.

    An empty cell is missing. A null word is missing in a column whose other cells are all numbers, booleans, dates or times
    of day with their date, and a label in a text column. No other cell is emptied: one that does not fit makes a text column.
    """
    cells = []
    for c in df.columns:
        v = F.when(~F.col(f"`{c}`").isin(*NULL_WORDS), _cell(f"`{c}`"))
        cells.append(F.struct(
            F.count(v).alias("n"), F.count(v.try_cast("double")).alias("numbers"), F.count(v.try_cast("bigint")).alias("whole"),
            F.count_if(F.lower(v).isin("true", "false")).alias("flags"), F.count(v.try_cast("timestamp_ntz")).alias("moments"),
            F.count_if(v.try_cast("timestamp_ntz") != F.date_trunc("day", v.try_cast("timestamp_ntz"))).alias("clocks"),
            F.count_if(v.rlike(DATE_HINT) & parse_day(v).isNotNull()).alias("days")).alias(c))
    facts = df.agg(*cells).first()
    out = []
    for c in df.columns:
        f, cell = facts[c], _cell(f"`{c}`")
        typed = F.when(~F.col(f"`{c}`").isin(*NULL_WORDS), cell)
        gaps = f["n"] < 1
        if gaps:
            out.append(typed.alias(c))
        elif f["whole"] == f["n"]:
            out.append(typed.try_cast("bigint").alias(c))
        elif f["numbers"] == f["n"]:
            out.append(typed.try_cast("double").alias(c))
        elif f["flags"] == f["n"]:
            out.append(typed.try_cast("boolean").alias(c))
        elif f["moments"] == f["n"] and f["clocks"]:
            out.append(typed.try_cast("timestamp_ntz").alias(c))
        elif f["days"] == f["n"]:
            out.append(parse_day(typed).alias(c))
        else:
            out.append(cell.alias(c))
    return df.select(*out)


def drop_blank_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without the columns that have a blank or made-up header and no value at all; one pass over those columns only."""
    blank = [c for c in df.columns if not c.strip() or re.match(MADE_UP, c)]
    if not blank:
        return df, []
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(blank)]).first()
    empty = [c for i, c in enumerate(blank) if counts[str(i)] == 0]
    if len(empty) == len(df.columns):
        return df, []
    return df.drop(*empty), empty
