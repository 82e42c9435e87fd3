"""Fill-in-the-middle: texts cut at two token bounds and put in another order, found by a Fenwick tree over blocks of the text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BLANK, WORD

SEED = 42
#: Percent of the texts that are transformed, and percent of those in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of UTF-8 in a block of the tree.
BLOCK = 1024

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Fenwick:
    """Prefix sums over blocks: one array per counted quantity, descended from the highest power of two."""

    def __init__(self, counts: Sequence[np.ndarray]):
        self.size = len(counts[0])
        at = np.arange(1, self.size + 1)
        low = at - (at & -at)
        sums = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        #: trees[q][i]: the quantity q in the blocks from i - lowbit(i) up to i.
        self.trees = [np.concatenate([[0], s[1:] - s[low]]) for s in sums]

    def block_of(self, rank: int) -> tuple[int, list[int]]:
        """The block that holds the ``rank``-th unit of the first quantity (from 1), and all quantities before that block."""
        first, at, before = self.trees[0], 0, [0] * len(self.trees)
        step = 1 << max(0, self.size.bit_length() - 1)
        while step:
            to = at + step
            if to <= self.size and before[0] + first[to] < rank:
                before = [int(b + tree[to]) for b, tree in zip(before, self.trees, strict=True)]
                at = to
            step >>= 1
        return at, before


class Units:
    """The token bounds of one text, as UTF-8: blanks with the word after them, or the blanks at the end."""

    def __init__(self, raw: bytes | memoryview, block: int = BLOCK):
        self.view, self.block = np.frombuffer(raw, np.uint8), block
        blank = _IS_BLANK[self.view]
        #: True at the last byte of each unit.
        self.last = ~blank
        self.last[:-1] &= blank[1:]
        if len(blank):
            self.last[-1] = True
        starts = np.arange(0, len(blank), block)
        self.count = int(np.count_nonzero(self.last))
        if self.count:
            points = (self.view & 0xC0) != 0x80
            self.tree = Fenwick([np.add.reduceat(x, starts, dtype=np.int64) for x in (self.last, points)])

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if not units:
            return 0, 0
        at, (before, points) = self.tree.block_of(units)
        low = at * self.block
        end = low + int(np.flatnonzero(self.last[low : low + self.block])[units - before - 1]) + 1
        return end, points + int(np.count_nonzero((self.view[low:end] & 0xC0) != 0x80))


def draws(key: object, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers of a key; a null key counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transformed(raw: bytes, key: object, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, output, code points of the prefix, of the middle) of one text; the last two are None if plain."""
    units = Units(raw)
    h1, h2, h3, h4 = draws(key, seed)
    n = units.count
    if not raw or h3 % 100 >= rate or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", raw, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (end, points), (to, upto) = units.cut(a), units.cut(b)
    prefix, middle, suffix = raw[:end], raw[end:to], raw[to:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_rate:
        return n, "spm", b"".join((s, suffix, p, prefix, m, middle)), points, upto - points
    return n, "psm", b"".join((p, prefix, s, suffix, m, middle)), points, upto - points


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, text, n, form, output, prefix_chars, middle_chars.

    Whole texts, cut at token bounds that the key alone decides, so a rerun or a repeated row gives the same output. A null
    text is an empty one; empty texts, and texts that hold a marker, stay plain. A null key counts as the empty text.
    Other columns of ``df`` are neither read nor returned, whatever their names; an empty table gives no rows. A narrow map:
    nothing is shuffled, and a task holds one Arrow batch. The tree of a text has 16 bytes per block of ``BLOCK`` bytes.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = [transformed(t, k, seed, rate, spm_rate) for k, t in zip(batch.column(2).to_pylist(), texts, strict=True)]
            n, form, output, prefix, middle = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(output, pa.binary()).cast(pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())],
                names=["_id", "text", "n", "form", "output", "prefix_chars", "middle_chars"])

    taken = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("string").alias("_key"))
    schema = T.StructType([
        T.StructField("_id", df.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("output", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType())])
    return taken.mapInArrow(turn, schema).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The original text, from an output and its form alone.

    No part holds a marker and no marker overlaps itself, so the first place of each marker is where it was put.
    """
    def parts(opening: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the opening marker, the marker ``second``, and the marker for the middle."""
        then, mid = F.locate(second, output), F.locate(MIDDLE, output)
        return (
            F.substring(output, F.lit(len(opening) + 1), then - len(opening) - 1),
            F.substring(output, then + len(second), mid - then - len(second)),
            F.substring(output, mid + len(MIDDLE), F.char_length(output)))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def infill_documents(df: DataFrame) -> DataFrame:
    """The digests of every document's output and of the text rebuilt from it."""
    out = fill_in_middle(df)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '{BLANK[:-1]}*{WORD}|{BLANK}') AS units,
    ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
