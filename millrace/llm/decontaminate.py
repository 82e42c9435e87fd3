"""Benchmark decontamination: one Aho-Corasick automaton over the words of test questions and answers, run once over each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import shared_fs
from millrace.session import new_path

#: Consecutive words of an item that count as a leak; a shorter item counts as a whole.
WINDOW = 10
#: Bytes of items that one automaton is built from: about 60 bytes of memory per byte of windows, which repeat each word ten times.
AUTOMATON_BYTES = 256 << 10
#: Bytes of text that a task holds while it runs the automata over it, one after the other.
HELD_BYTES = 32 << 20

#: Byte -> itself in lower case where it belongs to a word, else a space: ASCII letters and digits, and all bytes beyond ASCII.
_WORDS = bytes(b if chr(b).isalnum() or b > 127 else 0x20 for b in bytes(range(128)).lower() + bytes(range(128, 256)))


def folded(text: bytes) -> bytes:
    """The text with lower-case words and single spaces, one at either end: word bounds are part of what is searched."""
    words = text.translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def windows(words: Sequence[bytes], width: int = WINDOW) -> Iterator[bytes]:
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield b" " + b" ".join(words[i : i + width]) + b" "


class Leaks:
    """The automaton of some items, given as (id, text); a window that several items hold is one pattern with all their ids."""

    def __init__(self, items: Sequence[tuple[str, bytes]], width: int = WINDOW):
        holders: dict[bytes, set[str]] = {}
        for key, text in items:
            for w in windows(folded(text).split(), width):
                holders.setdefault(w, set()).add(key)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # Bytes as the characters of the same numbers: offsets stay bytes, and a text costs one byte a character.
        for i, w in enumerate(holders):
            self.machine.add_word(w.decode("latin-1"), i)
        self.holders = list(holders.values())
        self.lengths = [len(w) for w in holders]
        if holders:
            self.machine.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(end, window) of each occurrence in a folded text, by the place of its last byte."""
        return list(self.machine.iter(text.decode("latin-1"))) if self.holders else []


def hit_words(text: bytes, spans: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes where words of a folded text begin, which of them lie inside a span); spans are (first, last) bytes, spaces included."""
    blank = np.frombuffer(text, np.uint8) == 0x20
    starts = np.flatnonzero(blank[:-1]) + 1
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.searchsorted(starts, bounds[:, 0]), 1)
    np.add.at(change, np.searchsorted(starts, bounds[:, 1]), -1)
    return starts, np.cumsum(change[:-1]) > 0


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in code points of the original text: runs of hit words, from the first letter to the last."""
    view = np.frombuffer(text, np.uint8)
    word = np.frombuffer(text.translate(_WORDS), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((view & 0xC0) != 0x80)])
    runs = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    return list(zip(points[starts[first]].tolist(), points[ends[last]].tolist(), strict=True))


@lru_cache(maxsize=1)
def _automaton(path: str, width: int) -> Leaks:
    system, base = shared_fs(path)
    table = pq.read_table(base, filesystem=system)
    return Leaks(list(zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True)), width)


def _item_files(items: DataFrame, id_col: str, text_col: str, most: int) -> list[str]:
    """Items in files of the shared folder, each about ``most`` bytes of text or one item; the files' names are all the driver gets.

    An item above that size is divided where no window is lost: its pieces overlap by all but one word of a window.
    """
    spark = items.sparkSession
    path = new_path(spark, "items")
    schema = pa.schema([("id", pa.string()), ("text", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = shared_fs(path)
        names, rows, size = [], [], 0
        task = TaskContext.get()

        def flush() -> None:
            # A repeated task writes files of its own; only the names that the finished one returns are read.
            name = f"{base}/{task.partitionId()}-{task.taskAttemptId()}-{len(names)}.parquet"
            system.create_dir(base)
            pq.write_table(pa.Table.from_pylist(rows, schema), name, filesystem=system)
            names.append(name.rpartition("/")[2])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _pieces(text, most):
                    if rows and size + len(piece) > most:
                        flush()
                        rows, size = [], 0
                    rows.append({"id": key, "text": piece})
                    size += len(piece)
        if rows:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    kept = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    return sorted(f"{path}/{r.name}" for r in kept.mapInArrow(write, "name string").collect())


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    if len(text) <= most:
        yield text
        return
    words, at = folded(text).split(), 0
    while at < len(words):
        to, size = at, 0
        while to < len(words) and (to < at + 2 * WINDOW or size < most):
            size += len(words[to]) + 1
            to += 1
        yield b" ".join(words[at:to])
        at = to if to == len(words) else to - WINDOW + 1


def leaked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_hit, items (sorted as texts), spans (start, end in code points of the text).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A window is ``WINDOW``
    consecutive words of an item, or a shorter item as a whole; a word inside any occurrence of a window is hit, and
    ``spans`` are the runs of hit words. Whole texts, scanned once per automaton: one automaton holds all items up to ``automaton_bytes``
    of their text, larger benchmarks get one per that many bytes, whose hits are united before they are counted. A null text has no words; an item
    without words has no window; a null item id is the empty text; rows that share an item id are one item with the
    windows of all of them. Repeated documents give repeated results, empty tables no rows or no hits. Other columns
    are neither read nor returned. A narrow map over ``docs``: nothing is shuffled, and a task holds ``HELD_BYTES`` of text and one
    automaton.
    """
    files = _item_files(items, item_id, item_text, automaton_bytes)

    def judged(rows: list[tuple[object, bytes]]) -> tuple[list, ...]:
        texts = [folded(t) for _, t in rows]
        spans: list[list[tuple[int, int]]] = [[] for _ in rows]
        found: list[set[str]] = [set() for _ in rows]
        for name in files:
            leaks = _automaton(name, WINDOW)
            for i, text in enumerate(texts):
                if hits := leaks.find(text):
                    spans[i] += [(end + 1 - leaks.lengths[w], end) for end, w in hits]
                    found[i].update(*(leaks.holders[w] for w in {w for _, w in hits}))
        n, n_hit, places = [], [], []
        for (_, raw), text, own in zip(rows, texts, spans, strict=True):
            n.append(text.count(b" ") - 1)
            hit = hit_words(text, own)[1] if own else np.zeros(0, bool)
            n_hit.append(int(hit.sum()))
            places.append([{"start": a, "end": b} for a, b in original_spans(raw, hit)] if own else [])
        return [k for k, _ in rows], n, n_hit, [sorted(x) for x in found], places

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), place]
        rows, size = [], 0

        def result(kind: pa.DataType) -> pa.RecordBatch:
            keys, *columns = judged(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["_id", "n_words", "n_hit", "items", "spans"])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((key, text or b""))
                size += len(text or b"")
                if size >= HELD_BYTES or len(rows) >= 20_000:
                    yield result(kind)
                    rows, size = [], 0
        if rows:
            yield result(kind)

    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return taken.mapInArrow(scan, schema).withColumnRenamed("_id", id_col)


def decontaminated_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document's counts, the digest of the items found, and the verdict."""
    found = leaked(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TOKEN}') AS words FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TOKEN}') AS words FROM benchmark
), spot AS (
  SELECT item, words, unnest(range(1, greatest(2, len(words) - {WINDOW} + 2))) AS p FROM i WHERE len(words) > 0
), w AS (
  SELECT DISTINCT item, least({WINDOW}, len(words)) AS width, array_to_string(words[p:p + {WINDOW} - 1], ' ') AS text FROM spot
), places AS (
  SELECT row, words, width, unnest(range(1, len(words) - width + 2)) AS p FROM d, (SELECT DISTINCT width FROM w) AS widths WHERE len(words) >= width
), hits AS (
  SELECT g.row, g.p, g.width, w.item
  FROM (SELECT row, p, width, array_to_string(words[p:p + width - 1], ' ') AS text FROM places) AS g JOIN w ON g.text = w.text AND g.width = w.width
), covered AS (
  SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + width)) AS q FROM (SELECT DISTINCT row, p, width FROM hits)) GROUP BY row
), listed AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN listed USING (row)
"""
