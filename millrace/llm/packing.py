"""Concatenate and cut: all documents as one stream of token ids, cut into windows of equal length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import give_back, written

WINDOW = 2048
END_ID = 1
#: Distinct pieces whose ids one worker remembers before it starts anew: about 60 MB.
REMEMBERED = 300_000
#: Documents tokenized at once.
ENCODED_ROWS = 512

#: Texts of these characters only (ASCII and Latin letters) are cut by the standard library's faster expressions, which
#: agree there with the tokenizer's Unicode classes. Any other text goes through the whole tokenizer.
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
#: Fixed value: the published splitting rule of byte-level BPE, with letters and digits as the standard library writes them.
_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s")


class _Remembered(dict):
    """Piece -> its ids as bytes; a missing piece is encoded."""

    def __init__(self, encode: Callable[[str], list[int]], dtype: str):
        super().__init__()
        self.encode, self.dtype = encode, dtype

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), self.dtype).tobytes()
        return ids


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def token_encoder(path: str) -> tuple[Callable[[str], bytes], str]:
    """Text -> ids as little-endian bytes, and the ids' numpy type, for a byte-level BPE file of the tokenizers library.

    Where the file's merges are in the order of their ids, the same merges run in tiktoken, several times as fast, and
    frequent pieces are remembered; otherwise the tokenizers library itself encodes.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    dtype = "<u2" if whole.get_vocab_size() <= 1 << 16 else "<u4"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
    results = [vocab["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in merges]
    ranked = results == sorted(results) and spec["model"]["type"] == "BPE" and spec["pre_tokenizer"]["type"] == "ByteLevel"
    ranked = ranked and not spec["pre_tokenizer"].get("add_prefix_space") and spec.get("normalizer") is None

    def plain(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype).tobytes()

    if not ranked:
        return plain, dtype
    import tiktoken

    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    known = _Remembered(bpe.encode_ordinary, dtype)

    def fast(text: str) -> bytes:
        if _OTHER.search(text):
            return plain(text)
        return b"".join(map(known.__getitem__, _PIECES.findall(text)))

    fast.forget = known.clear
    return fast, dtype


def tokenized(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: (``id_col``, ids, n, _part, _at), written once; ``n`` counts the end id, ``_at`` the ids before in the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, dtype = token_encoder(tokenizer)
        width, part, at = int(dtype[-1]), TaskContext.get().partitionId(), 0
        for whole in batches:
            # A few rows at a time: the texts and ids of a whole batch as Python objects would be several times its size.
            for batch in (whole.slice(lo, ENCODED_ROWS) for lo in range(0, whole.num_rows, ENCODED_ROWS)):
                ids = [ids_of(t) if t else b"" for t in batch.column(1).to_pylist()]
                n = np.array([len(x) // width + 1 for x in ids], np.int64)
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
                    schema=pa.schema([pa.field(id_col, batch.column(0).type), ("ids", pa.binary()), ("n", pa.int64()), ("_part", pa.int32()), ("_at", pa.int64())]))
                at = int(ends[-1])
        # The encoder stays in the worker, which other stages use next; the pieces it remembers do not.
        getattr(ids_of, "forget", lambda: None)()
        give_back()

    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    return written(df.select(id_col, text_col).mapInArrow(encode, schema), "tokens")


def concatenate_and_cut(
    df: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in windows of ``window`` ids: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Two passes. Each task tokenizes its rows and notes how many ids came before each in that task; one total per task
    is summed up into the task's place in the whole stream, so a document's global offset is known without a
    shuffle. The second pass cuts at the multiples of ``window``: a document across a boundary gives one piece per side.
    A null text is an empty one: its only id is the end id. Repeated rows are packed as often as they occur. Only the
    last sequence can be shorter than ``window``. An empty table gives no pieces. ``with_ids`` adds the ids themselves.
    """
    tokens = tokenized(df, tokenizer, id_col, text_col)
    totals = tokens.groupBy("_part").agg(F.sum("n").alias("_n"))
    base = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    # One row of 12 bytes per task of the first pass: a million tasks, 100 TB and more, are 12 MB.
    placed = tokens.join(F.broadcast(base), "_part").select(id_col, "ids", (F.col("_base") + F.col("_at")).alias("_global"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dtype = token_encoder(tokenizer)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            row, start, length, crc, total, where, pieces = [], [], [], [], [], [], []
            for i, (raw, g) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                ids = np.concatenate([np.frombuffer(raw.as_buffer(), dtype).astype("<u4"), end])
                n, s = len(ids), 0
                while s < n:
                    k = min(n - s, window - (g + s) % window)
                    row.append(i)
                    start.append(s)
                    length.append(k)
                    crc.append(zlib.crc32(ids[s : s + k]))
                    total.append(n)
                    where.append(g + s)
                    if with_ids:
                        pieces.append(ids[s : s + k])
                    s += k
            at = np.array(where, np.int64)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                       pa.array(at // window), pa.array(at % window)]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names, *(["ids"] if with_ids else [])])
        give_back()

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names)])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces that carry their ids; a group holds at most one window."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
