"""WARC archives with a two-level capture index: compressed blocks of sorted keys under a sparse directory."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shuffle_parts, written
from millrace.session import new_path

#: Payloads below this many bytes are stored every time.
REVISIT_BYTES = 100
#: Captures per compressed block of the index, and bytes per archive file.
BLOCK_LINES, FILE_BYTES = 300, 256 << 20
_DATE = "1970-01-01T00:00:00Z"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder, given as a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: captures of one host, and of its subdomains, lie together. A null URL has the empty key."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(text.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(text)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record in a gzip member of its own; a revisit holds headers only and names the capture it repeats."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Date: {_DATE}",
        # Header values are lines: whatever could break one is percent-encoded by JSON's escapes.
        f"WARC-Target-URI: {json.dumps(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _capture(header: str) -> int | None:
    name = header.removeprefix("<urn:capture:").removesuffix(">")
    return None if name == "None" else int(name)


def _decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, first): ``first`` is the smallest page_id of the same payload, null for short ones."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= REVISIT_BYTES
    # Counted inside the tasks first, so a payload of any share moves one row per task.
    firsts = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", "first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row as a record into archives below ``folder``: (key, page_id, file, at, size) of each.

    File names are unique per attempt, and only what a finished task reports is in the result, so a repeated task leaves at most
    files that nothing refers to.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                names, places, sizes = [], [], []
                columns = [batch.column(i).to_pylist() for i in range(1, 6)]
                for page_id, url, payload, digest, first in zip(*columns, strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    repeats = first is not None and page_id != first
                    member = record("revisit" if repeats else "response", page_id, url, payload, digest, first)
                    out.write(member)
                    names.append(name)
                    places.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                    names=["key", "page_id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    rows = _decided(pages).select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", "payload", "digest", F.col("first").cast("long").alias("first"))
    return written(rows.mapInArrow(put, "key string, page_id long, file string, at long, size long"), "captures")


def _line(key: str, page_id: int | None, file: str, at: int, size: int) -> str:
    return json.dumps([key, page_id, file, at, size])


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorted index files below ``folder``: (part, file, low, directory_at, directory_size), one row per file.

    A file holds compressed blocks of ``BLOCK_LINES`` captures in the order of (key, page_id, file, at), then its sparse directory: the
    first entry, place and size of each block. One key, or one page_id of a key, may fill many files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(folder)
        system.create_dir(base, recursive=True)
        name, blocks, lines, at, out = f"{uuid.uuid4().hex}.index", [], [], 0, None

        def flush() -> None:
            nonlocal lines, at
            if lines:
                raw = zlib.compress("\n".join(lines).encode(), 6)
                out.write(raw)
                blocks.append([*json.loads(lines[0])[:4], at, len(raw)])
                at += len(raw)
                lines = []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(_line(*row))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is not None:
            flush()
            directory = zlib.compress(json.dumps(blocks).encode(), 6)
            out.write(directory)
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([json.dumps(blocks[0][:4])]), pa.array([at], pa.int64()), pa.array([len(directory)], pa.int64())],
                names=["file", "low", "directory_at", "directory_size"])

    order = ["key", "page_id"]
    ranged = captures.repartitionByRange(shuffle_parts(captures), *order, "file", "at").sortWithinPartitions(*order, "file", "at")
    return written(ranged.mapInArrow(put, "file string, low string, directory_at long, directory_size long"), "index")


def _order(key: str, page_id: int | None, file: str, at: int) -> tuple[bytes, bool, int, str, int]:
    """As Spark sorts: keys by their bytes, a null page_id first."""
    return key.encode(), page_id is not None, page_id or 0, file, at


class CaptureIndex:
    """Lookups in one folder of index files: file by its lowest entry, block by the directory, line by its place; then a range read."""

    def __init__(self, files: list[tuple[str, str, int, int]], index_folder: str, archive_folder: str):
        self.files = sorted(files, key=lambda f: _order(*json.loads(f[1])))
        self.lows = [_order(*json.loads(f[1])) for f in self.files]
        self.folders = index_folder, archive_folder
        self._remember()

    def _remember(self) -> None:
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=8)(self._block)
        self.archive = lru_cache(maxsize=16)(self._archive)

    def __getstate__(self) -> tuple:
        return self.files, self.lows, self.folders

    def __setstate__(self, state: tuple) -> None:
        self.files, self.lows, self.folders = state
        self._remember()

    def _read(self, name: str, at: int, size: int) -> bytes:
        system, base = _folder(self.folders[0])
        with system.open_input_file(f"{base}/{name}") as f:
            return f.read_at(size, at)

    def _directory(self, i: int) -> tuple[list, list]:
        name, _, at, size = self.files[i]
        blocks = json.loads(zlib.decompress(self._read(name, at, size)))
        return [_order(*b[:4]) for b in blocks], blocks

    def _block(self, i: int, b: int) -> tuple[list, list]:
        blocks = self.directory(i)[1]
        entries = [json.loads(x) for x in zlib.decompress(self._read(self.files[i][0], *blocks[b][4:])).decode().split("\n")]
        return [_order(*e[:4]) for e in entries], entries

    def _archive(self, name: str):
        system, base = _folder(self.folders[1])
        return system.open_input_file(f"{base}/{name}")

    def file_of(self, key: str, page_id: int | None, file: str, at: int) -> int:
        return max(0, bisect.bisect_right(self.lows, _order(key, page_id, file, at)) - 1)

    def entry(self, key: str, page_id: int | None, file: str, at: int) -> list | None:
        """The entry of the capture of (key, page_id) at this place of an archive, found by three binary searches."""
        wanted = _order(key, page_id, file, at)
        i = self.file_of(key, page_id, file, at)
        firsts, _ = self.directory(i)
        orders, entries = self.block(i, max(0, bisect.bisect_right(firsts, wanted) - 1))
        at = bisect.bisect_right(orders, wanted) - 1
        return entries[at] if at >= 0 and orders[at] == wanted else None

    def fetch(self, entry: list) -> tuple[dict[str, str], bytes]:
        _, _, file, at, size = entry
        return parsed(self.archive(file).read_at(size, at))


def read_back(wanted: DataFrame, index: CaptureIndex) -> DataFrame:
    """One row per (key, page_id, file, at) of ``wanted``, from the record that the index finds: what its headers and payload say."""

    def home(key: Column, page_id: Column, file: Column, at: Column) -> Column:
        @F.pandas_udf("int")
        def place(keys, ids, files, places):
            import pandas as pd

            return pd.Series([index.file_of(k, None if pd.isna(i) else int(i), f, int(a)) for k, i, f, a in zip(keys, ids, files, places, strict=True)], dtype="int32")

        return place(key, page_id.cast("string"), file, at)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, page_id, file, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                headers, payload = index.fetch(index.entry(key, page_id, file, at))
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise OSError(f"the record of page {page_id} is damaged")
                refers = _capture(headers["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((page_id, int(headers["X-Payload-Length"]), digest, kind, refers))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = wanted.withColumn("_home", home(F.col("key"), F.col("page_id"), F.col("file"), F.col("at")))
    near = dealt.repartition(shuffle_parts(wanted), "_home").sortWithinPartitions("_home", "key", "page_id", "file", "at")
    return near.select("key", "page_id", "file", "at").mapInArrow(get, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, index them, and read each back through the index.

    A null html is an empty payload. Of equal payloads of 100 bytes or more, the smallest page_id is a response, the others revisit it;
    rows that repeat that page_id are responses too. An empty table gives no rows.
    """
    spark = pages.sparkSession
    base = new_path(spark, "warc")
    captures = write_archives(pages, f"{base}/archives")
    parts = write_index(captures, f"{base}/index")
    # One row per index file: as many as shuffle partitions.
    index = CaptureIndex([tuple(r) for r in parts.collect()], f"{base}/index", f"{base}/archives")
    return read_back(captures.select("key", "page_id", "file", "at"), index)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
