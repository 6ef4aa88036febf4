"""WARC archives with a two-level capture index.

``write_archives`` writes one record for each page, as a gzip member of its own, into archive files of the shared folder; a payload that
several pages have is stored once, by the page with the smallest id, and the others become revisit records that refer to it. Digests
are counted before the shuffle and only those that repeat are joined back, so a payload that a third of all pages share costs one row.

``write_index`` sorts the captures by URL key (the host's labels reversed, then path and query) over ranges of keys. Each range becomes
a shard file: compressed blocks of ``BLOCK_LINES`` lines, then a sparse directory with the first and last key and the place of each
block. A table with the keys at the ends of each shard, at most ``MAX_SHARDS`` rows, is the level above.

``find`` looks URLs up: a binary search among the shards, then, shard by shard, one among the directory's blocks, a range read of the
block and one within it. ``fetch`` reads the found records by offset and length, in the order of the files. A task holds a shard's
directory, one block and one record. A key with very many captures goes on over blocks and shards.

Files have names of their own for each attempt of a task, and only those that a finished attempt reports are read; so lost executors
cost no more than their tasks. Tasks reach the folder (``spark.checkpoint.dir``, or a given one) by pyarrow's file systems: local
and mounted folders, HDFS, S3, GCS.

Defined cases: a NULL html is an empty payload, a NULL url an empty one; pages without id go last when the smallest is looked for, and a
payload that only such pages have is a response in each; pages that repeat the smallest id are responses too; control characters and
blanks of a URL are percent-encoded in headers and keys; an empty table gives an empty archive; further columns do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch, small
from itemweave.llm.url_filter import host

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES, SHARD_LINES, MAX_SHARDS = 2_048, 1_000_000, 8_192
ROLL_BYTES, READ_BYTES = 1 << 30, 64 << 20
LEVEL = 3

_CAPTURES = "key string, url string, page_id long, type string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host's labels reversed, so that a domain's captures are neighbours."""
    shown = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rest = F.regexp_replace(F.regexp_replace(shown, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?#]*", ""), "#.*$", "")
    h = host(shown)
    return F.when(h == "", shown).otherwise(F.concat(F.array_join(F.reverse(F.split(h, r"\.")), ","), F.lit(")"), rest))


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if re.match(r"file:/*", folder):
        folder = re.sub(r"^file:/*", "/", folder)
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


@dataclass
class Archive:
    """An archive: the folder of its files, the captures in them, and the ends of the index's shards."""

    spark: SparkSession
    scratch: Scratch
    folder: str
    captures: DataFrame
    shards: DataFrame | None = None


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block keeps the HTTP header only."""
    def urn(i):
        return f"<urn:page:{'' if i is None else i}>"

    shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {shown}", f"WARC-Payload-Digest: sha1:{base32_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says of its page; the payload of a response is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    named = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if ": " in line)}
    block = rest[:int(named["content-length"])]
    if version != VERSION or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])

    def number(urn: str):
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    out = {"page_id": number(named["warc-record-id"]), "url": named.get("warc-target-uri", ""), "payload_bytes": size,
           "payload_digest": named["warc-payload-digest"].removeprefix("sha1:"), "record_type": named["warc-type"], "refers_to": None, "payload": payload}
    if out["record_type"] == "revisit":
        out |= {"refers_to": number(named["warc-refers-to"]), "payload": None}
    elif len(payload) != size or base32_digest(payload) != out["payload_digest"]:
        raise ValueError(f"the payload of page {out['page_id']} is not that of its digest")
    return out


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _write_records(folder: str, date: str, roll: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, key, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "key", "payload", "first")), strict=True):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    refers_to = first if first is not None and first != page_id else None
                    member = gzip.compress(record(page_id, url, payload, refers_to, date), LEVEL, mtime=0)
                    out.write(member)
                    rows.append({"key": key, "url": url, "page_id": page_id, "type": "response" if refers_to is None else "revisit",
                                 "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> Archive:
    """Write a record for each page. Payloads of fewer than ``least_bytes`` bytes are stored with every page."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    folder = folder or scratch.path("archives")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    digest, size = F.unhex(F.sha1("payload")), F.octet_length("payload")
    firsts = (rows.where(size >= least_bytes).groupBy(digest.alias("digest"), size.alias("size")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "size", "first"))
    firsts = small(scratch.save(firsts, "firsts"), 200_000)
    keyed = rows.join(firsts, (digest == F.col("digest")) & (size == F.col("size")), "left").select("page_id", "url", url_key(F.col("url")).alias("key"), "payload", "first")
    # Records need their payload in one piece; a batch of 64 pages bounds what a task holds.
    captures = scratch.save(keyed.mapInArrow(_write_records(folder, date, roll_bytes, _arrow(_CAPTURES)), _CAPTURES), "captures", batch=64)
    scratch.drop("firsts")
    return Archive(spark, scratch, folder, captures)


def _write_shard(folder: str, block_lines: int, schema: pa.Schema):
    """One shard file for each task: blocks, directory, and the directory's length in the last 8 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at, lines, keys, directory = None, f"{uuid.uuid4().hex}.idx", 0, [], [], []

        def block():
            nonlocal at, lines, keys
            data = gzip.compress("\n".join(lines).encode(), LEVEL, mtime=0)
            out.write(data)
            directory.append((keys[0], keys[-1], at, len(data)))
            at, lines, keys = at + len(data), [], []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                key = row.pop("key")
                lines.append(f"{key} {json.dumps(row)}")
                keys.append(key)
                if len(lines) == block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            data = gzip.compress("\n".join(f"{a} {b} {c} {d}" for a, b, c, d in directory).encode(), LEVEL, mtime=0)
            out.write(data + len(data).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first": directory[0][0], "last": directory[-1][1], "blocks": len(directory)}], schema)
    return run


def write_index(archive: Archive, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> Archive:
    """Write the capture index beside the archives."""
    parts = int(archive.spark.conf.get("spark.sql.shuffle.partitions"))
    count = archive.captures.count()
    shards = min(max(-(-count // shard_lines), min(parts, -(-count // block_lines)), 1), MAX_SHARDS)
    order = ["key", "page_id", "file", "offset"]
    laid = archive.captures.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    schema = "file string, first string, last string, blocks int"
    archive.shards = archive.scratch.save(laid.mapInArrow(_write_shard(archive.folder, block_lines, _arrow(schema)), schema), "shards")
    return archive


def _in_shards(ends: list[tuple[str, str, str]]):
    """The shards, by file, that may hold a key; ``ends`` are their first and last keys in order."""
    firsts, lasts = [e[0] for e in ends], [e[1] for e in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(ends[i][2], key) for key in batch.column("key").to_pylist() for i in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["file", "key"])
    return run


class _Shard:
    """Searches one shard file: its directory is read once, the block last used is kept."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        rows = [line.split(" ") for line in gzip.decompress(self.file.read_at(n, size - 8 - n)).decode().split("\n")]
        self.firsts, self.lasts = [r[0] for r in rows], [r[1] for r in rows]
        self.places = [(int(r[2]), int(r[3])) for r in rows]
        self.block, self.keys, self.lines = -1, [], []

    def find(self, key: str) -> Iterator[dict]:
        for k in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            if k != self.block:
                at, n = self.places[k]
                self.lines = gzip.decompress(self.file.read_at(n, at)).decode().split("\n")
                self.keys = [line.split(" ", 1)[0] for line in self.lines]
                self.block = k
            for i in range(bisect_left(self.keys, key), bisect_right(self.keys, key)):
                yield {"key": key} | json.loads(self.lines[i].split(" ", 1)[1])


def _search(folder: str, schema: pa.Schema, rows: int = 1_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, shard, out = None, None, []
        for batch in batches:
            for file, key in zip(batch.column("file").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if file != name:
                    name, shard = file, _Shard(store, f"{base}/{file}")
                for hit in shard.find(key):
                    out.append(hit)
                    if len(out) == rows:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        yield pa.RecordBatch.from_pylist(out, schema)
    return run


def find(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures of the given URLs, each once: key, url, page_id, type, file, offset, length."""
    ends = sorted((r["first"], r["last"], r["file"]) for r in archive.shards.limit(MAX_SHARDS + 1).collect())
    keys = urls.select(url_key(F.col(url)).alias("key")).distinct()
    parts = int(archive.spark.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.mapInArrow(_in_shards(ends), "file string, key string").repartition(parts, "file").sortWithinPartitions("file", "key")
    return asked.mapInArrow(_search(archive.folder, _arrow(_CAPTURES)), _CAPTURES)


def _read(folder: str, payloads: bool, schema: pa.Schema, batch_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, file, out, held = None, None, [], 0
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if path != name:
                    name, file = path, store.open_input_file(f"{base}/{path}")
                row = parsed(gzip.decompress(file.read_at(length, offset)))
                if not payloads:
                    del row["payload"]
                out.append(row)
                held += 200 + row["payload_bytes"] * payloads
                if held >= batch_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)
    return run


def fetch(archive: Archive, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of captures: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload (NULL for revisits)]."""
    parts = int(archive.spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    laid = captures.select("file", "offset", "length").repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return laid.mapInArrow(_read(archive.folder, payloads, _arrow(schema)), schema)
