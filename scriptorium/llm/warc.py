"""WARC archives: a deduplicating writer and a splittable reader.

``write_archives`` writes each page as a gzip member of its own. Among pages of equal payload
the one with the largest id is a ``response``; the others are ``revisit`` records that refer to
it and hold no payload. ``read_archives`` cuts the files into byte ranges. The task of a range
looks for gzip magic in it, and takes a place for a member only if its first bytes inflate to a
WARC header and the member ends where another begins, or with the file. It owns the records
that start inside its range, and reads on past the end for the last of them.

Defined results: a null payload is empty; a null url is left out and read back as null; a null
id is kept, and never chosen as the one that others revisit; repeated rows with the id that others
revisit are responses too; an empty table gives no files and an empty table back; other columns are not written.
Payloads of any length are held whole by the task that writes or reads them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.lookup import Lookup, write_lookup
from scriptorium.llm.shared import drop_folder, drop_table, filesystem, lean, new_folder, put_file, stored, table

RANGE_BYTES = 8 << 20
MIN_REVISIT_BYTES = 0
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_URL_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def find_owners(pages: DataFrame, key: str, payload: str, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[tuple[str, int], tuple[str, int]]:
    """Two tables of the largest id of each payload that several pages have, by either of two hashes of its digest.

    Only digests and ids are shuffled, and counted by task before. An owner that both tables name is that of the digest.
    """
    marked = pages.where(F.octet_length(payload) >= min_bytes).select(key, F.sha1(payload).alias("digest"))
    owners = marked.groupBy("digest").agg(F.max(key).alias("value"), F.count("*").alias("copies")).where("copies > 1 and value is not null")
    found = stored(owners.select("digest", "value"), "owners")
    places = tuple(write_lookup(found.select(F.xxhash64("digest", F.lit(k)).alias("key"), "value"), "owners") for k in (0, 1))
    drop_table(found)
    return places


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None) -> bytes:
    revisit = owner is not None and owner != page_id
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: " + DATE]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=_URL_SAFE))
    head += ["Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if revisit:
        head += ["WARC-Profile: " + PROFILE, f"WARC-Refers-To: <urn:page:{owner}>"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    return VERSION + "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "payload", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the pages into ``folder``, a file for each task that has any; returns (file, bytes, records)."""
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[payload], F.lit(b"")).alias("payload"))
    places = find_owners(rows, "page_id", "payload", min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def members() -> Iterator[bytes]:
            nonlocal count
            lean()
            tables = [Lookup(p) for p in places]
            for batch in batches:
                owners: list[set[int | None]] = [{None} for _ in range(batch.num_rows)]
                named = [set(zip(*(x.tolist() for x in t.find(batch.column(4 + k).to_numpy())))) for k, t in enumerate(tables)]
                for i, owner in named[0] & named[1]:
                    owners[i] = {owner}
                for values, (owner,) in zip(zip(*(batch.column(k) for k in range(4))), owners):
                    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                    page_id, address, body, digest = (v.as_py() for v in values)
                    own = owner if len(body) >= min_bytes else None
                    yield gzip.compress(_record(page_id, address, body, digest, own)) + gzip.flush()
                    count += 1

        found = members()
        first = next(found, None)
        if first is None:
            return

        def pieces() -> Iterator[bytes]:
            yield first
            yield from found

        size = put_file(place, pieces())
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["file", "bytes", "records"])

    marked = rows.withColumn("digest", F.sha1("payload"))
    hashed = marked.select("page_id", "url", "payload", "digest", *[F.xxhash64("digest", F.lit(k)).alias(f"hash{k}") for k in (0, 1)])
    files = stored(hashed.mapInArrow(write, "file string, bytes long, records long"), "files")
    for place, _ in places:
        drop_folder(place)
    return files


# --- reading ----------------------------------------------------------------------------


class _Window:
    """Bytes of a file by place, read in pieces of a megabyte; what lies before ``drop`` is let go."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.base, self.data = source, size, at, bytearray()

    def reach(self, upto: int) -> None:
        upto = min(upto, self.size)
        while self.base + len(self.data) < upto:
            self.source.seek(self.base + len(self.data))
            piece = self.source.read(min(1 << 20, self.size - self.base - len(self.data)))
            if not piece:
                break
            self.data += piece

    def drop(self, before: int) -> None:
        del self.data[: before - self.base]
        self.base = before

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place of ``what`` from ``at`` on that is before ``end``, or -1."""
        self.reach(end + len(what) - 1)
        found = self.data.find(what, at - self.base, end + len(what) - 1 - self.base)
        return found + self.base if found >= 0 else -1


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated member that starts at ``at`` and its end; None if no WARC member starts there."""
    inflate, out, place = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            window.reach(place + (1 << 16))
            piece = window.data[place - window.base : place - window.base + (1 << 16)]
            if not piece:
                return None
            out.append(inflate.decompress(piece))
            place += len(piece)
            if out and not (b"".join(out[:2]) + VERSION)[:5] == VERSION[:5]:
                return None
    except zlib.error:
        return None
    end = place - len(inflate.unused_data)
    window.reach(end + 3)
    after = window.data[end - window.base : end - window.base + 3]
    if after and after != MAGIC[: len(after)]:
        return None
    return b"".join(out), end


def parse_record(record: bytes) -> tuple:
    """The fields of :data:`RECORDS` from an inflated record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(x) if (x := fields[name][len("<urn:page:") : -1]) else None
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    url = unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    if kind == "revisit":
        size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
        return number("WARC-Record-ID"), url, size, stated, kind, number("WARC-Refers-To"), None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has digest {digest}, its record states {stated}")
    return number("WARC-Record-ID"), url, len(payload), digest, kind, None, payload


def records_of_range(uri: str, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end)."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as source:
        window, at = _Window(source, size, start), start
        while at < end:
            window.drop(at)
            at = window.find(MAGIC, at, end)
            if at < 0:
                return
            found = _member(window, at)
            if found is None:
                at += 1
            else:
                yield found[0]
                at = found[1]


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives listed in ``files`` (file, bytes), as :data:`RECORDS`; without ``payloads`` that column is null."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("file", "bytes", starts.alias("start"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                rows, held = [], 0
                for record in records_of_range(one["file"], one["bytes"], one["start"], min(one["bytes"], one["start"] + range_bytes)):
                    row = parse_record(record)
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(row[-1] or b"") if payloads else 64
                    if held > 1 << 22:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    # a partition for about each range: the reading is dealt out anew, whoever wrote the file, and a given number isn't coalesced
    many = ranges.count()
    return ranges.repartition(max(1, many), "file", "start").mapInArrow(read, RECORDS)


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every row of ``pages`` into archives and describes the records read back from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    files = write_archives(pages, new_folder(spark, "warc"))
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h,
         max(page_id) OVER (PARTITION BY sha1(body)) AS owner
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(h || '00', ((i * 5) // 4 + 1)::INT, 3))::INT) >> ((7 - (i * 5) % 4)::INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner = page_id THEN NULL ELSE owner END AS refers_to
FROM d
"""
