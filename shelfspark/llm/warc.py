"""WARC archives and a two-level capture index.

``write_archives`` stores each page as one WARC record, one gzip member a record.  Of records with
equal payloads the one with the smallest page id is a response, the others revisit it.
``read_archives`` reads archives back record by record and checks each stored payload against its
digest.  ``build_index`` sorts captures by reversed-host URL key into compressed blocks and keeps
a sparse directory with the first and last key of each block.  ``look_up`` finds the blocks of a
set of URLs by binary search, first among at most ``FENCES`` fences, then inside one directory
segment, and opens only those blocks; ``fetch`` then cuts the byte ranges of the hits out of
their archives.

Null html: an empty payload.  Null url: no target URI, the empty key.  Null page ids: such a row is
a response only when no row with an id has its payload, else it revisits.  Repeated rows of the
smallest id are all responses.  An empty table writes no record and gives an empty index.  Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_rows, new_path, written

#: Aimed bytes of payload in one archive; the archive is the unit that a task holds in memory.
ARCHIVE_BYTES = 16 << 20
#: Captures in one compressed index block.
BLOCK_ROWS = 2000
#: Entries of the broadcast top of the directory.
FENCES = 2048
#: A payload shared by more than this share of all rows is joined by broadcast: at most 1 / HOT of them exist.
HOT = 1e-3

#: Fixed values of the format: an empty gzip member (it ends each record's member) and the date of every record.
GZIP_EMPTY = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
CAPTURE = RECORD + ", url_key string, archive string, start long, length long"


def url_key(url: Column) -> Column:
    """Reversed-host sort key: ``http://b.Example.com:80/p?q#f`` becomes ``com,example,b:80)/p?q``; empty for null."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", ""), "^(?i)[a-z][a-z0-9+.-]*://", "")
    for blank, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):  # as in the archive
        rest = F.replace(rest, F.lit(blank), F.lit(code))
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    name, port = F.regexp_extract(host, r"^[^:]*", 0), F.regexp_extract(host, r":.*$", 0)
    path = F.regexp_extract(rest, r"^[^/?]*((?s).*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(key)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _with_digest(pages: DataFrame) -> DataFrame:
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return pages.withColumn("_size", F.octet_length(body).cast("long")).withColumn("_sha", F.unhex(F.sha1(body)))


def first_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Payloads of at least ``least`` bytes that occur more than once: their digest, smallest page id and number."""
    groups = _with_digest(pages).where(F.col("_size") >= least).groupBy("_sha")
    return groups.agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")


def _record(page_id: int | None, url: str | None, html: str | None, size: int, sha: bytes, refers_to: int | None) -> bytes:
    payload = b"" if refers_to is not None else (html or "").encode("utf-8", "surrogatepass")
    kind = "response" if refers_to is None else "revisit"
    target = [] if url is None else ["WARC-Target-URI: " + re.sub(r"[\t\n\r ]", lambda m: f"%{ord(m[0]):02X}", url)]
    refers = [] if refers_to is None else [
        f"WARC-Refers-To: <urn:page:{refers_to}>",
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *target, f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", f"WARC-Payload-Length: {size}", *refers,
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", "",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + http + payload + CRLF + CRLF) + pack.flush()


def _records(rows: Iterator[tuple]) -> Iterator[tuple]:
    for row in rows:
        yield (_record(*row),)


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a ``warc.gz`` text of records to ``path`` on any file system that Spark writes; returns ``path``.

    Pages move once, spread evenly over archives.  A record is one gzip member; the writer's separator is an
    empty member, so each file is one valid chain of members.
    """
    pages = pages.select("page_id", "url", "html")
    firsts = written(first_pages(pages, least), "warc-firsts")
    total, bytes_ = _with_digest(pages).agg(F.count("*"), F.sum("_size")).first()
    most = max(2, math.ceil(total * HOT))
    hot = firsts.where(F.col("_n") > most).select("_sha", F.col("_first").alias("_hot"))  # at most 1 / HOT rows
    n = max(1, math.ceil((bytes_ or 0) / archive_bytes), pages.sparkSession.sparkContext.defaultParallelism)
    spread = F.xxhash64("page_id", "url")
    rows = _with_digest(pages).join(F.broadcast(hot), "_sha", "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.xxhash64("_sha")).otherwise(spread)).repartition(n, "_key")
    cold = firsts.where(F.col("_n") <= most).select(F.xxhash64("_sha").alias("_key"), F.col("_sha").alias("_cold"), "_first")
    typed = rows.join(cold.repartition(n, "_key"), (rows["_key"] == cold["_key"]) & (F.col("_sha") == F.col("_cold")), "left")
    first = F.coalesce("_hot", "_first")
    revisit = first.isNotNull() & ((F.col("page_id") != first) | F.col("page_id").isNull())
    records = map_rows(typed.select("page_id", "url", "html", "_size", "_sha", F.when(revisit, first)), _records, "record binary",
                       lambda r: len(r[0]))
    records.select(F.col("record").cast("string")).write.option("lineSep", GZIP_EMPTY.decode("latin-1")).option(
        "encoding", "ISO-8859-1").text(path)
    return path


def _members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, data) of each non-empty gzip member."""
    at, view = 0, memoryview(content)
    while at < len(content):
        pack = zlib.decompressobj(31)
        data, step = [], at
        while not pack.eof:  # in pieces: the rest of the archive is never copied
            if step >= len(content):
                raise ValueError(f"archive ends inside the member at {at}")
            data.append(pack.decompress(view[step : step + (64 << 10)]))
            step += 64 << 10
        end = min(step, len(content)) - len(pack.unused_data)
        if any(data):
            yield at, end - at, b"".join(data)
        at = end


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(found["content-length"])]
    return found | {"payload": block.partition(CRLF + CRLF)[2]}


def _page(name: str) -> int | None:
    value = name[len("<urn:page:") : -1]
    return int(value) if value else None


def _captures(rows: Iterator[tuple]) -> Iterator[tuple]:
    for archive, content in rows:
        for start, length, data in _members(content):
            r = parse_record(data)
            sha, size, kind = r["warc-payload-digest"].removeprefix("sha1:"), int(r["warc-payload-length"]), r["warc-type"]
            if kind == "response" and (digest(r["payload"]) != sha or len(r["payload"]) != size):
                raise ValueError(f"{archive}: payload at {start} does not match its digest")
            refers = _page(r["warc-refers-to"]) if "warc-refers-to" in r else None
            yield _page(r["warc-record-id"]), r.get("warc-target-uri"), size, sha, kind, refers, archive, start, length


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: ``RECORD`` columns, url_key, and where the record lies."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = map_rows(files, _captures, RECORD + ", archive string, start long, length long")
    return found.select("*", url_key(F.col("url")).alias("url_key")).select(*[c.split()[0] for c in CAPTURE.split(", ")])


# --- index -------------------------------------------------------------------------------------------

FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]


def _pack(rows: list[tuple]) -> bytes:
    return zlib.compress("\n".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in rows).encode("utf-8", "surrogatepass"), 6)


def unpack(block: bytes) -> list[tuple]:
    return [tuple(json.loads(x)) for x in zlib.decompress(block).decode("utf-8", "surrogatepass").split("\n")]


def _sorted_key(key: str) -> bytes:
    return key.encode("utf-8", "surrogatepass")


def _blocks(block_rows: int):
    key = FIELDS.index("url_key")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part in batches_by_bytes(rows, lambda r: 1, block_rows):
            yield part[0][key], part[-1][key], len(part), _pack(part)

    return run


def build_index(captures: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> str:
    """Write ``path/blocks`` (compressed, range-sorted by key) and ``path/directory`` (their keys); returns ``path``.

    Ranges are cut on (key, page id, place), so one key with very many captures spreads over many blocks.
    """
    order = ["url_key", "page_id", "archive", "start"]
    ranged = captures.select(*FIELDS).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = map_rows(ranged, _blocks(block_rows), "first_key string, last_key string, n long, block binary", lambda r: len(r[3]))
    blocks.select(F.monotonically_increasing_id().alias("block_id"), "*").write.parquet(f"{path}/blocks")
    spark = captures.sparkSession
    directory = spark.read.parquet(f"{path}/blocks").select("block_id", "first_key", "last_key")
    n = directory.count()
    size = max(1, math.ceil(n / FENCES))
    ordered = directory.orderBy("first_key", "block_id").select("*", F.monotonically_increasing_id().alias("_at"))
    ordered.select("*", F.floor(F.col("_at") / size).alias("segment")).drop("_at").write.parquet(f"{path}/directory")
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures, from the compressed blocks."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (block,) in rows:
            yield from unpack(block)

    return map_rows(spark.read.parquet(f"{path}/blocks").select("block"), run, CAPTURE)


def look_up(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """Captures of the URLs in column ``url``: fences, directory segment, block, each by binary search.

    The fences are the first keys of at most ``FENCES`` segments plus those of the file's partitions; only the blocks that may hold a
    wanted key are decompressed.
    """
    directory = spark.read.parquet(f"{path}/directory")
    tops = directory.groupBy("segment").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    fences = sorted(((r["low"], r["high"], r["segment"]) for r in tops.collect()), key=lambda x: (_sorted_key(x[0]), _sorted_key(x[1])))
    lows, highs = [_sorted_key(x[0]) for x in fences], [_sorted_key(x[1]) for x in fences]

    def segments(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (key,) in rows:
            k = _sorted_key(key)
            for i in range(bisect_left(highs, k), bisect_right(lows, k)):
                yield key, fences[i][2]

    wanted = map_rows(urls.select(url_key(F.col("url")).alias("want")).distinct(), segments, "want string, segment long")
    hits = wanted.join(directory, "segment").where("first_key <= want AND want <= last_key").groupBy("block_id").agg(
        F.sort_array(F.collect_set("want")).alias("wants"))
    at = FIELDS.index("url_key")

    def opened(rows: Iterator[tuple]) -> Iterator[tuple]:
        for wants, block in rows:
            held = unpack(block)
            keys = [_sorted_key(r[at]) for r in held]
            for w in map(_sorted_key, wants):
                yield from held[bisect_left(keys, w) : bisect_right(keys, w)]

    return map_rows(spark.read.parquet(f"{path}/blocks").join(hits, "block_id").select("wants", "block"), opened, CAPTURE)


def fetch(spark: SparkSession, captures: DataFrame, path: str) -> DataFrame:
    """Captures with ``payload``, cut from the byte ranges of their archives (null for revisits)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
    cut = captures.join(files, "archive").select(
        *[c for c in FIELDS], F.expr("substring(content, cast(start + 1 as int), cast(length as int))").alias("_member"))

    def payloads(rows: Iterator[tuple]) -> Iterator[tuple]:
        kind = FIELDS.index("record_type")
        for *row, member in rows:
            yield *row, None if row[kind] == "revisit" else parse_record(zlib.decompress(member, 31))["payload"]

    return map_rows(cut, payloads, CAPTURE + ", payload binary", lambda r: 200 + len(r[-1] or b""))


def archive_and_index(pages: DataFrame, least: int = 0) -> tuple[str, str]:
    """Write archives and the index of what they hold into the shared folder; returns both paths."""
    spark = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"), least)
    return archives, build_index(read_archives(spark, archives), new_path(spark, "captures"))
