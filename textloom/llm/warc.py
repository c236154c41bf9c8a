"""Operator 9: web archives (WARC 1.1) with a two-level capture index.

``write`` sorts the captures by reversed-host URL key, and each task writes its range: gzip members into archive files and, in the
same order, index lines into compressed blocks of ``BLOCK_LINES`` captures. It returns the sparse directory, one row for each
block with its first key and place. ``fetch`` answers a table of keys: a binary search in the first keys of the ranges
says to which task a key goes, there the directory gives the blocks that may hold it (several, where its captures cross their borders), a search inside each the captures, and only
then their bytes are read, as ranges of the archive files.

Equal payloads of at least ``least`` bytes are stored once, with the smallest page_id; other captures become revisit records,
which carry the HTTP headers (with the payload's length), the digest and the id of the first.

Files are written and read through pyarrow's file systems, in the shared folder. A file's name is used by one attempt of one task, so
what a lost executor has begun is never read.

Edge cases: null html is an empty payload; a null URL has an empty key and no target header; rows without a page_id are always
responses and aren't referred to; repeated rows are captures of their own, and those with the smallest id are all responses; an empty
table gives an empty directory.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, lean, parts, shared_path, stored
from textloom.llm.token_counts import slices

BLOCK_LINES = 256
LEAST_BYTES = 100
ROWS_EACH = 200_000
MOST_RANGES = 20_000
FILE_BYTES = 256 << 20
LEVEL = 4
GAP = 1 << 16
SLICE_BYTES = 1 << 20
MOST_READ = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

DIRECTORY = "range int, block int, first_key binary, last_key binary, captures int, index_file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: http://b.a.org:80/X?q is org,a,b)/X?q."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def capture_key(url: Column, page_id: Column) -> Column:
    """The key with the page_id in digits of a fixed width, as bytes; a space sorts before all that a URL can hold."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(F.regexp_replace(url_key(url), r"[\x00-\x20]", "%20"), F.lit(" "), F.coalesce(number, F.lit("~"))).cast("binary")


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_digest, refers_to of the captures whose payload another one stores."""
    facts = pages.select("page_id", F.sha2(payload(), 256).alias("payload_digest"), F.octet_length(payload()).alias("n")).where("page_id is not null").where(F.col("n") >= least)
    firsts = facts.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    return facts.join(firsts, "payload_digest").where("page_id != refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def write(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES, rows_each: int = ROWS_EACH) -> DataFrame:
    """Writes the archives and their index to the shared folder; returns the directory. A range has about ``rows_each`` captures, an archive file ``file_bytes``
    (and its last record), an index block ``block_lines`` captures."""
    spark = pages.sparkSession
    bounded_batches(spark)
    own = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    again = stored(revisits(own, least), "revisits")
    rows = own.withColumn("payload_digest", F.sha2(payload(), 256)).join(again, ["page_id", "payload_digest"], "left")
    ranges = min(MOST_RANGES, parts(pages.count(), rows_each, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = (
        rows.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), "page_id", "url", "payload_digest", "refers_to", payload().cast("binary").alias("payload"))
        .repartitionByRange(ranges, "key").sortWithinPartitions("key")
    )
    folder = shared_path(spark, "warc")
    return stored(rows.mapInArrow(lambda batches: written(batches, folder, file_bytes, block_lines), DIRECTORY), "directory")


def opened(uri: str):
    """The file system of a folder or file, and its path there. What Hadoop names s3a or s3n is s3 here."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


@lean
def written(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, block_lines: int) -> Iterator[pa.RecordBatch]:
    """Writes one range."""
    from pyspark import TaskContext

    fs, path = opened(folder)
    own, name, files = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
    archive = index = None
    at = index_at = 0
    block: list[tuple[bytes, bytes]] = []
    out: list[tuple] = []

    def flush() -> None:
        nonlocal index_at, block
        data = zlib.compress(b"\n".join(k + b"\t" + v for k, v in block), 6)
        index.write(data)
        out.append((own, len(out), block[0][0], block[-1][0], len(block), f"{folder}/{name}.cdx", index_at, len(data)))
        index_at, block = index_at + len(data), []

    for b in (b.slice(at, to - at) for b in batches for at, to in slices(pc.binary_length(b["payload"]).to_numpy(zero_copy_only=False), SLICE_BYTES)):
        columns = [b[c].to_pylist() for c in ("key", "page_id", "url", "payload_digest", "refers_to", "payload")]
        for key, page, url, digest, first, body in zip(*columns, strict=True):
            if archive is None or at > file_bytes:
                if archive is None:
                    fs.create_dir(path, recursive=True)
                    index = fs.open_output_stream(f"{path}/{name}.cdx", compression=None)
                else:
                    archive.close()
                file, at, files = f"{name}-{files:05d}.warc.gz", 0, files + 1
                archive = fs.open_output_stream(f"{path}/{file}", compression=None)
            data = member(record(page, url, digest, first, body))
            archive.write(data)
            block.append((key, f"{file} {at} {len(data)}".encode()))
            at += len(data)
            if len(block) == block_lines:
                flush()
    if block:
        flush()
    if archive is not None:
        archive.close()
        index.close()
    columns = zip(*out, strict=True) if out else [[]] * 8
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in DIRECTORY.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def member(data: bytes) -> bytes:
    own = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return own.compress(data) + own.flush()


def record_id(page: int | None) -> str:
    return f"<urn:textloom:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page: int | None, url: str | None, digest: str, first: int | None, body: bytes) -> bytes:
    """A response record, or a revisit record if there is a first."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if first is None else http
    target = "" if url is None else "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) + "\r\n"
    more = "" if first is None else f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {record_id(first)}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if first is None else 'revisit'}\r\nWARC-Record-ID: {record_id(page)}\r\nWARC-Date: {DATE}\r\n"
        f"{target}WARC-Payload-Digest: sha256:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The named fields from ``at`` on, after the first line, and where what follows them begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:textloom:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parsed(data: bytes, with_payload: bool) -> tuple:
    """The row of one record. A response is held against its digest."""
    head, at = headers(data, 0)
    if not data.startswith(b"WARC/1.1\r\n") or data[at + int(head["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, body = headers(data, at)
    own = data[body : at + int(head["content-length"])]
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "response" and (hashlib.sha256(own).hexdigest() != digest or len(own) != int(http["content-length"])):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return page_of(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], page_of(head.get("warc-refers-to")), int(http["content-length"]), digest, own if with_payload else None


def fetch(directory: DataFrame, keys: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records with the capture keys in the column ``key``, each once: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, and payload (null for a revisit, and null without ``with_payload``)."""
    tops = sorted((bytes(r.first_key), r.range) for r in directory.where("block = 0").select("first_key", "range").collect())  # one row a range
    first_keys, ranges = [k for k, _ in tops], [r for _, r in tops]
    if not tops:
        return keys.sparkSession.createDataFrame([], RECORD)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ranges[max(0, bisect_right(first_keys, k) - 1)] for k in b["key"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), b["key"]], ["range", "key"])

    wanted = keys.select("key").distinct().mapInArrow(routed, "range int, key binary").withColumns({c: F.lit(None).cast(t) for c, t in (("last_key", "binary"), ("index_file", "string"), ("offset", "long"), ("length", "long"))})
    known = directory.select("range", F.col("first_key").alias("key"), "last_key", "index_file", "offset", "length")
    both = known.unionByName(wanted).repartitionById(max(ranges) + 1, F.col("range")).sortWithinPartitions("range", "key", F.col("index_file").isNull())
    return both.mapInArrow(lambda batches: fetched(batches, with_payload), RECORD)


@lean
def fetched(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Goes through blocks and keys in order."""
    places: list[tuple] = []  # blocks that may hold the next keys, in order
    wanted: list[bytes] = []

    def answers() -> Iterator[tuple]:
        for first, last, *place in places:
            own = wanted[bisect_left(wanted, first) : bisect_right(wanted, last)]
            if own:
                yield from found(own, *place)

    def found(keys: list[bytes], file: str, offset: int, length: int) -> Iterator[tuple]:
        fs, path = opened(file)
        lines = [x.rpartition(b"\t") for x in zlib.decompress(ranged(fs, path, offset, length)).split(b"\n")]
        own = [k for k, _, _ in lines]
        spans = []
        for k in keys:
            for i in range(bisect_left(own, k), bisect_right(own, k)):
                name, at, n = lines[i][2].decode().rsplit(" ", 2)
                spans.append((name, int(at), int(n)))
        for name, near in joined(spans):
            start = near[0][0]
            data = ranged(fs, f"{path.rpartition('/')[0]}/{name}", start, near[-1][0] + near[-1][1] - start)
            for at, n in near:
                yield parsed(zlib.decompress(data[at - start : at - start + n], 31), with_payload)

    def rows() -> Iterator[tuple]:
        nonlocal places
        for b in batches:
            for key, last, file, offset, length in zip(*(b[c].to_pylist() for c in ("key", "last_key", "index_file", "offset", "length")), strict=True):
                if file is not None:
                    if wanted:
                        yield from answers()
                        wanted.clear()
                    if places and places[0][1] < key:
                        places = [p for p in places if p[1] >= key]
                    places.append((key, last, file, offset, length))
                else:
                    wanted.append(key)
                    if len(wanted) >= 4 * BLOCK_LINES:
                        yield from answers()
                        wanted.clear()
        yield from answers()

    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    held: list[tuple] = []
    n = 0
    for r in rows():
        held.append(r)
        n += 200 + len(r[-1] or b"")
        if n > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def ranged(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def joined(spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Ranges of a file that lie close together, to be read at once."""
    held: list[tuple[int, int]] = []
    name = None
    for file, at, n in spans:
        if held and (file != name or not 0 <= at - (held[-1][0] + held[-1][1]) <= GAP or at - held[0][0] > MOST_READ):
            yield name, held
            held = []
        name = file
        held.append((at, n))
    if held:
        yield name, held
