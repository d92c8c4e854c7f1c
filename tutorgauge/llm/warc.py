"""WARC archives of pages, read back through a two-level capture index."""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgauge.operators.joins import settled
from tutorgauge.session import new_folder

MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 4 << 20  # of compressed records in a row, and CHUNKS_PER_FILE of them in a file
CHUNKS_PER_FILE = 8
LINES_PER_BLOCK = 3000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An empty gzip member: what the text sink writes between rows is then part of a valid gzip file.
SEPARATOR = bytes.fromhex("1f8b08000000000000030300000000000000 0000".replace(" ", ""))
CAPTURE = "page_id {id}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id}, file string, offset long, length long"


def surt(url: str | Column) -> Column:
    """Sort key of a URL: host labels reversed and in lower case, then path and query; no scheme, user, default port or fragment."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(?:80|443)(?![0-9]))?(:[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(u, pattern, 1))
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    rest = F.regexp_extract(u, pattern, 3)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.rlike(u, F.lit(pattern)), F.concat(reversed_host, F.regexp_extract(u, pattern, 2), F.lit(")"), path)).otherwise(u)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _header_value(text: str) -> str:
    """White space and control characters, which would end a header line, percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names the response with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda page: f"<urn:uuid:{hashlib.md5(f'page {page}'.encode()).hexdigest()}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page: {refers_to}"]
    lines += [f"Payload-Length: {len(payload)}", *([] if page_id is None else [f"Page: {page_id}"])]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record per row as gzip members into files of the folder, through Spark's own sink, so any store will do.

    Of rows with equal payloads of at least ``min_bytes`` the one with the least id is the response and the others revisit it;
    smaller payloads are all responses. A null html is an empty payload. Rows that repeat the least id are all
    responses; a null id names no response: a group of such rows alone are all responses.
    """
    data = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), data.alias("data")).withColumn("digest", F.sha2("data", 256))
    long_enough = rows.filter(F.octet_length("data") >= min_bytes)
    twice = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    # settled, so that the join has two plain sides and a payload that a third of the pages share is split
    known = settled(twice.select(F.col("digest").alias("again"), "first"))
    joined = rows.join(known, rows.digest == known.again, "left")
    ids = lambda c: F.col(c).cast("string")
    named = joined.select(ids("page_id").alias("page_id"), "url", "data", "digest", ids("first").alias("first"))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for page_id, address, data, digest, first in batch.itertuples(index=False):
                held.append(_gzip(record(page_id, address, data, digest, first, first is not None and first != page_id)))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pd.DataFrame({"chunk": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"chunk": [b"".join(held)]})

    out = named.mapInPandas(chunks, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    sink = out.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", CHUNKS_PER_FILE)
    sink.text(folder)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of every gzip member that holds something."""
    at, view = 0, memoryview(data)
    while at < len(data):
        opener, fed, parts = zlib.decompressobj(31), at, []
        while not opener.eof:
            if fed >= len(data):
                raise ValueError("archive ends within a record")
            parts.append(opener.decompress(view[fed : fed + 65536]))
            fed = min(fed + 65536, len(data))
        end = fed - len(opener.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record (names in lower case) and its payload; a length or digest that does not fit is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if rest[len(block) :] != b"\r\n\r\n" or headers["warc-type"] == "response" and (
        len(payload) != int(headers["payload-length"]) or f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["warc-payload-digest"]
    ):
        raise ValueError(f"broken record {headers['warc-record-id']}")
    return headers, payload


def read_archives(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """A row per record: page, URL, type, size and digest of the full payload, referred page, and file, offset and length.

    Payloads of responses are read and checked against their digests.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "length"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in batch.itertuples(index=False):
                rows = []
                for offset, length, content in members(data):
                    h, _ = parsed(content)
                    rows.append((h.get("page"), h.get("warc-target-uri"), h["warc-type"], int(h["payload-length"]), h["warc-payload-digest"][7:], h.get("refers-to-page"), path, offset, length))
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    out = files.mapInPandas(scan, CAPTURE.format(id="string"))
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def write_index(captures: DataFrame, folder: str, lines: int = LINES_PER_BLOCK) -> None:
    """Captures in order of (URL key, page) as compressed blocks of ``lines`` lines, and a directory with a row per block.

    Range-partitioned by key and page, so a URL that very many pages share spreads over tasks.
    """
    keyed = settled(captures.select(surt("url").alias("key"), F.col("page_id"), F.to_json(F.struct(*captures.columns)).alias("line")))
    ordered = keyed.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "line")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, number, offset = TaskContext.get().partitionId(), [], 0, 0

        def closed() -> pd.DataFrame:
            nonlocal held, number, offset
            data = _gzip("".join(f"{json.dumps(k)} {line}\n" for k, line in held).encode())
            out = pd.DataFrame({"part": [part], "block": [number], "first_key": [held[0][0]], "last_key": [held[-1][0]], "lines": [len(held)], "offset": [offset], "length": [len(data)], "data": [data]})
            held, number, offset = [], number + 1, offset + len(data) + len(SEPARATOR)
            return out

        for batch in batches:
            for key, line in zip(batch["key"], batch["line"]):
                held.append((key, line))
                if len(held) == lines:
                    yield closed()
        if held:
            yield closed()

    made = settled(ordered.select("key", "line").mapInPandas(blocks, "part int, block int, first_key string, last_key string, lines int, offset long, length long, data binary"))
    one_file = made.repartition("part").sortWithinPartitions("part", "block").select("part", F.col("data").cast("string").alias("value"))
    one_file.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").partitionBy("part").text(f"{folder}/blocks")
    made.drop("data").orderBy("part", "block").write.parquet(f"{folder}/directory")


def _block_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/blocks")
    return files.withColumn("part", F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int"))


def _lines(data: bytes) -> list[tuple[str, dict]]:
    out = []
    for line in zlib.decompress(data, 31).decode().splitlines():
        key, end = json.JSONDecoder().raw_decode(line)
        out.append((key, json.loads(line[end + 1 :])))
    return out


def read_index(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """Every capture of the index: the directory says which ranges of the block files to read."""
    ranges = spark.read.parquet(f"{folder}/directory").groupBy("part").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    met = _block_files(spark, folder).select("part", "content").join(ranges, "part").select("content", "ranges.offset", "ranges.length")
    schema = CAPTURE.format(id=id_type)
    names = [c.split()[0] for c in schema.split(", ")]

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, offsets, lengths in batch.itertuples(index=False):
                for offset, length in zip(offsets, lengths):
                    found = [[c.get(n) for n in names] for _, c in _lines(content[offset : offset + length])]
                    frame = pd.DataFrame(found, columns=names, dtype=object)
                    yield frame.astype({n: "Int64" for n in names if schema.split(f"{n} ")[1].startswith("long")})

    return met.mapInPandas(captures, schema)


def _range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def lookup(spark: SparkSession, folder: str, url: str) -> list[dict]:
    """Captures of one URL: binary search over the parts, then over the directory rows of the parts that can hold
    it, then over the lines of those blocks, which alone are read. The driver holds the part list and one part's directory."""
    key = spark.range(1).select(surt(F.lit(url)).alias("k")).first().k
    directory = spark.read.parquet(f"{folder}/directory")
    parts = directory.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last").collect()
    until = bisect_right([p.first for p in parts], key)
    files = {r.part: r.path for r in _block_files(spark, folder).select("part", "path").collect()} if until else {}
    found = []
    for part in (p for p in parts[:until] if p.last >= key):
        rows = directory.filter(F.col("part") == part.part).orderBy("block").collect()
        for block in reversed(rows[: bisect_right([r.first_key for r in rows], key)]):
            if block.last_key < key:
                break
            lines = _lines(_range(spark, files[part.part], block.offset, block.length))
            end = bisect_right([k for k, _ in lines], key)
            found += [c for k, c in lines[:end] if k == key]
    return sorted(found, key=lambda c: (c.get("page_id") is not None, c.get("page_id"), c["file"], c["offset"]))


def fetch(spark: SparkSession, capture: dict) -> bytes:
    """Payload of a response capture, or the empty payload of a revisit, by one range read."""
    return parsed(zlib.decompress(_range(spark, capture["file"], capture["offset"], capture["length"]), 31))[1]


def archived(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes archives and index below the shared folder and returns the captures as the index has them."""
    spark, id_type = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    folder = new_folder(spark, "warc")
    write_archives(pages, f"{folder}/archives", id_col, url, html, min_bytes)
    write_index(read_archives(spark, f"{folder}/archives", id_type), f"{folder}/index")
    return read_index(spark, f"{folder}/index", id_type)
