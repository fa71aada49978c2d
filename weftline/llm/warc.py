"""WARC archives with a two-level capture index.

Archives are gzip members, one to a record, in files of the shared folder. The index sorts the
captures by reversed-host URL key and cuts them into compressed blocks; a sparse directory holds the
first key of each block. A lookup searches the directory, reads one block, searches that and reads
the one record, each by byte range.

Files are written by tasks under a name of their own for each attempt, and only the rows that
Spark keeps of a task name its file: a task that is run again leaves an orphan, never a mixture.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lineage import scratch_path, settle
from weftline.llm.text import whole
from weftline.llm.urls import host_of

#: Fixed values of the format.
VERSION = "WARC/1.0"
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads under so many bytes are always stored.
LEAST_BYTES = 100
BLOCK_ROWS = 3000
#: Bytes of a file that one task reads.
STRETCH = 1 << 23
_CAPTURE = "key string, page_id bigint, url string, digest string, type string, file string, offset bigint, length bigint"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def url_key(url: Column) -> Column:
    """Reversed host, a bracket, and the rest of the url in lower case without its fragment."""
    host = host_of(url)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://[^/?#]*([^#]*)", 1)))


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 4, mtime=0)


def _parse(member: bytes) -> dict:
    """A record read back; length and digest of a response come from its payload, those of a revisit from its headers."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    if fields["WARC-Type"] == "response":
        size, digest, payload_out = len(payload), hashlib.sha256(payload).hexdigest(), payload
    else:
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
        digest, payload_out = fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload_out}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` and return the captures ``(key, page_id, url, digest, type, file, offset, length)``.

    A null payload is empty. Of equal payloads of at least 100 bytes the one with the smallest
    page id is stored as a response and the others revisit it; rows that share that id are all
    responses, and null ids come last. Null urls have no target and the key of an empty url.
    The ids are integers. Only digests are grouped; payloads move once, by digest, and then
    only if Spark does not find the repeated digests small enough to send around.
    """
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(whole(payload_col), "UTF-8").alias("payload"))
    named = named.select("page_id", "url", url_key(F.col("url")).alias("key"), "payload", F.sha2("payload", 256).alias("digest"))
    firsts = named.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = named.join(firsts, "digest", "left").select("page_id", "url", "key", "payload", "digest", other.alias("refers_to"))
    out = _schema(_CAPTURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, sink, offset = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, key, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
                member = _record(page_id, url, payload, digest, refers_to)
                sink.write(member)
                rows.append({"key": key, "page_id": page_id, "url": url, "digest": digest, "type": "response" if refers_to is None else "revisit", "file": name, "offset": offset, "length": len(member)})
                offset += len(member)
            yield pa.RecordBatch.from_pylist(rows, out)
        if sink:
            sink.close()

    return settle(ready.mapInArrow(run, _CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sort the captures by key, write them in compressed blocks and return the directory ``(first_key, last_key, file, offset, length, n)``.

    A row of the directory stands for ``block_rows`` captures. Equal keys may run over several
    blocks and files; ties are in order of page id, null first.
    """
    shape = "first_key string, last_key string, file string, offset bigint, length bigint, n bigint"
    out = _schema(shape)
    names = captures.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, sink, offset, held = f"index-{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def block(rows: list[tuple]) -> dict:
            nonlocal sink, offset
            sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
            member = gzip.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode(), 6, mtime=0)
            sink.write(member)
            offset += len(member)
            return {"first_key": rows[0][0], "last_key": rows[-1][0], "file": name, "offset": offset - len(member), "length": len(member), "n": len(rows)}

        for batch in batches:
            held += zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            full = len(held) - len(held) % block_rows
            yield pa.RecordBatch.from_pylist([block(held[k : k + block_rows]) for k in range(0, full, block_rows)], out)
            held = held[full:]
        if held:
            yield pa.RecordBatch.from_pylist([block(held)], out)
        if sink:
            sink.close()

    # the page id and file part even a key that holds most captures
    order = ["key", "page_id", "file", "offset"]
    return settle(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape), "directory")


def read_index(directory: DataFrame, folder: str) -> DataFrame:
    """All captures, from the blocks that the directory names."""
    out = _schema(_CAPTURE)
    blocks = directory.select("file", "offset", "length").repartition("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    rows = _block(f, r["offset"], r["length"])
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, x, strict=True)) for x in rows], out)

    return blocks.mapInArrow(run, _CAPTURE)


def _block(f, offset: int, length: int) -> list[list]:
    f.seek(offset)
    return [json.loads(x) for x in zlib.decompress(f.read(length), 31).decode().split("\n")]


def lookup(keys: DataFrame, directory: DataFrame, folder: str, key_col: str = "key") -> DataFrame:
    """Captures with the given url keys.

    First the file is searched, by the first and last key of each index file (one entry to a
    file, so no more than the index had partitions, which is a setting and not a size of the
    data), then the blocks of that file, then the block. Repeated keys count once, null keys
    find nothing; a key with captures in several blocks or files finds all of them.
    """
    spark, out = directory.sparkSession, _schema(_CAPTURE)
    ranges = sorted((r["first"], r["last"], r["file"]) for r in directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).toLocalIterator())
    shared = spark.sparkContext.broadcast(ranges)
    shape = _schema("file string, key string")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [r[0] for r in shared.value], [r[1] for r in shared.value]
        for batch in batches:
            rows = [{"file": shared.value[k][2], "key": key} for key in batch.column(0).to_pylist()
                    for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_pylist(rows, shape)

    wanted = keys.select(F.col(key_col).alias("key")).where("key is not null").distinct().mapInArrow(route, "file string, key string")
    none = F.lit(None)
    both = wanted.select("file", F.lit(1).alias("kind"), "key", none.cast("string").alias("last_key"), none.cast("long").alias("offset"), none.cast("long").alias("length"))
    both = both.unionByName(directory.select("file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "offset", "length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, blocks, at, rows = None, [], None, []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, blocks, at = r["file"], [], None
                if r["kind"] == 0:
                    blocks.append((r["key"], r["last_key"], r["offset"], r["length"]))
                    continue
                key, k = r["key"], bisect.bisect_left(blocks, r["key"], key=lambda x: x[1])
                while k < len(blocks) and blocks[k][0] <= key:
                    if at != k:
                        with fs.open_input_file(f"{base}/{name}") as f:
                            rows, at = _block(f, *blocks[k][2:]), k
                    for row in rows[bisect.bisect_left(rows, key, key=lambda x: x[0]) : bisect.bisect_right(rows, key, key=lambda x: x[0])]:
                        found.append(dict(zip(out.names, row, strict=True)))
                    k += 1
            yield pa.RecordBatch.from_pylist(found, out)

    return both.repartition(_tasks(spark), "file").sortWithinPartitions("file", "kind", "key").mapInArrow(run, _CAPTURE)


def _tasks(spark: SparkSession) -> int:
    """Adaptive execution puts partitions together by their size, which here says nothing of the work; a given number stays."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, read by byte range in the order of each file; revisits have no payload of their own.

    A task gets stretches of 8 MB of a file, so large files are read by many tasks.
    """
    out = _schema(_RECORD)
    stretch = F.floor(F.col("offset") / STRETCH)
    places = captures.select("file", "offset", "length").repartition(_tasks(captures.sparkSession), "file", stretch).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, f = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), 500):
                got = []
                for r in rows[k : k + 500]:
                    if r["file"] != name:
                        if f:
                            f.close()
                        name, f = r["file"], fs.open_input_file(f"{base}/{r['file']}")
                    f.seek(r["offset"])
                    got.append(_parse(f.read(r["length"])))
                yield pa.RecordBatch.from_pylist(got, out)
        if f:
            f.close()

    return places.mapInArrow(run, _RECORD)


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame, str]:
    """Write archives and index; gives the captures, the directory and the folder (a new one in the shared folder by default)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, **columns)
    return captures, write_index(captures, folder), folder
