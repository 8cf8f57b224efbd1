"""Web archives: records are written with an index of offset, length, URL and digest, and read back by byte ranges.

Each task writes archive files of gzip members, one member a record, to a shared folder, and returns an index
row for each record. A file's name holds the attempt that wrote it, and only index rows of finished tasks are
kept, so a repeated task leaves no wrong record. Selected index rows are sorted by file and offset, neighbouring
byte ranges are read at once, and records are cut out by their offsets.

Of records with equal payloads of at least ``MIN_DUPLICATE`` bytes the one with the smallest page id is a
response, the others are revisits that name it and carry no payload; rows that repeat that page id are responses
too. A null html is an empty payload, a null url gives no target header, and a null page id is never referred to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import key_filter, map_arrow, partitions
from tidewatch.session import settle, shared_dir

MIN_DUPLICATE = 100
ARCHIVE_BYTES = 256 << 20  # a file is closed beyond this size
RANGE_BYTES = 4 << 20  # the most read at once, unless one record is larger
GAP_BYTES = 64 << 10  # unselected bytes that are read rather than skipped
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each record will hold; refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_DUPLICATE
    repeated = settle(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-repeated")
    # Only payloads that may be repeated are shuffled to their digest.
    may_repeat = key_filter(repeated.select(F.xxhash64("digest").alias("k")), "k")
    marked = rows.withColumn("__may", large & may_repeat(F.xxhash64("digest")))
    alone = marked.where(~F.col("__may")).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"))
    joined = marked.where("__may").join(repeated, "digest", "left")
    return alone.unionByName(joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to")))


def _clean(value: str) -> str:
    """A header value: control characters and spaces in percent form."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"])
    return lines.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the response in it, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    inner, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in inner.decode().split("\r\n")[1:]), payload


def _open(folder: str):  # type: ignore[no-untyped-def]
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(planned: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns the stored index, INDEX with one row for each record."""
    spark = planned.sparkSession
    folder = folder or f"{shared_dir(spark)}/tidewatch/warc-{uuid.uuid4().hex}"
    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        task, number, out, at, name = TaskContext.get(), 0, None, 0, ""
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, number, at = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", number + 1, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload.encode(), digest, refers_to)) + packer.flush()
                out.write(member)
                rows.append((page_id, name, at, len(member), url, digest, "response" if refers_to is None else "revisit"))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)
        if out is not None:
            out.close()

    index = map_arrow(planned.select("page_id", "url", "payload", "digest", "refers_to"), write, INDEX)
    return settle(index.withColumn("folder", F.lit(folder)), "warc-index")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the index rows given.

    A revisit's payload is null; its bytes and digest are those of the full payload, as its headers state. Digests
    of payloads that are read are computed again and must agree.
    """
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    schema = pa.schema(list(zip([k.split()[0] for k in kinds.split(", ")], types, strict=True)))

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def cut(data: bytes, url: str | None) -> tuple:
        fields, inner, body = parse(zlib.decompress(data, 31))
        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(inner["Content-Length"])
        if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        row = (page(fields["WARC-Record-ID"]), url, size, digest, kind, page(fields.get("WARC-Refers-To")))
        return (*row, body if kind == "response" else None) if payload else row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[tuple[str, str], object] = {}
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):  # rows[at:to] are one read
                first, to = rows[at], at + 1
                end = first["offset"] + first["length"]
                while to < len(rows) and (rows[to]["folder"], rows[to]["file"]) == (first["folder"], first["file"]) and 0 <= rows[to]["offset"] - end <= GAP_BYTES and rows[to]["offset"] + rows[to]["length"] - first["offset"] <= RANGE_BYTES:
                    end = rows[to]["offset"] + rows[to]["length"]
                    to += 1
                key = (first["folder"], first["file"])
                if key not in opened:
                    for f in opened.values():
                        f.close()
                    store, root = _open(first["folder"])
                    opened = {key: store.open_input_file(f"{root}/{first['file']}")}
                source = opened[key]
                source.seek(first["offset"])
                data = source.read(end - first["offset"])
                found = [cut(data[r["offset"] - first["offset"] :][: r["length"]], r["url"]) for r in rows[at:to]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
                at = to
        for f in opened.values():
            f.close()

    near = F.floor(F.col("offset") / F.lit(RANGE_BYTES))
    dealt = index.select("folder", "file", "offset", "length", "url").repartition(partitions(index), "folder", "file", near).sortWithinPartitions("folder", "file", "offset")
    return map_arrow(dealt, read, kinds)
