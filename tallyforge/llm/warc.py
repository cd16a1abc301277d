"""WARC archives: writing them from pages, an index of their records, and reads by byte range.

Each task writes compressed archives, one gzip member a record, straight into the shared folder,
under a name of its own attempt; the index rows that it returns name what it wrote, and the
index is a Parquet table. What a lost attempt left behind is in no index. Readers sort an
archive's records by offset and fetch neighbouring byte ranges in one read.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _scratch

#: Bytes of an archive, of a gap that is read rather than skipped, and of one read at most
#: (a longer record is read by itself).
ARCHIVE, GAP, READ = 64 << 20, 64 << 10, 8 << 20
LEVEL = 4
#: The pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
#: Digests of shared payloads up to which their table is broadcast (about 60 bytes each).
BROADCAST_DIGESTS = 200_000

INDEX = "id {id}, url string, archive string, at long, length long, digest string, payload_bytes long, record_type string, refers_to {id}"


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 SHA-1 of a string column."""
    bits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(bits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head(kind: str, url: str, own: str, refers: str | None, sha: str, block: int) -> bytes:
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {block}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*lines, "", ""]).encode()


def http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_types(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, html, digest, payload_bytes, refers_to of every row."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("html"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes")
    )
    shared = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last")).where("n > 1")
    shared = _scratch.written(shared.select("digest", "last"), "shared")
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    named = rows.join(shared, "digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return named.select("id", "url", "html", "digest", "payload_bytes", F.when(again, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and their index under folder (a URI all executors reach); returns the index.

    Of the rows whose payloads (html in UTF-8, null: empty) are equal and have least_bytes at
    least, those with the largest id are responses and the others revisit it. Null ids count as
    smallest; where all are null, all are responses. Null urls are empty in the record and null
    in the index; repeated rows each give a record; an empty table gives an empty index.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    schema = INDEX.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(f"{root}/archives", recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            rows = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c != "html"}
            html, index = batch.column("html"), []
            for k in range(batch.num_rows):
                if out is None or at >= ARCHIVE:
                    if out:
                        out.close()
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                own, refers, sha, size = rows["id"][k], rows["refers_to"][k], rows["digest"][k], rows["payload_bytes"][k]
                block = http(size)
                if refers is None:
                    block += html[k].as_py().encode()
                what = "response" if refers is None else "revisit"
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = packer.compress(head(what, rows["url"][k] or "", own, refers, sha, len(block)) + block + b"\r\n\r\n") + packer.flush()
                out.write(record)
                index.append((name, at, len(record), what))
                at += len(record)
            archive, starts, lengths, types = zip(*index, strict=True) if index else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(archive, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), batch.column("digest"), batch.column("payload_bytes"), pa.array(types, pa.string()), batch.column("refers_to")],
                names=[x.split()[0] for x in schema.split(", ")],
            )
        if out:
            out.close()

    index = with_types(pages, least_bytes, id_col, url_col, html_col).mapInArrow(_buffers.tidy(run), schema)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first, beyond the last, start, end) of the reads for sorted (start, length) ranges."""
    out: list[list[int]] = []
    for k, (at, n) in enumerate(ranges):
        if out and at - out[-1][3] <= GAP and at + n - out[-1][2] <= READ:
            out[-1][1], out[-1][3] = k + 1, max(out[-1][3], at + n)
        else:
            out.append([k, k + 1, at, at + n])
    return [tuple(x) for x in out]


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, body) of one uncompressed record."""
    top, _, rest = record.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(warc["Content-Length"])]
    lines, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:]), body


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """id, url, payload_bytes, payload_digest, record_type, refers_to and payload (binary; null for
    revisits and without payloads) of the index rows given, from the archives themselves.

    Responses get size and digest from their payload and must match their header; revisits carry
    both in theirs. A record that doesn't parse or match raises ValueError.
    """
    schema = index.schema
    kind = schema["id"].dataType.simpleString()
    spread = index.select("id", "url", "archive", "at", "length", "refers_to")
    spread = spread.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive").sortWithinPartitions("archive", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            archives, ats, lengths = (batch.column(c).to_pylist() for c in ("archive", "at", "length"))
            refers = batch.column("refers_to").to_pylist()
            size, sha, what, found, body_of = [], [], [], [], []
            first = 0
            while first < batch.num_rows:
                to = first
                while to < batch.num_rows and archives[to] == archives[first]:
                    to += 1
                with fs.open_input_file(f"{root}/{archives[first]}") as f:
                    for a, b, start, end in coalesced(list(zip(ats[first:to], lengths[first:to], strict=True))):
                        f.seek(start)
                        data = f.read(end - start)
                        for k in range(first + a, first + b):
                            warc, answer, body = parse(zlib.decompress(data[ats[k] - start : ats[k] - start + lengths[k]], 31))
                            said = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                            if warc["WARC-Type"] == "response" and (digest(body) != said or len(body) != int(answer["Content-Length"])):
                                raise ValueError(f"damaged record at {archives[k]}:{ats[k]}")
                            size.append(int(answer["Content-Length"]))
                            sha.append(said)
                            what.append(warc["WARC-Type"])
                            named = warc.get("WARC-Refers-To", "")[10:-1]
                            if named and named != str(refers[k]):
                                raise ValueError(f"index and archive differ at {archives[k]}:{ats[k]}")
                            found.append(refers[k] if named else None)
                            body_of.append(body if payloads and warc["WARC-Type"] == "response" else None)
                first = to
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(what, pa.string()), pa.array(found, batch.schema.field("refers_to").type), pa.array(body_of, pa.binary())],
                names=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )

    return spread.mapInArrow(_buffers.tidy(run), f"id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def archive_folder(spark: SparkSession) -> str:
    return _scratch.path(spark, "warc")
