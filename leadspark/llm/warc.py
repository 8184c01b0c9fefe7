"""WARC archives: write pages, normalise whole-file gzip to one member per record, read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch

#: Payloads of at least this many bytes are written once and revisited by their copies.
REVISIT_BYTES = 1000
CHUNK = 1 << 20
RECORD = "urn:leadspark:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, page_id long, type string, digest string, offset long, length long"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only, which states the full length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(RECORD)
    return int(name) if name.lstrip("-").isdigit() else None


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of a stream of WARC bytes, one record in memory at a time."""
    buffer = bytearray()
    need = 0

    def fill(size: int) -> bool:
        while len(buffer) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        end = buffer.find(b"\r\n\r\n", max(0, need - 3))
        if end < 0:
            need = len(buffer)
            if not fill(need + 1):
                if buffer.strip():
                    raise ValueError("the WARC stream ends inside a header")
                return
            continue
        need = 0
        head = fields(bytes(buffer[:end]))
        size = end + 4 + int(head["content-length"])
        if not fill(size):
            raise ValueError("the WARC stream ends inside a record")
        yield head, bytes(buffer[:size]) + b"\r\n\r\n"
        del buffer[:size]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one member or of many, inflated once in bounded chunks.

    A stream that ends inside a member, its checksum included, is refused, even if it was
    cut where all its bytes can be read. Zero bytes after a member are padding.
    """
    codec, data = None, b""
    while True:
        data = data or stream.read(CHUNK)
        if not data and codec is not None and not codec.eof:
            # what the codec still holds comes out without more input
            if out := codec.decompress(b"", CHUNK):
                yield out
                continue
            if not codec.eof:
                raise ValueError("the gzip stream is cut off")
        if not data:
            return
        if codec is not None and codec.eof:
            data = data.lstrip(b"\0")
            if not data:
                continue
        if codec is None or codec.eof:
            codec = zlib.decompressobj(wbits=31)
        out = codec.decompress(data, CHUNK)
        data = codec.unused_data if codec.eof else codec.unconsumed_tail
        if out:
            yield out


def member(data: bytes, level: int = 6) -> bytes:
    codec = zlib.compressobj(level, wbits=31)
    return codec.compress(data) + codec.flush()


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another.

    Only ids, digests and lengths are grouped and joined, with a partial maximum before
    the shuffle, so a payload that a third of all pages share stays cheap.
    """
    large = pages.select("page_id", "digest", "payload_bytes").filter(
        (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    )
    keeper = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other"))
    keeper = keeper.filter("other < refers_to").drop("other")
    return large.join(keeper, ["digest", "payload_bytes"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a WARC record per page, each partition one gzip stream; rows: (archive, n).

    `pages` has page_id, url and html. A null html is an empty payload. Of pages with
    equal payloads of REVISIT_BYTES or more, the largest page_id is the response and the
    others revisit it; rows that repeat that id are responses all. A page without an id
    is a response. Files are written under a name of their own and renamed when whole,
    so a task that runs twice leaves one whole file.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("payload_bytes"),
    )
    rows = base.join(decisions(base), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        task = TaskContext.get()
        where, home = place(folder)
        where.create_dir(home, recursive=True)
        name = f"{home}/part-{task.partitionId():06d}.warc.gz"
        draft, codec, n = f"{name}.{task.taskAttemptId()}", zlib.compressobj(1, wbits=31), 0
        with where.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(codec.compress(record(*row)))
                    n += 1
            out.write(codec.flush())
        where.move(draft, name)
        archive = f"{folder}/{name.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n])], ["archive", "n"])

    return rows.mapInArrow(run, "archive string, n long")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives (column archive) as one gzip member per record; rows: the index.

    Each file is inflated once from start to end. `X.warc.gz` becomes `X.members.warc.gz`
    with the sidecar `X.members.idx`: a line per record with offset, length, page, type
    and digest, separated by tabs. The returned rows say the same. A file already cut
    into members passes unchanged in content; an empty one gives no rows.
    """

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                where, path = place(archive)
                target = path.removesuffix(".warc.gz") + ".members"
                mark, offset, lines = f".{TaskContext.get().taskAttemptId()}", 0, []
                with where.open_input_stream(path, compression=None) as stream, where.open_output_stream(f"{target}.warc.gz{mark}", compression=None) as out:
                    for head, whole in records(inflated(stream)):
                        data = member(whole)
                        out.write(data)
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        lines.append((page_of(head.get("warc-record-id")), head.get("warc-type"), digest, offset, len(data)))
                        offset += len(data)
                text = "".join(f"{o}\t{n}\t{'' if p is None else p}\t{t}\t{d}\n" for p, t, d, o, n in lines)
                with where.open_output_stream(f"{target}.idx{mark}", compression=None) as out:
                    out.write(text.encode())
                where.move(f"{target}.warc.gz{mark}", f"{target}.warc.gz")
                where.move(f"{target}.idx{mark}", f"{target}.idx")
                name = archive.removesuffix(".warc.gz") + ".members.warc.gz"
                cols = list(zip(*lines)) or [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array([name] * len(lines), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["archive", "page_id", "type", "digest", "offset", "length"])

    return archives.select("archive").mapInArrow(run, INDEX)


def read_back(index: DataFrame) -> DataFrame:
    """Read the records an index names, each by its own offset.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to. A response is
    measured on its payload and must match its stated digest; a revisit states both of
    the payload it stands for.
    """

    def run(batches):
        name, stream = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    where, path = place(archive)
                    name, stream = archive, where.open_input_file(path)
                stream.seek(offset)
                whole = zlib.decompress(stream.read(length), wbits=31)
                head_end = whole.find(b"\r\n\r\n")
                head = fields(whole[:head_end])
                block = whole[head_end + 4 : head_end + 4 + int(head["content-length"])]
                http_end = block.find(b"\r\n\r\n")
                payload, stated = block[http_end + 4 :], head["warc-payload-digest"].removeprefix("sha1:")
                size = int(fields(block[:http_end])["content-length"])
                revisit = head["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
                    raise ValueError(f"record at {offset} of {archive} does not match its digest")
                out.append((page_of(head["warc-record-id"]), size, stated, head["warc-type"], page_of(head.get("warc-refers-to"))))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return index.select("archive", "offset", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive `pages` in the shared folder, normalise the archives and read them back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path()
    written = scratch.write(write_archives(pages, folder))
    files = scratch.write(written.select("archive"))
    n = max(1, files.count())
    index = scratch.write(normalise(files.repartition(n, "archive")))
    scratch.drop(index)
    return read_back(index.repartition("archive").sortWithinPartitions("archive", "offset"))
