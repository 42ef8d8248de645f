"""WARC archives written and read as a chunked record table: (record, chunk number, bytes, digest so far).

No step after the payload's own input row holds a whole payload: the writer takes chunk rows and compresses them as they
come, the reader inflates a file in small blocks and hands out chunk rows that carry the digest of all bytes so far.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.tables import new_folder, written

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK, HEADER_LIMIT = 1 << 18, 1 << 20
MANIFEST = "file string, records bigint, bytes bigint"
CHUNKS = ("file string, record_no bigint, record_id string, record_type string, key string, refers_to string, uri string, declared_digest string, "
          "declared_bytes bigint, chunk_no bigint, last boolean, bytes_so_far bigint, digest_so_far string")


def with_types(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Adds n_bytes, digest (hex SHA-1), record_type and refers_to to (key, uri, payload).

    Of records with equal payloads of at least ``min_bytes`` that with the largest key is the response and the others
    revisit it; smaller ones are all responses.  A null payload is an empty one.  A record with a null key is a response
    only if all keys of its group are null; rows that repeat the largest key are all responses."""
    payload = F.coalesce("payload", F.lit(b""))
    known = records.withColumn("payload", payload).withColumn("n_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    groups = (known.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max("key").alias("keeper"), F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) & F.col("keeper").isNotNull()).drop("n"))
    revisit = F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper"))
    return (known.join(written(groups, "payloads"), ["digest", "n_bytes"], "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("keeper"))).drop("keeper"))


def chunked(records: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Chunk rows of every record, in order; a revisit and an empty payload are one empty chunk."""
    stored = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("n_bytes"))
    last = F.greatest(F.ceil(stored / chunk_bytes) - 1, F.lit(0)).cast("int")
    head = ["key", "uri", "record_type", "refers_to", "n_bytes", "digest"]
    cut = records.select(*head, "payload", last.alias("last_no"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})"))
    return cut.select(F.col("key").cast("string").alias("key"), "uri", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "n_bytes", "digest",
                      "chunk_no", "last_no", data.alias("data"))


def record_id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{digest} {key}'.encode()).digest())}>"


def head_of(row: dict, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    length = len(http) + (0 if row["record_type"] == "revisit" else row["n_bytes"])
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['key'], row['digest'])}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(row['uri'] or 'urn:unknown', safe=':/?#[]@!$&()*+,;=%~')}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}", f"X-Payload-Length: {row['n_bytes']}"]
    if row["key"] is not None:
        lines.append(f"X-Record-Key: {quote(row['key'], safe='')}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}", f"X-Refers-To-Key: {quote(row['refers_to'], safe='')}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def write(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 256 << 20) -> DataFrame:
    """Write chunk rows as .warc.gz files of about ``roll_bytes``, one gzip member per record; returns the manifest.

    Chunks of a record must follow one another within a partition, as ``chunked`` makes them.  Every attempt of a task
    writes files of its own; the manifest, a written table, names only those of the attempts that succeeded.  The digest
    is carried over the chunks and must come out as the header says."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        done, out, name, records, sha, pack = [], None, None, 0, None, None
        for batch in batches:
            data = batch.column("data")
            for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out, records = fs.open_output_stream(name, compression=None), 0
                if row["chunk_no"] == 0:
                    sha, pack = hashlib.sha1(), zlib.compressobj(6, zlib.DEFLATED, 31)
                    for part in head_of(row, date):
                        out.write(pack.compress(part))
                part = data[i].as_py()
                sha.update(part)
                out.write(pack.compress(part))
                if row["chunk_no"] == row["last_no"]:
                    if row["record_type"] == "response" and sha.hexdigest() != row["digest"]:
                        raise ValueError(f"chunks of record {row['key']} are not whole")
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
                    if out.tell() >= roll_bytes:
                        done.append((name, records, out.tell()))
                        out.close()
                        out = None
        if out is not None:
            done.append((name, records, out.tell()))
            out.close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return written(chunks.mapInArrow(run, MANIFEST), "manifest")


def blocks(stream) -> Iterator[bytes]:
    """The bytes of an archive in blocks of at most ``BLOCK``, whether it is plain or any number of gzip members."""
    raw = stream.read(BLOCK)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(BLOCK)
        return
    inflate = zlib.decompressobj(31)
    while raw:
        part = inflate.decompress(raw, BLOCK)
        if part:
            yield part
        raw = inflate.unconsumed_tail
        while len(part) == BLOCK and not raw and not inflate.eof and (part := inflate.decompress(b"", BLOCK)):
            yield part
        if inflate.eof:
            raw, inflate = inflate.unused_data, zlib.decompressobj(31)
        if not raw:
            raw = stream.read(BLOCK)


class Window:
    """Reads from blocks what is asked for and keeps at most a block and a header."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.held = source, bytearray()

    def more(self) -> bool:
        part = next(self.source, None)
        self.held += part or b""
        return part is not None

    def until(self, mark: bytes, limit: int) -> bytes | None:
        """Everything up to and with ``mark``, or None if it does not come within ``limit`` bytes."""
        while (at := self.held.find(mark, 0, limit)) < 0:
            if len(self.held) >= limit or not self.more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        part = bytes(self.held[:n])
        del self.held[:n]
        return part


def records_of(source: Iterator[bytes], chunk_bytes: int) -> Iterator[tuple[dict[str, str], int, bool, bytes, int, str]]:
    """(header, chunk number, last, data, bytes so far, digest so far) of every chunk of every record with a payload."""
    window = Window(source)
    while True:
        while window.held[:1] in (b"\r", b"\n") or not window.held and window.more():
            if window.held[:1] in (b"\r", b"\n"):
                window.take(1)
        if (raw := window.until(b"\r\n\r\n", HEADER_LIMIT)) is None:
            if window.held:
                raise ValueError("no end of a record's header")
            return
        fields = dict(line.partition(":")[::2] for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if line)
        header = {k.strip().lower(): v.strip() for k, v in fields.items()}
        left, no, size, sha = int(header["content-length"]), 0, 0, hashlib.sha1()
        if header.get("content-type", "").startswith("application/http") and (http := window.until(b"\r\n\r\n", min(left, HEADER_LIMIT))) is not None:
            left -= len(http)
        while True:
            data = window.take(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise ValueError("the archive ends within a record")
            left, size = left - len(data), size + len(data)
            sha.update(data)
            yield header, no, left == 0, data, size, sha.hexdigest()
            no += 1
            if not left:
                break


def hex_digest(declared: str) -> str | None:
    return base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") and len(declared) == 37 else declared.removeprefix("sha1:").lower() or None


def read(manifest: DataFrame, chunk_bytes: int = 1 << 20, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names in column file, about one task per file.

    Every record has at least one chunk row; the one with ``last`` carries its whole length and digest.  ``data`` False
    leaves the bytes out.  Records without a key, URI or digest header have null there; an empty archive gives no rows."""
    schema = CHUNKS + (", data binary" if data else "")
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def rows(file: str):
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_stream(path, compression=None) as stream:
            at, no = None, -1
            for header, chunk, last, part, size, digest in records_of(blocks(stream), chunk_bytes):
                if chunk == 0:
                    no += 1
                    at = [file, no, header.get("warc-record-id"), header.get("warc-type")] + [unquote(v) if (v := header.get(k)) is not None else None for k in ("x-record-key", "x-refers-to-key")]
                    at += [header.get("warc-target-uri"), hex_digest(header.get("warc-payload-digest", "")), int(v) if (v := header.get("x-payload-length")) else None]
                yield (*at, chunk, last, size, digest, *([part] if data else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda held: pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*held), fields)], names=[n for n, _ in fields])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += 200 + (len(row[-1]) if data else 0)
                    if size > 4 << 20:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    files = manifest.select("file").distinct()
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, schema)


def archived(records: DataFrame, min_bytes: int = 1000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write (key, uri, payload) to archives in a new shared folder; returns their manifest."""
    return write(chunked(with_types(records, min_bytes), chunk_bytes), new_folder(records.sparkSession, "warc"))
