"""WARC archives of one Zstandard frame a record, with the dictionary in a leading skippable frame.

A file is: a skippable frame (magic 0x184D2A5D) that holds the dictionary, if there is one; then
for each record one Zstandard frame made with that dictionary. Tasks write files of their own
name to the shared folder and pass on their paths, which Spark commits as a table, so a task that
is run again leaves no record twice. Files are read a chunk at a time, one record in memory.

The dictionary is trained on a bounded sample of whole payloads, by the smallest hashes of page_id
(SAMPLE_ROWS, SAMPLE_BYTES); with too few rows there
is none. A null html is an empty payload; a null url has no target field, a null page_id no id
field and reads back as null. Of records with equal payloads of at least REVISIT_BYTES, those with
the largest page_id are responses; the others revisit it. Repeated rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import sampled, shared_folder, stored

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 1000
SAMPLE_ROWS, SAMPLE_BYTES = 400, 16 << 20
#: Repeated payloads up to which all are looked up by broadcast; beyond, only those above a HOT-th of all rows.
BROADCAST_FIRSTS, HOT = 500_000, 1000
DICT_BYTES = 32 << 10
#: Uncompressed bytes after which a task begins another file.
FILE_BYTES = 256 << 20


def filesystem(path: str):
    """(filesystem, path within it) of a folder's URI."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(file:)?/*", "file:///", path))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record where refers_to is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block + END


def parse_record(data: bytes) -> dict:
    """A record's fields; ValueError where a header or a length is wrong."""
    head, mark, rest = data.partition(END)
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + len(END) or not rest.endswith(END):
        raise ValueError("the block's length is not Content-Length")
    http, mark, payload = rest[: -len(END)].partition(END)
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = re.search(rb"(?im)^Content-Length: *(\d+)\r?$", http)
    if length is None:
        raise ValueError("no length of the payload")
    kind, size = fields["warc-type"], int(length[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload is not the one that was written")
    elif kind != "revisit" or payload or "warc-profile" not in fields:
        raise ValueError(f"bad {kind} record")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


class ArchiveWriter:
    def __init__(self, stream, dictionary: bytes | None):
        import zstandard

        self.stream, self.bytes = stream, 0
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True, write_checksum=True)
        if dictionary:
            stream.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def write(self, record: bytes) -> None:
        self.stream.write(self.frames.compress(record))
        self.bytes += len(record)


def read_archive(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, a frame each; ValueError on a cut or damaged file."""
    import zstandard

    data = stream.read(chunk)
    made = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            if not (more := stream.read(max(chunk, 8 + size - len(data)))):
                raise ValueError("the dictionary is cut off")
            data += more
        held, data = data[8 : 8 + size], data[8 + size :]
        if held[:4] == b"\x28\xb5\x2f\xfd":
            held = zstandard.ZstdDecompressor().decompress(held)
        made = zstandard.ZstdCompressionDict(held)
    frames = zstandard.ZstdDecompressor(dict_data=made)
    while data or (data := stream.read(chunk)):
        frame, out = frames.decompressobj(), []
        try:
            while True:
                out.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                if not (data := stream.read(chunk)):
                    raise ValueError("a frame is cut off")
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame is damaged: {e}") from e
        yield b"".join(out)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes | None:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else None
    except zstandard.ZstdError:  # too little to learn from
        return None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null as empty), refers_to: the page_id of the response that a row revisits.

    Payloads that repeat are counted by digest, with their rows counted per task first. The few that
    make up more than a HOT-th of all rows are looked up by broadcast, so no task gets a hot payload's rows.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    large = F.octet_length("html") >= REVISIT_BYTES
    rows = rows.withColumn("key", F.when(large, F.unhex(F.sha2("html", 256))))
    firsts = rows.filter(large).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    firsts, total = stored(firsts, "firsts"), pages.count()
    if firsts.count() <= BROADCAST_FIRSTS:
        found = rows.join(F.broadcast(firsts.drop("n")), "key", "left")
    else:
        hot = F.broadcast(firsts.filter(F.col("n") * HOT > total).select("key", F.col("last").alias("hot_last")))  # fewer than HOT rows
        marked = rows.join(hot, "key", "left")
        # keys of their own for rows that have no partner to meet
        met = F.when(F.col("hot_last").isNull(), F.col("key"))
        marked = marked.withColumn("key", F.coalesce(met, F.unhex(F.sha2(F.concat_ws(" ", F.lit("alone"), F.col("page_id").cast("string"), "url"), 256))))
        found = marked.join(firsts.filter(F.col("n") * HOT <= total).drop("n"), "key", "left").withColumn("last", F.coalesce("hot_last", "last"))
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes with_revisits(pages) to archives in folder; returns the table of their paths and record counts."""
    sample = [t.encode("utf-8", "surrogatepass") for t in sampled(pages.filter("html is not null"), "html", SAMPLE_ROWS, SAMPLE_BYTES, "page_id")]
    dictionary = train_dictionary([record_bytes(0, "", s, None) for s in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        stream = writer = None
        done, path, n = [], "", 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    stream = fs.open_output_stream(path)
                    writer = ArchiveWriter(stream, dictionary)
                writer.write(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                n += 1
                if writer.bytes >= FILE_BYTES:
                    stream.close()
                    done.append((path.rsplit("/", 1)[1], n))
                    writer = None
        if writer is not None:
            stream.close()
            done.append((path.rsplit("/", 1)[1], n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "n_records"])

    return stored(with_revisits(pages).mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(paths: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives in column path: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(at) as stream:
                    for data in read_archive(stream):
                        rows.append(row := parse_record(data))
                        size += row["payload_bytes"] if payload else 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    few = paths.select("path")
    return few.repartition(max(1, few.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc")), payload)
