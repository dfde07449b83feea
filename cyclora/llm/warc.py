"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, which may itself be compressed; then comes one Zstandard frame for
each record. The reader finds every frame's end from its block headers,
decodes it alone and checks headers, lengths and digests. Archives are bytes
in a binary column, so any store that Spark reads will do: what ``archives``
makes, or files read with ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import shared_folder

from .common import BROADCAST_ROWS, ROW, checkpoint, looked_up, numbered, settled, table

SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: An archive is closed when its payloads have this many bytes or it has this many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 4000
#: Bytes of a dictionary, and of the payloads that it is trained on.
DICTIONARY_BYTES, TRAINED_ON = 32 << 10, 1 << 20
#: The least payload that a revisit may stand for.
LEAST = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or a record breaks the format."""


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and its blocks' headers."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME:
            raise WarcError(f"no frame at byte {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        size_bytes = (1 if single else 0, 2, 4, 8)[flags >> 6]
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_bytes
        last = 0
        while not last:
            head = int.from_bytes(data[end : end + 3], "little")
            if end + 3 > len(data):
                raise WarcError(f"the frame at byte {at} is cut off")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise WarcError(f"the frame at byte {at} has a reserved block")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    except (IndexError, struct.error) as e:
        raise WarcError(f"the frame at byte {at} is cut off") from e
    if end > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return end - at


def records(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive."""
    import zstandard as zstd

    data, at, dictionary = memoryview(archive), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary is cut off")
        raw, at = bytes(data[8 : 8 + size]), 8 + size
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=128 << 20)
        kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY) else zstd.DICT_TYPE_RAWCONTENT
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=kind)
    decoder = zstd.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        size = frame_size(data, at)
        try:
            yield decoder.decompressobj().decompress(data[at : at + size])
        except zstd.ZstdError as e:
            raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        at += size
    if at != len(data):
        raise WarcError("the last frame is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, whose form and length are checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise WarcError("a record has no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"a header line is malformed: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise WarcError(f"headers are missing: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("a record's length is not as its header says")
    return headers, rest[:-4]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page(record: bytes) -> tuple:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of a response or revisit record."""
    headers, block = parse(record)
    kind = headers["warc-type"]
    http, gap, payload = block.partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not gap:
        raise WarcError(f"a record of type {kind} is no page")
    fields = dict(x.decode("latin-1").lower().split(": ", 1) for x in http.split(b"\r\n")[1:])
    size, digest = int(fields["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or sha1_base32(payload) != digest:
            raise WarcError("a payload is not as its headers say")
    elif payload or headers.get("warc-profile") != _PROFILE:
        raise WarcError("a revisit has a payload or another profile")
    number = lambda name: int(x) if (x := headers[name].removeprefix("<urn:page:").removesuffix(">")) != "null" else None
    refers = number("warc-refers-to") if kind == "revisit" else None
    url = headers.get("warc-target-uri")
    return number("warc-record-id"), url, payload if kind == "response" else None, size, digest, kind, refers


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>")
    head.append("WARC-Date: 2024-01-01T00:00:00Z")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " ").strip())
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(made: list[bytes]) -> bytes:
    """Records as one archive, with a dictionary trained on the first of them."""
    import zstandard as zstd

    samples, size = [], 0
    for x in made:
        if size >= TRAINED_ON:
            break
        samples.append(x[: 64 << 10])
        size += len(samples[-1])
    try:
        dictionary = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        raw = dictionary.as_bytes()
    except zstd.ZstdError:  # too little to train on
        raw = b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\n")
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    packed = zstd.ZstdCompressor(level=9).compress(raw)
    encoder = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(encoder.compress, made)])


def archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives (name, content) that hold a record for each row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, a null one empty. Of rows with equal
    payloads of at least ``least`` bytes that with the largest page_id is
    written as a response and the others as revisits of it; smaller payloads
    are all responses. Where the largest page_id is repeated, one of its
    rows is the response, the same one each time; a null page_id is smaller than any other. A null url
    is left out, control characters in a url are too. An empty table gives no
    archives; further columns are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = numbered(settled(pages)).select(ROW, "page_id", "url", html.alias("payload"))
    keys = rows.select(
        ROW, "page_id", F.sha2("payload", 256).alias("key"), F.length("payload").alias("n")
    ).where(F.col("n") >= least)
    best = F.max(F.struct(F.col("page_id").isNotNull(), F.col("page_id").alias("id"), F.col(ROW).alias("row")))
    groups = keys.groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = checkpoint(groups.where("n > 1").select("key", "best", "n"))
    revisits = looked_up(keys.drop("n"), groups, ["key"], "n").where(F.col(ROW) != F.col("best.row"))
    revisits = checkpoint(revisits.select(ROW, F.coalesce(F.col("best.id").cast("string"), F.lit("null")).alias("refers_to")))
    if revisits.count() <= BROADCAST_ROWS:  # the payloads needn't move to meet their marks
        revisits = F.broadcast(revisits)
    sent = rows.join(revisits, ROW, "left").select(ROW, F.col("page_id").cast("bigint"), "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[bytes] = []
        size, first = 0, ""

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [f"pages-{first}.warc.zst"], "content": pa.array([write_archive(made)], pa.binary())})

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                number, *rest = (x.as_py() for x in row)
                if not made:
                    first = f"{number['file'] & (1 << 64) - 1:016x}-{number['at']}"
                made.append(write_record(*rest))
                size += len(made[-1])
                if size >= ARCHIVE_BYTES or len(made) >= ARCHIVE_RECORDS:
                    yield flush()
                    made, size = [], 0
        if made:
            yield flush()

    return sent.mapInArrow(run, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write archives (name, content) as files into a folder that driver and executors share; returns name and n_bytes.

    A file gets its name only when it is whole, so a task that is run again
    leaves nothing broken. ``folder`` is a path or URI that pyarrow can write to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(*batch.columns, strict=True):
                draft = f"{path}/_{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content.as_py())
                store.move(draft, f"{path}/{name}")
                sizes.append(len(content.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return checkpoint(files.select("name", "content").mapInArrow(run, "name string, n_bytes bigint"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The pages in the archives of a folder."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder))


def read(files: DataFrame) -> DataFrame:
    """The pages in archives (a binary column ``content``): page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    The html of a revisit is null. An archive that breaks the format fails the job.
    """
    types = {
        "page_id": pa.int64(),
        "url": pa.string(),
        "html": pa.string(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
    }

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        columns[2] = tuple(x if x is None else x.decode("utf-8", "replace") for x in columns[2])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for content in some.column(0):
                rows: list[tuple] = []
                size = 0
                for record in records(content.as_py()):
                    rows.append(page(record))
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id bigint, url string, html string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.select("content").mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archive files in the cluster's shared folder and read back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    made = write_files(archives(table(spark, sf_dir, "pages")), folder)
    # without pages there is no folder to read
    pages = read(spark.createDataFrame([], "content binary")) if made.isEmpty() else read_files(spark, folder)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, upper(sha1(html)) AS sha, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(sha, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM h
"""
