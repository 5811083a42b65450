"""WARC archives of individually compressed records with a dictionary of their own.

A task writes archives of a stated number of records. In each a leading
skippable frame holds a Zstandard dictionary that is built from the archive's
first records, then every record is a frame of its own. Spark's text writer commits the files, so any
store and any lost executor will do; its line separator is an empty skippable
frame, which readers pass over.
"""

import hashlib
import base64
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairsmith.llm import shared

#: Payloads from this size on are stored once; later readers are referred to them.
LEAST_REVISITED = 1_000
#: Bytes of records, at most, from which an archive's dictionary is built, and its size.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
#: Records of an archive.
ARCHIVE_RECORDS = 10_000
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_MAGIC = bytes.fromhex("5d2a4d18")
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """(page, url, payload, digest, bytes, refers_to): what to archive of each row.

    Of equal payloads of at least ``LEAST_REVISITED`` bytes the row with the
    largest id holds the payload and the others have its id as refers_to and no
    payload. A null payload is empty. Rows with a null id are never referred to
    and hold their own payload if no other does; of repeated rows with the
    largest id each holds it. Payloads meet only by digest, and a crowded one is
    split by the adaptive join.
    """
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).alias("page"), F.col(url_column).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    holders = rows.where(F.col("bytes") >= LEAST_REVISITED).groupBy("digest").agg(F.max("page").alias("holder"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(holders, "digest", "left")
    refers = F.when(~F.col("holder").eqNullSafe(F.col("page")), F.col("holder"))
    return joined.select(F.col("page").cast("string").alias("page"), "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "bytes", refers.cast("string").alias("refers_to"))


def _record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if page is not None:
        head.append(f"Page-ID: {quote(page, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {quote(refers_to, safe='')}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def dictionary_of(sample: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained from the records; from a few records a small one, of the records repeated; at last the records themselves."""
    small = max(256, min(DICTIONARY_BYTES, sum(map(len, sample)) // 4))
    for times, size, k in ((1, DICTIONARY_BYTES, 512), (30, small, 64)):
        try:
            return zstandard.train_dictionary(size, sample * times, k=k, d=8)
        except zstandard.ZstdError:
            continue
    return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write(decided: DataFrame, path: str) -> None:
    """Archives of the rows of ``decide`` under ``path``: of ``ARCHIVE_RECORDS`` records, or what is left of a task's rows.

    Each begins with its own dictionary, however few records it has. A table
    without rows gives no archive; null urls and ids leave out their fields.
    """
    shared.small_batches(decided.sparkSession)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])

        def started(sample: list[bytes]):
            dictionary = dictionary_of(sample)
            data = dictionary.as_bytes()
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
            return compressor, out([DICTIONARY_MAGIC + len(data).to_bytes(4, "little") + data, *map(compressor.compress, sample)])

        sample, size, n, compressor = [], 0, 0, None
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist() for c in ("page", "url", "payload", "digest", "bytes", "refers_to")]
            for row in zip(*columns):
                one = record(*row)
                n += 1
                if compressor:
                    yield out([compressor.compress(one)])
                else:
                    sample.append(one)
                    size += len(one)
                    if size >= SAMPLE_BYTES or n == ARCHIVE_RECORDS:
                        compressor, first = started(sample)
                        yield first
                if n == ARCHIVE_RECORDS:  # the writer goes on to its next file
                    sample, size, n, compressor = [], 0, 0, None
        if n and not compressor:
            yield started(sample)[1]

    rows = decided.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", ARCHIVE_RECORDS + 1).text(path)


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    if 0x50 <= data[at] <= 0x5F and data[at + 1 : at + 4] == DICTIONARY_MAGIC[1:]:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if data[at : at + 4] != zstandard.FRAME_HEADER:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def records(data: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] == DICTIONARY_MAGIC:
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : end]))
        elif data[at : at + 4] == zstandard.FRAME_HEADER:
            yield decompressor.decompress(data[at:end])
        at = end


def parsed(one: bytes) -> tuple:
    """(page, url, record_type, payload, digest, bytes, refers_to); a response's digest and size are those of the payload read."""
    head, _, rest = one.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    plain = lambda name: unquote_to_bytes(fields[name]).decode() if name in fields else None
    if fields["WARC-Type"] == "response":
        if hashlib.sha1(payload).hexdigest() != told or len(payload) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        payload = None
    return plain("Page-ID"), plain("WARC-Target-URI"), fields["WARC-Type"], payload, told, size, plain("Refers-To-Page-ID")


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page, url, record_type, payload, payload_digest, payload_bytes, refers_to) of all records under ``path``; ids as text.

    A task holds one archive of ``ARCHIVE_RECORDS`` records at a time. Damaged records are an error.
    """
    shared.small_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        names = ["page", "url", "record_type", "payload", "payload_digest", "payload_bytes", "refers_to"]
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for one in records(batch.column(0)[i].as_py()):
                    row = parsed(one)
                    held.append(row if with_payload else (*row[:3], None, *row[4:]))
                    size += len(one)
                    if size > shared.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "page string, url string, record_type string, payload binary, payload_digest string, payload_bytes long, refers_to string")
