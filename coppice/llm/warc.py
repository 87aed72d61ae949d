"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds its dictionary, trained on records of
that archive; each record is a frame that can be decompressed alone with it. Archives
are rows of bytes that Spark's text writer puts in files of their own, so they reach any
file system Spark writes to, and a task that is lost or run twice leaves no half file. The
line end that writer adds is an empty skippable frame, which every decompressor passes over.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coppice.llm.common import pick, ship, sliced, stored
from coppice.session import run_folder

# Uncompressed bytes of the records of one archive; a longer record has one to itself.
ARCHIVE_BYTES = 32 << 20
# Bytes of a dictionary, and of the records, dealt evenly over an archive, that it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 8 << 20
LEVEL = 3
# Digests of repeated payloads that are sent to every task; rarer ones are joined.
MAX_SENT = 100_000
# Frame marks, and the profile of a revisit by payload digest.
DICTIONARY_MARK = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class Record(NamedTuple):
    fields: dict[str, str]  # names in lower case
    block: bytes


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    """Names a page's record by its id and payload; a null id is a star, which no id is written as."""
    return f"<urn:page:{'*' if page_id is None else quote(str(page_id), safe='')}:{digest}>"


def page_of(name: str) -> str | None:
    page = name.removeprefix("<urn:page:").rpartition(":")[0]
    return None if page == "*" else unquote(page)


def encoded(fields: dict[str, str], block: bytes) -> bytes:
    """A record's bytes; its length field is added."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return b"WARC/1.1\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (head.encode(), len(block), block)


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names another record and has only the
    head. Blanks, controls and letters beyond ASCII in the url are percent-encoded."""
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if refers_to:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return encoded(fields, head + (b"" if refers_to else payload))


def trained(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary from records dealt evenly over the archive; from too few bytes to train
    on, the last of those bytes themselves."""
    step = max(1, sum(map(len, records)) // sample)
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(size, chosen, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The dictionary in a leading skippable frame, then a frame for each record."""
    dictionary = trained(records)
    content = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    head = DICTIONARY_MARK + len(content).to_bytes(4, "little") + content
    return b"".join([head, *map(compressor.compress, records)])


def dictionary_of(content) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive, and where its records begin."""
    if bytes(content[:4]) != DICTIONARY_MARK:
        return None, 0
    end = 8 + int.from_bytes(content[4:8], "little")
    return zstandard.ZstdCompressionDict(bytes(content[8:end])), end


def records_of(content) -> Iterator[Record]:
    """The records of an archive's bytes, one after the other; a damaged one is an error."""
    dictionary, begin = dictionary_of(content)
    frames = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(frames.stream_reader(content[begin:], read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield Record(fields, block)


def with_responses(pages: DataFrame, min_bytes: int = 0, max_sent: int = MAX_SENT) -> DataFrame:
    """page_id, url, payload (bytes), digest (hex), and refers_to: the page_id whose record a
    revisit refers to, with ``revisit`` true.

    Digests that repeat are found by an aggregate over digests alone. If there are few,
    all go to every task and payloads stay where they are. Otherwise the most frequent
    are sent, as many as ``max_sent`` at most, and payloads of the others join by digest,
    in groups that are then small.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id", "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest")
    )
    long = rows.filter(F.length("payload") >= min_bytes) if min_bytes else rows
    groups = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    several = stored(groups.filter("n > 1").select("digest", "refers_to", "n", F.lit(True).alias("again")), "digests")
    found = several.agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).first()
    often = 0 if found["kinds"] <= max_sent else -(-found["rows"] // max_sent)
    known = rows.join(F.broadcast(several.filter(F.col("n") >= often).drop("n")), "digest", "left")
    if often:
        rest = known.filter("again is null").drop("refers_to", "again")
        rare = several.filter(F.col("n") < often).drop("n")
        known = known.filter("again").unionByName(rest.join(rare, "digest", "left"))
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return known.select("page_id", "url", "payload", "digest", "refers_to", revisit.alias("revisit"))


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE
) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives under ``path``.

    The payload is the html in UTF-8, a null one is empty. Of the rows whose payloads are
    equal and have at least ``min_bytes``, those with the largest page_id are responses
    (repeated rows under it all are), the others revisits of it; a null page_id ranks below
    all others. A null url has no field. Very long payloads have an archive each; an empty
    table makes a folder without records; other columns are ignored. Each archive begins with
    a warcinfo record.
    """
    ship(pages.sparkSession)
    info = encoded(
        {"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:page:*:info>", "WARC-Date": date, "Content-Type": "application/warc-fields"},
        b"format: WARC File Format 1.1\r\n",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total = [], 0
        for part in sliced(batches, 100):
            for row in part.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                refers_to = record_id(row["refers_to"], digest) if row["revisit"] else None
                record = page_record(row["page_id"], row["url"], row["payload"], digest, refers_to, date)
                if waiting and total + len(record) > archive_bytes:
                    yield as_row(archive([info, *waiting]))
                    waiting, total = [], 0
                waiting.append(record)
                total += len(record)
        if waiting:
            yield as_row(archive([info, *waiting]))

    def as_row(content: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])

    rows = with_responses(pages, min_bytes).mapInArrow(run, "value binary")
    files = rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    files.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per response or revisit under ``path``: page_id (as text), url (as written),
    payload_bytes, payload_digest, record_type, refers_to (as text), and ``payload`` if
    asked for (null for a revisit).

    A response's size and digest are those of the payload found; one that differs from
    the digest in its head is an error. A revisit's are those its head states. Other types of
    records are passed over; a folder without records gives no rows. A file is read whole
    by one task.
    """
    ship(spark)
    made = StructType.fromDDL(
        "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
        + (", payload binary" if payload else "")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in records_of(memoryview(content.as_buffer())):
                    if record.fields["warc-type"] in ("response", "revisit"):
                        rows.append(_page(record))
                        held += len(record.block) if payload else 200
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays(_columns(rows), names=made.names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays(_columns(rows), names=made.names)

    def _columns(rows: list[tuple]) -> list[pa.Array]:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        columns = list(zip(*rows)) or [()] * 7
        return [pa.array(values, kinds.get(name, pa.string())) for name, values in zip(made.names, columns)]

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, made)


def _page(record: Record) -> tuple:
    fields = record.fields
    head, _, payload = record.block.partition(b"\r\n\r\n")
    page, digest = page_of(fields["warc-record-id"]), fields["warc-payload-digest"].removeprefix("sha1:")
    url = fields.get("warc-target-uri")
    if fields["warc-type"] == "revisit":
        lines = (line.partition(b":") for line in head.split(b"\r\n"))
        size = next(int(value) for name, _, value in lines if name.lower() == b"content-length")
        return page, url, size, digest, "revisit", page_of(fields["warc-refers-to"]), None
    if payload_digest(payload) != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what was archived")
    return page, url, len(payload), digest, "response", None, payload


def archived(pages: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Write ``pages`` as :func:`write_archives` does and read the archives back: page_id,
    refers_to (both of the table's own type), url, payload_bytes, payload_digest, record_type."""
    spark = pages.sparkSession
    path = path or run_folder(spark, "warc")
    write_archives(pages, path, **settings)
    kind = pick(pages, "page_id").schema["page_id"].dataType
    found = read_archives(spark, path)
    typed = {name: F.col(name).cast(kind) for name in ("page_id", "refers_to")}
    return found.withColumns(typed)
