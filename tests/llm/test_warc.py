import pytest
import zstandard
from pyspark.sql import functions as F

from coppice.llm.warc import (
    DICTIONARY_MARK,
    archive,
    archived,
    dictionary_of,
    encoded,
    page_of,
    payload_digest,
    read_archives,
    record_id,
    records_of,
    with_responses,
    write_archives,
)
from coppice.session import run_folder

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/", "same text"),
    (2, "http://b.example/ü x\r\ny", "same text"),
    (3, None, "same text"),
    (4, "", ""),
    (5, "http://c.example/", None),
    (6, "http://d.example/", "ünï \x00 \r\n\r\nWARC/1.1\r\n P*M\x18\x00\x00\x00\x00 😀"),
    (7, "http://e.example/", "long " * 300_000),
    (8, "http://f.example/", "again"),
    (8, "http://f.example/", "again"),
    (None, "http://g.example/", "again"),
    (None, "http://h.example/", "alone"),
]


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload]
        first = max((i for i in same if i is not None), default=None)
        revisit = len(same) > 1 and len(payload) >= least and page_id != first
        out.append((page_id, len(payload), payload_digest(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def found(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(row) for row in df.select(*names).collect()), key=repr)


@pytest.fixture
def pages(spark):
    table = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return table.select("*", *[F.lit("x").alias(name) for name in ("HTML", "payload", "digest", "revisit", "value", "n")])


def test_round_trip(pages):
    assert found(archived(pages)) == expected(ROWS)
    assert archived(pages).schema["refers_to"].dataType.simpleString() == "bigint"


def test_short_payloads_are_all_responses(pages):
    assert found(archived(pages, min_bytes=6)) == expected(ROWS, 6)


def test_payloads_and_urls_come_back(spark, pages):
    path = run_folder(spark, "warc")
    write_archives(pages, path, archive_bytes=1000)
    rows = read_archives(spark, path, payload=True).collect()
    html = {row[0]: row[2] or "" for row in ROWS}
    assert all(bytes(r.payload).decode() == html[int(r.page_id)] for r in rows if r.record_type == "response" and r.page_id)
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    assert {r.url for r in rows if r.page_id in ("2", "3", "4")} == {"http://b.example/%C3%BC%20x%0D%0Ay", None, ""}
    # The long payload has an archive to itself, and so do its neighbours on either side.
    sizes = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len([1 for size in sizes if size.content]) >= 4


def test_every_frame_can_be_read_alone(spark, sf):
    path = run_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf}/pages.parquet").coalesce(1), path)
    (content,) = [bytes(row.content) for row in spark.read.format("binaryFile").load(path).collect()]
    assert content[:4] == DICTIONARY_MARK
    dictionary, begin = dictionary_of(content)
    frames, rest = 0, content[begin:]
    while len(rest) > 8:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        record = one.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert len(list(records_of(archive([record])))) == 1
        rest, frames = one.unused_data, frames + 1
    assert frames == 51 and rest == b"P*M\x18\x00\x00\x00\x00"
    # The dictionary is a trained one and pays for itself.
    html = [row.html.encode() for row in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(page)) for page in html)
    assert dictionary.dict_id() and len(content) - begin < alone


def test_many_repeated_digests_are_joined(pages):
    """Beyond what is sent to every task, the same answer."""
    few, all_ = (sorted(map(tuple, with_responses(pages, max_sent=n).collect()), key=repr) for n in (2, 1000))
    assert few == all_


def test_damage_is_an_error():
    digest = payload_digest(b"payload")
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id(1, digest)}
    good = encoded(fields, b"payload")
    assert [r.block for r in records_of(archive([good, good]))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="cut short"):
        list(records_of(archive([good[:-6]])))
    with pytest.raises(ValueError, match="no record"):
        list(records_of(archive([b"x" + good])))
    damaged = bytearray(archive([good]))
    damaged[-3] ^= 1
    with pytest.raises(zstandard.ZstdError):
        list(records_of(bytes(damaged)))
    assert list(records_of(b"")) == []
    # Without a dictionary, as other writers make them.
    assert [r.block for r in records_of(zstandard.compress(good) * 3)] == [b"payload"] * 3


def test_record_names():
    for page_id in (0, -5, 1 << 60, "a:b>*~ é", "", "*", None):
        assert page_of(record_id(page_id, "D")) == (None if page_id is None else str(page_id))


def test_text_ids(spark):
    rows = [("a*:b", "u", "t"), ("b é", "u", "t"), ("", "u", "s")]
    out = archived(spark.createDataFrame(rows, "page_id string, url string, html string"))
    assert found(out) == expected(rows)


def test_empty(spark):
    out = archived(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and "payload_bytes" in out.columns
