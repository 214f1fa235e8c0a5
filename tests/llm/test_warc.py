import struct

import pytest
import zstandard

from formspark.llm import common, warc


def test_write_and_read_back(spark):
    long = "<p>é</p>" * 20_000
    rows = [(5, "http://a/1", "x", 1), (3, None, "x", 2), (7, "u", None, 3), (8, "u", "", 4), (None, "w", "x", 5), (None, "w", "only", 6), (1, "z", long, 7), (2, "z", long, 8), (2, "z", long, 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    path = common.shared_folder(spark, "warc")
    warc.write_archives(df.repartition(2), path)
    out = warc.read_archives(spark, path).collect()
    assert len(out) == 9
    by = {}
    for r in out:
        by.setdefault(r["record_id"], []).append(r)
    assert by["<urn:x-page:5>"][0]["refers_to"] == "<urn:x-page:3>" and by["<urn:x-page:3>"][0]["record_type"] == "response"
    assert by["<urn:x-page:8>"][0]["refers_to"] == "<urn:x-page:7>" and by["<urn:x-page:8>"][0]["payload_bytes"] == 0
    assert [r["refers_to"] for r in by["<urn:x-page:2>"]] == ["<urn:x-page:1>"] * 2
    assert bytes(by["<urn:x-page:1>"][0]["payload"]).decode() == long
    assert by["<urn:x-page:2>"][0]["payload_bytes"] == len(long.encode()) and bytes(by["<urn:x-page:2>"][0]["payload"]) == b""
    assert {r["refers_to"] for r in by["<urn:x-page:none>"]} == {None, "<urn:x-page:3>"}
    assert by["<urn:x-page:3>"][0]["payload_digest"] == warc.digest(b"x")


def test_archives_roll_and_common_payloads_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "COMMON", 4)
    rows = [(i, f"http://h/{i}", None if i % 3 == 0 else f"<p>{i % 50} {'x' * (i % 40)}</p>") for i in range(400)]
    path = common.shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").collect()
    assert len(files) > 4 and all(bytes(f["content"])[:4] == struct.pack("<I", warc.DICTIONARY_MAGIC) for f in files)
    got = {r["record_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 400
    for i, _, html in rows:
        first = min(j for j, _, other in rows if (other or "") == (html or ""))
        r = got[f"<urn:x-page:{i}>"]
        assert r["refers_to"] == (None if first == i else f"<urn:x-page:{first}>") and r["payload_digest"] == warc.digest((html or "").encode())


def test_query_agrees_with_its_sql(spark):
    import duckdb

    from formspark.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    out = warc.op8_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(con.execute(queries.ORACLE["op8_warc"]).fetchall(), key=str)


def test_empty_table(spark):
    path = common.shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(*records, dictionary=b"WARC/1.1 dictionary " * 50, packed=True):
    frame = warc.dictionary_frame(dictionary) if packed else struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return frame + warc.SEPARATOR.join(c.compress(r) for r in records)


def test_frames_and_dictionary():
    a, b = warc.record(1, "u", b"one", None), warc.record(2, "u", b"two" * 100_000, None)
    for packed in (True, False):
        assert list(warc.frames(archive(a, b, packed=packed))) == [a, b]
    plain = zstandard.ZstdCompressor().compress(a)
    assert list(warc.frames(plain + plain)) == [a, a]
    assert list(warc.frames(b"")) == []


@pytest.mark.parametrize("broken", [lambda x: x[:-3], lambda x: x + b"junk", lambda x: x + b"\x00" * 12, lambda x: x[:9]])
def test_damaged_archives_raise(broken):
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(broken(archive(warc.record(1, "u", b"one", None)))))


@pytest.mark.parametrize(("old", "new"), [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Date", b"X-Date"), (b"\r\n\r\n\r\n", b"\r\n"), (b"one", b"two"), (b"WARC-Type:", b"WARC-Type")])
def test_invalid_records_raise(old, new):
    good = warc.record(1, "u", b"one\r\n", None)
    warc.http_payload(*warc.parse(good))
    with pytest.raises(ValueError):
        warc.http_payload(*warc.parse(good.replace(old, new)))
