import hashlib

import pytest
import zstandard

from talweg.llm import warc

SF = "/root/testdata/sf0.001"


def brute(rows, least=1000):
    best = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            best[data] = max(best.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = best.get(data) if len(data) >= least and page is not None else None
        again = to is not None and page < to
        out.append(("" if page is None else str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(to) if again else None))
    return sorted(out, key=str)


def trip(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, digest string")
    got = warc.round_trip(df, **options).collect()
    return got, sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str)


def test_pages_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got, told = trip(spark, rows, archive_bytes=20_000)
    assert told == brute(rows)
    html = {str(p): h for p, _, h in rows}
    assert all(r["payload"].decode() == html[r["page_id"]] for r in got if r["record_type"] == "response")
    assert len({r["archive"] for r in got}) > 1


def test_edge_cases(spark):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "http://x/ y\n", None), (2, None, ""), (3, "u", big), (9, "u", big), (5, "u", big), (6, "u", small), (7, "u", small), (None, "u", big), (8, "u", "\r\n\r\n" * 300), (9, "u", big), (10, "u", "z" * 3_000_000)]
    got, told = trip(spark, rows)
    assert told == brute(rows)
    assert {r["url"] for r in got if r["page_id"] == "1"} == {"http://x/%20y%0A"}
    assert trip(spark, [])[1] == []


def test_repeated_ids_with_other_payloads(spark):
    """A copy under a larger id of one payload says nothing of the same id's other payload."""
    one, two, three = "a" * 1500, "b" * 1500, "c" * 1500
    rows = [(1, "u", one), (1, "u", two), (5, "u", one), (2, "u", one), (2, "u", three), (6, "u", three), (2, "u", three)]
    got, told = trip(spark, rows)
    assert told == brute(rows)
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {one, two, three}


def archive():
    dictionary = warc.train_dictionary([b"few"])
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    pages = [warc.page_record(i, "http://x/", body, hashlib.sha1(body).hexdigest()) for i, body in enumerate((b"one", b"", b"three" * 1000))]
    return dictionary, pages, warc.leading_frame(dictionary) + b"".join(squeeze.compress(p) for p in pages)


def test_reader_finds_dictionary_and_frames():
    dictionary, pages, data = archive()
    assert [body for _, body in warc.frames(data)] == pages
    assert [r.payload for r in warc.records(data)] == [b"one", b"", b"three" * 1000]
    plain = b"".join(zstandard.ZstdCompressor().compress(p) for p in pages)
    raw = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    bare = warc.SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary + b"".join(raw.compress(p) for p in pages)
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    for other in (plain, bare, data + skip, plain + skip):
        assert [body for _, body in warc.frames(other)] == pages
    assert list(warc.frames(b"")) == []


@pytest.mark.parametrize("change", [lambda d: d[:-3], lambda d: d + b"junk", lambda d: d[:20], lambda d: d[:-40] + bytes([d[-40] ^ 255]) + d[-39:]])
def test_reader_refuses_damaged_archives(change):
    with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
        list(warc.records(change(archive()[2])))


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"WRAC/1.1"), (b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""), (b"Content-Length: ", b"Content-Length: 1"), (b"one\r\n\r\n", b"two\r\n\r\n"), (b"WARC-Type: ", b"WARC-Type "),
        (b"Content-Type: text/html; charset=utf-8\r\nContent-Length: 3", b"Content-Type: text/html; charset=utf-8\r\nContent-Length: 4"),
    ],
)
def test_records_are_validated(change):
    good = archive()[1][0]
    assert warc.parse(good).payload == b"one"
    assert change[0] in good
    with pytest.raises(warc.ArchiveError):
        warc.parse(good.replace(*change, 1))
