import base64
import hashlib
import struct

import pytest
import zstandard

from tillwise.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, sha string, n int, refers_to string"


def pages():
    rows = [(k, f"http://h.example/{k}?a=b c", f"<html>{'text é ' * (k % 5)}{k % 11}</html>") for k in range(120)]
    rows += [(200, None, None), (201, "u\r\nX: y", ""), (202, "u", None), (None, "n", "only null id"), (203, "u", "x" * 300_000)]
    rows += [rows[3], rows[119], (None, "n", rows[0][2])]
    return [(*row, "p", "s", 1, "r") for row in rows]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    W.write_archives(W.with_revisits(spark.createDataFrame(pages(), SCHEMA).repartition(3)), path)
    return path


def expected(least=0):
    first = {}
    for number, _, html, *_ in pages():
        body = (html or "").encode()
        if number is not None:
            first[body] = max(first.get(body, number), number)
    out = []
    for number, _, html, *_ in pages():
        body = (html or "").encode()
        lead = first.get(body) if len(body) >= least else number
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = number == lead
        out.append((str(number), len(body), digest, "response" if same else "revisit", None if same else lead))
    return sorted(out, key=str)


def fields(rows):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_round_trip(spark, archive):
    found = W.read_archives(spark, archive).collect()
    assert fields(found) == expected()
    bodies = {r.page_id: r.payload.decode() for r in found if r.record_type == "response"}
    texts = {number: html or "" for number, _, html, *_ in pages()}
    assert all(bodies[number] == texts[number] for number in bodies if number is not None)
    assert all(r.error is None and r.date == W.DATE for r in found)
    assert {r.payload for r in W.read_archives(spark, archive, payloads=False).collect()} == {None}


def test_short_payloads_can_be_left_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    W.write_archives(W.with_revisits(spark.createDataFrame(pages(), SCHEMA), least_bytes=20), path)
    assert fields(W.read_archives(spark, path, payloads=False).collect()) == expected(20)


def files(archive):
    from pathlib import Path

    return [p for p in Path(archive).glob("part-*") if p.stat().st_size]


def test_archives_are_one_frame_per_record_after_a_dictionary(archive):
    total = 0
    for path in files(archive):
        data = path.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == W.DICTIONARY and data[8:12] == W.DICTIONARY_START
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        records = list(W._records(memoryview(data)))
        # Any Zstandard reader that knows the dictionary sees the records one after the other.
        with reader.stream_reader(data, read_across_frames=True) as whole:
            assert whole.read() == b"".join(records)
        assert all(one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") for one in records)
        total += len(records)
    assert total == len(pages())


@pytest.mark.parametrize(
    "change, says",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), "content length"),
        (lambda r: r.replace(b"WARC-Date", b"WARC-Data"), "warc-date"),
        (lambda r: r.replace(b"html>", b"HTML>"), "digest"),
        (lambda r: r[:-1], "content length"),
        (lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), "header line"),
        (lambda r: b"WARC/1.1\r\nno end", "no end"),
    ],
)
def test_wrong_records_are_found(change, says):
    good = W.record(7, "http://a", b"<html>body</html>", None, W.DATE)
    assert W.parse(good)["page_id"] == 7
    with pytest.raises(ValueError, match=says):
        W.parse(change(good))


def test_broken_archives_stop_or_are_reported(spark, archive, tmp_path):
    data = files(archive)[0].read_bytes()
    (tmp_path / "cut.warc.zst").write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends inside a frame"):
        W.read_archives(spark, str(tmp_path)).collect()
    found = W.read_archives(spark, str(tmp_path), strict=False).collect()
    assert [r.error for r in found if r.error] == ["the archive ends inside a frame"]
    assert len(found) == len(list(W._records(memoryview(data))))


def test_archive_without_dictionary_and_empty_ones(spark, tmp_path):
    plain = zstandard.ZstdCompressor()
    records = [W.record(k, None, b"x" * k, None, W.DATE) for k in range(3)]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(plain.compress(r) for r in records))
    (tmp_path / "b.warc.zst").write_bytes(b"")
    found = W.read_archives(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.payload, r.url) for r in sorted(found)] == [(k, b"x" * k, "about:blank") for k in range(3)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    W.write_archives(W.with_revisits(spark.createDataFrame([], SCHEMA)), path)
    assert W.read_archives(spark, path).count() == 0
