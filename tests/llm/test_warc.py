import gzip
import hashlib
from pathlib import Path

import pytest

from tidyspark.llm import warc


def expected(rows, least=1000):
    by = {}
    for key, _, html in rows:
        if html and len(html.encode()) >= least and key is not None:
            by[html] = max(by.get(html, key), key)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        to = by.get(html)
        revisit = to is not None and key is not None and to != key
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, "http://c", "x" * 999), (4, None, "x" * 999), (5, "u", None), (6, "u", ""),
    (7, "bad\r\nurl", "line\r\n\r\nline\nWARC/1.1\r\nWARC-Type: response\r\n" * 60), (8, "é", "é漢🎉\0" * 3000), (9, "z", "WARC/1.1\r\n"),
    (10, "z", "\r\n"), (11, "z", "\n" * 2500), (11, "z", "\n" * 2500), (12, "z", "\n" * 2500),
]


@pytest.mark.parametrize("chunk", [7, 100, 1 << 20])
def test_round_trip(spark, tmp_path, chunk):
    pages = spark.createDataFrame([(*r, 1, "n") for r in ROWS], "page_id long, url string, html string, raw int, key string").repartition(3)
    got = warc.round_trip(pages, str(tmp_path / "w"), chunk=chunk, per_file=50)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS)


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), chunk=100)
    data = b"".join(gzip.open(p).read() for p in sorted(Path(tmp_path / "w").glob("part-*")))
    n = 0
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(head.partition(b"Content-Length: ")[2])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n > len(ROWS)


def test_table_and_empty(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in warc.round_trip(pages, str(tmp_path / "a"), chunk=4096).collect()), key=str) == expected(rows)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_lost_segment_raises(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), chunk=100)
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).where("chunk_no != 2")
    with pytest.raises(Exception, match="lacks segment"):
        warc.digest_records(chunks).collect()
