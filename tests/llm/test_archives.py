import base64
import hashlib

import pytest

from pagelake.llm import arc

PAGES = "page_id long, url string, html string, path string, offset long, record binary"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, b"r") for i, u, h in rows], PAGES)


def expected(rows, least=0):
    full = [(i, u, (h or "").encode()) for i, u, h in rows]
    out = []
    for i, _, p in full:
        same = [j for j, _, q in full if q == p]
        first = max(same)
        again = len(p) >= least and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out)


def converted(spark, rows, least=0):
    got = arc.convert(arc.as_arc(pages(spark, rows), records=7), least)
    return sorted(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ROWS = [(i, f"http://h{i % 3}.test/a b\n{i}", ["<p>x</p>", "", None, f"<p>{i}\r\n\r\nWARC/1.1\n</p>", "é\n\n ü"][i % 5]) for i in range(60)]


@pytest.mark.parametrize("least", [0, 8, 100])
def test_records_come_back(spark, least):
    assert converted(spark, ROWS, least) == expected(ROWS, least)


def test_pages_of_the_corpus(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert converted(spark, rows) == expected(rows)


def test_a_page_with_the_address_of_a_version_block_stays(spark):
    rows = [(1, "filedesc://x.arc", "<p>a</p>"), (2, "http://x/", "<p>a</p>"), (3, "filedesc:", None)]
    assert converted(spark, rows) == expected(rows)


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert converted(spark, []) == []
    got = arc.convert(arc.as_arc(pages(spark, [(None, None, "a"), (4, "http://x/", "a"), (4, "http://x/", "a"), (9, "u", "z" * 400_000)]))).collect()
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in got) == ["(4, 'response', None)", "(4, 'revisit', 4)", "(9, 'response', None)", "(None, 'revisit', 4)"]


def test_both_versions_and_declared_lengths():
    rows = [("http://x/1", 1, "a\nhttp://y/ 0.0.0.0 20240101000000 text/html 5\nb"), ("http://x/2", 2, "")]
    for version in (1, 2):
        read = list(arc.arc_records(arc.arc_file(rows, version, "f.arc")))
        assert [r[1]["URL"] for r in read] == [b"filedesc://f.arc", b"http://x/1", b"http://x/2"]
        assert read[1][2].endswith(b"text/html 5\nb")
        assert set(read[1][1]) == set(arc.FIELDS[version].split())
    with pytest.raises(ValueError):
        list(arc.arc_records(arc.arc_file(rows, 1, "f.arc")[:-40]))


def test_old_records_get_types_and_dates(spark):
    about = f"1 0 x\n{arc.FIELDS[1]}\n"
    old = f"filedesc://o 0.0.0.0 1999 text/plain {len(about)}\n{about}\ndns:h.test 1.2.3.4 199901022303 text/dns 4\nabcd\n\nhttp://h.test/a b 1.2.3.4 19990102030405 text/html 19\nHTTP/1.0 200 OK\r\n\r\n".encode()
    assert [arc.warc_date(r[1]["Archive-date"].decode()) for r in arc.arc_records(old)] == ["1999-01-01T00:00:00Z", "1999-01-02T23:03:00Z", "1999-01-02T03:04:05Z"]
    files = spark.createDataFrame([("o.arc", old)], "path string, content binary")
    got = {r.url: (r.kind, r.content_type, r.payload_bytes) for r in arc.parse_arc(files).collect()}
    assert got == {"dns:h.test": ("resource", "text/dns", 4), "http://h.test/a b": ("response", "text/html", 0)}
    assert {r.record_type for r in arc.convert(files).collect()} == {"resource", "response"}


def test_written_files_are_warc(spark, tmp_path):
    import gzip

    out = f"{tmp_path}/w"
    arc.write_warc(arc.to_warc(arc.as_arc(pages(spark, ROWS), records=7)), out)
    names = sorted(tmp_path.glob("w/part-*.gz"))
    records = [r for n in names for r in arc.warc_records(gzip.decompress(n.read_bytes()), n.name)]
    kinds = [h["WARC-Type"] for h, _ in records]
    assert names and kinds.count("warcinfo") == len(names) and len(kinds) == len(names) + 60
    for h, block in records:
        assert h.get("WARC-Block-Digest", f"sha1:{arc.digest(block)}") == f"sha1:{arc.digest(block)}"
    assert len({h["WARC-Record-ID"] for h, _ in records}) == len(records)
