import base64
import gzip
import hashlib
import tempfile

import pytest

from demandspark.llm.warc import arc_records, arc_to_warc, archives, converted, iso_date, read_warc, warc_records, write_arc

DDL = "page_id long, url string, html string"


def pages():
    big = "<p>é\r\n\r\nWARC/1.0\r\n</p>" * 5000
    rows = [(i, f"http://h/{i}?a b", f"<html>{i % 7}\r\n\r\n</html>") for i in range(40)]
    rows += [(50, None, None), (51, "http://e", ""), (52, "http://e", ""), (60, "http://big", big), (61, "http://big2", big), (62, "u", "dns\n\n")]
    return rows + [(None, "http://n", "no id"), (None, None, None), (70, "http://once", "filedesc://x 1 2 3 4\n")]


def brute(rows, min_bytes=0):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= min_bytes:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = best.get(h or "")
        revisit = len(data) >= min_bytes and to is not None and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5, 10**9])
def test_round_trip(spark, min_bytes):
    base = tempfile.mkdtemp()
    df = spark.createDataFrame(pages(), DDL).repartition(3)
    write_arc(df, f"{base}/arc")
    arc_to_warc(archives(spark, f"{base}/arc"), f"{base}/warc", min_bytes)
    back = read_warc(spark, f"{base}/warc").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == brute(pages(), min_bytes)
    html = {r[0]: (r[2] or "").encode() for r in pages()}
    assert all(bytes(r.payload) == html[r.page_id] for r in back if r.record_type == "response" and r.page_id is not None)
    assert len({r.record_id for r in back}) == len(back)


def test_repeated_pages_leave_one_response(spark):
    base = tempfile.mkdtemp()
    write_arc(spark.createDataFrame([(1, "u", "x")] * 4, DDL).repartition(2), f"{base}/arc")
    arc_to_warc(archives(spark, f"{base}/arc"), f"{base}/warc")
    kinds = sorted(r.record_type for r in read_warc(spark, f"{base}/warc").collect())
    assert kinds == ["response", "revisit", "revisit", "revisit"]


def test_no_pages(spark):
    base = tempfile.mkdtemp()
    write_arc(spark.createDataFrame([], DDL), f"{base}/arc")
    arc_to_warc(archives(spark, f"{base}/arc"), f"{base}/warc")
    assert read_warc(spark, f"{base}/warc").count() == 0


def test_both_versions_and_other_records():
    v1 = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    v2 = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    one = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n%b\n" % (len(v1), v1)
    one += b"http://x/a b c 1.2.3.4 199609231421 text/html 12\nHTTP/1.0 200\n"[:-1] + b"\n"
    two = b"filedesc://b.arc 0.0.0.0 20000101000000 text/plain 200 - - 0 b.arc %d\n%b\n" % (len(v2), v2)
    two += b"dns:example.org 1.2.3.4 20000102030405 text/dns 200 - - 99 b.arc 3\nabc\n"
    recs = list(arc_records(gzip.compress(one[: len(one) // 2]) + gzip.compress(one[len(one) // 2 :])))
    assert [h["URL"] for h, _, _ in recs] == ["filedesc://a.arc", "http://x/a b c"] and recs[1][2] == b"HTTP/1.0 200"
    recs = list(arc_records(gzip.compress(two)))
    assert recs[1][0]["Result-code"] == "200" and recs[1][2] == b"abc"
    assert [converted(h, at, b, "f", True)[1] for h, at, b in recs] == ["warcinfo", "resource"]
    assert iso_date("199609231421") == "1996-09-23T14:21:00Z" and iso_date("19960923") == "1996-09-23T00:00:00Z"
    with pytest.raises(ValueError):
        list(arc_records(gzip.compress(two[:-3])))
    with pytest.raises(ValueError):
        list(warc_records(gzip.compress(b"nothing\r\n")))
