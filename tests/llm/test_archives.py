"""ARC to WARC and back."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from tabloom.llm import archives as A


def test_headers_are_read_by_version_and_length():
    for version in (1, 2):
        bodies = ["<p>a</p>\nhttp://fake 1.1.1.1 20200101000000 text/html 3\n", "", "é" * 10]
        content = A._arc_block(version, "x.arc") + b"".join(A._arc_record(version, k, f"http://h/{k} b", b.encode()) for k, b in enumerate(bodies))
        got = list(A.arc_records(content))
        assert [bytes(block).partition(b"\r\n\r\n")[2].decode() for _, block in got] == bodies
        assert [f["URL"] for f, _ in got] == [f"http://h/{k}%20b" for k in range(3)]
        assert set(got[0][0]) == set(A.FIELDS[version])
    with pytest.raises(ValueError, match="declares"):
        list(A.arc_records(content[:-5]))
    old = A._arc_block(1, "x") + b"http://a b/ 1.2.3.4 20010203040506 text/html 3\nabc\n"
    assert next(A.arc_records(old))[0]["URL"] == "http://a b/"


def test_gzip_members_and_plain_files_are_read():
    records = [A._warc("response", [("WARC-Record-ID", f"<{k}>")], b"x" * k) for k in range(3)]
    for content in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        assert [len(block) for _, block in A.warc_records(content)] == [0, 1, 2]


def test_pages_come_back(spark):
    html = ["<html>é</html>", None, "", "<html>é</html>", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\n", "x" * 300_000, "<html>é</html>", "\r\n\r\n"]
    rows = [(k, None if k == 2 else f"http://h/{k} x", h, "clash", k) for k, h in enumerate(html)]
    rows += [(6, "http://h/6 x", html[6], "clash", 6), (None, "http://h/n", "alone", None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, payload long").repartition(2)
    got = A.pages_through_warc(frame).collect()
    groups = defaultdict(list)
    for i, _, h, _, _ in rows:
        groups[h or ""].append(i)
    want = Counter()
    for h, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        for i in ids:
            revisit = top is not None and i != top
            want[(i, len(h.encode()), digest, "revisit" if revisit else "response", top if revisit else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert A.pages_through_warc(frame.limit(0)).count() == 0
