import base64
import hashlib
import io

import pytest
import zstandard

from latent.llm import warc
from latent.session import Workspace
from tests.llm.conftest import prose

SCHEMA = "html string, page_id long, url string, digest string, revisit string, first string"


def pages(spark):
    rows = [(f"<p>{prose(i, 80)}</p>", i, f"http://h{i % 3}.org/{i}\r\nX: y", "d", "r", "f")
            for i in range(40)]
    rows += [(rows[3][0], 100 + i, None, "", "", "") for i in range(30)]
    rows += [("", 200, "u", "", "", ""), (None, 201, "u", "", "", ""), (rows[9][0], -7, "u", "", "", ""),
             (rows[4][0], None, "u", "", "", ""), ("only without id", None, "u", "", "", ""), rows[5],
             ("ÄÖ 日本 🙂" * 3000, 202, "u", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def expected(rows):
    first = {}
    for r in rows:
        t = r.html or ""
        if r.page_id is not None:
            first[t] = min(first.get(t, r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        one = first.get(r.html or "", None)
        revisit = one is not None and one != r.page_id
        out.append((str(r.page_id), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", one if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    docs = pages(spark)
    got = warc.round_trip(docs).collect()
    assert sorted(((str(r.page_id), *r[3:5], r.record_type, r.refers_to) for r in got),
                  key=str) == expected(docs.collect())
    assert {r.url for r in got if r.page_id == 3} == {"http://h0.org/3%0D%0AX: y"}
    assert all(r.url is None for r in got if r.page_id and 100 <= r.page_id < 130)
    assert warc.round_trip(docs.limit(0)).count() == 0


def test_payloads_small_archives_and_least_bytes(spark):
    docs, ws = pages(spark), Workspace(spark)
    listed = warc.write_archives(docs, f"file://{ws.path}/warc", archive_bytes=2000)
    assert listed.count() > 8
    rows = warc.read_archives(listed, payload=True).collect()
    want = {r.page_id: (r.html or "").encode() for r in docs.collect()}
    assert all(bytes(r.payload) == want[r.page_id] for r in rows
               if r.record_type == "response" and r.page_id is not None)
    one = warc.read_archives(warc.write_archives(docs, f"file://{ws.path}/least", min_bytes=10))
    assert {r.record_type for r in one.where("page_id IN (200, 201)").collect()} == {"response"}


def archive(records, dictionary=b"", tail=b""):
    d = dictionary or warc.train_dictionary([])
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    return io.BytesIO(warc.header_frame(d) + b"".join(map(coder.compress, records)) + tail)


GOOD = warc.record(1, "u", b"body", warc.base32(hashlib.sha1(b"body").digest()), None, False, "2000")


@pytest.mark.parametrize("bad", [
    GOOD.replace(b"WARC/1.1", b"WARC/9.9"), GOOD.replace(b"WARC-Date", b"Date"), GOOD[:-1],
    GOOD + b"x", GOOD + GOOD, GOOD.replace(b"body", b"b0dy"), GOOD.replace(b"Length: 4", b"Length: 5"),
    GOOD.replace(b"response\r", b"resource\r", 1), GOOD.replace(b"WARC-Date: ", b"WARC-Date "), b"",
    GOOD.replace(b"<urn:page:1>", b"<urn:x:1>")])
def test_bad_records_are_refused(bad):
    with pytest.raises(ValueError):
        list(warc.read_archive(archive([GOOD, bad])))


def test_streams_and_bad_archives():
    many = list(warc.read_archive(archive([GOOD] * 500), chunk=7))
    assert len(many) == 500 and many[9]["payload"] == b"body"
    whole = archive([GOOD]).getvalue()
    for cut in (whole[:-3], whole[:4], b"x" + whole, whole[:20]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(cut)))
