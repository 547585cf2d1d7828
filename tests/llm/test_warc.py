"""Operator 12: archives written and read back."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from acreage.llm import oracles, warc
from acreage.llm.queries import QUERIES

LONG = "<p>" + "ä" * 200_000 + "</p>"
ROWS = [(7, "http://a/7", "x" * 100), (3, "http://a/3", "x" * 100), (9, None, "x" * 100), (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99),
        (4, "http://a/4\r\nX: y", LONG), (5, "http://ü/5", LONG), (6, "u", None), (8, "u", ""), (None, "n", "x" * 100), (10, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 9),
        (12, "d", "d" * 200), (11, "d", "d" * 200), (11, "d", "d" * 200)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        first = min(same) if len(data) >= 100 and same and key is not None else key
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if first != key else "response", first if first != key else None))
    return sorted(map(repr, out))


def result(rows):
    return sorted(repr((r["page_id"] and int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_page"] and int(r["refers_to_page"])))
                  for r in rows.collect())


@pytest.fixture(scope="module")
def manifest(spark):
    return warc.write(pages(spark).repartition(3), date="2024-01-01T00:00:00Z")


def test_records_read_back(manifest):
    assert result(warc.records(manifest)) == expected(ROWS)


def test_chunks_hold_the_payloads_and_carry_digests(manifest):
    parts = {}
    for r in warc.chunks(manifest, size=1000).orderBy("path", "record_id", "chunk").collect():
        if r["record_type"] == "response" and r["page_id"] != "11":
            assert len(r["data"]) <= 1000
            data = parts.setdefault(r["page_id"], bytearray())
            data += r["data"]
            assert (len(data), hashlib.sha256(data).hexdigest()) == (r["payload_bytes"], r["payload_digest"])
    for key, html in (("4", LONG), ("3", "x" * 100), ("6", ""), ("8", ""), ("10", ROWS[10][2]), (None, "x" * 100)):
        assert bytes(parts[key]) == html.encode()


def test_no_record_reaches_python_whole(spark):
    rows = warc.chunked(warc.plan(pages(spark)), 1024)
    got = rows.agg(F.max(F.octet_length("data")).alias("m"), F.max("chunk").alias("c")).first()
    assert got["m"] == 1024 and got["c"] == (len(LONG.encode()) - 1) // 1024


def test_archive_format(manifest):
    text = b"".join(gzip.open(r["path"].removeprefix("file:")).read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) + manifest.count()
    assert b"WARC-Target-URI: http://a/4%0D%0AX: y\r\n" in text
    assert b"WARC-Profile: " + warc.PROFILE.encode() in text


def test_revisits_refer_to_responses(manifest):
    assert warc.dangling(manifest).count() == 0
    rows = warc.records(manifest).collect()
    ids = {r["record_id"]: r["page_id"] for r in rows if r["record_type"] == "response"}
    assert all(ids[r["refers_to"]] == r["refers_to_page"] for r in rows if r["record_type"] == "revisit")


def test_damage_is_found(spark, tmp_path):
    m = warc.write(pages(spark).coalesce(1), folder=f"file://{tmp_path}/w")
    path = m.first()["path"].removeprefix("file:")
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) - 40])
    with pytest.raises(Exception, match="cut off"):
        warc.records(m).count()


def test_empty_table_and_clashing_names(spark):
    m = warc.write(pages(spark).limit(0))
    assert m.count() == 0 and warc.records(m).count() == 0 and warc.chunks(m).count() == 0
    odd = pages(spark).selectExpr("*", "1 as payload", "2 as first", "3 as chunk", "4 as record_id", "5 as refers_to")
    assert result(warc.records(warc.write(odd))) == expected(ROWS)


def test_query_equals_sql(spark):
    from acreage.plans.check import duck
    sf = "/root/testdata/sf0.001"
    e = duck(sf).execute(oracles.WARC)
    names = [c[0] for c in e.description]
    assert sorted(map(repr, e.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES["op12_warc"](spark, sf).select(*names).collect())
