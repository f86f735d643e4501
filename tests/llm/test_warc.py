import gzip
import hashlib
import io
import random

import pytest

from modgraph.llm import warc

SCHEMA = "page_id bigint, url string, html string, first bigint"


def brute(rows):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = min((p for p, _, h, _ in rows if p is not None and (h or "").encode() == data), default=None)
        revisit = len(data) >= 100 and page is not None and same != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", same if revisit else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    bodies = ["<p>" + "é" * rng.randint(30, 80) + "</p>" for _ in range(12)] + [None, "", "short", "\r\n\r\n" * 40, "x" * 2_000_000, "y" * 99, "z" * 100]
    rows = [(i * 7 % 90, f"http://a.example/{i}", rng.choice(bodies), 1) for i in range(90)]
    rows += [(500, None, "x" * 2_000_000, 1), (501, "http://a b\r\nc", "q" * 150, 1), (502, "u", "q" * 150, 1), (502, "u", "q" * 150, 1), (501, "again", "q" * 150, 1), (None, None, None, None), (None, "u", "q" * 150, 1)]
    return rows


def test_round_trip(spark):
    rows = pages()
    archives = warc.write_pages(spark.createDataFrame(rows, SCHEMA))
    got = warc.read_pages(archives).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)


def test_archives_hold_one_gzip_member_per_record_and_whole_payloads(spark, tmp_path):
    rows = pages()[:30]
    archives = warc.write_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}")
    path = archives.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    records = list(warc.members(io.BytesIO(data)))
    assert b"".join(records) == gzip.decompress(data)
    payloads = {}
    for record in records:
        headers, _, payload = warc.parse_record(record)
        if headers["warc-type"] == "response":
            payloads[int(headers["x-page"])] = payload
        else:
            assert not payload and headers["warc-profile"] == warc.PROFILE
    for page, _, html, _ in rows:
        if page in payloads:
            assert payloads[page] == (html or "").encode()


def test_small_reads_frame_records_alike(monkeypatch):
    records = [warc.make_record(i, "u", b"a" * i, None, "d") for i in range(20)]
    data = b"".join(map(warc.gzip_member, records))
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert list(warc.members(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_damage_is_found():
    record = warc.make_record(1, "u", b"payload", None, "d")
    for bad in (record.replace(b"payload", b"paYload"), record[:-1], record + b"x", b"nothing"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_empty_table(spark):
    assert warc.read_pages(warc.write_pages(spark.createDataFrame([], SCHEMA))).count() == 0


def test_record_ids_are_unique_and_revisits_name_a_response(spark, tmp_path):
    warc.write_pages(spark.createDataFrame(pages(), SCHEMA).repartition(3), f"file://{tmp_path}").collect()
    ids, referred = {}, []
    for path in tmp_path.glob("*.warc.gz"):
        with open(path, "rb") as stream:
            for record in warc.members(stream):
                headers, _, _ = warc.parse_record(record)
                assert headers["warc-record-id"] not in ids
                ids[headers["warc-record-id"]] = headers
                if "warc-refers-to" in headers:
                    referred.append(headers)
    assert len(ids) == len(pages()) and len(referred) > 20
    for h in referred:
        to = ids[h["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["x-page"] == h["x-refers-to-page"] and to["warc-payload-digest"] == h["warc-payload-digest"]
