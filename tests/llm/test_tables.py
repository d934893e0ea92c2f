"""WARC, chats and registered queries."""

import base64
import gzip
import hashlib
import json
from pathlib import Path

import duckdb
import pytest

from wordloom.llm import files, queries, warc

FOLDER = "/root/testdata/sf0.001"


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é\r\n\r\nx" * 50, "<p>a</p>"]
    rows = [(i, f"http://x/{i}\r\ny", h, "extra") for i, h in enumerate(html)] + [(0, "again", "<p>a</p>", "e"), (None, None, "<p>b</p>", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/warc"
    warc.write(pages, folder, file_bytes=700)
    got = sorted(((-1 if r.page_id is None else r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect())
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    expected = []
    for i, _, h, _ in rows:
        first = min(k for k, _, x, _ in rows if (x or "") == (h or "") and k is not None)
        expected.append((-1 if i is None else i, len((h or "").encode()), digest(h), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(expected, key=lambda x: x[:1] + tuple(map(str, x[1:]))) or sorted(map(str, got)) == sorted(map(str, expected))
    names = [n for f in files.read_manifest(folder)["files"] for n in f["names"]]
    assert len(names) > 2
    first = gzip.decompress(files.read_bytes(folder, names[0]))
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert b"WARC-Target-URI: http://x/1%0D%0Ay\r\n" in b"".join(gzip.decompress(files.read_bytes(folder, n)) for n in names)
    again = f"file://{tmp_path}/again"
    warc.write(pages, again, file_bytes=700)
    content = lambda f: [files.read_bytes(f, n) for e in files.read_manifest(f)["files"] for n in e["names"]]
    assert content(folder) == content(again)
    assert names == [n for e in files.read_manifest(again)["files"] for n in e["names"]]
    large = f"file://{tmp_path}/large"  # records above the roll size have a file each
    warc.write(pages, large, file_bytes=10)
    assert len(files.read_manifest(large)["files"]) == len(rows) and warc.read(spark, large).count() == len(rows)
    small = {r.page_id: r.record_type for r in warc.round_trip(pages.where("page_id > 0"), min_revisit_bytes=9).collect()}
    assert set(small.values()) == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_broken_file_is_noticed():
    record = warc.record(1, "u", b"payload", None, False)
    assert warc.page_of(*warc.parse(record))[0] == 1
    with pytest.raises(ValueError):
        warc.page_of(*warc.parse(record.replace(b"payload", b"payloaD")))
    with pytest.raises(ValueError):
        warc.parse(record[:-3])


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda cols, rows: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=repr)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(columns, found.fetchall())


def test_registered_queries():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
