import base64
import gzip
import hashlib

import duckdb
from pyspark.sql import functions as F

from vastgrain.llm import common, warc
from vastgrain.llm.queries import ORACLE_SQL, op5_warc

TRAP = "<html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</html>"
PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", TRAP), (3, None, "<p>é</p>"), (4, "http://d/ x", None), (5, "http://e/", ""), (6, "http://f/", "<p>é</p>"), (7, "http://g/", "x" * 300_000)]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def save(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))


def test_round_trip(spark, tmp_path):
    save(spark, tmp_path, PAGES)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc(spark, str(tmp_path)).collect()}
    keeper = {}
    for i, _, html in PAGES:
        keeper[html or ""] = max(i, keeper.get(html or "", 0))
    want = {i: (len((h or "").encode()), digest(h), "response" if keeper[h or ""] == i else "revisit", None if keeper[h or ""] == i else keeper[h or ""]) for i, _, h in PAGES}
    assert got == want


def test_nested_captures_hold_payloads(spark, tmp_path):
    save(spark, tmp_path, PAGES)
    warc.write_archive(spark.read.parquet(str(tmp_path / "pages.parquet")), str(tmp_path / "a"), records_per_file=4, min_bytes=1, compression="none")
    rows = warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == len(PAGES) and all(r.n_records == 3 and r.request and r.metadata for r in rows)
    payloads = sorted(bytes(r.response.payload) for r in rows if r.response.type == "response")
    assert payloads == sorted([b"", b"", TRAP.encode(), "<p>é</p>".encode(), b"x" * 300_000])


def by_sql(folder):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return sorted(con.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({ORACLE_SQL['op5_warc']}) q").fetchall(), key=str)


def by_archive(spark, folder):
    return sorted(map(tuple, op5_warc(spark, str(folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_empty(spark, tmp_path):
    save(spark, tmp_path, [])
    assert op5_warc(spark, str(tmp_path)).count() == 0


def test_every_row_is_a_capture(spark, tmp_path):
    """Repeated rows, null ids with and without a twin, one id with two payloads, several ids of one payload."""
    rows = [*PAGES, PAGES[0], PAGES[1], PAGES[1], (None, "http://n/", "alone"), (None, "http://n/", "<p>é</p>"), (None, None, None), (None, None, "two"), (None, None, "two"), (7, "http://g/", "other"), (-3, "u", "other")]
    save(spark, tmp_path, rows)
    got = by_archive(spark, tmp_path)
    assert len(got) == len(rows) and got == by_sql(tmp_path)
    assert sum(r[3] == "response" for r in got) == len({h or "" for _, _, h in rows})


def test_columns_of_other_names_are_left_alone(spark, tmp_path):
    rows = [(*p, "a", 1, "b", "c", 2) for p in PAGES]
    schema = "page_id long, url string, html string, payload string, __row long, capture_id string, keeper string, payload_bytes int"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
    assert by_archive(spark, tmp_path) == by_sql(tmp_path)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (500, 2000))
    pages = [(i, f"http://{i}/", chr(65 + i % 26) * n) for i, n in enumerate([100] * 60 + [900] * 20 + [9000] * 5)]
    pages = [(i, u, f"{i}{h}") for i, u, h in pages]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    warc.write_archive(spark.read.parquet(str(tmp_path / "pages.parquet")), str(tmp_path / "a"), compression="none")
    for file in (tmp_path / "a").rglob("*.txt"):
        payloads = [b for h, b in warc.parse(file.read_bytes()) if h["warc-type"] == "response"]
        assert len(payloads) <= 1 or sum(map(len, payloads)) < 4000 + 150 * len(payloads)
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).count() == len(pages)


def test_without_the_filter(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1)
    save(spark, tmp_path, [*PAGES, PAGES[0]])
    assert by_archive(spark, tmp_path) == by_sql(tmp_path)


def test_parses_members_and_folded_headers():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one.replace(b"hello", b"WARC/"))
    assert [(h["x"], b) for h, b in warc.parse(data)] == [("a b", b"hello"), ("a b", b"WARC/")]


def test_base32(spark):
    got = spark.range(50).select("id", warc.base32_sha1(F.sha1(F.col("id").cast("string"))).alias("d")).collect()
    assert all(r.d == digest(str(r.id)) for r in got)
