import re
import threading
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vastgrain.sources import http


class Ranged(SimpleHTTPRequestHandler):
    asked: list = []
    broken = ""

    def log_message(self, *args):
        pass

    def do_GET(self):
        wanted = re.fullmatch(r"bytes=(\d*)-(\d*)", self.headers.get("Range", ""))
        path = Path(self.translate_path(self.path))
        if not wanted or path.is_dir():
            return super().do_GET()
        data = path.read_bytes()
        a, b = wanted.groups()
        first, last = (int(a), min(len(data) - 1, int(b or len(data) - 1))) if a else (max(0, len(data) - int(b)), len(data) - 1)
        Ranged.asked.append((path.name, first, last, self.headers.get("Authorization")))
        if Ranged.broken == "shift":
            first += 1
        body = data[first : last + 1]
        if Ranged.broken == "short":
            Ranged.broken = ""
            body = body[:-1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {first}-{last}/{len(data)}")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture()
def served(tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Ranged, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Ranged.asked, Ranged.broken = [], ""
    yield tmp_path, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def table(n, first=0):
    return pa.table({"id": range(first, first + n), "wide": [f"{i * 7919 % 1000003}" * 30 for i in range(n)], "v": [i * 0.5 for i in range(n)]})


def test_ranged_file(served):
    folder, url = served
    data = bytes(i * i % 251 for i in range(300_000))
    (folder / "x.bin").write_bytes(data)
    f = http.RangedFile(f"{url}/x.bin", block=4096, cache=16 * 4096, token="t")
    assert f.length == len(data) and Ranged.asked == [("x.bin", len(data) - http.FOOTER, len(data) - 1, "Bearer t")]
    for at, n in ((0, 10), (4090, 20), (100_000, 50_000), (299_990, 100), (5, 3)):
        f.seek(at)
        assert f.read(n) == data[at : at + n]
    assert f.seek(-10, 2) == len(data) - 10 and f.read() == data[-10:] and len(f.blocks) <= 16
    before = f.stats()["fetches"]
    f.ranges([(40_000, 50_000), (60_000, 70_000)])
    assert f.stats()["fetches"] == before + 1
    f.seek(65_000)
    assert f.read(10) == data[65_000:65_010] and f.stats()["fetches"] == before + 1
    Ranged.broken = "short"
    f.seek(20_000)
    assert f.read(10) == data[20_000:20_010]
    Ranged.broken = "shift"
    f.seek(200_000)
    with pytest.raises(http.RangeRefused):
        f.read(10)


def test_remote_parquet_reads_only_what_is_asked_for(served, spark):
    folder, url = served
    for k in range(2):
        pq.write_table(table(4000, 4000 * k), folder / f"{k}.parquet", row_group_size=1000, compression="none")
    urls = [f"{url}/{k}.parquet" for k in range(2)]
    whole = http.open_urls(spark, urls)
    assert whole.count() == 8000 and whole.columns == ["id", "wide", "v"] and whole.selectExpr("sum(id)").first()[0] == sum(range(8000))
    Ranged.asked = []
    few = http.open_urls(spark, urls, columns=["v"], where=("id", 2500, 2600))
    assert few.rdd.getNumPartitions() == 1 and sorted(r.v for r in few.collect()) == [i * 0.5 for i in range(2500, 2601)]
    size = (folder / "0.parquet").stat().st_size
    assert sum(b - a + 1 for _, a, b, _ in Ranged.asked if b - a + 1 != http.FOOTER) < 2.2 * http.BLOCK and size > 600_000


def test_footers(served):
    folder, url = served
    pq.write_table(table(100), folder / "a.parquet")
    (footer, stats) = http.footers([f"{url}/a.parquet"])[0]
    assert footer.num_rows == 100 and stats["fetches"] == 1


def test_remote_tree(served, spark):
    folder, url = served
    for path in ("a.txt", "d/b.txt", "d/e/c c.csv"):
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text("x" * len(path))
    rows = http.list_tree(spark, url).collect()
    assert {(r.path, r.size) for r in rows} == {("a.txt", 5), ("d/b.txt", 7), ("d/e/c c.csv", 11)}
    assert [r.path for r in http.list_tree(spark, url, include="*.csv", sizes=False).collect()] == ["d/e/c c.csv"]
    assert {r.path for r in http.list_tree(spark, url, max_depth=0).collect()} == {"a.txt"}
    with pytest.raises(ValueError):
        http.list_tree(spark, url, max_files=1)
