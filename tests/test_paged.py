"""The paged source against a small HTTP feed: requests are counted, filters reach it, streams go on where they stopped."""

from __future__ import annotations

import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from slopewatch.sources import paged

ROWS = [{"fechaobservacion": f"2024-01-{i % 28 + 1:02d}", "municipio": ["Medellín", "MEDELLIN", "Bello"][i % 3], "valorobservado": i, "codigoestacion": None if i % 50 == 0 else f"s{i}"} for i in range(1000)]


class Feed(BaseHTTPRequestHandler):
    """Rows with $where (clauses of >=, <, like and upper), $limit and $offset."""

    def do_GET(self):  # noqa: N802
        asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        rows = self.server.rows
        for clause in asked.get("$where", "1=1").split(" and "):
            if m := re.fullmatch(r"(\w+) (>=|<) '(.*)'", clause):
                rows = [r for r in rows if (str(r[m[1]]) >= m[3]) == (m[2] == ">=")]
            elif m := re.fullmatch(r"(?:upper\((\w+)\)|(\w+)) like '%(.*)%'", clause):
                rows = [r for r in rows if m[3] in (r[m[1]].upper() if m[1] else r[m[2]] or "")]
        first = int(asked["$offset"])
        rows = rows[first : first + int(asked["$limit"])]
        self.server.asked.append((asked.get("$where"), len(rows)))
        body = json.dumps(rows).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def feed():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    server.rows, server.asked = list(ROWS), []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_port}/rows?$where={{where}}&$limit={{limit}}&$offset={{offset}}"
    yield server
    server.shutdown()


def test_filters_reach_the_feed(spark, feed):
    rows = paged.feed(spark, feed.url, limit=100, cap=2000, stride=30, upper="municipio")
    assert rows.count() == 1000
    requests, sent = len(feed.asked), sum(n for _, n in feed.asked)
    assert (requests, sent) == (11, 1000)
    feed.asked.clear()
    wanted = rows.filter((F.col("fechaobservacion") >= "2024-01-20") & F.col("municipio").like("%MEDELL%") & (F.col("valorobservado").cast("int") % 2 == 0))
    got = sorted(int(r.valorobservado) for r in wanted.collect())
    assert got == [i for i, r in enumerate(ROWS) if r["fechaobservacion"] >= "2024-01-20" and "MEDELL" in r["municipio"] and i % 2 == 0]
    assert {w for w, _ in feed.asked} == {"fechaobservacion >= '2024-01-20' and upper(municipio) like '%MEDELL%'"}
    assert sum(n for _, n in feed.asked) == sum(r["fechaobservacion"] >= "2024-01-20" and "MEDELL" in r["municipio"].upper() for r in ROWS)
    assert len(feed.asked) < requests


def test_what_the_feed_cannot_be_asked_is_left_to_spark(spark, feed):
    rows = paged.feed(spark, feed.url, limit=500, cap=1000)
    assert rows.filter("codigoestacion is null").count() == 20
    assert rows.filter("codigoestacion like 's1_'").count() == 10
    assert rows.filter("municipio = 'Bello' or valorobservado = '0'").count() == len([r for r in ROWS if r["municipio"] == "Bello"]) + 1
    feed.asked.clear()
    assert rows.filter("codigoestacion in ('s1', 's2', 's3000') and municipio <> 'it''s'").count() == 2
    assert {w for w, _ in feed.asked} == {"codigoestacion in ('s1', 's2', 's3000')"}


def test_folders_of_lines_and_missing_pages(spark, tmp_path):
    (tmp_path / "offset=0").mkdir()
    (tmp_path / "offset=0" / "part-0.json").write_text('{"a": "x"}\n{"a": 2}\n')
    (tmp_path / "offset=0" / "_SUCCESS").write_text("")
    rows = paged.feed(spark, f"file://{tmp_path}/offset={{offset}}", "a string, b string", limit=2, cap=10)
    assert sorted(map(tuple, rows.collect())) == [("2", None), ("x", None)]


def run(spark, feed, folder, fail_at=None, **options):
    """One run of a stream with what is there; a batch can fail after it has been read."""
    failed = []

    def write(batch, number):
        n = batch.persist().count()
        if number == fail_at and not failed:
            failed.append(number)
            raise RuntimeError("broken off")
        if n:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/table/b={number}")  # a batch that runs again replaces itself

    q = paged.stream(spark, feed.url, limit=100, **options).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p.numInputRows for p in q.recentProgress)


def test_a_stream_that_stops_and_breaks_off_holds_each_row_once(spark, feed, tmp_path):
    options = {"batch": 3, "progress": str(tmp_path / "progress")}
    feed.rows = ROWS[:950]
    assert run(spark, feed, tmp_path, **options) == 300
    with pytest.raises(StreamingQueryException):
        run(spark, feed, tmp_path, fail_at=1, **options)
    asked = len(feed.asked)
    while run(spark, feed, tmp_path, **options):
        pass
    assert len(feed.asked) > asked
    feed.rows = ROWS
    while run(spark, feed, tmp_path, **options):
        pass
    table = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(int(r.valorobservado) for r in table.collect()) == list(range(1000))
    assert max(r["count"] for r in table.groupBy("batch").count().collect()) <= 300


def test_pages_of_a_batch_are_tasks_of_their_own(spark, feed, tmp_path):
    stream = paged.PagedStream({"url": feed.url, "limit": "100", "batch": "64"}, paged.StructType.fromDDL("valorobservado string"))
    assert stream.initialOffset() == {"offset": 0} and stream.latestOffset() == {"offset": 1000}
    assert len(feed.asked) <= 8  # bisection, not one request a page
    parts = stream.partitions({"offset": 250}, {"offset": 460})
    assert [(p.first, p.last) for p in parts] == [(250, 300), (300, 400), (400, 460)]
    assert [int(r[0]) for p in parts for r in stream.read(p)] == list(range(250, 460))
    assert stream.partitions({"offset": 460}, {"offset": 460}) == []
    again = paged.PagedStream({"url": feed.url, "limit": "100", "batch": "2"}, paged.StructType.fromDDL("valorobservado string"))
    assert again.latestOffset() == {"offset": 1000}  # started again without knowing where it stands


def test_codes_are_asked_for_once_and_fail_alone(spark, feed, tmp_path):
    from slopewatch.operators.jobs import Folder
    from slopewatch.sources import services

    answers = {"01": {"features": [{"attributes": {"nombre": "One"}, "geometry": {"rings": [[[0, 0], [1, 1], [0, 0]]]}}, {"geometry": {"rings": []}}]}, "50": {"features": []}}

    class Codes(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            code = self.path.rsplit("/", 1)[1]
            feed.asked.append(code)
            if code == "07" and not feed.rows:
                self.send_response(500)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answers.get(code, answers["01"])).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Codes)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/{{code}}"
    feed.rows = []
    codes = spark.createDataFrame([("1", 1), ("1", 2), ("50", 3), ("7", 4), (None, 5)], "c string, n int").select(services.service_code(F.col("c")).alias("code"), "n")
    kept = Folder(spark, str(tmp_path))
    got = {r.n: (r.code, r.nombre) for r in services.resolved(codes, url, kept, "a", attempts=1).collect()}
    assert got == {1: ("01", "One"), 2: ("01", "One"), 3: ("50", None), 4: ("07", None), 5: (None, None)}
    assert "500" in services.asked(codes.filter("n = 4"), url, attempts=1).first().failure
    feed.rows, feed.asked[:] = ["up again"], []
    assert {r.n for r in services.resolved(codes, url, kept, "b", attempts=1).filter("geometry is not null").collect()} == {1, 2, 4}
    assert sorted(set(feed.asked)) == ["07", "50"]
    server.shutdown()
