"""Readers, generators, the paged source, streams and models on small files."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from slopewatch.sources import paged, readers, samples
from slopewatch.streaming import ingest


def test_emergencies(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("TIPO,FECHA,COMUNA,LAT,longitud\nDeslizamiento,03/02/2024,8,6.1,-75.5\nIncendio,03/02/2024,8,6.1,-75.5\nMOVIMIENTO en masa,junk,9,x,-75\n,2024-01-01,1,1,1\n", encoding="utf-8")
    rows = readers.emergencies(readers.csv(spark, str(path))).orderBy("commune_id").collect()
    assert [(r.fecha, r.tipo_emergencia, r.commune_id, r.has_coords) for r in rows] == [("2024-02-03", "deslizamiento", "8", True), (None, "movimiento en masa", "9", False)]
    with pytest.raises(ValueError):
        readers.emergencies(spark.createDataFrame([("a",)], "other string"))


def test_rainfall(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(" Fecha ,Station,Valor\n2024-01-01,A,1\n2024-01-02,A,2\n2024-02-01,A,4\n2024-02-02,A,-1\n2024-02-03,A,x\n2024-02-04,A,8\n", encoding="utf-8")
    rows = readers.rainfall(readers.csv(spark, str(path))).orderBy("fecha").collect()
    assert [(r.precipitacion_acum_3d, r.precipitacion_acum_7d) for r in rows] == [(1, 1), (3, 3), (7, 7), (14, 15)]
    assert rows[0].cod_municipio == "05001"


def test_polygons(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    features = [{"properties": {"CODIGO": "1", "GRADO_AMEN": "ALTA"}, "geometry": square}, {"properties": {"ID": "2", "slope": "14,99"}, "geometry": square}, {"properties": {}, "geometry": square}, {"properties": {"ID": "3"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("d.geojson", json.dumps({"type": "FeatureCollection", "features": features}))
    path = readers.unzip_geojson(str(archive), str(tmp_path))
    rows = readers.polygons(spark, path).orderBy("commune_id").collect()
    assert [(r.commune_id, r.pendiente_promedio, r.is_zona_ladera) for r in rows] == [("1", 25.0, True), ("2", 14.99, False)]


def test_stations_and_articles(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"estaciones": [{"codigo": 7, "valor": -900, "latitud": "6.1"}, {"codigo": "8", "valor": "-899.9", "latitud": 6.2}]}))
    assert [(r.codigo, r.valor) for r in readers.station_snapshot(spark, str(tmp_path / "s.json")).collect()] == [("8", -899.9)]
    (tmp_path / "7.txt").write_text("A\t2024-01-01 00:00:00\t1.5\textra\nbad\nA\tjunk\t1\nA\t2024-01-01 00:05:00\t-999\n")
    assert readers.station_history(spark, str(tmp_path / "7.txt")).count() == 1
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "date": "x", "title": {"rendered": "T"}, "content": {"rendered": "<p>c</p>"}}]))
    assert readers.articles(spark, str(tmp_path / "a.json")).first().title == "T"
    (tmp_path / "q.json").write_text(json.dumps({"features": [{"attributes": {"codigo": "01"}, "geometry": {"rings": [[[0, 0], [1, 1]]]}}]}))
    assert json.loads(readers.ring_query(spark, str(tmp_path / "q.json")).first().geometry)["type"] == "Polygon"
    html = spark.createDataFrame([("<p>Alerta roja</p><p>nada</p>",)], "h string")
    assert html.select(readers.alert_blocks(F.col("h")).alias("b")).first().b == ["Alerta roja"]


def test_fallback_and_retry(spark):
    def broken():
        raise OSError("gone")

    assert readers.with_fallback(broken, lambda: spark.range(0), lambda: spark.range(3)).count() == 3
    pauses, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert readers.retried(flaky, sleep=pauses.append) == "ok" and pauses == [1.0, 2.0]
    with pytest.raises(OSError):
        readers.retried(broken, sleep=pauses.append)


def test_remote_first(spark, tmp_path):
    (tmp_path / "local.csv").write_text("a,b\n1,2\n")
    told, landing = [], str(tmp_path / "landing" / "x.csv")
    long = b"a,b\n" + b"3,4\n" * 40

    def broken():
        raise OSError("gone")

    def from_(download):
        return readers.remote_first(spark, download, landing, str(tmp_path / "local.csv"), lambda: spark.range(7), log=lambda i, why: told.append((i, why)), sleep=lambda s: None)

    assert from_(lambda: long).count() == 40 and not told
    assert from_(lambda: b"a,b\n3,4\n").count() == 1 and from_(broken).count() == 1 and from_(lambda: b"only_a_header" * 20).count() == 1
    assert [i for i, _ in told] == [0, 0, 0] and told[1][1] == "gone" and told[2][1] == "no rows"
    (tmp_path / "local.csv").unlink()
    assert from_(broken).count() == 7


def test_paged_feed_is_asked_again(spark, monkeypatch):
    import urllib.error
    import urllib.request

    asked, pauses = [], []

    def answer(url, timeout):
        asked.append(url)
        if "page=2" in url:
            raise urllib.error.HTTPError(url, 400, "no such page", None, None)
        if len(asked) < 3:
            raise OSError("busy")
        import io

        return io.StringIO('[{"day": "2024-01-01"}, {"day": "2024-02-01"}]')

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    monkeypatch.setattr("time.sleep", pauses.append)
    from pyspark.sql.types import StructType

    settings = paged._Settings({"url": "http://x.org/?page={page}&from={since}&n={limit}", "limit": "2", "since": "2024-01-15", "since_column": "day"}, StructType.fromDDL("day string"))
    assert settings.page(0) == ([("2024-02-01",)], 2) and asked[-1] == "http://x.org/?page=1&from=2024-01-15&n=2" and pauses == [1.0, 2.0]
    assert settings.page(2) == ([], 0)


def test_samples(spark):
    assert samples.emergencies(spark).count() == 800
    rain = samples.rainfall(spark, days=60)
    assert rain.count() == 300 and rain.filter("precipitacion_acum_7d < precipitacion_acum_3d - 0.02").count() == 0
    assert sorted(map(tuple, samples.emergencies(spark, 5).collect())) == sorted(map(tuple, samples.emergencies(spark, 5).collect()))
    assert samples.districts(spark).filter("is_zona_ladera").count() == 12


def test_paged_source(spark, tmp_path):
    for offset in (0, 3, 6):
        n = 3 if offset < 6 else 1
        (tmp_path / f"{offset}.json").write_text(json.dumps([{"codigoestacion": str(offset + i), "valorobservado": i} for i in range(n)]))
    spark.dataSource.register(paged.PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("paged_json").option("url", f"{tmp_path}/{{offset}}.json").option("limit", 3).option("cap", 30)
    rows = reader.load()
    assert rows.count() == 7 and rows.filter("valorobservado = '2'").count() == 2
    assert reader.option("stride", 4).load().count() == 7


def test_stream_replay_inserts_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 10:00:00", 2.0), ("b", "2024-01-05 00:00:00", 4.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    rows.coalesce(1).write.parquet(source)  # one file: with several, which rows are late would depend on their order
    stream = ingest.read_folder(spark, source, "k string, t timestamp, v double")
    for n in range(2):
        q = ingest.start(ingest.daily(stream, "k", "t", "v"), f"daily{n}", str(tmp_path / f"c{n}"), ingest.insert_if_absent(target, ["k", "day"]))
        q.awaitTermination()
        assert ingest.run_log(q)["status"] == "ok"
    assert [(r.k, r.total, r.records) for r in spark.read.parquet(target).collect()] == [("a", 3.0, 2)]
    minute = ingest.snapshots(stream, "k", "t", "v")
    ingest.start(minute, "minute", str(tmp_path / "c3"), ingest.insert_if_absent(str(tmp_path / "m"), ["k", "minute"])).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_training(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from slopewatch.ml import training as T

    rows = spark.range(200).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("label"), ((F.col("id") % 4 == 0).cast("double") * 2 + F.rand(3)).alias("f0"), F.rand(4).alias("f1"))
    best, found, model = T.choose(rows, ["f0", "f1"], "id", ["logistic"], k=2)
    assert best == "logistic" and found["logistic"] > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = T.scored(PipelineModel.load(str(tmp_path / "m")), rows)
    assert T.report(again).filter("threshold = 0.5").first().auc > 0.9
    assert T.choose(rows.filter("label = 0"), ["f0"], "id")[2] is None
    assert T.scored(None, rows).first().risk_score == 0.5
    latest = spark.createDataFrame([("1", 2.0, 0.5)], "commune_id string, f0 double, f1 double")
    assert T.predictions(spark, model, latest, ["f0", "f1"], "v1", F.current_timestamp()).count() == 21


def test_small_tables_leave_one_out(spark):
    from slopewatch.ml import training as T

    rows = spark.range(24).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"), ((F.col("id") % 3 == 0).cast("double") + F.col("id") / 100).alias("f0"))
    ready, k, pooled = T.split(T.weighted(rows), "id")
    assert (k, pooled) == (24, True) and ready.select("fold").distinct().count() == 24
    best, found, model = T.choose(rows, ["f0"], "id", ["logistic"])
    assert best == "logistic" and found["logistic"] > 0.9 and model is not None
    many = rows.unionByName(spark.range(100, 200).select("id", F.lit(0).alias("label"), F.lit(0.0).alias("f0")))
    assert T.split(many.filter("label = 0 or id < 9"), "id")[1:] == (5, True) and T.split(many, "id")[1:] == (5, False)
    two = spark.createDataFrame([(0, 1)], "future int, past int")
    assert T.labelled(two, "future", "past")[1] == "past_7d_fallback" and T.labelled(two, "past", "future")[1] == "future_7d"
