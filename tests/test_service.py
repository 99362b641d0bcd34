"""The batch job and the questions on small domain tables."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import writes
from slopewatch.plans import etl, service
from slopewatch.schemas import SCHEMAS, districts

T = datetime.datetime


def rows(spark, name, data):
    columns = [c.strip().split(" ")[0] for c in SCHEMAS[name].split(",")]
    full = [tuple(r.get(c) for c in columns) for r in data]
    return spark.createDataFrame(full, SCHEMAS[name].replace(" NOT NULL", ""))


@pytest.fixture(scope="module")
def tables(spark):
    p = [("1", 0.9, "Crítico", T(2024, 1, 30)), ("1", 0.2, "bajo", T(2024, 1, 10)), ("2", 0.7, "Alto", T(2024, 1, 20)), ("2", 0.6, "ALTO", T(2024, 1, 20)), ("17", 0.5, "medio", T(2024, 1, 18))]
    predictions = rows(spark, "risk_predictions", [{"id": i, "commune_id": c, "risk_score": s, "risk_category": k, "created_at": t} for i, (c, s, k, t) in enumerate(p)])
    e = [("1", "2024-01-30"), ("1", "29/01/2024"), ("1", "junk"), ("2", "2023-01-01"), (None, None)]
    events = rows(spark, "landslide_events", [{"id": i, "commune_id": c, "fecha": d, "ingested_at": T(2024, 1, i + 1)} for i, (c, d) in enumerate(e)])
    f = [("1", T(2024, 1, 30), 3.0, None), ("1", T(2024, 1, 30, 5), 4.0, 2.0), ("1", T(2024, 1, 5), 10.0, None), ("2", None, 1.0, 1.0)]
    features = rows(spark, "ml_features", [{"id": i, "commune_id": c, "reference_date": t, "features": json.dumps({"precip_sum_mm_day": v}), "precip_acum_7d": a, "created_at": T(2024, 1, 1)} for i, (c, t, v, a) in enumerate(f)])
    return predictions, events, features


def test_questions(spark, tables):
    predictions, events, features = tables
    today = F.lit("2024-01-30").cast("date")
    assert [r.id for r in service.latest_predictions(predictions, 2).collect()] == [0, 3]
    polygons = spark.createDataFrame([("1", '{"type":"Polygon","coordinates":[[[0,0],[1,1]]]}')], "commune_id string, geometry string")
    found = {r.commune_id: r for r in service.district_map(districts(spark), predictions, polygons, events).collect()}
    assert len(found) == 21 and (found["1"].risk_score, found["1"].n_eventos) == (0.9, 3) and found["5"].risk_category == service.UNKNOWN
    shape = json.loads(service.district_geojson(service.district_map(districts(spark), predictions, polygons, events)).first().geojson)
    assert shape["features"][0]["properties"]["commune_id"] == "1"
    detail = service.district_detail(predictions, features, events, "1", today)
    assert tuple(detail["rain"].first()) == (4.0, 14.0) and detail["prediction"].first().risk_score == 0.9 and detail["events"].count() == 3
    past = service.history(features, events, predictions, "1", today).collect()
    assert len(past) == 30 and (past[-1].lluvia, past[-1].eventos, past[-1].risk_category) == (1.0, 1, "Crítico") and past[0].risk_category == service.UNKNOWN
    stats = service.statistics(predictions, events, today).first()
    assert (stats.criticas, stats.altas, stats.eventos_30d, stats.tendencia) == (1, 2, 2, "subió")
    assert service.alerts(predictions, districts(spark)).count() == 2 and service.alerts(predictions, districts(spark), folded=True).count() == 3
    assert [r.commune_id for r in service.compare(["2", "x", "2", "5", "1"], predictions, districts(spark)).collect()] == ["2", "5", "1"]
    assert [r.commune_id for r in service.top_event_districts(events, 1).collect()] == ["1"]
    assert service.historical_events(events, "1", F.lit("2024-01-03").cast("timestamp"), 1).count() == 2
    assert service.filtered_events(events, "1", "2024-01-01", "").count() == 3 - 1 + (1 if "29/01/2024" >= "2024-01-01" else 0)


def test_turns_and_feeds(spark):
    turns = rows(spark, "agent_conversations", [{"id": i, "session_id": "s" if i < 5 else "t", "role": "user", "content": str(i), "created_at": T(2024, 1, 1, i)} for i in range(8)])
    assert [r.content for r in service.conversation(turns, "s", 2).collect()] == ["3", "4"]
    assert [r.content for r in service.conversation(turns, "s", 2, newest=False).collect()] == ["0", "1"]
    logs = rows(spark, "scraping_logs", [{"id": i, "source": "a" if i else "old", "status": "ok", "records_valid": None if i % 2 else 1, "created_at": T(2024, 1, 1, 0, i % 60, i // 60)} for i in range(210)])
    status = service.feed_status(logs, 200).collect()
    assert [r.source for r in status] == ["a"] and status[0].runs == 210 and status[0].total_records_valid == 105


def test_batch_job(spark, tmp_path):
    day = [f"2024-01-{n:02d}" for n in range(1, 13)]
    events = rows(spark, "events", [{"commune_id": "1", "fecha": d} for i, d in enumerate(day) for _ in range(i + 1)] + [{"commune_id": "2", "fecha": day[0]}, {"commune_id": "zz", "fecha": day[0]}])
    rain = rows(spark, "precipitation", [{"fecha": d, "estacion": "Popular alto", "precipitacion_mm": float(5 * i), "precipitacion_acum_3d": 100.01 if i == 11 else 1.0, "precipitacion_acum_7d": 1.0} for i, d in enumerate(day)])
    polygons = spark.createDataFrame([("1", 20.0, True, "g"), ("2", None, False, "g"), ("60", 10.0, False, "g"), ("60", 10.0, False, "g")], "commune_id string, pendiente_promedio double, is_zona_ladera boolean, geometry string")
    tables = etl.run(spark, events, rain, polygons, districts(spark), str(tmp_path), F.lit("2024-01-12"), "first")
    etl_rows = {r.commune_id: r for r in tables.read("communes").collect()}
    assert set(etl_rows) == {"1", "2", "60"} and etl_rows["1"].indice_riesgo == 0.8 and etl_rows["2"].indice_parcial
    assert etl_rows["1"].correlacion_diaria == 1.0 and etl_rows["1"].correlacion_7d is None and etl_rows["2"].correlacion_diaria is None
    alerts = tables.read("alerts").collect()
    assert sorted((r.commune_id, r.nivel, r.precipitacion_valor) for r in alerts) == [("1", "Naranja", 55.0), ("1", "Rojo", 100.01)]
    for job in ("second", "second"):  # a job that is started again changes nothing
        tables = etl.run(spark, events, rain, polygons, districts(spark), str(tmp_path), F.lit("2024-01-13"), job)
        assert tables.read("communes").count() == 3 and tables.read("events").count() == 2 * events.count()


def test_small_writes(spark, tmp_path):
    log = writes.run_row(spark, "rain", "ok", {"downloaded": 3, "valid": 2, "discarded": 1}, T(2024, 1, 1), T(2024, 1, 1, 1))
    writes.append(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().records_valid == 2
    writes.chunked(spark.range(10).coalesce(1), str(tmp_path / "c"), 4)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
    writes.json_lines(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writes.covers(log, ["source"]) and not writes.covers(log, ["x"])


def test_rewrite_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    state = lambda n: spark.createDataFrame([(1, n)], "k int, v int")
    read = lambda: [tuple(r) for r in spark.read.parquet(path).collect()]
    writes.rewrite(spark, state(1), path, ["k"])
    state(2).write.parquet(path + ".new")  # ended after writing: the old state is in place
    writes.recover(spark, path)
    assert read() == [(1, 1)] and not (tmp_path / "t.new").exists()
    state(3).write.parquet(path + ".new")
    (tmp_path / "t").rename(tmp_path / "t.old")  # ended between the moves: the new one is complete
    writes.recover(spark, path)
    assert read() == [(1, 3)] and not (tmp_path / "t.old").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")
    (tmp_path / "t.new").mkdir()  # not complete
    writes.recover(spark, path)
    assert read() == [(1, 3)]
    writes.rewrite(spark, state(4), path, ["k"])
    assert read() == [(1, 4)] and {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"t"}


def test_conformed(spark):
    rows = writes.conformed(spark.createDataFrame([("2024-01-01", "3.5")], "fecha string, latitud string"), "events")
    assert rows.first().latitud == 3.5 and rows.columns[0] == "source_row_id" and rows.first().barrio is None
    with pytest.raises(ValueError):
        writes.conformed(rows, "agent_conversations")
