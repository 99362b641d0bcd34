"""Answers of a polygon service, asked by code and kept as a dimension."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import Folder, Job
from ..schemas import RURAL_TO_MODEL

ANSWER = "code string, nombre string, geometry string, failure string"


def service_code(code: Column) -> Column:
    """The code as the service has it: two digits, codes of rural districts as they are."""
    return F.when(code.isin(*RURAL_TO_MODEL), code).otherwise(F.lpad(code, 2, "0"))


def _ask(url: str, at_once: int, attempts: int):
    def one(code: str) -> tuple:
        from .paged import fetch

        try:
            answer = fetch(url.format(code=code), attempts)
            answer = answer[0] if isinstance(answer, list) and answer else answer
            features = (answer or {}).get("features") or []
            rings = (features[0].get("geometry") or {}).get("rings") if features else None
            name = (features[0].get("attributes") or {}).get("nombre") if features else None
            return code, name, json.dumps({"type": "Polygon", "coordinates": rings}) if rings else None, None
        except Exception as e:  # one code's failure is no other's
            return code, None, None, str(e)[:500]

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.column("code").to_pylist()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["code", "nombre", "geometry", "failure"])

    return run


def asked(codes: DataFrame, url: str, at_once: int = 8, attempts: int = 3) -> DataFrame:
    """(code, nombre, geometry, failure): the first polygon of the service's answer for each distinct ``code``, as GeoJSON; no
    geometry where there is none.  Requests are made by the executors, ``at_once`` of a task beside each other; a code whose
    requests fail says why."""
    return codes.select("code").filter("code is not null").distinct().mapInArrow(_ask(url, at_once, attempts), ANSWER)


def resolved(codes: DataFrame, url: str, kept: Folder, job: str, **options) -> DataFrame:
    """Rows of ``codes`` (code and others) with nombre and geometry, from the dimension in ``kept``.

    Only codes that the dimension lacks are asked for, and those that have a polygon are added to it, in one commit by the name
    of ``job``; a code that failed or has none is asked again next time.
    """
    known = kept.read("polygons")
    missing = codes.select("code").distinct() if known is None else codes.select("code").distinct().join(known, "code", "left_anti")
    with Job(kept, job) as j:
        if not j.done and not missing.isEmpty():
            j.upsert("polygons", asked(missing, url, **options).filter("geometry is not null").drop("failure"), ["code"], 1)
    known = kept.read("polygons")
    if known is None:
        return codes.withColumns({"nombre": F.lit(None).cast("string"), "geometry": F.lit(None).cast("string")})
    return codes.join(known, "code", "left")
