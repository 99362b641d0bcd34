"""Table schemas and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "agent_conversations": "id long NOT NULL, session_id string NOT NULL, role string NOT NULL, content string NOT NULL, created_at timestamp NOT NULL",
    "landslide_events": "id long NOT NULL, source_row_id string, fecha string, tipo_emergencia string, commune_id string, barrio string, latitud double, longitud double, has_coords boolean, ingested_at timestamp NOT NULL",
    "ml_features": "id long NOT NULL, commune_id string NOT NULL, reference_date timestamp, source string, features string, precip_acum_7d double, n_events_window int, created_at timestamp NOT NULL",
    "risk_predictions": "id long NOT NULL, commune_id string NOT NULL, risk_score double NOT NULL, risk_category string NOT NULL, model_version string, explanation string, raw_output string, created_at timestamp NOT NULL",
    "scraping_logs": "id long NOT NULL, source string NOT NULL, status string NOT NULL, run_started_at timestamp, run_finished_at timestamp, records_downloaded int, records_valid int, records_discarded int, detail string, created_at timestamp NOT NULL",
    "events": "source_row_id string, fecha string, tipo_emergencia string, commune_id string, barrio string, latitud double, longitud double, has_coords boolean",
    "precipitation": "fecha string, estacion string, precipitacion_mm double, precipitacion_acum_3d double, precipitacion_acum_7d double, cod_municipio string",
    "communes": "commune_id string NOT NULL, nombre_comuna string, pendiente_promedio double, is_zona_ladera boolean, indice_riesgo double, categoria_riesgo string, indice_parcial boolean, n_eventos long, correlacion_diaria double, correlacion_3d double, correlacion_7d double, geometry string",
    "alerts": "commune_id string, nivel string, precipitacion_valor double, tipo_umbral string, timestamp string",
    "data_quality_log": "fuente string, fecha_ingesta string, registros_descargados long, registros_validos long, registros_descartados long, motivo_descarte string, estado string",
}

# Districts (id, name, hillside).
DISTRICTS = [
    ("1", "Popular", True),
    ("2", "Santa Cruz", True),
    ("3", "Manrique", True),
    ("4", "Aranjuez", False),
    ("5", "Castilla", False),
    ("6", "Doce de Octubre", True),
    ("7", "Robledo", True),
    ("8", "Villa Hermosa", True),
    ("9", "Buenos Aires", True),
    ("10", "La Candelaria", False),
    ("11", "Laureles-Estadio", False),
    ("12", "La América", False),
    ("13", "San Javier", True),
    ("14", "El Poblado", False),
    ("15", "Guayabal", False),
    ("16", "Belén", True),
    ("50", "Palmitas", True),
    ("60", "San Cristóbal", True),
    ("70", "Altavista", True),
    ("80", "San Antonio de Prado", True),
    ("90", "Santa Elena", True),
]

# Rural code to model id.
RURAL_TO_MODEL = {"50": "17", "60": "18", "70": "19", "80": "20", "90": "21"}

# Spellings of district names besides the names and ids themselves.
EXTRA_ALIASES = {"laureles estadio": "11", "poblado": "14", "candelaria": "10"}

# Hazard grade to the slope in degrees that stands for it.
HAZARD_SLOPE = {"ALTA": 25.0, "MEDIA": 18.0, "BAJA": 10.0, "MUY BAJA": 5.0, "MUY_BAJA": 5.0}

# Density layers in order of priority.
DENSITY_LAYERS = [(5, "Alta"), (4, "Media-alta"), (3, "Media-baja"), (2, "Baja")]

def districts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISTRICTS, "commune_id string, nombre_comuna string, is_zona_ladera boolean")


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """A small fixed dimension as an expression: no join, no shuffle."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), default) if default is not None else F.element_at(pairs, key)
