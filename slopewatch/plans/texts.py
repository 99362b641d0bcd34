"""Text, dates and labels in query form."""

from __future__ import annotations

import html as markup

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..session import table
from ..sources import readers
from .registry import query

NAMES = {"the": "1", "of the": "1", "with": "2", "de la": "3", "la": "3", "und": "4", "der": "4", "que": "5"}
ANY = " OR ".join("contains(lower(text), '{}')".format(w) for w in ("shing", "loser", "avec"))


@query("keyword_filter", f"SELECT doc_id, lang FROM documents WHERE {ANY}")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(X.any_of(F.lower("text"), ["shing", "loser", "avec"])).select("doc_id", "lang")


SPELLED = "CASE doc_id % 5 WHEN 0 THEN 'Comuna ' || (doc_id % 30) || ' alta' WHEN 1 THEN 'en el CORREGIMIENTO ' || (50 + 10 * (doc_id % 5)) WHEN 2 THEN 'comuna' || (doc_id % 100) || ',' WHEN 3 THEN source ELSE NULL END"


def spelled():
    n = F.col("doc_id")
    return (
        F.when(n % 5 == 0, F.concat(F.lit("Comuna "), (n % 30).cast("string"), F.lit(" alta"))).when(n % 5 == 1, F.concat(F.lit("en el CORREGIMIENTO "), (50 + 10 * (n % 5)).cast("string")))
        .when(n % 5 == 2, F.concat(F.lit("comuna"), (n % 100).cast("string"), F.lit(","))).when(n % 5 == 3, F.col("source"))
    )


@query(
    "commune_from_text",
    f"""
WITH t AS (SELECT doc_id, {SPELLED} AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(t, '(?i)comuna\\s*(\\d{{1,2}})\\b', 1) <> '' THEN CAST(CAST(regexp_extract(t, '(?i)comuna\\s*(\\d{{1,2}})\\b', 1) AS INTEGER) AS VARCHAR)
  ELSE CASE regexp_extract(t, '(?i)corregimiento\\s*(\\d{{2,3}})\\b', 1) WHEN '50' THEN '17' WHEN '60' THEN '18' WHEN '70' THEN '19' WHEN '80' THEN '20' WHEN '90' THEN '21' END END AS commune_id FROM t
""",
)
def commune_from_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.commune_from_text(spelled()).alias("commune_id"))


@query(
    "commune_from_station",
    f"""
WITH t AS (SELECT doc_id, TRY_CAST(regexp_extract({SPELLED}, '(\\d{{1,2}})', 1) AS INTEGER) AS n FROM documents)
SELECT doc_id, CASE WHEN n BETWEEN 1 AND 16 THEN CAST(n AS VARCHAR) WHEN n = 50 THEN '17' WHEN n = 60 THEN '18' WHEN n = 70 THEN '19' WHEN n = 80 THEN '20' WHEN n = 90 THEN '21' END AS commune_id FROM t
""",
)
def commune_from_station(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.commune_from_station(spelled()).alias("commune_id"))


@query(
    "model_commune",
    "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_size = 50 THEN '17' ELSE CAST(p_size AS VARCHAR) END AS commune_id, lpad(CAST(p_size AS VARCHAR), 2, '0') AS codigo FROM part",
)
def model_commune(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("SN"), F.col("p_size").cast("string"))).otherwise(F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return table(spark, d, "part").select("p_partkey", X.model_commune(code).alias("commune_id"), X.two_digits(F.col("p_size").cast("string")).alias("codigo"))


@query("accent_fold", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


def places_sql(texts: str, key: str, names: dict[str, str]) -> str:
    """SQL for the first place of each id of ``names`` in the folded texts ``t`` of ``texts``."""
    values = ", ".join(f"('{a}', '{i}')" for a, i in names.items())
    return f"""
a(alias, id) AS (VALUES {values}), t AS ({texts}),
m AS (SELECT {key}, id, t, '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)' AS p FROM t, a WHERE contains(t, alias) AND regexp_matches(t, '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)')),
f AS (SELECT {key}, id, CAST(min(strpos(t, regexp_extract(t, p)) + length(regexp_extract(t, p, 1))) AS BIGINT) AS position FROM m GROUP BY 1, 2)"""


@query("alias_match", f"WITH {places_sql('SELECT doc_id, strip_accents(lower(text)) AS t FROM documents', 'doc_id', NAMES)} SELECT doc_id, id, position FROM f")
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    """Several spellings of an id count once, where the first of them stands."""
    found = table(spark, d, "documents").select("doc_id", F.explode(X.mentions(F.col("text"), NAMES)).alias("m"))
    return found.select("doc_id", "m.id", "m.position")


SPELLINGS = ["El Poblado", "poblado", "LAURELES-ESTADIO", "laureles estadio", "Candelaria", "San  Javier", "san cristóbal", "Doce de Octubre", "belén", "comuna 14", "60", "la américa"]
QUESTION = f"""
SELECT c_custkey, strip_accents(lower('Deslizamiento en ' || s[c_custkey % 12 + 1] || ' y ' || s[c_custkey // 3 % 12 + 1] || ', ' || s[c_custkey // 5 % 12 + 1] || CASE c_custkey % 3 WHEN 0 THEN 's' ELSE '?' END)) AS t
FROM customer, (SELECT [{", ".join(f"'{x}'" for x in SPELLINGS)}] AS s)"""


@query("alias_districts", f"WITH {places_sql(QUESTION, 'c_custkey', X.aliases())} SELECT c_custkey, coalesce(string_agg(id, ',' ORDER BY position), '') AS ids FROM customer LEFT JOIN f USING (c_custkey) GROUP BY 1")
def alias_districts(spark: SparkSession, d: str) -> DataFrame:
    """The districts that a question names, by all their names, ids and other spellings, in order."""
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in SPELLINGS])
    one, two, three = (F.get(names, (n % 12).cast("int")) for n in (k, F.floor(k / 3), F.floor(k / 5)))
    text = F.concat(F.lit("Deslizamiento en "), one, F.lit(" y "), two, F.lit(", "), three, F.when(k % 3 == 0, "s").otherwise("?"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(X.mentions(text, X.aliases()), lambda m: m["id"]), ",").alias("ids"))


@query(
    "alias_resolve",
    """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN '12' WHEN 2 THEN '14' END AS id
FROM nation
""",
)
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "La América ").when(k % 4 == 2, "POBLADO").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", X.resolve_alias(text).alias("id"))


STRIP = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _name, _sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
    STRIP = f"regexp_replace({STRIP}, '&{_name};?', '{_sign}', 'g')"


@query("html_strip", f"SELECT page_id, md5(trim(regexp_replace({STRIP}, '\\s+', ' ', 'g'))) AS text FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_html(F.col("html"))).alias("text"))


#: Every name of HTML 4, decimal and hexadecimal numbers, and texts that only look like references.
REFERENCES = [f"&{n};" for n in sorted(markup.entities.name2codepoint)] + ["&#233;", "&#xE9;", "&#X1F600;", "&#128;", "&#0;", "&#x110000;", "&#55296;", "&eacute", "&copy2024", "&ampquot;", "&nosuch;", "&", "&;", "&#;", "& x", "&notit;", "&amp;lt;", "&#39x"]
READ = ", ".join("'" + markup.unescape(x).replace("'", "''") + "'" for x in REFERENCES)


@query("html_references", f"SELECT p_partkey, 'Pág. ' || r[p_partkey % {len(REFERENCES)} + 1] || ' y ' || r[p_partkey // 7 % {len(REFERENCES)} + 1] || '.' AS text FROM part, (SELECT [{READ}] AS r)")
def html_references(spark: SparkSession, d: str) -> DataFrame:
    """Character references of all kinds in texts; the expected signs are the standard library's."""
    k = F.col("p_partkey")
    known = F.array(*[F.lit(x) for x in REFERENCES])
    one, other = (F.get(known, (n % len(REFERENCES)).cast("int")) for n in (k, F.floor(k / 7)))
    return table(spark, d, "part").select("p_partkey", X.unescape(F.concat(F.lit("Pág. "), one, F.lit(" y "), other, F.lit("."))).alias("text"))


@query("link_count", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) AS INTEGER) AS links FROM pages")
def link_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.count_links(F.col("html")).alias("links"))


@query(
    "alert_blocks",
    """
WITH p AS (SELECT page_id, replace(replace(html, 'tion', 'alerta'), 'shing', 'Emergencia') AS h FROM pages),
b AS (SELECT page_id, list_transform(list_filter(regexp_extract_all(h, '>([^<>]+)<', 1), lambda x: regexp_matches(x, '(?i)alerta|emergencia|desliz')), lambda x: left(trim(x), 500)) AS b FROM p)
SELECT page_id, CAST(len(b) AS INTEGER) AS blocks, md5(array_to_string(b, '|')) AS said FROM b
""",
)
def alert_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text nodes of portal pages that speak of an alert."""
    html = F.replace(F.replace("html", F.lit("tion"), F.lit("alerta")), F.lit("shing"), F.lit("Emergencia"))
    return table(spark, d, "pages").withColumn("b", readers.alert_blocks(html)).select("page_id", F.size("b").alias("blocks"), F.md5(F.array_join("b", "|")).alias("said"))


@query("date_parse_matrix", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 6 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS fecha FROM orders")
def date_parse_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in six shapes, junk and blanks, read back."""
    k = F.col("o_orderkey") % 8
    text = None
    for i, shape in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")):
        one = F.date_format("o_orderdate", shape)
        text = F.when(k == i, one) if text is None else text.when(k == i, one)
    return table(spark, d, "orders").select("o_orderkey", D.any_date(text.when(k == 6, "mañana").otherwise(" ")).cast("string").alias("fecha"))


@query("local_offset", "SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS utc FROM events")
def local_offset(spark: SparkSession, d: str) -> DataFrame:
    """The wall clock of a text with the local offset, read as UTC."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return table(spark, d, "events").select("event_id", F.date_format(D.local_as_utc(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(
    "text_templates",
    """
SELECT c_custkey, 'src:cliente:' || c_custkey AS row_id, CASE WHEN c_custkey % 5 = 0 THEN 'sin titulo' ELSE left(c_name, 12) END AS titulo, upper(left(c_mktsegment,
  1)) || lower(substr(c_mktsegment, 2)) || ': ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ' mm' AS texto
FROM customer
""",
)
def text_templates(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_name"))
    line = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(": "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" mm"))
    return table(spark, d, "customer").select("c_custkey", X.row_id("src", "cliente", F.col("c_custkey")).alias("row_id"), X.title(name, 12).alias("titulo"), line.alias("texto"))


SAID = "strip_accents(lower(text || CASE WHEN turn % 3 = 0 THEN ' No tengo información ESPECÍFICA.' ELSE '' END))"


@query("refusal_flag", f"SELECT conv_id, turn, {' OR '.join(f"contains({SAID}, '{w}')" for w in X.REFUSALS)} AS refuses FROM conversations")
def refusal_flag(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" No tengo información ESPECÍFICA."))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.refuses(said).alias("refuses"))


AGE = "date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') // 60"


@query(
    "age_label",
    f"WITH a AS (SELECT event_id, {AGE} AS m FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)) SELECT event_id, CASE WHEN m < 60 THEN greatest(1, m) || ' minute' || CASE WHEN greatest(1, m) = 1 THEN '' ELSE 's' END "
    "WHEN m < 1440 THEN m // 60 || ' hour' || CASE WHEN m // 60 = 1 THEN '' ELSE 's' END ELSE m // 1440 || ' day' || CASE WHEN m // 1440 = 1 THEN '' ELSE 's' END END AS age FROM a",
)
def age_label(spark: SparkSession, d: str) -> DataFrame:
    then = F.date_trunc("SECOND", "ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", D.age_label(then, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


@query("date_label", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m') AS label FROM orders")
def date_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM").alias("label"))


@query(
    "article_date",
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) ELSE '2001-08-02' END AS fecha
FROM orders
""",
)
def article_date(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    gmt = F.when(k == 0, F.concat(day.cast("string"), F.lit("T10:00:00"))).when(k == 2, "no date").otherwise("")
    local = F.when(k.isin(0, 1), F.concat(F.date_add(day, 1).cast("string"), F.lit("T05:00:00")))
    return table(spark, d, "orders").select("o_orderkey", D.article_date(gmt, local, F.lit("2001-08-02").cast("date")).cast("string").alias("fecha"))
