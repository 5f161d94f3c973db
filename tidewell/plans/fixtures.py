"""The driver's tables seen as readings, audit, panes and graphs, in Spark and in SQL.

Each pair below states one mapping twice: a DataFrame, and the CTE that the oracles use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_HOUR = 2  # readings that make an hour of a series complete, at the density of the events table
DEMAND_ID = 5
AS_OF = "2024-02-01 00:00:00"
#: indicador_id, tecnologia, familia, renovable, min_mw, max_mw, sumable, orden_apilado
TECHNOLOGIES = ((1, "view", "generacion", True, 1.0, 250.0, True, 1), (2, "click", "generacion", False, 0.5, 300.0, True, 2), (3, "purchase", "generacion", None, 0.1, 200.0, True, 3), (4, "signup", "generacion", True, 0.0, 400.0, False, 99), (5, "error", "demanda", False, 0.0, 350.0, True, 99))
TYPE_IDS = {"view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return repr(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows)


def array(items) -> str:
    return "[" + ", ".join(literal(x) for x in items) + "]"


def technologies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TECHNOLOGIES), "indicador_id bigint, tecnologia string, familia string, renovable boolean, min_mw double, max_mw double, sumable boolean, orden_apilado bigint")


TECHNOLOGIES_SQL = f"tec AS (SELECT * FROM (VALUES {values(TECHNOLOGIES)}) t(indicador_id, tecnologia, familia, renovable, min_mw, max_mw, sumable, orden_apilado))"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw readings: ten-minute instants, one zone for most users and none for the rest."""
    ids = F.create_map(*[F.lit(x) for kv in TYPE_IDS.items() for x in kv])
    at = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) * 600)
    zone = F.when(F.col("user_id") % 10 != 0, F.lit(1).cast("long"))
    return table(spark, sf_dir, "events").select(
        ids[F.col("event_type")].cast("long").alias("indicador_id"), at.alias("instante"), F.col("value").alias("valor"), zone.alias("geo_id"),
        F.concat(F.lit("zona-"), zone.cast("string")).alias("geo_nombre"), F.col("ts").cast("timestamp").alias("ingerido_en"))


READINGS_SQL = f"""raw AS (
  SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_IDS.items())} END::BIGINT AS indicador_id,
         make_timestamp((floor(epoch(ts) / 600) * 600)::BIGINT * 1000000) AS instante, value AS valor,
         CASE WHEN user_id % 10 <> 0 THEN 1::BIGINT END AS geo_id, CASE WHEN user_id % 10 <> 0 THEN 'zona-1' END AS geo_nombre, ts AS ingerido_en FROM events)"""
STAGED_SQL = f"""{READINGS_SQL},
stg AS (SELECT indicador_id, instante, valor AS potencia_mw, geo_id, geo_nombre, ingerido_en FROM raw
        QUALIFY row_number() OVER (PARTITION BY indicador_id, instante, geo_id ORDER BY ingerido_en DESC, valor DESC) = 1)"""
HOURLY_SQL = f"""{TECHNOLOGIES_SQL}, {STAGED_SQL},
hor AS (SELECT date_trunc('hour', instante) AS hora, indicador_id, tecnologia, familia, renovable, sumable, orden_apilado, geo_id, geo_nombre,
               avg(potencia_mw) AS potencia_media_mw, min(potencia_mw) AS potencia_min_mw, max(potencia_mw) AS potencia_max_mw,
               sum(potencia_mw * (5.0::DOUBLE / 60.0)) AS energia_mwh, count(*) AS lecturas, count(*) = {PER_HOUR} AS hora_completa, max(ingerido_en) AS ingerido_en
        FROM stg LEFT JOIN tec USING (indicador_id) GROUP BY ALL)"""
MART_SQL = f"""{HOURLY_SQL},
tot AS (SELECT hora, geo_id, geo_nombre, sum(potencia_media_mw) AS potencia_total_mw, sum(energia_mwh) AS energia_total_mwh,
               sum(CASE WHEN renovable THEN potencia_media_mw ELSE 0 END) AS potencia_renovable_mw,
               sum(CASE WHEN NOT renovable THEN potencia_media_mw ELSE 0 END) AS potencia_no_renovable_mw,
               count(DISTINCT indicador_id) AS tecnologias, max(ingerido_en) AS ingerido_en
        FROM hor WHERE hora_completa AND familia = 'generacion' AND sumable GROUP BY ALL),
dem AS (SELECT hora, geo_id, potencia_media_mw AS demanda_mw FROM hor WHERE indicador_id = {DEMAND_ID} AND hora_completa),
esp AS (SELECT count(*) AS tecnologias_esperadas FROM tec WHERE familia = 'generacion' AND sumable),
mart AS (SELECT tot.hora, tot.geo_id, geo_nombre, potencia_total_mw, energia_total_mwh, potencia_renovable_mw, potencia_no_renovable_mw, demanda_mw,
                round(potencia_total_mw / nullif(demanda_mw, 0), 4) AS razon_generacion_demanda, tot.hora = max(tot.hora) OVER () AS es_ultima_hora,
                date_sub('hour', tot.hora, max(tot.hora) OVER ()) AS horas_de_antiguedad, tecnologias, tecnologias_esperadas,
                tecnologias = tecnologias_esperadas AS cobertura_completa,
                CASE WHEN tecnologias = tecnologias_esperadas THEN round(100.0 * potencia_renovable_mw / nullif(potencia_total_mw, 0), 2) END AS porcentaje_renovable, ingerido_en
         FROM tot CROSS JOIN esp LEFT JOIN dem ON tot.hora = dem.hora AND tot.geo_id = dem.geo_id)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the audit of requests."""
    at = F.col("o_orderdate").cast("timestamp")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        at.alias("momento"), (F.col("o_custkey") % 16).alias("indicador_id"), at.alias("ventana_inicio"), (at + F.make_dt_interval(hours=(F.col("o_orderkey") % 200).cast("int"), mins=F.lit(30))).alias("ventana_fin"),
        F.when(status == "F", F.lit(200)).when(status == "P", F.lit(503)).cast("long").alias("codigo"), (F.col("o_orderkey") % 3 + 1).alias("intentos"), (F.col("o_orderkey") % 288).alias("puntos"),
        F.floor("o_totalprice").cast("double").alias("segundos"), F.when(F.col("o_orderkey") % 7 == 0, "HTTP 503").alias("error"))


REQUESTS_SQL = """aud AS (
  SELECT o_orderdate AS momento, o_custkey % 16 AS indicador_id, o_orderdate AS ventana_inicio, o_orderdate + to_hours((o_orderkey % 200)::INT) + to_minutes(30) AS ventana_fin,
         CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'P' THEN 503 END::BIGINT AS codigo, o_orderkey % 3 + 1 AS intentos, o_orderkey % 288 AS puntos,
         floor(o_totalprice) AS segundos, CASE WHEN o_orderkey % 7 = 0 THEN 'HTTP 503' END AS error FROM orders),
req AS (SELECT *, codigo = 200 AND error IS NULL AS exito, intentos - 1 AS reintentos, date_sub('hour', ventana_inicio, ventana_fin) AS horas_pedidas FROM aud)"""

# A lineage graph: (id, tipo, capa, detalle), and edges as each source saw them.
NODES_A = (("w.raw.orders", "fuente", "raw", "orders as they come"), ("w.raw.lines", "fuente", "raw", ""), ("w.stg.orders", "modelo", "staging", ""), ("w.stg.lines", "modelo", "staging", ""), ("w.int.daily", "desconocido", "", ""), ("w.mart.sales", "modelo", "marts", "daily sales"), ("w.mart.quality", "modelo", "marts", ""), ("w.ops.marks", "tabla", "ops", ""))
NODES_B = (("W.INT.daily", "modelo", "intermediate", "a day's lines"), ("w.mart.sales", "vista", "other", "ignored"), ("w.ops.marks", "tabla", "", "marks"), ("w.seed.regions", "semilla", "seeds", ""))
EDGES_A = (("w.raw.orders", "w.stg.orders", "catalogo"), ("w.raw.lines", "w.stg.lines", "catalogo"), ("w.stg.orders", "w.int.daily", "catalogo"), ("w.stg.lines", "w.int.daily", "catalogo"), ("w.int.daily", "w.mart.sales", "catalogo"), ("w.stg.orders", "w.stg.orders", "catalogo"), ("w.raw.orders", "w.mart.quality", "catalogo"))
EDGES_B = (("W.STG.lines", "w.int.daily", "manifiesto"), ("w.seed.regions", "w.int.daily", "manifiesto+sql"), ("w.int.daily", "w.mart.quality", "manifiesto"), ("x.ext.feed", "w.raw.orders", "manifiesto"), ("w.mart.sales", "w.mart.quality", "manifiesto"), ("w.int.daily", "w.mart.sales", "sql"))
CYCLIC = (("a", "b", "sql"), ("a", "c", "sql"), ("b", "a", "sql"), ("c", "b", "sql"), ("c", "d", "sql"), ("d", "e", "sql"), ("f", "f", "sql"), ("e", "g", "sql"), ("g", "h", "sql"), ("h", "g", "sql"))


def node_frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "id string, tipo string, capa string, detalle string")


def edge_frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "origen string, destino string, motivo string")


EDGES_SQL = f"""e0 AS (SELECT lower(origen) AS origen, lower(destino) AS destino, unnest(string_split(motivo, '+')) AS fuente FROM (VALUES {values(EDGES_A + EDGES_B)}) t(origen, destino, motivo)),
edges AS (SELECT origen, destino, list_sort(list(DISTINCT fuente)) AS fuentes FROM e0 WHERE origen <> destino GROUP BY ALL)"""
NODES_SQL = f"""n0 AS (SELECT lower(id) AS id, tipo, nullif(capa, '') AS capa, nullif(detalle, '') AS detalle, s FROM (
  SELECT *, 0 AS s FROM (VALUES {values(NODES_A)}) t(id, tipo, capa, detalle) UNION ALL SELECT *, 1 FROM (VALUES {values(NODES_B)}) t(id, tipo, capa, detalle)
  UNION ALL SELECT DISTINCT unnest([origen, destino]), 'externo', NULL, NULL, 2 FROM edges)),
nodes AS (SELECT id, arg_min(tipo, rk) AS tipo, arg_min(capa, rk) FILTER (capa IS NOT NULL) AS capa, coalesce(arg_min(detalle, rk) FILTER (detalle IS NOT NULL), '') AS detalle
  FROM (SELECT *, (CASE WHEN tipo IN ('desconocido', 'externo') THEN 10 ELSE 0 END) + s AS rk FROM n0) GROUP BY id)"""
JOB_SQL = """jobs AS (
  SELECT o_orderdate AS creation_time, CASE WHEN o_custkey % 4 = 0 THEN 'etl-' || (o_custkey % 3) || '@p.iam.gserviceaccount.com' ELSE 'u' || (o_custkey % 50) || '@example.com' END AS user_email,
         CASE WHEN o_orderkey % 11 = 0 THEN 'LOAD' ELSE 'QUERY' END AS job_type, 'DONE' AS state, CASE WHEN o_orderkey % 13 = 0 THEN 'bad' END AS error_result, o_orderkey % 1000 AS total_bytes_billed,
         o_orderkey FROM orders),
reads AS (SELECT lower('P.d.t' || (l_partkey % 20)) AS tabla, creation_time, user_email, total_bytes_billed FROM jobs JOIN (SELECT DISTINCT l_orderkey, l_partkey % 20 AS l_partkey FROM lineitem) ON o_orderkey = l_orderkey
          WHERE job_type = 'QUERY' AND state = 'DONE' AND error_result IS NULL AND creation_time >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAYS)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their lines as the query history."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("creation_time"),
        F.when(cust % 4 == 0, F.concat(F.lit("etl-"), (cust % 3).cast("string"), F.lit("@p.iam.gserviceaccount.com"))).otherwise(F.concat(F.lit("u"), (cust % 50).cast("string"), F.lit("@example.com"))).alias("user_email"),
        F.when(key % 11 == 0, "LOAD").otherwise("QUERY").alias("job_type"), F.lit("DONE").alias("state"), F.when(key % 13 == 0, "bad").alias("error_result"), (key % 1000).alias("total_bytes_billed"))
    ref = F.struct(F.lit("P").alias("project_id"), F.lit("d").alias("dataset_id"), F.concat(F.lit("t"), (F.col("l_partkey") % 20).cast("string")).alias("table_id"))
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(ref).alias("referenced_tables"))
    return orders.join(refs, orders.o_orderkey == refs.l_orderkey).drop("o_orderkey", "l_orderkey")
